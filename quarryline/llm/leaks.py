"""Passages of evaluation items in documents, whole or in part.

Every window of an item is cut into error-budget-plus-one pieces, one of which stands unchanged in any passage within
the budget. Exact hits of pieces in a document are verified with Myers' bit-parallel edit distance over words.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.looks import caseless_look

#: Items handled at a time; more are searched for in further passes over the documents, so that what every task holds is bounded.
BLOCK = 5_000
RADIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Words as unbroken runs of letters and digits, in one character per look and case."""
    tools = sys.__dict__.setdefault("_quarryline_words", {})
    if not tools:
        tools["ascii"] = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
        tools["gaps"] = re.compile(r"[\W_]+")
    plain = caseless_look(text)
    return plain.translate(tools["ascii"]).split() if plain.isascii() else tools["gaps"].sub(" ", plain).split()


def myers(pattern: list[int], text: list[int], most: int) -> int:
    """Least number of word edits between the pattern and any part of the text; most + 1 if it's more than most.

    One step per word of the text on bit vectors of the pattern's length (Myers 1999).
    """
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, m
    for w in text:
        eq = masks.get(w, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp) & full, vp & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1, hn << 1
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0 & full
        best = min(best, score)
        if not best:
            break
    return best if best <= most else most + 1


class ItemIndex:
    """Pieces of all items' windows by hash, with the items' words as numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int, errors: int):
        self.window, self.errors, self.piece = window, errors, window // (errors + 1)
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[str, list[int]]] = []
        places: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text or "")]
            if len(ids) < window:
                continue
            self.items.append((item_id, ids))
            hashes = self.hashes(np.array(ids, dtype=np.int64))
            for at, h in enumerate(hashes.tolist()):
                places.setdefault(h, []).append((len(self.items) - 1, at))
        self.places = places
        self.known = np.array(sorted(places), dtype=np.uint64)

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of every run of piece-many words."""
        n = len(ids) - self.piece + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.zeros(n, dtype=np.uint64)
        for i in range(self.piece):
            total = total * RADIX + values[i : i + n]
        return total ^ (total >> np.uint64(31))

    def search(self, texts: list[str]) -> list[tuple[int, str, int]]:
        """(number of the text, item_id, least edits) for every text and item within the budget."""
        get, ids, starts = self.vocabulary.get, [], []
        for text in texts:
            starts.append(len(ids))
            ids += [get(w, -1) for w in words_of(text)]
            ids.append(-1)  # no run crosses it
        if not self.items or not ids:
            return []
        every = np.fromiter(ids, dtype=np.int64, count=len(ids))
        n = len(every) - self.piece + 1
        if n <= 0:
            return []
        # only runs of words that all occur in items
        unknown = np.concatenate([[0], np.cumsum(every < 0)])
        whole = np.flatnonzero(unknown[self.piece :] == unknown[:n])
        hashes = self.hashes(every)[whole]
        spot = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = self.known[spot] == hashes
        if not hit.any():
            return []
        bounds = np.array([*starts, len(ids)])
        owner = np.searchsorted(bounds, whole[hit], side="right") - 1
        best: dict[tuple[int, int], int] = {}
        tried: set[tuple[int, int, int]] = set()  # item, begin of the window, where it would begin in the texts
        for p, h, doc in zip(whole[hit].tolist(), hashes[hit].tolist(), owner.tolist()):
            for item, q in self.places[h]:
                if best.get((doc, item)) == 0:
                    continue
                self._verify(ids, bounds, p, q, doc, item, best, tried)
        return [(doc, self.items[item][0], d) for (doc, item), d in best.items()]

    def _verify(self, ids, bounds, p: int, q: int, doc: int, item: int, best: dict, tried: set) -> None:
        own = self.items[item][1]
        for begin in range(q, q - self.window, -self.piece):  # windows of which the run is a piece
            if begin < 0 or begin + self.window > len(own) or (item, begin, p - q) in tried:
                continue
            tried.add((item, begin, p - q))
            low = max(int(bounds[doc]), p - (q - begin) - self.errors)
            high = min(int(bounds[doc + 1]) - 1, p - (q - begin) + self.window + self.errors)
            d = myers(own[begin : begin + self.window], ids[low:high], self.errors)
            if d <= self.errors:
                best[doc, item] = min(d, best.get((doc, item), self.errors + 1))


def find_leaks(documents: DataFrame, items: DataFrame, window: int = 12, errors: int = 1) -> DataFrame:
    """(doc_id, item_id, edits): documents with a passage that is within ``errors`` word edits of ``window`` words of an item.

    edits 0 means that a run of at least window words stands in both. Items of fewer words than the window, NULL and
    empty texts match nothing. Items are the stated query set: they're searched for in blocks of at most BLOCK, each
    against all documents. Documents are searched whole. Repeated rows give one row.
    """
    rows = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    count = rows.count()
    blocks = max(1, -(-count // (BLOCK // 2)))  # half, as hashing doesn't fill blocks evenly
    found = None
    for i in range(blocks):
        own = [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()]
        sent = documents.sparkSession.sparkContext.broadcast(own)
        name = uuid.uuid4().hex  # an index that a worker still holds from another search must not be taken for this one

        def search(batches: Iterator[pd.DataFrame], sent=sent, name=name) -> Iterator[pd.DataFrame]:
            cache = sys.__dict__.setdefault("_quarryline_items", {})
            if name not in cache:
                cache.clear()
                cache[name] = ItemIndex(sent.value, window, errors)
            index = cache[name]
            for pdf in batches:
                ids, texts, out = pdf["doc_id"].tolist(), pdf["text"].tolist(), []
                begin, size = 0, 0
                for i, text in enumerate(texts):
                    size += len(text)
                    if size > 2_000_000 or i + 1 == len(texts):
                        out += [(ids[begin + d], item, e) for d, item, e in index.search(texts[begin : i + 1])]
                        begin, size = i + 1, 0
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "edits"])

        part = documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text").mapInPandas(search, "doc_id bigint, item_id string, edits int")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
