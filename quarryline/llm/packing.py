"""Documents placed into containers of one token capacity.

Documents are routed to tiers of several context sizes by length. Within a shard of bounded size each tier, the longest
first, fills the gaps in the windows of longer tiers and packs what is left into windows of its own context size; the
windows of all tiers are then packed into containers, which are dealt to step groups of equal work.
"""

from __future__ import annotations

import base64
import bisect
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.workspace import materialize, workspace

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenization of the public byte-level vocabulary; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Context sizes as parts of the capacity, longest first; a piece belongs to the shortest that holds it.
CONTEXTS = (1.0, 0.5, 0.25)
#: Containers in a shard on average; enough that shards lose next to nothing, few enough for one task.
SHARD_CONTAINERS = 4_000
#: Containers of one training step.
STEP = 16


def encoder(path: str):
    cache = sys.__dict__.setdefault("_quarryline_encoders", {})
    if path not in cache:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache[path]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document with a text; NULL and empty texts have no tokens and are left out."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(encode(t)) for t in pdf["text"]]})

    return documents.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text").mapInPandas(count, "doc_id bigint, n_tokens bigint")


class _Gaps:
    """Boxes with room, by room: the fullest one that takes a piece."""

    def __init__(self) -> None:
        self.rooms: list[tuple[int, int]] = []

    def add(self, room: int, box: int) -> None:
        if room > 0:
            bisect.insort(self.rooms, (room, box))

    def take(self, size: int) -> tuple[int, int] | None:
        at = bisect.bisect_left(self.rooms, (size, -1))
        return self.rooms.pop(at) if at < len(self.rooms) else None


def windows(lengths: list[int], capacity: int, contexts: tuple[float, ...] = CONTEXTS) -> tuple[list[int], list[int]]:
    """(window of each length, context size of each window).

    Tiers go from the longest context to the shortest, pieces within one by falling length. A piece goes to the
    fullest window of a longer tier that takes it, then to the fullest of its own tier, then to a new one of its own.
    """
    sizes = sorted({int(part * capacity) for part in contexts} | {capacity}, reverse=True)
    tier = [max(k for k, size in enumerate(sizes) if size >= n) for n in lengths]
    longer, placed, context = _Gaps(), [0] * len(lengths), []
    for k, size in enumerate(sizes):
        own = _Gaps()
        for i in sorted((i for i, t in enumerate(tier) if t == k), key=lambda i: (-lengths[i], i)):
            for gaps in (longer, own):
                found = gaps.take(lengths[i])
                if found:
                    room, box = found
                    break
            else:
                gaps, room, box = own, size, len(context)
                context.append(size)
            placed[i] = box
            gaps.add(room - lengths[i], box)
        for room, box in own.rooms:
            longer.add(room, box)
    return placed, context


def fill(lengths: list[int], capacity: int, contexts: tuple[float, ...] = CONTEXTS) -> list[tuple[int, int, int, int, int]]:
    """(container, position in it, tokens before it in the container, window, context of the window) of each length.

    Windows are numbered over all containers. They are packed by falling size of what they hold, each into the
    fullest container that takes it, so two containers never both lie half empty. Ties keep the order given.
    """
    placed, context = windows(lengths, capacity, contexts)
    load = [0] * len(context)
    members: list[list[int]] = [[] for _ in context]
    for i, w in enumerate(placed):
        load[w] += lengths[i]
        members[w].append(i)
    gaps, used, held = _Gaps(), [], []
    out: list[tuple[int, int, int, int, int]] = [(0, 0, 0, 0, 0)] * len(lengths)
    for w in sorted(range(len(load)), key=lambda w: (-load[w], w)):
        found = gaps.take(load[w])
        room, box = found if found else (capacity, len(used))
        if not found:
            used.append(0)
            held.append(0)
        gaps.add(room - load[w], box)
        for i in sorted(members[w], key=lambda i: (-lengths[i], i)):
            out[i] = (box, held[box], used[box], w, context[w])
            held[box] += 1
            used[box] += lengths[i]
    return out


def deal(loads: list[int], step: int = STEP) -> list[int]:
    """Group of each container so that groups of ``step`` containers have nearly equal loads: dealt in turns, back and forth."""
    groups = max(1, -(-len(loads) // step))
    out = [0] * len(loads)
    for turn, box in enumerate(sorted(range(len(loads)), key=lambda b: (-loads[b], b))):
        row, col = divmod(turn, groups)
        out[box] = col if row % 2 == 0 else groups - 1 - col
    return out


def pack(documents: DataFrame, capacity: int = 4096, vocabulary: str = VOCABULARY, shard_containers: int = SHARD_CONTAINERS, contexts: tuple[float, ...] = CONTEXTS) -> DataFrame:
    """(shard, container_no, position, doc_id, piece_no, token_from, n_tokens, offset, window_no, context, step_group) of every document or piece.

    A document of more than capacity tokens is cut into full pieces and a rest; no other is cut. Every token is
    placed once. Pieces are spread over shards by a hash, so no task holds more than a bounded share of them whatever
    the source; the number of shards follows the total of tokens. NULL and empty texts have nothing to place; a
    repeated doc_id is placed as often as it stands there. context is the size of the window that a piece lies in:
    that of its own tier or, where it fills a gap, of a longer one.
    """
    spark = documents.sparkSession
    counted = materialize(token_counts(documents, vocabulary), f"{workspace(spark)}/tokens")
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, round(total / (capacity * shard_containers)))
    pieces = counted.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_tokens - 1) div {capacity} as int)"))))
    pieces = pieces.select("doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("token_from"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no").cast("bigint") * capacity).alias("n_tokens"))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
        spots = fill(pdf["n_tokens"].tolist(), capacity, contexts)
        work: dict[int, int] = {}
        for (box, *_), n in zip(spots, pdf["n_tokens"].tolist()):
            work[box] = work.get(box, 0) + n * n  # attention's work within documents
        group = deal([work[b] for b in range(len(work))])
        columns = {name: [s[i] for s in spots] for i, name in enumerate(["container_no", "position", "offset", "window_no", "context"])}
        return pdf.assign(**columns, step_group=[group[s[0]] for s in spots])[["shard", "container_no", "position", "doc_id", "piece_no", "token_from", "n_tokens", "offset", "window_no", "context", "step_group"]]

    schema = "shard int, container_no bigint, position bigint, doc_id bigint, piece_no int, token_from bigint, n_tokens bigint, offset bigint, window_no bigint, context bigint, step_group bigint"
    return sharded.groupBy("shard").applyInPandas(one, schema)


def packing_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: pieces, containers, tokens, share of unused space, step groups, and the greatest group's work by the mean group's."""
    boxes = packed.groupBy("shard", "container_no", "step_group").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("work"))
    groups = boxes.groupBy("shard", "step_group").agg(F.sum("used").alias("used"), F.sum("pieces").alias("pieces"), F.sum("work").alias("work"), F.count(F.lit(1)).alias("boxes"))
    n = F.sum("boxes")
    return groups.agg(F.sum("pieces").alias("n_pieces"), n.alias("n_containers"), F.sum("used").alias("n_tokens"), F.round(1 - F.sum("used") / (n * capacity), 6).alias("unused_share"), F.count(F.lit(1)).alias("n_groups"), F.round(F.max("work") / F.avg("work"), 6).alias("work_spread"))


def tier_report(packed: DataFrame) -> DataFrame:
    """Per context size: windows, pieces of the tier itself, pieces of shorter tiers that fill its gaps, tokens, share of unused space in the windows."""
    known = packed.withColumn("filler", F.col("n_tokens") * 2 <= F.col("context"))
    boxes = known.groupBy("context", "shard", "window_no").agg(F.sum("n_tokens").alias("used"), F.count_if(~F.col("filler")).alias("own"), F.count_if("filler").alias("fillers"))
    n = F.count(F.lit(1))
    return boxes.groupBy("context").agg(n.alias("n_windows"), F.sum("own").alias("n_own"), F.sum("fillers").alias("n_fillers"), F.sum("used").alias("n_tokens"), F.round(1 - F.sum("used") / (n * F.col("context")), 6).alias("unused_share"))
