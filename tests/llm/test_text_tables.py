"""Text problems against brute force over whole small tables."""

import collections
import itertools
import os
import unicodedata

import pytest

from quarryline.llm import leaks, looks, packing, queries

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def texts(spark, name, key):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{D}/{name}.parquet").select(key, "text").collect()]


def test_p8_found(spark):
    grams = lambda t: {tuple(w[i : i + 12]) for w in [leaks.words_of(t or "")] for i in range(len(w) - 11)}
    where = collections.defaultdict(set)
    for item, text in texts(spark, "eval_items", "item_id"):
        for g in grams(text):
            where[g].add(item)
    want = {(doc, item) for doc, text in texts(spark, "documents", "doc_id") for g in grams(text) if g in where for item in where[g]}
    got = [tuple(r) for r in queries.p8_found(spark, D).select("doc_id", "item_id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_p9_found(spark):
    groups = collections.defaultdict(list)
    for doc, text in texts(spark, "documents", "doc_id"):
        if text:
            groups[unicodedata.normalize("NFC", looks.look_of(text))].append((doc, text))
    want = {(min(a, b)[0], max(a, b)[0]) for g in groups.values() for a, b in itertools.combinations(g, 2) if a[1] != b[1]}
    got = [tuple(r) for r in queries.p9_found(spark, D).select("doc_id_a", "doc_id_b").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_p7_packed(spark):
    capacity = 4096
    counts = {doc: len(packing.encoder(packing.VOCABULARY).encode_ordinary(text)) for doc, text in texts(spark, "documents", "doc_id") if text}
    rows = queries.p7_packed(spark, D).collect()
    boxes, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        boxes[r.shard, r.container_no].append((r.position, r.offset, r.n_tokens))
        pieces[r.doc_id].append((r.piece_no, r.token_from, r.n_tokens))
    assert set(pieces) == set(counts)
    for doc, parts in pieces.items():
        parts.sort()
        assert sum(p[2] for p in parts) == counts[doc]
        assert [p[1] for p in parts] == [i * capacity for i in range(len(parts))]
        assert len(parts) == -(-counts[doc] // capacity)
    for parts in boxes.values():
        at = 0
        for i, (position, offset, n) in enumerate(sorted(parts)):
            assert (position, offset) == (i, at)
            at += n
        assert at <= capacity
    least = -(-sum(counts.values()) // capacity)
    assert len(boxes) <= least * 1.05 + 1
