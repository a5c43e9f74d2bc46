"""Letters composed of a letter and marks or written as these: one look, held against NFD, a table of looks and NFC."""

import collections
import itertools
import os
import unicodedata

import pytest

from quarryline.llm import looks, queries

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TAGS = ("<wide", "<narrow", "<font", "<noBreak")
TABLE = dict(zip("".join(m for m, _ in (looks.GREEK, looks.CYRILLIC, looks.MARKS)), "".join(o for _, o in (looks.GREEK, looks.CYRILLIC, looks.MARKS)))) | looks.LIGATURES


def own_look(c):
    if c in looks.GONE:
        return ""
    if unicodedata.decomposition(c).startswith(TAGS) or 0x2160 <= ord(c) <= 0x217F:
        c = unicodedata.normalize("NFKC", c)
    return " " if unicodedata.category(c[0]) == "Zs" else TABLE.get(c, c)


def expected(data):
    groups, known = collections.defaultdict(list), {}
    for doc, text in data:
        if text:
            for c in set(unicodedata.normalize("NFD", text)) - known.keys():
                known[c] = own_look(c)
            groups[unicodedata.normalize("NFC", "".join(known[c] for c in unicodedata.normalize("NFD", text)))].append((doc, text))
    return sorted({(min(a, b)[0], max(a, b)[0]) for g in groups.values() for a, b in itertools.combinations(g, 2) if a[1] != b[1]})


def pairs(df):
    return sorted(tuple(r) for r in df.select("doc_id_a", "doc_id_b").collect())


def test_composed_and_decomposed_are_one_look(spark):
    letters = "ёЁїЇѐӯўӳΆόΉἈὀᾼガآक़가"
    data = []
    for i, c in enumerate(letters):
        data += [(10 * i, f"{i} {c}n"), (10 * i + 1, f"{i} {unicodedata.normalize('NFD', c)}n"), (10 * i + 2, f"{i} {unicodedata.normalize('NFD', c)[0]}n")]
    data += [(900, "900 ёn"), (901, "900 ën"), (902, "900 eön"), (903, "900 ёn")]
    want = [(10 * i, 10 * i + 1) for i in range(len(letters))] + [(900, 901), (900, 903), (901, 903)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert expected(data) == want
    assert pairs(looks.look_pairs(df)) == want
    classes = {r.doc_id: r.class_id for r in looks.canonical_members(df).collect()}
    assert all(classes[a] == classes[b] for a, b in want) and all(classes[10 * i + 2] == 10 * i + 2 for i in range(len(letters)))
    assert all(looks.look_of(data[3 * i][1]) == looks.look_of(data[3 * i + 1][1]) for i in range(len(letters)))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
def test_p9_found_by_own_looks(spark):
    data = [(r[0], r[1]) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    assert pairs(queries.p9_found(spark, D)) == expected(data)
