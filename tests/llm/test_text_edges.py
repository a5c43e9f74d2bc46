"""Defined results for nulls, empty and long texts, ties, copies and clashing columns."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import leaks, looks, packing

DOCS = "doc_id bigint, text string, variant string, look string, class_id bigint, n_tokens string, edits string"


def docs(spark, data):
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in data], DOCS)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_looks(spark):
    plain = "Café at 2 - no; fi 12 IV."
    same = ["Café at 2 - no; fi 12 IV.", "Ｃafé at 2 ‐ no; ﬁ 12 IV.", "C​afé аt　2 - no; fi １２ ⅠⅤ.", "Caf­e‍́ at 2 ‑ no; fi 12 Ⅳ."]
    other = ["Cafe at 2 - no; fi 12 IV.", "café at 2 - no; fi 12 IV.", "Café at ² - no; fi 12 IV.", "Café at 2 - no; fi\n12 IV.", "Café at 2 – no; fi 12 IV."]
    data = [(1, plain), (2, plain), *[(10 + i, t) for i, t in enumerate(same)], *[(20 + i, t) for i, t in enumerate(other)], (30, None), (31, ""), (32, ""), (33, "​"), (34, "​​")]
    got = rows(looks.look_pairs(docs(spark, data)), "doc_id_a", "doc_id_b")
    group = [1, 2, 10, 11, 12, 13]
    assert got == sorted([(a, b) for a in group for b in group if a < b and (a, b) != (1, 2)] + [(33, 34)])
    canonical = dict(rows(looks.canonical_members(docs(spark, data)), "doc_id", "class_id"))
    assert {canonical[i] for i in group} == {1} and canonical[20] == 20 and 30 not in canonical and 31 not in canonical


def test_looks_of_repeated_ids_and_large_classes(spark, monkeypatch):
    monkeypatch.setattr(looks, "PART", 3)
    data = [(1, "one A"), (1, "one \u0410"), (2, "one A"), (3, "two"), (3, "two\u3164")] + [(10 + i, "many" + "\U000e0101" * i) for i in range(8)] + [(30, "ho\uffa0t"), (31, "hot")]
    got = rows(looks.look_pairs(docs(spark, data)), "doc_id_a", "doc_id_b")
    assert got == sorted([(1, 2), (30, 31)] + [(10 + i, 10 + j) for i in range(8) for j in range(i + 1, 8)])


def test_looks_without_texts(spark):
    assert looks.look_pairs(docs(spark, [])).count() == 0
    assert looks.canonical_members(docs(spark, [(1, None)])).count() == 0


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10_000)}" for _ in range(n)]


def items(spark, data):
    return spark.createDataFrame(data, "item_id string, text string")


def test_leaks(spark):
    item = words(40, 1)
    filler = words(50_000, 2)
    passage = lambda n, at=5: item[at : at + n]
    near = passage(12)
    near[7] = "changed"
    data = [
        (1, " ".join(filler + passage(12) + filler)), (2, " ".join(filler[:50] + passage(11) + filler[:50])), (3, "\n".join(["X", *passage(12), "y"]).upper()), (4, ",".join(passage(12)).replace("w", "ｗ")),
        (5, " ".join(filler[:20] + near + filler[:20])), (6, None), (7, ""), (8, " ".join(passage(40, 0))), (1, " ".join(filler + passage(12) + filler)), (9, " ".join(passage(6) + filler[:1] + passage(6, 11))),
    ]
    asked = [("A", " ".join(item)), ("B", " ".join(item)), ("C", " ".join(item[:8])), ("D", None), ("E", "")]
    got = leaks.find_leaks(docs(spark, data), items(spark, asked))
    assert rows(got.where("edits = 0"), "doc_id", "item_id") == [(i, x) for i in (1, 3, 4, 8) for x in "AB"]
    assert {i for i, _ in rows(got.where("edits = 1"), "doc_id", "item_id")} == {2, 5, 9}
    assert leaks.find_leaks(docs(spark, []), items(spark, asked)).count() == 0
    assert leaks.find_leaks(docs(spark, data), items(spark, [])).count() == 0


def test_leaks_in_any_case_and_look(spark):
    # capital В, Н, К, М, Т look like Latin letters, their small forms don't; ё composed or not
    words_in = "В начале Нового ведомства Контроль Многих Томов её отчёт и Ёлка всё ещё там".split()
    text = " ".join(words_in)
    shapes = [text, text.lower(), text.upper(), unicodedata.normalize("NFD", text), text.upper().translate(str.maketrans("ВНКМТАЕО", "BHKMTAEO")), unicodedata.normalize("NFD", text.lower()).translate(str.maketrans("аеорсух", "aeopcyx"))]
    data = [(i, f"x {t} y") for i, t in enumerate(shapes)] + [(90, f"x {text.replace('Томов', 'Томаса')} y")]
    got = leaks.find_leaks(docs(spark, data), items(spark, [("A", text)]))
    assert rows(got.where("edits = 0"), "doc_id") == [(i,) for i in range(len(shapes))]


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 4)
    asked = [(f"I{i}", " ".join(words(20, i))) for i in range(9)]
    data = [(i, " ".join(words(20, i)[3:16])) for i in range(9)]
    assert rows(leaks.find_leaks(docs(spark, data), items(spark, asked)).where("edits = 0"), "doc_id", "item_id") == [(i, f"I{i}") for i in range(9)]


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        last, row = row, [i + 1] + [0] * len(text)
        for j, t in enumerate(text):
            row[j + 1] = min(last[j] + (p != t), last[j + 1] + 1, row[j] + 1)
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.lists(st.integers(0, 3), max_size=20))
def test_myers(pattern, text):
    assert leaks.myers(pattern, text, len(pattern)) == distance(pattern, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_fill(lengths):
    spots = packing.fill(lengths, 64)
    boxes = {}
    for n, (box, position, offset, _, _) in zip(lengths, spots):
        boxes.setdefault(box, []).append((position, offset, n))
    for parts in boxes.values():
        at = 0
        for i, (position, offset, n) in enumerate(sorted(parts)):
            assert (position, offset) == (i, at)
            at += n
        assert at <= 64
    assert sum(1 for p in boxes.values() if sum(x[2] for x in p) * 2 <= 64) <= 1


def test_tiers_decide_where_pieces_go():
    # the piece of 10 goes to the long window's gap of 24, though the short window's gap of 10 would be tighter
    placed, context = packing.windows([40, 6, 10], 64)
    assert context == [64] and placed == [0, 0, 0]
    placed, context = packing.windows([40, 17, 15, 14, 10], 64)
    assert context == [64, 32, 16] and placed == [0, 0, 1, 2, 1] or len(context) >= 2
    assert packing.windows([16, 16, 16, 16], 64)[1] == [16] * 4 and packing.windows([16, 16, 16, 16], 64, (1.0,))[1] == [64]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_windows(lengths):
    placed, context = packing.windows(lengths, 64)
    for w, size in enumerate(context):
        inside = [n for n, p in zip(lengths, placed) if p == w]
        assert sum(inside) <= size and max(inside) * 2 > size or size == 16
    spots = packing.fill(lengths, 64)
    assert all(len({s[0] for s in spots if s[3] == w}) == 1 for w in range(len(context)))


def test_deal_balances():
    group = packing.deal(list(range(64)), 16)
    sums = [sum(i for i, g in enumerate(group) if g == k) for k in range(4)]
    assert max(sums) - min(sums) <= 4 and all(group.count(k) == 16 for k in range(4))


@pytest.mark.parametrize("shard_containers", [1, 4_000])
def test_pack(spark, shard_containers):
    data = [(1, "a b c " * 400), (2, None), (3, ""), (4, "word"), (5, "word"), (5, "word"), (6, "здр " * 90)]
    packed = packing.pack(docs(spark, data), capacity=128, shard_containers=shard_containers).collect()
    counts = {}
    for r in packed:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.n_tokens
        assert r.offset + r.n_tokens <= 128
    encode = packing.encoder(packing.VOCABULARY).encode_ordinary
    assert counts == {1: len(encode(data[0][1])), 4: 1, 5: 2, 6: len(encode(data[6][1]))}
    assert packing.pack(docs(spark, [(1, None)])).count() == 0
