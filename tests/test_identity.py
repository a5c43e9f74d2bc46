import random

from quarryline.operators import identity

SIDE = "group_key string, {} string, place bigint, fingerprint string, cwe string, title string, paths array<string>"


def test_ladder(spark):
    numbered = lambda rows: [(r[0], r[1], i, *r[2:]) for i, r in enumerate(rows)]
    old = spark.createDataFrame(numbered([("g", "o1", "f1", "c", "alpha", ["a"]), ("g", "o2", "x", "c2", "beta", ["b", "c"]), ("g", "o3", None, "c3", "gamma ray burst", ["d", "e"]), ("g", "o4", None, None, "delta wing seen", None), ("g", "o5", None, None, None, []), ("h", "o1", "f1", None, "alpha", None)]), SIDE.format("old_id"))
    new = spark.createDataFrame(numbered([("g", "n1", "f1", "c", "other", ["z"]), ("g", "n2", "y", "c2", "beta", ["c", "b"]), ("g", "n3", None, "c9", "unlike", ["d", "e", "k"]), ("g", "n4", None, None, "delta wing seen twice", None), ("g", "n5", None, None, None, None)]), SIDE.format("new_id"))
    got = sorted(tuple(r) for r in identity.match_ladder(old, new).collect())
    assert got == [("g", "o1", "n1", "fingerprint"), ("g", "o2", "n2", "path+cwe"), ("g", "o3", "n3", "overlap"), ("g", "o4", "n4", "title")]
    assert identity.match_ladder(old.where("false"), new).count() == 0


def test_aliases(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("w", "x"), ("q", "r"), ("q", "z"), (None, "a"), ("s", "s")]
    got = dict(tuple(r) for r in identity.resolve_aliases(spark.createDataFrame(pairs, "old_id string, new_id string")).collect())
    assert got == {"a": "e", "b": "e", "c": "e", "d": "e", "x": None, "y": None, "w": None, "q": "r", "s": None}
    assert identity.resolve_aliases(spark.createDataFrame([], "old_id string, new_id string")).count() == 0


def test_in_turn_is_first_come_first_served(spark, tmp_path):
    pick = random.Random(3)
    pairs = [("g", f"o{i:02}", i, f"n{j:02}", j, pick.randrange(4) / 4) for i in range(30) for j in range(25) if pick.random() < 0.15]
    free, want = set(range(25)), {}
    for i in range(30):
        own = [(s, -j) for _, _, k, _, j, s in pairs if k == i and j in free]
        if own:
            want[f"o{i:02}"] = f"n{-max(own)[1]:02}"
            free.discard(-max(own)[1])
    df = spark.createDataFrame(pairs, "group_key string, old_id string, place bigint, new_id string, new_place bigint, score double")
    assert {r.old_id: r.new_id for r in identity.in_turn(df, "x", str(tmp_path / "w")).collect()} == want
    assert identity.in_turn(df.where("false"), "x", str(tmp_path / "e")).count() == 0


def test_titles_that_repeat(spark):
    old = spark.createDataFrame([("g", f"o{i}", i, None, None, "Cache poisoning in hook" if i % 2 else "Cache poisoning in store", None) for i in range(6)], SIDE.format("old_id"))
    new = spark.createDataFrame([("g", f"n{i}", i, None, None, "Cache poisoning in hook", None) for i in range(4)] + [("g", "n9", 9, None, None, "Nothing alike whatsoever", None)], SIDE.format("new_id"))
    got = sorted(tuple(r)[1:3] for r in identity.match_ladder(old, new).collect())
    # the title of o0 comes first and takes three of the four, in order
    assert got == [("o0", "n0"), ("o1", "n3"), ("o2", "n1"), ("o4", "n2")]
