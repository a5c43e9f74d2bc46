"""Defined results for nulls, empty tables, ties, copies and clashing columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions.timestamps import with_readings
from quarryline.operators import changefeed, hierarchy, instants, late_events, orphans, relational, schema_drift, skew
from quarryline.plans import problems
from quarryline.workspace import workspace

T = lambda day: dt.datetime(2024, 1, day)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def reference(spark, children, parents):
    c = spark.createDataFrame(children, "row_no bigint, fk string, born timestamp_ntz, ref_time string, k0 string")
    p = spark.createDataFrame(parents, "key string, loaded_at timestamp_ntz, removed_at timestamp_ntz, k0 string")
    return orphans.Reference("c", "fk", c, {"fk": "key"}, F.col("born"), p)


def test_orphans(spark):
    children = [(1, "a", T(5), "x", "x"), (1, "a", T(5), "x", "x"), (2, "a", T(1), None, None), (3, None, T(5), None, None), (4, "z", T(5), None, None), (5, "a", T(9), None, None), (6, "a", None, None, None)]
    parents = [("a", T(2), T(9), None), ("a", T(2), T(9), None), (None, T(1), None, None), ("z", None, None, None)]
    ref = reference(spark, children, parents)
    assert rows(orphans.find_orphans(ref), "row_no") == [(2,), (4,), (5,), (6,)]
    assert rows(orphans.find_orphans(reference(spark, children, [])), "row_no") == [(1,), (2,), (4,), (5,), (6,)]
    assert rows(orphans.find_orphans(reference(spark, [], parents)), "row_no") == []
    assert rows(orphans.orphan_counts([ref]), "n_refs", "n_orphans") == [(1, 1), (4, 3)]


def test_salted_join_keeps_every_row(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("hot", "h"), ("cold", "c")], "k string, w string")
    heavy = skew.heavy_keys(left.select("k"), ["k"], share=10, floor=10)
    assert [r.k for r in heavy.collect()] == ["hot"]
    a, b, on = skew.salted(left, right, ["k"], "v", salts=4, heavy=heavy)
    assert a.join(b, on).count() == 501
    assert a.select("__salt").distinct().count() == 4
    assert skew.heavy_keys(left.select("k"), ["k"]) is None


FEED = "feed_pos bigint, log_no bigint, log_pos bigint, op string, k string, v string, file string, pos string"


def feed(spark, changes):
    return spark.createDataFrame([(*c, None, None) for c in changes], FEED)


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_changefeed(spark, batches):
    changes = [
        (1, 1, 2, "U", "a", "new"), (2, 1, 1, "insert", "a", "old"), (3, 1, 2, "U", "a", "new"), (4, 1, 5, "tombstone", "b", None), (5, 1, 4, "I", "b", "late"), (6, 2, 1, " Delete ", "c", None),
        (7, 2, 2, "c", "c", "again"), (8, 1, 9, "x?", "d", "bad"), (9, 1, 9, "I", None, "no key"), (10, None, 1, "I", "e", "no place"), (11, 3, 1, "u", "f", None), (12, 1, 9, "I", "f", "older"),
    ]
    got = changefeed.apply_feed(feed(spark, changes), workspace(spark), ["k"], ["log_no", "log_pos"], ["v"], "feed_pos", batches)
    assert rows(got, "k", "log_no", "log_pos", "v") == [("a", 1, 2, "new"), ("c", 2, 2, "again"), ("f", 3, 1, None)]


def test_changefeed_after_a_stop(spark):
    path = workspace(spark)
    open_table = lambda: changefeed.ChangeTable(spark, path, ["k"], ["log_no", "log_pos"], ["v"])
    changes = [(1, 1, 1, "I", "a", "1"), (2, 1, 2, "I", "b", "1"), (3, 2, 1, "U", "a", "2"), (4, 2, 2, "D", "b", None), (5, 1, 3, "U", "b", "late")]
    df = feed(spark, changes)
    open_table().apply(df.where("feed_pos <= 2"))
    df.write.parquet(f"{path}/data/batch=1")  # a batch that stopped before its commit
    assert rows(open_table().read(), "k", "v") == [("a", "1"), ("b", "1")]
    open_table().apply(df.where("feed_pos > 2"))
    assert rows(open_table().read(), "k", "v") == [("a", "2")]


def test_changefeed_empty(spark):
    assert changefeed.apply_feed(feed(spark, []), workspace(spark), ["k"], ["log_no", "log_pos"], ["v"], "feed_pos").count() == 0


def trees(spark, links, paths=True):
    return hierarchy.resolve_trees(spark.createDataFrame(links, "parent string, child string"), paths)


def test_hierarchy(spark):
    links = [("r", "a"), ("r", "a"), ("a", "b"), ("b", "c"), ("r", "d"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "w"), ("s", "s"), (None, "n"), ("n", None)]
    got = trees(spark, links)
    assert rows(got, "node_id", "root_id", "depth", "subtree_size") == [
        ("a", "r", 1, 3), ("b", "r", 2, 2), ("c", "r", 3, 1), ("d", "r", 1, 1), ("r", "r", 0, 5), ("s", "(cycle)", -1, None),
        ("w", "(below cycle)", -1, None), ("x", "(cycle)", -1, None), ("y", "(cycle)", -1, None), ("z", "(below cycle)", -1, None),
    ]
    assert {r.node_id: r.path for r in got.collect() if r.path} == {"r": ["r"], "a": ["r", "a"], "b": ["r", "a", "b"], "c": ["r", "a", "b", "c"], "d": ["r", "d"]}
    assert rows(hierarchy.descendants(got), "ancestor", "node_id", "distance") == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("r", "a", 1), ("r", "b", 2), ("r", "c", 3), ("r", "d", 1)]


def test_hierarchy_without_trees(spark):
    assert trees(spark, []).count() == 0
    assert hierarchy.descendants(trees(spark, [])).count() == 0
    assert rows(trees(spark, [("a", "b"), ("b", "a")]), "node_id", "root_id") == [("a", "(cycle)"), ("b", "(cycle)")]


def test_several_parents(spark):
    # b's smallest parent lies on a cycle, so it keeps the one with a root; the links not followed are rows
    links = [("a0", "a1"), ("a1", "a0"), ("a0", "b"), ("r", "b"), ("s", "b"), ("b", "c"), ("p", "q"), ("o", "q")]
    df = spark.createDataFrame(links, "parent string, child string")
    got = hierarchy.resolve_trees(df)
    assert rows(got, "node_id", "root_id", "depth") == [("a0", "(cycle)", -1), ("a1", "(cycle)", -1), ("b", "r", 1), ("c", "r", 2), ("o", "o", 0), ("p", "p", 0), ("q", "o", 1), ("r", "r", 0), ("s", "s", 0)]
    assert rows(hierarchy.dropped_links(df, got), "parent", "child", "kept") == [("a0", "b", "r"), ("p", "q", "o"), ("s", "b", "r")]


def plain_trees(links):
    parent = {c: p for p, c in links}
    nodes = {n for pair in links for n in pair}
    out = {}
    for n in nodes:
        path, at = [n], n
        while at in parent and parent[at] not in path:
            at = parent[at]
            path.append(at)
        out[n] = (at, len(path) - 1, path[::-1]) if at not in parent else ("(cycle)", -1, None) if parent[at] == n else ("(below cycle)", -1, None)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_random_trees(spark, seed):
    pick = random.Random(seed)
    links = [(f"{pick.randrange(max(0, i - 3), 200 if seed % 2 and pick.random() < 0.05 else i) % 200:03}" if i else "root", f"{i:03}") for i in range(200) if pick.random() < 0.97]
    got, want = trees(spark, links).collect(), plain_trees(links)
    assert {r.node_id: (r.root_id, r.depth, r.path) for r in got} == want
    below = {n: sum(1 for _, d, p in want.values() if d >= 0 and n in p) for n, (_, d, _) in want.items() if d >= 0}
    assert {r.node_id: r.subtree_size for r in got if r.depth >= 0} == below
    pairs = rows(hierarchy.descendants(trees(spark, links, paths=False)), "ancestor", "node_id", "distance")
    assert pairs == sorted(((a, n, d - i) for n, (_, d, p) in want.items() if d > 0 for i, a in enumerate(p[:-1])), key=str)


def test_a_long_chain_takes_few_rounds(spark):
    n = 20_000
    links = spark.range(1, n).selectExpr("cast(id - 1 AS string) AS parent", "cast(id AS string) AS child")
    got = hierarchy.resolve_trees(links, paths=False)
    assert got.agg(F.count("*"), F.max("depth"), F.sum("subtree_size"), F.countDistinct("root_id")).first()[:] == (n, n - 1, n * (n + 1) // 2, 1)


@pytest.mark.parametrize(("text", "zone", "want"), [
    ("2024-03-31 02:30:00", "Europe/Berlin", "2024-03-31T01:30:00"), ("2024-10-27 02:30:00", "Europe/Berlin", "2024-10-27T00:30:00"), ("2024-07-01 10:00:00 EST", "America/New_York", "2024-07-01T15:00:00"),
    ("2024-07-01 10:00:00 IST", "Asia/Kolkata", "2024-07-01T04:30:00"), ("2024-01-01 10:00:00 EST", "Australia/Sydney", "2024-01-01T00:00:00"), ("03.04.2024 10:00", None, "2024-04-03T10:00:00"), ("03/04/2024 12:05 AM", None, "2024-03-04T00:05:00"),
    ("1704067200.129", "Asia/Tokyo", "2024-01-01T00:00:00.129"), ("1704067200129", None, "2024-01-01T00:00:00.129"), ("2024-02-30", None, None), ("0000-00-00", None, None), ("", None, None), (None, None, None), ("soon", None, None),
    ("2024-01-01T00:00:00.123999999Z", "Asia/Tokyo", "2024-01-01T00:00:00.123"), ("2024-09-08", "America/Santiago", "2024-09-08T04:00:00"), ("Wed, 1 May 2024 10:00:00 +0530", None, "2024-05-01T04:30:00"), ("2024-01-01 10:00:00 QQQ", None, None),
])
def test_readings(spark, text, zone, want):
    got = with_readings(spark.createDataFrame([(text, zone, "x")], "value string, tz string, readings string").drop("readings"), "value", "tz", "readings").first().readings
    ms = got[0].ms if got else None
    assert ms == (None if want is None else round((dt.datetime.fromisoformat(want) - dt.datetime(1970, 1, 1)).total_seconds() * 1000))


def test_viterbi_follows_neighbours_without_conventions(spark):
    # the clear values say month first; with no declared convention the doubtful ones follow them
    data = [(1, "05/13/2024 10:00 AM", "s"), (2, "05/06/2024 10:00 AM", "s"), (3, "06/07/2024 10:00 AM", "s"), (4, "06/14/2024 10:00 AM", "s"), (5, "03.04.2024 10:00", "t"), (6, "04.04.2024 10:00", "t")]
    df = spark.createDataFrame(data, "row_no bigint, written string, source string").withColumn("tz", F.lit(None).cast("string"))
    read = with_readings(df, "written", "tz", "readings")
    declared = instants.choose_readings(read, F.col("source"), [F.col("row_no")], ["row_no"])
    free = instants.choose_readings(read, F.col("source"), [F.col("row_no")], ["row_no"], undeclared=0.0)
    day = lambda df: [(r.row_no, dt.datetime.fromtimestamp(r.epoch_ms / 1000, dt.timezone.utc).strftime("%m-%d")) for r in df.orderBy("row_no").collect()]
    assert day(declared) == [(1, "05-13"), (2, "05-06"), (3, "06-07"), (4, "06-14"), (5, "04-03"), (6, "04-04")]
    assert day(free)[:4] == [(1, "05-13"), (2, "05-06"), (3, "06-07"), (4, "06-14")]
    assert instants.choose_readings(read.where("false"), F.col("source"), [F.col("row_no")], ["row_no"]).count() == 0


@pytest.mark.parametrize(("block_rows", "cut"), [(3, 7), (1, 4), (1000, 11), (4, None)])
def test_cut_chains_cost_the_same(spark, block_rows, cut):
    # the cheapest path through a chain in blocks, with runs of undecided rows, costs what it costs in one piece
    pick = random.Random(block_rows)
    data, n = [], 160
    for chain in ("s", "t", None):
        for i in range(n):
            width = 1 if pick.random() < (0.3 if i < 80 else 0.02) else pick.randrange(2, 5)
            data.append((i, chain, [(10 * pick.randrange(1, 3) + (j > 0), (i + pick.randrange(-9, 9)) * 86_400_000 + j) for j in range(width)]))
    df = spark.createDataFrame(data, "row_no bigint, source string, readings array<struct<code:int,ms:bigint>>").repartition(5)
    readings = {(c, i): r for i, c, r in data}

    def cost(block, size):
        out = instants.choose_readings(df, F.col("source"), [F.col("row_no")], ["row_no", "source"], undeclared=0.5, block=block, block_rows=size).collect()
        assert len(out) == len(data)
        total = 0.0
        for chain in ("s", "t", None):
            path = [next((c, ms) for c, ms in readings[chain, r.row_no] if ms == r.epoch_ms) for r in sorted((r for r in out if r.source == chain), key=lambda r: r.row_no)]
            total += sum(0.5 * (c % 10 != 0) for c, _ in path) + sum(instants._move(a, b) for a, b in zip(path, path[1:]))
        return total

    assert cost(F.floor(F.col("row_no") / cut) if cut else None, block_rows) == cost(None, 10_000)


def test_p6_takes_the_conventions_only(spark, tmp_path):
    # a month 13 names no instant by the conventions, though with day and month swapped it would
    data = [(1, "13/05/2024", "s", None), (2, "05/13/2024", "s", None), (2, "05/13/2024", "s", None), (3, "06/07/2024 10:00", "s", "CET"), (4, None, "s", None), (5, "never", None, None), (6, "2024-01-01T00:00:00+00:00", "s", None)]
    for name, field, source in (("finding_events", "occurred_at", "repo_key"), ("findings", "last_updated", "repo_key"), ("repos", "audit_date", "tree")):
        spark.createDataFrame(data, f"row_no bigint, {field} string, {source} string, site_tz string").write.parquet(str(tmp_path / f"{name}.parquet"))
    ms = lambda *at: int(dt.datetime(*at, tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = problems.p6_found(spark, str(tmp_path)).where("table_name = 'repos'")
    assert rows(got, "row_no", "field_name", "epoch_ms") == [(2, "audit_date", ms(2024, 5, 13)), (3, "audit_date", ms(2024, 6, 7, 8))]


def test_normalise_a_hot_source(spark):
    data = [(i, "hot" if i % 4 else f"s{i}", f"0{1 + i % 9}.0{1 + i % 8}.2024 10:00" if i % 5 else "2024-01-01T00:00:00Z", None) for i in range(400)]
    df = spark.createDataFrame(data, "row_no bigint, source string, written string, site_tz string")
    whole = rows(instants.normalise(df, "t", "written", F.col("source")), "row_no", "epoch_ms")
    assert len(whole) == 400 and rows(instants.normalise(df, "t", "written", F.col("source"), block_rows=20), "row_no", "epoch_ms") == whole


LATE = "row_no bigint, event_id string, repo_key string, recorded_at string, occurred_at string, site_tz string, resolution string, week_ms string"


def late_rows():
    at = lambda day: f"2024-{day}T00:00:00+00:00"
    return [
        (1, "a", "r", at("01-08"), at("01-01"), None, "open", None), (1, "a", "r", at("01-08"), at("01-01"), None, "open", None), (2, "a", "r", at("03-08"), at("01-01"), None, "open", None),
        (3, "b", "r", "2024-01-07T23:59:59+00:00", at("01-01"), None, None, None), (4, "c", "r", at("02-05"), at("01-01"), None, "open", None), (5, "d", "r", at("02-04"), at("01-01"), None, "open", None), (6, "e", None, at("01-01"), "never", None, None, None),
    ]


@pytest.mark.parametrize("runs", [1, 3])
def test_late_events(spark, runs):
    df, path = spark.createDataFrame(late_rows(), LATE), workspace(spark)
    for i in range(runs):
        # a store that's opened anew goes on; "a" comes again in a later run
        late_events.LateStore(spark, path).ingest(df.where((F.col("row_no") * runs / 7).cast("int") == i))
    store = late_events.LateStore(spark, path)
    assert rows(store.late_cases(), "event_id", "outcome") == [("a", "corrects"), ("c", "cut"), ("d", "corrects")]
    assert rows(store.weekly(), "resolution", "n_on_time", "n_corrected", "n_events", "n_cut") == [("open", 0, 2, 2, 1), (None, 1, 0, 1, 0)]
    first = late_events.partials(store.arrivals().where("event_id < 'c'"))
    both = late_events.merge(first, late_events.partials(store.arrivals().where("event_id >= 'c'")))
    assert rows(both, *both.columns) == rows(store.counts(), *both.columns)
    shorter = late_events.LateStore(spark, path, late_events.Lateness(open_days=7))
    assert rows(shorter.late_cases(), "event_id", "outcome") == [("a", "corrects"), ("c", "cut"), ("d", "cut")]


def test_late_events_after_a_stop(spark):
    df, path = spark.createDataFrame(late_rows(), LATE), workspace(spark)
    store = late_events.LateStore(spark, path)
    store.ingest(df.where("row_no <= 3"))
    late_events.first_deliveries(df).write.parquet(f"{path}/arrivals/run=000001")  # a run that stopped before its commit
    assert store.arrivals().count() == 2
    store.ingest(df.where("row_no > 3"))
    assert rows(store.late_cases(), "event_id", "outcome") == [("a", "corrects"), ("c", "cut"), ("d", "corrects")]
    # the partials decide: without the stored counts nothing is a case
    spark.createDataFrame([], "week_ms bigint, resolution string, arrival_ms bigint, n bigint").write.mode("overwrite").parquet(f"{path}/partials/run=000001")
    assert rows(store.late_cases(), "event_id", "outcome") == [("a", "corrects")]


def test_late_events_without_rows(spark):
    store = late_events.LateStore(spark, workspace(spark))
    assert store.weekly().count() == 0 and store.late_cases().count() == 0
    store.ingest(spark.createDataFrame([], LATE))
    assert store.weekly().count() == 0 and store.late_cases().count() == 0


def test_schema_drift(spark):
    raw = [
        ("p", "meta", 1, "f1", '{"key": "a", "value": "1"}'), ("p", "meta", 1, "f1", '{"key": "b", "value": "2"}'), ("p", "meta", 1, "f1", '{"key": "a", "value": "1"}'), ("p", "meta", 1, "f1", '{"key": "c", "va'), ("p", "meta", 1, "f1", None),
        ("p", "meta", 3, "f3", '{"key": "a", "val": "1", "note": null}'), ("p", "meta", 3, "f3", '{"val": ["x"], "key": "z"}'), ("p", "meta", 4, "f4", '{"key": "a", "content": "1"}'), ("p", "meta", 4, "f4", "[1]"), ("q", "meta", 1, "g1", '{"key": "a"}'),
    ]
    df = spark.createDataFrame(raw, "producer string, dataset string, file_no int, file_name string, body string").withColumn("field", F.lit("x"))
    drift = schema_drift.Drift(df)
    assert rows(drift.changes(), "file_name", "field_name", "change_kind") == [("f3", "val", "renamed"), ("f3", "val", "retyped"), ("f4", "content", "renamed"), ("f4", "content", "retyped")]
    assert rows(drift.unified("meta"), "file_name", "key", "value") == [("f1", "a", "1"), ("f1", "b", "2"), ("f3", "a", "1"), ("f3", "z", '["x"]'), ("f4", "a", "1"), ("g1", "a", None)]
    assert schema_drift.Drift(df.where("false")).changes().count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 2, "x2"), ("a", 3, "x3"), ("c", 1, "z"), ("c", 0, "first")], "k string, n int, v string")
    assert rows(relational.upsert(old, new, ["k"], "n"), "k", "v") == [("a", "x3"), ("b", "y"), ("c", "z")]
    assert rows(relational.first_wins(old, new, ["k"], "n"), "k", "v") == [("a", "x"), ("b", "y"), ("c", "first")]
    before = spark.createDataFrame([("a", {"pqc": "1", "z": "2"}), ("b", {"q": "1"})], "k string, m map<string,string>")
    after = spark.createDataFrame([("a", {"n": "3"}), ("c", {"n": "4"})], "k string, m map<string,string>")
    assert {r.k: r.m for r in relational.preserve_merge(before, after, "k", "m", ["pqc"]).collect()} == {"a": {"pqc": "1", "n": "3"}, "b": {"q": "1"}, "c": {"n": "4"}}
