"""The dealt fields of raw records in one form, held against plain Python over whole tables."""

import collections
import json
import os

import pytest
from pyspark.sql import functions as F

from quarryline.operators import schema_drift

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
RAW = "producer string, dataset string, file_no int, file_name string, body string"


def drift(spark, dataset, bodies):
    return schema_drift.Drift(spark.createDataFrame([("p", dataset, 1, "f", json.dumps(b)) for b in bodies], RAW))


def refs(v):
    if isinstance(v, str) and v[:1] in "[{":
        v = json.loads(v)
    if isinstance(v, str):
        v = v.split(",")
    if isinstance(v, dict):
        v = [f"{k}:{x}" for k, x in v.items()]
    return sorted({x if isinstance(x, str) else f"{x['framework']}:{x['id']}" for x in v})


def kind(v):
    v = v["name"] if isinstance(v, dict) else v[0] if isinstance(v, list) else v
    return {1: "code-audit", 2: "cloud-config", 3: "container-audit"}.get(v, v)


def value(v):
    v = v["v"] if isinstance(v, dict) and set(v) == {"v"} else v
    if isinstance(v, str) and v[:1] in "[{":
        v = json.loads(v)
    return v if isinstance(v, str) else json.dumps(v, sort_keys=True, separators=(",", ":"))


def test_control_refs(spark):
    shapes = [["b:A-1", "f:S-2"], '["f:S-2", "b:A-1"]', "b:A-1, f:S-2", [{"framework": "f", "id": "S-2"}, {"framework": "b", "id": "A-1"}], {"f": "S-2", "b": "A-1"}, {"b": ["A-1"], "f": "S-2"}, ["b:A-1", None, {"f": "S-2"}]]
    other = [({"framework": "b", "id": "A-1"}, ["b:A-1"]), ("b:A-1", ["b:A-1"]), ([{"v": "b:A-1"}], ["b:A-1"]), ([], []), ([7], ["7"]), ("[b:A-1", ["[b:A-1"])]
    data = [(s, ["b:A-1", "f:S-2"]) for s in shapes] + other
    got = drift(spark, "findings", [{"repo_key": "r", "finding_id": f"{i:02}", "control_refs": v} for i, (v, _) in enumerate(data)] + [{"repo_key": "r", "finding_id": "z", "title": "t"}]).unified("findings")
    assert [r.control_refs for r in got.orderBy("finding_id").collect()] == [w for _, w in data] + [None]


def test_report_kind_and_casts(spark):
    data = [("code-audit", "code-audit"), ({"name": "code-audit"}, "code-audit"), (["code-audit"], "code-audit"), (1, "code-audit"), ([2], "cloud-config"), ("3", "container-audit"), (9, None), (["a", "b"], None), ({"x": 1}, None)]
    own = drift(spark, "repos", [{"repo_key": str(i), "report_kind": v} for i, (v, _) in enumerate(data)] + [{"repo_key": "z", "is_branch_audit": True}, {"repo_key": "z", "is_branch_audit": 0}])
    assert [r.report_kind for r in own.unified("repos").orderBy("repo_key").collect()] == [w for _, w in data] + [None]
    got = {(r.record, r.value): (r.result, r.outcome) for r in own.casts("repos").collect()}
    want = {(f'["{i}"]', json.dumps(v, separators=(",", ":"))): (w, "cast" if w else "refused") for i, (v, w) in enumerate(data) if v != w}
    assert got == want | {('["z"]', "true"): ("1", "superseded")}


def test_meta_values(spark):
    data = [("x", "x"), ({"v": "x"}, "x"), (7, "7"), ({"v": '{"b": 1, "a": 2}'}, '{"a":2,"b":1}'), ({"b": 1, "a": 2}, '{"a":2,"b":1}'), ('["s", "t"]', '["s","t"]'), (["s", "t"], '["s","t"]'), ("[draft", "[draft"), ({"id": 1, "n": 2}, '{"id":1,"n":2}')]
    got = drift(spark, "meta", [{"key": str(i), "value": v} for i, (v, _) in enumerate(data)]).unified("meta")
    assert [r.value for r in got.orderBy("key").collect()] == [w for _, w in data]


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
@pytest.mark.parametrize(("dataset", "field", "form"), [("findings", "control_refs", refs), ("repos", "report_kind", kind), ("meta", "value", value)])
def test_whole_tables(spark, dataset, field, form):
    raw = spark.read.parquet(f"{D}/raw_records.parquet").where(F.col("dataset") == dataset)
    keys, want = schema_drift.RECORD_KEYS[dataset], collections.defaultdict(set)
    for r in raw.collect():
        try:
            doc = json.loads(r.body)
        except ValueError:
            continue
        if doc.get(field) is not None:
            want[(r.file_name, *(doc[k] for k in keys))].add(json.dumps(form(doc[field])))
    own = schema_drift.Drift(raw)
    got = {(r.file_name, *(r[k] for k in keys)): json.dumps(r[field]) for r in own.unified(dataset).collect()}
    assert want and all(got[k] in v for k, v in want.items())
    assert own.casts(dataset).where("outcome = 'refused'").count() == 0


def test_casts_of_several_datasets_at_once(spark):
    raw = [("p", "meta", 1, "f", '{"key": "a", "value": 1}'), ("p", "repos", 1, "g", '{"repo_key": "a", "report_kind": 1}')]
    own = schema_drift.Drift(spark.createDataFrame(raw, RAW))
    assert own.casts("meta").unionByName(own.casts("repos")).count() == 2


def test_broken_chains_of_renames(spark):
    meta = [("p", "meta", 1, "m1", '{"key": "a", "value": "x"}'), ("p", "meta", 2, "m2", '{"key": "a", "val": {"v": "y"}}'), ("p", "meta", 3, "m3", '{"key": "a", "val": "w", "value": "own"}')]
    gap = [("p", "findings", i, f"f{i}", json.dumps({"repo_key": "r", "finding_id": "1", "title": "t"} | more)) for i, more in enumerate([{"control_refs": ["b:A-1"]}, {}, {"controls": ["b:A-2"]}])]
    own = schema_drift.Drift(spark.createDataFrame(meta + gap, RAW))
    assert [(r.value, r.extras) for r in own.unified("meta").orderBy("file_name").collect()] == [("x", {}), ("y", {}), ("own", {})]
    assert [(r.control_refs, r.extras) for r in own.unified("findings").orderBy("file_name").collect()] == [(["b:A-1"], {}), (None, {}), (["b:A-2"], {})]
    assert [(r.value, r.outcome) for r in own.casts("meta").where("file_name = 'm3'").collect()] == [('"w"', "superseded")]


def test_registry_goes_on_where_it_stopped(spark, tmp_path):
    bodies = [{"key": "a", "value": "x"}, {"key": "a", "val": "x"}, {"key": "a", "val": "y"}, {"key": "a", "val": 7, "note": "n"}, {"key": "a", "other": 7, "note": "n"}]
    raw = spark.createDataFrame([("p", "meta", i, f"m{i}", json.dumps(b)) for i, b in enumerate(bodies)], RAW)
    whole = schema_drift.Drift(raw)
    listed = lambda d: sorted(tuple(r) for r in d.changes().collect())
    assert listed(whole) == [("m1", "val", "renamed"), ("m3", "note", "added"), ("m3", "val", "retyped"), ("m4", "other", "renamed")]
    path = str(tmp_path / "registry")
    for wanted in ((0, 1, 4), (0, 1, 2, 4), (0, 1, 2, 3, 4)):  # files come late between known ones
        part = schema_drift.Drift(raw.where(F.col("file_no").isin(*wanted)), path)
    assert listed(part) == listed(whole)
    known = schema_drift.SchemaRegistry(spark, path)
    # a later run keeps only files that are new; the registry alone gives the changes
    assert [spark.read.parquet(f"{path}/files/{n}").count() for n in known.runs()] == [3, 1, 1]
    assert spark.read.parquet(f"{path}/pairs/run=000001").select("file_name").collect()[:] == [("m4",)] or spark.read.parquet(f"{path}/pairs/run=000001").count() <= 1
    assert [r.version for r in part.fingerprints().orderBy("seq").collect()] == [1, 2, 2, 3, 4]
    steps = {(r.file_name, r.source_field): (r.version, r.field_name, r.rule) for r in part.migrations("meta").collect()}
    assert steps["m0", "value"] == (1, "value", "same") and steps["m2", "val"] == (2, "value", "renamed") and steps["m4", "other"] == (4, "value", "renamed") and steps["m3", "note"] == (3, "note", "extra")
    assert [r.value for r in part.unified("meta").orderBy("file_no").collect()] == ["x", "x", "y", "7", "7"]


def test_defaults(spark):
    own = drift(spark, "repos", [{"repo_key": "a"}, {"repo_key": "b", "is_branch_audit": True}, {"repo_key": "c", "is_branch_audit": None}])
    assert [r.is_branch_audit for r in own.unified("repos").orderBy("repo_key").collect()] == [0, 1, 0]
    assert [r.is_branch_audit for r in own.unified("repos", {}).orderBy("repo_key").collect()] == [None, 1, None]
    assert {(r.field_name, r.rule) for r in own.migrations("repos").collect()} >= {("is_branch_audit", "same"), ("tree", "default")}
