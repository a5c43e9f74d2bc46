"""Readers, writers and kernels on small files."""

import datetime as dt
import hashlib
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from quarryline.functions import scanners as sc
from quarryline.functions.udtf import register
from quarryline.operators import dispositions, graph, mining, portfolio, relational, timeline
from quarryline.plans import projection as plans
from quarryline.sources import projection, readers, sinks
from quarryline.streaming import ledger
from quarryline.workspace import workspace


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f'{{"a": {i}}}' if i % 7 else "" for i in range(5_000)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.text_lines(spark, str(tmp_path / "x.jsonl"))
        assert got.rdd.getNumPartitions() > 1
        assert [r.line for r in got.orderBy("line_no").collect()] == lines and got.agg(F.min("line_no"), F.max("line_no")).first()[:] == (0, 4_999)
        assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").where("doc.a <> line_no").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert readers.json_lines_if_there(spark, str(tmp_path / "none.jsonl"), "a int, b array<string>").count() == 0


def test_documents(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.json").write_text(json.dumps({"nodes": [{"id": "n", "type": "repo", "label": "l", "attrs": {"k": "v"}}], "edges": [{"from": "n", "to": "m", "rel": "owns", "branch": "b"}]}))
    (tmp_path / "g" / "b.json").write_text("{broken")
    nodes, edges = readers.graph_documents(spark, str(tmp_path / "g"))
    assert [tuple(r) for r in nodes.collect()] == [("n", "repo", "l", '{"k":"v"}')] and [tuple(r) for r in edges.collect()] == [("n", "m", "owns", '{"branch":"b"}')]
    (tmp_path / "bom.json").write_text(json.dumps({"metadata": {"component": {"name": "img"}}, "components": [{"name": "p", "version": "1", "purl": "pkg:x"}, {"name": "q"}]}))
    assert [(r.subject, r.name, r.version) for r in readers.components(spark, str(tmp_path / "bom.json")).orderBy("name").collect()] == [("img", "p", "1"), ("img", "q", None)]


def test_verified(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for name, body in (("good", b"abc"), ("bad", b"abd")):
        (tmp_path / "v" / name).write_bytes(body)
    listed = readers.listing(spark, str(tmp_path / "v")).select("path").withColumn("sha256", F.lit(hashlib.sha256(b"abc").hexdigest()))
    assert [r.path.rpartition("/")[2] for r in readers.verified(spark, str(tmp_path / "v"), listed).collect()] == ["good"]


def test_assessments_and_feeds(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    docs = [{"metadata": {"artifact": "compliance-assessment", "generated_at": "2024", "target": {"product": "p"}, "skipped_frameworks": {"soc": "no access"}}, "coverage": {"iso": "x"}}, {"metadata": {"artifact": "other"}, "coverage": {"iso": "x"}}, {"metadata": {"artifact": "compliance-assessment", "target": {"repos": ["r", "s"]}}, "coverage": {"iso": "x"}}]
    for i, d in enumerate(docs):
        (tmp_path / "a" / "deep" / f"{i}.json").write_text(json.dumps(d))
    got = readers.assessments(spark, str(tmp_path / "a"))
    assert sorted((r.target, r.framework, r.state) for r in got.collect()) == [("p", "iso", "covered"), ("p", "soc", "no access"), ("r,s", "iso", "covered")]
    feeds = spark.createDataFrame([("f", dt.datetime(2024, 1, 1)), ("g", dt.datetime(2024, 1, 2, 12))], "path string, modified timestamp")
    assert [(r.path, r.status) for r in readers.feed_status(feeds, F.lit("2024-01-02 13:00:00").cast("timestamp")).orderBy("path").collect()] == [("f", "stale"), ("g", "fresh")]
    paths = spark.createDataFrame([("/r/a",), ("/r/../x",), ("/else",), ("/r/./b//c",)], "p string")
    assert [r[0] for r in paths.select(readers.inside("/r", F.col("p"))).collect()] == [True, False, False, True]


def elf_file():
    """A small 64-bit ELF file with one needed library."""
    strings = b"\0libssl.so.3\0"
    head = b"\x7fELF" + bytes([2, 1, 1]) + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 64, 0, 0, 64, 56, 2, 0, 0, 0)
    data = 64 + 2 * 56
    dynamic = data + len(strings)
    load = struct.pack("<IIQQQQQQ", 1, 5, 0, 0, 0, 4096, 4096, 0)
    dyn = struct.pack("<IIQQQQQQ", 2, 6, dynamic, dynamic, dynamic, 48, 48, 0)
    return head + load + dyn + strings + struct.pack("<qQqQqQ", 1, 1, 5, data, 0, 0) + b"EVP_sha256\0"


def test_elf(spark):
    got = sc.parse_elf(elf_file(), (b"EVP_sha256", b"EVP_md5"))
    assert got == {"is_elf": True, "bits": 64, "machine": 62, "needed": ["libssl.so.3"], "found": ["EVP_sha256"]}
    assert sc.parse_elf(b"text")["is_elf"] is False and sc.parse_elf(None)["needed"] == [] and sc.parse_elf(elf_file()[:90])["is_elf"]
    df = spark.createDataFrame([(elf_file(),), (b"x",)], "content binary")
    assert [r[0].needed for r in df.select(sc.elf("content")).collect()] == [["libssl.so.3"], []]


def test_scanners_on_bad_input(spark):
    bad = spark.createDataFrame([("r", None), ("r", ""), ("r", "{broken"), ("r", "{}"), ("r", "[]")], "repo_key string, text string")
    for read in (sc.semgrep, sc.gitleaks, sc.osv, sc.grype, sc.yara, sc.call_sites, sc.govulncheck):
        assert read(bad).count() == 0, read
    files = bad.withColumnRenamed("repo_key", "path")
    assert sc.kubernetes(files).count() == 0 and sc.crypto_facts(files).count() == 0
    shown = spark.createDataFrame([("Protocol  : TLSv1.2\nProtocol: TLSv1.3\nx TLSv1.0\n",)], "t string")
    assert shown.select(sc.tls_versions(F.col("t"))).first()[0] == ["TLSv1.2", "TLSv1.3"]


def test_table_function(spark):
    register(spark)
    spark.createDataFrame([("a/go.mod", "module m\nrequire x v1 // indirect\nrequire y v2\n"), ("b/none", "x")], "path string, text string").createOrReplaceTempView("manifest_files")
    got = spark.sql("SELECT f.path, m.* FROM manifest_files f, LATERAL manifest_rows(f.path, f.text) m ORDER BY name").collect()
    assert [tuple(r) for r in got] == [("a/go.mod", "m", "x", "v1", True), ("a/go.mod", "m", "y", "v2", False)]


def test_projection_builds_are_whole(spark, tmp_path):
    path = str(tmp_path / "p")
    one = spark.createDataFrame([("r", "t", "s", "x", "code-audit")], "repo_key string, tree string, base_slug string, preferred string, report_kind string")
    walk = lambda: one.limit(0)
    assert projection.records(spark, path, walk)[1] == "walk"
    assert projection.write(spark, path, {"repos": one}, {"authority": "a"}) == {"repos": 1}
    projection.write(spark, path, {"repos": one.unionByName(one)}, {})
    found, way = projection.records(spark, path, walk)
    assert way == "index" and found.count() == 2
    # a build that stopped before it was named isn't seen; one of another revision is refused
    one.write.parquet(f"{path}/build-stopped/repos")
    assert projection.read(spark, path, "repos").count() == 2
    build = projection.current(spark, path)
    spark.createDataFrame([("schema_revision", "1")], "key string, value string").write.mode("overwrite").parquet(f"{path}/{build}/meta")
    with pytest.raises(ValueError):
        projection.read(spark, path, "repos")
    assert projection.records(spark, path, walk)[1] == "walk"


def test_projection_of_odd_documents(spark):
    doc = {"findings": [{"id": "F1", "locations": None, "cwes": None}, {"id": None}, {"id": "F2", "title": "first"}, {"id": "F2", "title": "last", "locations": [{"path": ""}, {"path": "a"}]}]}
    rows = spark.createDataFrame([("r", "p1", json.dumps(doc)), ("r", "p2", "[]"), ("r", "p3", None), (None, "p4", json.dumps({"findings": [{"id": "F1"}]}))], "repo_key string, path string, text string")
    got = sorted(((r.repo_key or "", r.finding_id, r.title, r.paths) for r in projection.findings_table(rows).collect()))
    assert got == [("", "F1", None, "[]"), ("r", "F1", None, "[]"), ("r", "F2", "last", '["a"]')]
    assert projection.events_table(rows).count() == 0 and projection.impact_table(rows).count() == 0


def test_scopes(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "boundary string, repo string")
    got = portfolio.scope(df(("b", "x"), ("b", "y")), df(("b", "z"), ("e", None)), df(("b", "y"), ("b", "gone")))
    assert sorted((r.boundary, r.repo or "", r.state) for r in got.collect()) == [("b", "gone", "stale_exclude"), ("b", "x", "in"), ("b", "y", "excluded"), ("b", "z", "in"), ("e", "", "empty")]
    with pytest.raises(Exception, match="stale_exclude|empty"):
        portfolio.checked_scope(got).collect()
    assert portfolio.checked_scope(portfolio.scope(df(("b", "x")), df(), df())).count() == 1


def test_versions(spark):
    cases = [("v1.2.3", ">=1.2.0, <v2.0.0", None, "go", None), ("v1.2.3", ">=v1.2.0, <v2.0.0", None, "go", True), ("v2.0.0", ">=v1.2.0 <v2.0.0", None, "go", False), ("1.2", "", "1.3.0", "npm", True), ("1.2.3.4", "<=1.2.3", None, "npm", True), ("1!2.0", "<2.1", None, "pypi", True), ("preview", "<1", None, "maven", None), ("1.0.0.Final", "", "1.0.1", "maven", True), ("v1.0", "<v2.0.0", None, "go", None), (None, "<1", "2", "npm", None)]
    df = spark.createDataFrame([c[:4] for c in cases], "v string, r string, f string, e string")
    got = [r[0] for r in df.select(portfolio.in_vulnerable_range(*map(F.col, "vrfe"))).collect()]
    # a bound that can't be read doesn't bind: the first case is held by its upper bound alone
    assert got[1:] == [c[4] for c in cases[1:]] and got[0] is True


def test_ordered_state_over_ranges(spark):
    rows = [(g, i, None if i % 5 else f"{g}{i}") for g in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v string")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = {(r.g, r.i): (r.last, r.n) for r in relational.with_last(df, ["g"], ["i"], {"last": F.col("v"), "n": F.col("i")}, inclusive=False).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(got[g, i] == ((None, None) if i == 0 else (f"{g}{(i - 1) // 5 * 5}", i - 1)) for g, i, _ in rows)
    assert relational.with_last(df.where("false"), ["g"], ["i"], {"last": F.col("v")}).count() == 0
    hits = spark.createDataFrame([("s", i, i not in (3, 9, 10)) for i in range(16)], "g string, i int, h boolean")
    assert sorted((r.began, r.n) for r in timeline.streaks(hits, ["g"], ["i"], F.col("h"), 5).collect()) == [(4, 5), (11, 5)]
    assert [r.i for r in relational.spaced(df.where("g = 'a'").select("i"), ["i"], 10).orderBy("i").collect()] == list(range(0, 200, 20))


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, at int, v string").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("k string, at int, v string").option("maxFilesPerTrigger", 1).parquet(src)
    seen = lambda df: sorted((r.k, r.at, r.v or "") for r in df.collect())
    batch(("a", 1, "x"), ("a", 2, "x"), ("b", 1, None))
    assert seen(ledger.changed_only(stream(), ["k"], "v", "at", out)) == [("a", 1, "x"), ("b", 1, "")]
    batch(("a", 3, "x"), ("b", 2, "y"), ("a", 4, "z"))
    again = seen(ledger.changed_only(stream(), ["k"], "v", "at", out))
    assert again == [("a", 1, "x"), ("a", 4, "z"), ("b", 1, ""), ("b", 2, "y")]
    assert seen(ledger.changed_only(stream(), ["k"], "v", "at", out)) == again
    done = ledger.run_to_end(stream().select("k"), workspace(spark))
    assert done.count() == 6


def test_precedents_of_nothing(spark):
    f = spark.createDataFrame([], "repo_key string, finding_id string, fingerprint string, paths array<string>, cwe string, category string")
    e = spark.createDataFrame([], "event_id string, repo_key string, finding_id string, recorded_at string, source_type string, actor_kind string, actor_identity string, validity string, resolution string")
    cache, population = dispositions.precedents(f, e, e.select("event_id", "repo_key"))
    assert cache.count() == 0 and [tuple(r) for r in population.collect()] == [("excluded_unsound", 0)]
    assert dispositions.matches(cache, f).count() == 0
    assert {(r.measure, r.n) for r in dispositions.summary(dispositions.derived(e, ["repo_key"])).collect()} == {("resolution", 0), ("validity", 0), ("conflicts", 0)}


def test_graph_of_nothing(spark):
    n = spark.createDataFrame([], "id string, kind string, label string, attrs string")
    e = spark.createDataFrame([], "src string, dst string, rel string, attrs string")
    t = spark.createDataFrame([("x",)], "target string")
    assert graph.blast_radius(e, n, t).count() == 0 and graph.top_shared(e, n, 5).count() == 0
    assert mining.reachability(spark.createDataFrame([], "repo string, cwes array<string>")).first()[:] == (None, None)
    assert sinks.markdown_summary(spark.createDataFrame([], "repo_key string, severity string")).count() == 0


def test_corpus_walk(spark, tmp_path):
    for at in ("findings/p/r/a-security-audit.json", "findings/p/_state/b-security-audit.json", "findings/.git/c.json", "other/d-security-audit.json"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("{}")
    (tmp_path / "findings" / "alias.json").symlink_to(tmp_path / "findings/p/r/a-security-audit.json")
    files = readers.listing(spark, str(tmp_path), "*-security-audit.json")
    assert [(r.tree, r.below) for r in readers.corpus(files, str(tmp_path), ["findings"]).collect()] == [("findings", "findings/p/r/a-security-audit.json")]
    assert [(r.alias.rpartition("/")[2], r.kind) for r in readers.link_aliases(spark, str(tmp_path)).collect()] == [("alias.json", "file")]


def test_lane_baseline(spark):
    now = spark.createDataFrame([("CWE-1", "go", 3, 1, "uncovered")], "cwe string, language string, n bigint, repos bigint, state string")
    p = spark.createDataFrame([("r", 0.4)], "rule string, precision double")
    assert {r.kind for r in mining.lane(None, now, None, p, (0, 3)).collect()} == {"baseline", "growth"}
    again = mining.lane(now.limit(0), now, p.limit(0), p, (0, 3)).collect()
    assert {(r.kind, r.detail) for r in again} == {("new_cluster", "- 3"), ("gate", "entered_below_gate"), ("attention", "1"), ("growth", "3")}


def test_rows_of_findings_do_not_carry_their_document(spark, tmp_path):
    spark.createDataFrame([("r", "p", "{}")], "repo_key string, path string, text string").write.parquet(str(tmp_path / "d"))
    plan = projection.findings_table(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    generate = next(line for line in plan.split("\n") if "Generate" in line)
    assert "doc#" not in generate and "findings#" in generate and plan.count("from_json") == 1


def test_manifests_are_read_once(spark, tmp_path):
    texts = ['{"kind": "Pod", "spec": {"hostPID": true}}\n---\nkind: Service\nspec: {type: NodePort}', '{"kind": "Pod", "spec": {"x": 1e5, "y": "\\u0041"}}\n---\n- a', "%YAML 1.1\n---\nkind: Pod\n...\n", "kind: Pod\n---\na: [", "kind: Pod\r\n---\r\nkind: Pod"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    docs = {r.path: [json.loads(x) for x in r.docs] for r in files.select("path", sc.yaml_documents("text").alias("docs")).collect()}
    assert docs == {"0": [{"kind": "Pod", "spec": {"hostPID": True}}, {"kind": "Service", "spec": {"type": "NodePort"}}], "1": [{"kind": "Pod", "spec": {"x": "1e5", "y": "A"}}], "2": [{"kind": "Pod"}], "3": [], "4": [{"kind": "Pod"}] * 2}
    assert sorted((r.path, r.check) for r in sc.kubernetes(files).where("path = '0'").collect()) == [("0", "KHS-N01"), ("0", "KHS-W06"), ("0", "KHS-W09"), ("0", "KHS-W10")]
    assert sc.kubernetes(files)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def large_repository(spark, path):
    """Tables of the smallest size, with one repository of 2,600 findings among its own."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    f = spark.read.parquet(f"{d}/findings.parquet").where("removed_at is null")
    more = f.limit(1).crossJoin(spark.range(2_600)).withColumns({"repo_key": F.lit("large"), "finding_id": F.concat(F.lit("F-"), "id"), "row_no": F.col("id") + 1_000_000}).drop("id")
    f.unionByName(more).write.parquet(f"{path}/findings.parquet")
    spark.read.parquet(f"{d}/repos.parquet").write.parquet(f"{path}/repos.parquet")


def test_a_large_repository_has_several_documents(spark, tmp_path):
    large_repository(spark, tmp_path)
    docs = plans.reports(spark, str(tmp_path)).where("repo_key = 'large'").select(F.size(F.from_json("text", projection.REPORT)["findings"]).alias("n"))
    each = [r.n for r in docs.collect()]
    assert len(each) == 3 and max(each) < 1_200 and sum(each) == 2_600
    got = plans.job_01_prj_01_findings(spark, str(tmp_path)).where("repo_key = 'large'")
    assert got.count() == got.select("finding_id").distinct().count() == 2_600


def test_build_with_a_large_repository(spark, tmp_path):
    large_repository(spark, tmp_path)
    want = plans.findings(spark, str(tmp_path)).count()
    got = {r.name: r.n for r in plans.job_01_snk_01_src_08_build(spark, str(tmp_path)).collect()}
    assert got["findings"] == want > 2_600 and got["repos"] == plans.repos(spark, str(tmp_path)).count()


def test_a_build_keeps_little_on_disk(spark, tmp_path):
    large_repository(spark, tmp_path)
    on_disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = on_disk.getAllFiles()
        return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    plans.job_01_snk_01_src_08_build(spark, str(tmp_path))
    assert sum(n for name, n in shuffled().items() if name not in before) < 50_000
    assert all(f.endswith(".json.gz") for f in plans.reports(spark, str(tmp_path)).inputFiles())


def test_findings_move_once_to_their_documents(spark, tmp_path):
    large_repository(spark, tmp_path)
    f = plans.dealt(spark, str(tmp_path))
    plan = f.groupBy("repo_key", "part").agg(F.collect_list("title"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange hashpartitioning(repo_key") == 2  # one to count repositories
    again = f.drop("part").exceptAll(plans.findings(spark, str(tmp_path)).select(f.drop("part").columns))
    assert again.isEmpty() and f.count() == plans.findings(spark, str(tmp_path)).count()
