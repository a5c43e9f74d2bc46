"""The projection's tables, built from documents that are written from the test tables, and must be given back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators.relational import latest
from quarryline.plans.registry import registry
from quarryline.plans.relational import E, FI, L, R, findings, ledger, links, repos
from quarryline.sources import projection as pj
from quarryline.workspace import shuffles_dropped, table, workspace

QUERIES, SQL, query = registry()
x = F.expr
#: Findings of a written report document, about; a repository with more has several documents.
PER_DOCUMENT = 1000


def filed(s, df):
    """Documents (path, text) written as JSON lines with their path, compressed, and read again; some broken ones lie among them."""
    path = f"{workspace(s)}/documents"
    broken = df.limit(0).unionByName(s.createDataFrame([("x/broken.json", '{"findings": [', None)], "path string, text string, repo_key string").select(*df.columns))
    with shuffles_dropped(s):
        df.unionByName(broken).write.json(path, compression="gzip")
    return s.read.schema(df.schema).json(path)


def dealt(s, d):
    """Findings with the part of their repository, by the hash of their id, that they go to; rows move once, to where a part is put together.

    A finding's loads have the same part, so they meet there.
    """
    large = table(s, d, "findings").groupBy("repo_key").agg(F.ceil(F.count("*") / PER_DOCUMENT).alias("parts")).where("parts > 1")
    f = table(s, d, "findings").join(F.broadcast(large), "repo_key", "left").withColumn("part", x("coalesce(pmod(xxhash64(finding_id), parts), 0)")).drop("parts")
    return latest(f.repartition("repo_key", "part"), ["repo_key", "part", "finding_id"], ["loaded_at", "row_no"]).where("removed_at is null")


def reports(s, d):
    """Reports of the findings; those of a large repository are dealt to several, so no row grows with it."""
    f = dealt(s, d)
    strings = lambda c: F.from_json(c, "array<string>")
    refs = F.regexp_extract_all("control_refs", F.lit(r"([a-z]+:[A-Z]+-\d+)"), F.lit(1))
    one = F.struct(
        F.col("finding_id").alias("id"), "title", "severity", F.coalesce(strings("cwes"), F.array().cast("array<string>")).alias("cwes"), F.struct(F.when(~F.isnan("cvss_score"), F.col("cvss_score")).alias("score"), F.col("cvss_vector").alias("vector")).alias("cvss"),
        F.transform(F.concat(F.coalesce(strings("paths"), F.array().cast("array<string>")), F.array(F.lit(""))), lambda p: F.struct(p.alias("path"), F.lit("1-2").alias("lines"))).alias("locations"), F.when(F.col("row_no") % 3 > 0, F.col("fingerprint")).alias("fingerprint"), "validation_status", refs.alias("control_refs"),
        F.struct("validity", "resolution", "assurance", "last_updated").alias("disposition"), F.lit("kept").alias("unknown_key"),
    )
    listed = f.groupBy("repo_key", "part").agg(F.array_sort(F.collect_list(F.struct("row_no", one.alias("f")))).alias("l"))
    doc = F.to_json(F.struct(F.lit("Report").alias("title"), F.struct(F.concat(F.lit("https://x.test/"), "repo_key").alias("repository")).alias("metadata"), F.transform("l", lambda v: v["f"]).alias("findings")))
    return filed(s, listed.select(F.concat("repo_key", x("if(part > 0, concat('-', part), '')"), F.lit("-security-audit.json")).alias("path"), doc.alias("text"), "repo_key"))


_OWNFP = "sha256(concat_ws('|', 'https://x.test/' || repo_key, array_to_string(list_sort(coalesce(from_json(paths, '[\"VARCHAR\"]'), [])), ';'), from_json(cwes, '[\"VARCHAR\"]')[1]))"
_LIST = lambda c: f"'[' || array_to_string(list_transform({c}, lambda v: '\"' || v || '\"'), ',') || ']'"


@query(f"""WITH {FI}, n AS (SELECT *, coalesce(from_json(paths, '["VARCHAR"]'), []) AS pa, coalesce(from_json(cwes, '["VARCHAR"]'), []) AS cw, regexp_extract_all(control_refs, '[a-z]+:[A-Z]+-\\d+') AS cr FROM f)
  SELECT repo_key, finding_id, title, severity, cw[1] AS primary_cwe, {_LIST('cw')} AS cwes, CASE WHEN NOT isnan(cvss_score) THEN cvss_score END AS cvss_score, CASE WHEN row_no % 3 > 0 AND fingerprint IS NOT NULL THEN fingerprint ELSE {_OWNFP} END AS fingerprint, validity, resolution, assurance, validation_status, last_updated, {_LIST('pa')} AS paths, CASE WHEN len(cr) > 0 THEN {_LIST('cr')} END AS control_refs FROM n""")
def job_01_prj_01_findings(s, d):
    return pj.findings_table(reports(s, d)).drop("cvss_vector")


def layers(s, d):
    e = ledger(s, d).where("repo_key is not null")
    ev = F.struct("event_id", F.col("finding_id").alias("finding_ref"), "recorded_at", "occurred_at", F.struct(F.col("source_type").alias("type"), F.col("source_ref").alias("ref"), F.struct(F.col("actor_kind").alias("kind"), F.col("actor_identity").alias("identity")).alias("actor")).alias("source"), F.struct("validity", "resolution").alias("disposition"))
    refs = F.map_from_entries(F.collect_list(F.when((F.col("source_type") == "jira_filing") & F.col("finding_id").isNotNull(), F.struct(F.concat_ws("#", "finding_id", F.substring("event_id", 1, 6)).alias("k"), F.array(F.struct(F.when(F.col("row_no") % 2 == 0, "tracker").alias("system"), x("if(row_no % 5 = 0, '', substr(event_id, 1, 10))").alias("id"), F.lit("high").alias("confidence"))).alias("v")))))
    listed = e.groupBy("repo_key").agg(F.array_sort(F.collect_list(ev)).alias("events"), refs.alias("external_refs"))
    return filed(s, listed.select(F.concat("repo_key", F.lit("-findings-layer.json")).alias("path"), F.to_json(F.struct(F.struct("external_refs").alias("metadata"), "events")).alias("text"), "repo_key"))


@query(f"WITH {E} SELECT event_id, repo_key, finding_id, recorded_at, occurred_at, source_type, source_ref, actor_kind, actor_identity, validity, resolution FROM e WHERE repo_key IS NOT NULL")
def job_01_prj_02_events(s, d):
    return pj.events_table(layers(s, d))


@query(f"WITH {E} SELECT substr(event_id, 1, 10) AS cve, CASE WHEN row_no % 2 = 0 THEN 'tracker' ELSE 'cve' END AS system, repo_key, finding_id || '#' || substr(event_id, 1, 6) AS finding_id, 'high' AS confidence FROM e WHERE repo_key IS NOT NULL AND source_type = 'jira_filing' AND finding_id IS NOT NULL AND row_no % 5 > 0")
def job_01_provenance(s, d):
    return pj.provenance_table(layers(s, d)).select("cve", "system", "repo_key", "finding_id", "confidence")


@query(f"""WITH {R}, k AS (SELECT repo_key, tree, product, repo_dir, base, report_kind, findings_current, audit_json, CASE WHEN row_no % 4 = 0 THEN 'v' || row_no END AS dref, CASE WHEN row_no % 8 = 0 THEN 'branch' ELSE 'tag' END AS rk, nullif(regexp_extract(base, '__((release|stable)-\\d+\\.\\d+(\\.\\d+)?)$', 1), '') AS sref FROM r)
  SELECT concat_ws('/', tree, product, repo_dir, base) || CASE WHEN report_kind <> 'code-audit' THEN '#' || report_kind ELSE '' END AS repo_key, coalesce(dref, sref) AS ref, CASE WHEN dref IS NOT NULL THEN 'metadata' WHEN sref IS NOT NULL THEN 'slug' END AS ref_source, CASE WHEN sref IS NOT NULL THEN replace(base, '__' || sref, '') ELSE base END AS base_slug,
    (CASE WHEN dref IS NOT NULL THEN rk = 'branch' ELSE sref IS NOT NULL END)::INT AS is_branch_audit, (audit_json IS NULL AND findings_current IS NULL)::INT AS is_md_only, CASE WHEN findings_current IS NOT NULL THEN 'findings_current' WHEN audit_json IS NOT NULL THEN 'audit_json' ELSE 'audit_md_only' END AS preferred FROM k""")
def job_01_prj_03_04_05_06_repos(s, d):
    bundles = repos(s, d).select("tree", "ownership", "business_unit", "label", "product", "repo_dir", "base", "report_kind", "findings_current", "audit_json", x("if(row_no % 4 = 0, concat('v', row_no), null)").alias("declared_ref"), x("if(row_no % 8 = 0, 'branch', 'tag')").alias("ref_kind"))
    return pj.repos_table(bundles).select("repo_key", "ref", "ref_source", "base_slug", "is_branch_audit", "is_md_only", "preferred")


@query(f"""WITH {R}, {FI}, fo AS (SELECT regexp_replace(report_path, '/[^/]*$', '') AS folder, arg_min(repo_key, (is_branch_audit, repo_key)) AS repo_key FROM r WHERE report_path IS NOT NULL GROUP BY 1), p AS (SELECT repo_key AS src, any_value(regexp_replace(report_path, '/[^/]*$', '')) AS folder FROM r WHERE row_no % 5 > 0 GROUP BY 1)
  SELECT fo.repo_key, f.finding_id, f.validation_status AS verdict, 'reports/' || replace(f.repo_key, '/', '_') || '-validation.json' AS report_path FROM f LEFT JOIN p ON p.src = f.repo_key LEFT JOIN fo USING (folder) WHERE f.validation_status IS NOT NULL""")
def job_01_src_16_join_12_validations(s, d):
    named = repos(s, d).where("row_no % 5 > 0").select("repo_key", "report_path")
    f = findings(s, d).where("validation_status is not null").join(named, "repo_key", "left")
    entry = F.struct(x("if(row_no % 2 = 0, concat(repo_key, '/', finding_id), null)").alias("source_id"), x("if(row_no % 2 = 0, null, finding_id)").alias("finding_ref"), F.col("validation_status").alias("verdict"))
    docs = f.groupBy("repo_key").agg(F.collect_list(entry).alias("validated_findings"), F.array(F.struct(F.lit("audit").alias("kind"), F.lit("nowhere/x.json").alias("path")), F.struct(F.lit("audit").alias("kind"), F.max("report_path").alias("path"))).alias("source_reports"))
    named_docs = docs.select(F.concat(F.lit("reports/"), F.replace("repo_key", F.lit("/"), F.lit("_")), F.lit("-validation.json")).alias("path"), F.to_json(F.struct("source_reports", "validated_findings")).alias("text"), "repo_key")
    return pj.validations_table(filed(s, named_docs).drop("repo_key"), repos(s, d)).drop("technique")


@query(f"WITH {L} SELECT 'ADV:' || dst AS cve, 'm' AS module, src AS repo_id, max(CASE rel WHEN 'depends_on' THEN 'affected' ELSE 'not_observed' END) AS classification, max(CASE WHEN rel = 'imports_package' OR length(src) % 2 > 0 THEN 0 ELSE 1 END)::INT AS needs_manual_trace, 'impact/' || dst || '.json' AS artifact FROM l WHERE rel IN ('depends_on', 'imports_package') GROUP BY dst, src HAVING count(*) = 1")
def job_01_src_16_impact(s, d):
    e = links(s, d).where("rel in ('depends_on', 'imports_package')")
    single = e.groupBy("src", "dst").agg(F.max("rel").alias("rel"), F.count("*").alias("n")).where("n = 1")
    row = F.struct(F.col("src").alias("repo_id"), x("if(rel = 'depends_on', 'affected', 'not_observed')").alias("classification"), x("if(rel = 'depends_on', length(src) % 2 = 0, null)").alias("needs_manual_trace"))
    docs = single.groupBy("dst").agg(F.collect_list(row).alias("repos")).select(F.concat(F.lit("impact/"), "dst", F.lit(".json")).alias("path"), F.to_json(F.struct(F.concat(F.lit("ADV:"), "dst").alias("cve"), F.lit("m").alias("module"), "repos")).alias("text"), F.lit(None).cast("string").alias("repo_key"))
    return pj.impact_table(filed(s, docs).drop("repo_key")).drop("evidence_level")


@query(f"WITH {R} SELECT 'reg-' || tree AS register, 'D-' || row_no AS decision_id, repo_key AS repo, CASE WHEN row_no % 2 = 0 THEN 'done' END AS status, 'registers/' || tree || '.json' AS path FROM r")
def job_01_src_16_decisions(s, d):
    one = F.struct(F.concat(F.lit("D-"), F.col("row_no").cast("string")).alias("decision_id"), F.col("repo_key").alias("repo"), x("if(row_no % 2 = 0, 'done', null)").alias("status"))
    docs = repos(s, d).groupBy("tree").agg(F.collect_list(one).alias("decisions")).select(F.concat_ws("", F.lit("registers/"), "tree", F.lit(".json")).alias("path"), F.to_json(F.struct(F.concat(F.lit("reg-"), "tree").alias("register"), "decisions")).alias("text"), F.lit(None).cast("string").alias("repo_key"))
    return pj.decisions_table(filed(s, docs).drop("repo_key")).select("register", "decision_id", "repo", "status", "path")


@query("SELECT src AS from_id, dst AS to_id, rel, count(*) AS n FROM edges GROUP BY ALL")
def job_01_src_12_graph_edges(s, d):
    e = table(s, d, "edges").groupBy("rel").agg(F.collect_list(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "rel", F.lit("b").alias("branch"))).alias("edges"))
    docs = e.select(F.concat("rel", F.lit(".json")).alias("path"), F.to_json(F.struct("edges")).alias("text"), F.lit(None).cast("string").alias("repo_key"))
    return pj.graph_edges_table(filed(s, docs).drop("repo_key")).groupBy("from_id", "to_id", "rel").agg(F.count("*").alias("n"))


@query(f"WITH {R}, {FI} SELECT 'findings' AS name, count(*) AS n FROM f UNION ALL SELECT 'repos', count(*) FROM r UNION ALL SELECT 'v_open', count(*) FROM f JOIN r USING (repo_key) WHERE coalesce(resolution, 'open') NOT IN ('resolved', 'risk_accepted') AND coalesce(validity, 'confirmed') NOT IN ('false_positive', 'hardening')")
def job_01_snk_01_src_08_build(s, d):
    """The build written, read back by its index, and the view of open findings over it."""
    path = workspace(s)
    tables = {"findings": pj.findings_table(reports(s, d)), "repos": repos(s, d)}
    counts = pj.write(s, path, tables, {"results_root": "x"})
    found, way = pj.records(s, path, lambda: repos(s, d).limit(0))
    assert way == "index"
    from quarryline.plans.relational import is_open

    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    view = pj.read(s, path, "findings").where(is_open()).join(found.select("repo_key"), "repo_key")
    return s.createDataFrame(sorted(counts.items()), "name string, n bigint").unionByName(n(view, "v_open"))
