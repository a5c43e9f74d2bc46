"""Queries over the projection and the portfolio graph, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.functions import text as fx
from quarryline.operators import relational as rel
from quarryline.plans.registry import registry
from quarryline.workspace import table

QUERIES, SQL, query = registry()

#: Resolutions and validities that close a finding; fixed values.
CLOSED, UNTRUE = ("resolved", "risk_accepted"), ("false_positive", "hardening")
OPEN_SQL = "coalesce(resolution, 'open') NOT IN ('resolved', 'risk_accepted') AND coalesce(validity, 'confirmed') NOT IN ('false_positive', 'hardening')"
#: Artifact columns of repos by family; fixed values.
ARTIFACTS = {"audit_json": "audit", "audit_md": "audit_md", "findings_current": "current", "findings_layer": "layer", "triage_json": "triage", "threat_model": "threat_model", "priv_profile": "profile"}


def repos(s: SparkSession, d: str) -> DataFrame:
    return rel.latest(table(s, d, "repos"), ["repo_key"], ["loaded_at", "row_no"]).where("removed_at is null")


def findings(s: SparkSession, d: str) -> DataFrame:
    return rel.latest(table(s, d, "findings"), ["repo_key", "finding_id"], ["loaded_at", "row_no"]).where("removed_at is null")


def ledger(s: SparkSession, d: str) -> DataFrame:
    return rel.latest(table(s, d, "finding_events"), ["event_id", "repo_key"], ["recorded_at", "row_no"])


def links(s: SparkSession, d: str) -> DataFrame:
    """Edges without repetition: one per (src, dst, rel), the greatest attributes."""
    return table(s, d, "edges").groupBy("src", "dst", "rel").agg(F.max("attrs").alias("attrs"))


def is_open():
    return ~F.coalesce("resolution", F.lit("open")).isin(*CLOSED) & ~F.coalesce("validity", F.lit("confirmed")).isin(*UNTRUE)


R = "r AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY loaded_at DESC, row_no DESC) AS rn FROM repos) WHERE rn = 1 AND removed_at IS NULL)"
FI = "f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY repo_key, finding_id ORDER BY loaded_at DESC, row_no DESC) AS rn FROM findings) WHERE rn = 1 AND removed_at IS NULL)"
E = "e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id, repo_key ORDER BY recorded_at DESC, row_no DESC) AS rn FROM finding_events) WHERE rn = 1)"
L = "l AS (SELECT src, dst, rel, max(attrs) AS attrs FROM edges GROUP BY ALL)"
OPEN = f"{R}, {FI}, o AS (SELECT f.*, r.tree, r.ownership, r.business_unit, r.product, r.is_branch_audit, r.repo_url FROM f JOIN r USING (repo_key) WHERE {OPEN_SQL})"


def open_findings(s, d):
    return findings(s, d).where(is_open()).join(repos(s, d).select("repo_key", "tree", "ownership", "business_unit", "product", "is_branch_audit", "repo_url"), "repo_key")


# ---- sources and projections

@query("SELECT dataset, sum(CASE WHEN json_valid(body) THEN 1 ELSE 0 END)::BIGINT AS n_valid, sum(CASE WHEN json_valid(body) THEN 0 ELSE 1 END)::BIGINT AS n_bad FROM raw_records GROUP BY 1")
def src_04_tolerant_json(s, d):
    good = F.try_parse_json("body").isNotNull()
    return table(s, d, "raw_records").groupBy("dataset").agg(F.count_if(good).alias("n_valid"), F.count_if(~good).alias("n_bad"))


@query(f"""WITH {R} SELECT repo_key, regexp_extract(report_path, '([^/]+)-(security-audit|cloud-config-audit|container-audit|findings-current)\\.(json|md)$', 1) AS base_found,
  regexp_extract(report_path, '([^/]+)-(security-audit|cloud-config-audit|container-audit|findings-current)\\.(json|md)$', 2) AS suffix FROM r""")
def src_02_report_kind(s, d):
    pattern = r"([^/]+)-(security-audit|cloud-config-audit|container-audit|findings-current)\.(json|md)$"
    return repos(s, d).select("repo_key", F.regexp_extract("report_path", pattern, 1).alias("base_found"), F.regexp_extract("report_path", pattern, 2).alias("suffix"))


_ARTIFACT_SQL = " UNION ALL ".join(f"SELECT repo_key, '{family}' AS family, {c} AS path FROM r WHERE {c} IS NOT NULL" for c, family in ARTIFACTS.items())


@query(f"WITH {R} {_ARTIFACT_SQL}")
def src_03_companions(s, d):
    return repos(s, d).select("repo_key", F.explode(F.array(*[F.struct(F.lit(v).alias("family"), F.col(k).alias("path")) for k, v in ARTIFACTS.items()])).alias("a")).select("repo_key", "a.family", "a.path").where("path is not null")


@query(f"WITH {R} SELECT repo_key, coalesce(findings_current, audit_json) AS path FROM r WHERE coalesce(findings_current, audit_json) IS NOT NULL")
def src_21_report_sweep(s, d):
    current = repos(s, d).where("findings_current is not null").select("repo_key", F.col("findings_current").alias("path"))
    raw = repos(s, d).where("audit_json is not null").select("repo_key", F.col("audit_json").alias("path"))
    return current.unionByName(raw.join(current, "repo_key", "left_anti"))


@query("SELECT report_path, min(repo_key) AS repo_key FROM repos WHERE report_path IS NOT NULL GROUP BY 1")
def src_22_distinct_reports(s, d):
    return table(s, d, "repos").where("report_path is not null").groupBy("report_path").agg(F.min("repo_key").alias("repo_key"))


@query(f"""WITH {R} SELECT repo_key, concat_ws('/', tree, product, repo_dir, base) || CASE WHEN report_kind <> 'code-audit' THEN '#' || report_kind ELSE '' END AS built_key,
  CASE WHEN findings_current IS NOT NULL THEN 'findings_current' WHEN audit_json IS NOT NULL THEN 'audit_json' ELSE 'audit_md_only' END AS preferred_form,
  CASE WHEN ref_source = 'metadata' THEN coalesce(ref_kind, '') = 'branch' ELSE ref IS NOT NULL END AS is_branch, coalesce(nullif(ref, ''), nullif(regexp_extract(base, '__((release|stable)-\\d+\\.\\d+(\\.\\d+)?)$', 1), '')) AS any_ref FROM r""")
def prj_03_04_05_06_repo(s, d):
    kind = F.when(F.col("report_kind") != "code-audit", F.concat(F.lit("#"), "report_kind")).otherwise("")
    return repos(s, d).select(
        "repo_key", F.concat(F.concat_ws("/", "tree", "product", "repo_dir", "base"), kind).alias("built_key"),
        F.when(F.col("findings_current").isNotNull(), "findings_current").when(F.col("audit_json").isNotNull(), "audit_json").otherwise("audit_md_only").alias("preferred_form"),
        F.when(F.col("ref_source") == "metadata", F.coalesce("ref_kind", F.lit("")) == "branch").otherwise(F.col("ref").isNotNull()).alias("is_branch"),
        F.coalesce(F.nullif("ref", F.lit("")), fx.branch_of(F.col("base"))).alias("any_ref"),
    )


@query(f"WITH {FI} SELECT repo_key, finding_id, len(from_json(paths, '[\"VARCHAR\"]'))::INT AS n_paths, array_to_string(from_json(cwes, '[\"VARCHAR\"]'), ';') AS cwe_list FROM f")
def prj_01_nested_lists(s, d):
    strings = lambda c: F.from_json(c, "array<string>")
    return findings(s, d).select("repo_key", "finding_id", F.when(F.col("paths").isNotNull(), F.size(strings("paths"))).alias("n_paths"), F.when(F.col("cwes").isNotNull(), F.array_join(strings("cwes"), ";")).alias("cwe_list"))


# ---- views and filters

@query(f"WITH {OPEN} SELECT repo_key, finding_id, severity, validity, resolution, tree, ownership FROM o")
def view_01_open(s, d):
    return open_findings(s, d).select("repo_key", "finding_id", "severity", "validity", "resolution", "tree", "ownership")


@query(f"WITH {R}, {FI} SELECT repo_key, finding_id, severity, tree FROM f JOIN r USING (repo_key) WHERE validity = 'hardening'")
def view_02_hardening(s, d):
    return findings(s, d).where("validity = 'hardening'").join(repos(s, d).select("repo_key", "tree"), "repo_key").select("repo_key", "finding_id", "severity", "tree")


@query(f"WITH {OPEN} SELECT fingerprint, count(*) AS occurrences, max(severity) AS severity_example, min(repo_key) AS first_repo FROM o WHERE ownership = 'owned' AND is_branch_audit = 0 AND fingerprint IS NOT NULL GROUP BY 1")
def view_03_distinct_owned(s, d):
    return open_findings(s, d).where("ownership = 'owned' and is_branch_audit = 0 and fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("occurrences"), F.max("severity").alias("severity_example"), F.min("repo_key").alias("first_repo"))


@query(f"WITH {R} SELECT repo_key, tree FROM r WHERE tree IN ('findings', 'upstream') AND coalesce(ownership, '') <> 'harness-qa'")
def flt_01_tree_subset(s, d):
    return repos(s, d).where(F.col("tree").isin("findings", "upstream") & (F.coalesce("ownership", F.lit("")) != "harness-qa")).select("repo_key", "tree")


_PATHS = f"{FI}, p AS (SELECT repo_key, finding_id, unnest(from_json(paths, '[\"VARCHAR\"]')) AS path FROM f)"


def finding_paths(s, d):
    return findings(s, d).select("repo_key", "finding_id", "severity", "primary_cwe", F.explode(F.from_json("paths", "array<string>")).alias("path"))


# ---- joins

@query(f"WITH {R}, {FI} SELECT f.repo_key, finding_id, tree, business_unit FROM f JOIN r USING (repo_key)")
def join_01_findings_repos(s, d):
    return findings(s, d).join(repos(s, d).select("repo_key", "tree", "business_unit"), "repo_key").select("repo_key", "finding_id", "tree", "business_unit")


@query(f"WITH {L} SELECT n.id, coalesce((SELECT min(l.dst) FROM l WHERE l.src = n.id AND l.rel = 'owned-by'), '(unassigned)') AS owner FROM (SELECT DISTINCT id FROM nodes) n")
def join_03_owner_default(s, d):
    owner = links(s, d).where("rel = 'owned-by'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("owner"))
    return table(s, d, "nodes").select("id").distinct().join(owner, "id", "left").select("id", F.coalesce("owner", F.lit("(unassigned)")).alias("owner"))


@query(f"WITH {L} SELECT DISTINCT src FROM l WHERE rel = 'consumes_group' AND dst IN (SELECT dst FROM l WHERE rel = 'in_group')")
def join_06_semi(s, d):
    groups = links(s, d).where("rel = 'in_group'").select("dst").distinct()
    return links(s, d).where("rel = 'consumes_group'").join(groups, "dst", "left_semi").select("src").distinct()


@query(f"WITH {L} SELECT l.src, l.dst, n.label FROM l JOIN nodes p ON p.id = l.src AND p.kind IN ('repo', 'category') JOIN nodes n ON n.id = l.dst AND n.kind = 'repo-ref' WHERE rel = 'has_ref' AND json_extract_string(l.attrs, '$.via') IN ('spine', 'registry')")
def join_07_refs(s, d):
    nodes = table(s, d, "nodes")
    chosen = links(s, d).where((F.col("rel") == "has_ref") & F.get_json_object("attrs", "$.via").isin("spine", "registry"))
    return chosen.join(nodes.where(F.col("kind").isin("repo", "category")).select(F.col("id").alias("src")), "src").join(nodes.where("kind = 'repo-ref'").select(F.col("id").alias("dst"), "label"), "dst").select("src", "dst", "label")


@query(f"WITH {R}, {E}, dirs AS (SELECT repo_dir, arg_min(repo_key, (is_branch_audit, repo_key)) AS repo_key FROM r GROUP BY 1), x AS (SELECT event_id, e.repo_key AS named, split_part(e.repo_key, '/', -2) AS dir FROM e) SELECT event_id, named, d.repo_key FROM x LEFT JOIN dirs d ON d.repo_dir = x.dir")
def join_12_directory_key(s, d):
    dirs = repos(s, d).groupBy("repo_dir").agg(F.min_by("repo_key", F.struct("is_branch_audit", "repo_key")).alias("repo_key"))
    named = ledger(s, d).select("event_id", F.col("repo_key").alias("named"), F.get(F.split("repo_key", "/"), F.size(F.split("repo_key", "/")) - 2).alias("repo_dir"))
    return named.join(dirs, "repo_dir", "left").select("event_id", "named", "repo_key")


@query(f"WITH {E}, k AS (SELECT repo_key, event_id, recorded_at, CASE WHEN source_type = 'routing' THEN actor_identity END AS signal FROM e) SELECT repo_key, event_id, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY repo_key ORDER BY recorded_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unattributed') AS active FROM k")
def join_16_win_06_locf(s, d):
    marked = ledger(s, d).select("repo_key", "event_id", "recorded_at", F.when(F.col("source_type") == "routing", F.col("actor_identity")).alias("signal"))
    return rel.with_last(marked, ["repo_key"], ["recorded_at", "event_id"], {"active": F.col("signal")}).select("repo_key", "event_id", F.coalesce("active", F.lit("unattributed")).alias("active"))


@query(f"WITH {FI}, {E} SELECT repo_key, finding_id FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo_key = f.repo_key AND e.finding_id = f.finding_id)")
def join_20_anti(s, d):
    return findings(s, d).join(ledger(s, d).select("repo_key", "finding_id"), ["repo_key", "finding_id"], "left_anti").select("repo_key", "finding_id")


@query(f"WITH {FI}, {E}, c AS (SELECT repo_key, finding_id, count(*) AS n FROM e GROUP BY ALL) SELECT f.repo_key, f.finding_id, coalesce(c.n, 0) AS n_events FROM f LEFT JOIN c USING (repo_key, finding_id)")
def join_26_missing_default(s, d):
    n = ledger(s, d).groupBy("repo_key", "finding_id").agg(F.count("*").alias("n"))
    return findings(s, d).join(n, ["repo_key", "finding_id"], "left").select("repo_key", "finding_id", F.coalesce("n", F.lit(0)).alias("n_events"))


# ---- aggregates

@query("SELECT rel, count(*) AS n FROM (SELECT DISTINCT src, dst, rel FROM edges) GROUP BY 1")
def agg_01_by_rel(s, d):
    return links(s, d).groupBy("rel").agg(F.count("*").alias("n"))


@query(f"WITH {FI}, d AS (SELECT severity, date_diff('day', CAST(min_loaded AS DATE), CAST(loaded_at AS DATE)) AS days FROM (SELECT f.*, (SELECT min(loaded_at) FROM findings) AS min_loaded FROM f)), s AS (SELECT severity, days, row_number() OVER (PARTITION BY severity ORDER BY days) - 1 AS i, count(*) OVER (PARTITION BY severity) AS n FROM d) SELECT severity, days::INT AS median_days FROM s WHERE i = n // 2")
def agg_12_upper_median(s, d):
    first = table(s, d, "findings").agg(F.min("loaded_at").alias("first_at"))
    days = findings(s, d).join(F.broadcast(first), F.lit(True)).select("severity", F.datediff(F.col("loaded_at").cast("date"), F.col("first_at").cast("date")).alias("days"))
    # counts per value, so no group's values are gathered
    counted = days.groupBy("severity", "days").agg(F.count("*").alias("n"))
    running = counted.withColumn("upto", F.sum("n").over(W.partitionBy("severity").orderBy("days"))).withColumn("total", F.sum("n").over(W.partitionBy("severity")))
    return running.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("severity").agg(F.min("days").alias("median_days"))


@query(f"WITH {FI}, g AS (SELECT repo_key, bool_or(severity = 'critical') AS any_critical, bool_and(severity IN ('low', 'informational')) AS only_minor, count(*) AS n FROM f GROUP BY 1) SELECT * FROM g")
def agg_36_booleans(s, d):
    return findings(s, d).groupBy("repo_key").agg(F.bool_or(F.col("severity") == "critical").alias("any_critical"), F.bool_and(F.col("severity").isin("low", "informational")).alias("only_minor"), F.count("*").alias("n"))


# ---- windows, sorts, sets

@query(f"WITH {R}, c AS (SELECT ref, count(*) AS n FROM r WHERE ref LIKE 'release-%' GROUP BY 1) SELECT ref, n FROM c ORDER BY n DESC, try_cast(split_part(substr(ref, 9), '.', 1) AS INT) DESC, try_cast(split_part(substr(ref, 9), '.', 2) AS INT) DESC LIMIT 5")
def win_12_top_refs(s, d):
    c = repos(s, d).where(F.col("ref").startswith("release-")).groupBy("ref").agg(F.count("*").alias("n"))
    part = lambda i: F.get(F.split(F.substring("ref", 9, 50), r"\."), F.lit(i)).try_cast("int")
    return c.orderBy(F.desc("n"), part(0).desc(), part(1).desc()).limit(5)


@query("SELECT src AS id FROM edges INTERSECT SELECT id FROM nodes")
def set_04_intersect(s, d):
    return table(s, d, "edges").select(F.col("src").alias("id")).intersect(table(s, d, "nodes").select("id"))


# ---- graph

@query("""WITH RECURSIVE g AS (SELECT DISTINCT src, dst FROM edges WHERE rel = 'depends_on'), start AS (SELECT DISTINCT src AS origin FROM g WHERE src LIKE 'repo:%'),
  walk(origin, node, depth) AS (SELECT origin, origin, 0 FROM start UNION SELECT w.origin, g.dst, w.depth + 1 FROM walk w JOIN g ON g.src = w.node WHERE w.depth < 3) SELECT origin, node, min(depth) AS depth FROM walk GROUP BY 1, 2""")
def grf_16_reach(s, d):
    g = table(s, d, "edges").where("rel = 'depends_on'").select("src", "dst").distinct()
    return rel.reach(g, g.where(F.col("src").startswith("repo:")).select(F.col("src").alias("origin")).distinct(), 3)


# ---- scalar functions and quality rules

@query("""SELECT row_no, regexp_replace(regexp_replace(nullif(regexp_extract(repo_url, '(https?://[^\\s<>"'')]+)', 1), ''), '[./]+$', ''), '\\.git$', '') AS url, regexp_replace(lower(base_slug), '[^a-z0-9]', '', 'g') AS slug,
  sha256(concat_ws('|', repo_key, base)) AS digest FROM (SELECT DISTINCT row_no, repo_url, base_slug, repo_key, base FROM repos)""")
def fn_str_01_04_hash(s, d):
    return table(s, d, "repos").select("row_no", "repo_url", "base_slug", "repo_key", "base").distinct().select("row_no", fx.repo_url(F.col("repo_url")).alias("url"), fx.slugify(F.col("base_slug")).alias("slug"), F.sha2(F.concat_ws("|", "repo_key", "base"), 256).alias("digest"))


@query(f"""WITH {FI} SELECT repo_key, finding_id, CASE WHEN cvss_score IS NULL OR isnan(cvss_score) THEN 'none' WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium' WHEN cvss_score > 0 THEN 'low' ELSE 'none' END AS band,
  try_cast(nullif(regexp_extract(primary_cwe, '(\\d+)', 1), '') AS INT) AS cwe_no FROM f""")
def fn_math_02_bands(s, d):
    return findings(s, d).select("repo_key", "finding_id", fx.cvss_band(F.col("cvss_score")).alias("band"), fx.cwe_number(F.col("primary_cwe")).alias("cwe_no"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def scan_pushdown(s, d):
    return table(s, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query(f"""WITH {FI}, {R}, {E}, t AS (SELECT repo_key, finding_id, min(substr(recorded_at, 1, 10)) FILTER (WHERE source_type = 'jira_filing') AS filed, min(substr(recorded_at, 1, 10)) AS first, max(substr(recorded_at, 1, 10)) FILTER (WHERE resolution IN ('resolved', 'fix_verified')) AS resolved FROM e GROUP BY 1, 2),
  a AS (SELECT repo_key, CASE WHEN regexp_matches(audit_date, '^\\d{{4}}-\\d\\d-\\d\\d') THEN substr(audit_date, 1, 10) END AS audited FROM r)
  SELECT f.repo_key, f.finding_id, try_cast(coalesce(filed, first, audited) AS DATE) AS started, CASE WHEN filed IS NOT NULL THEN 'filed' WHEN first IS NOT NULL THEN 'event' WHEN audited IS NOT NULL THEN 'audit' END AS by_what, try_cast(resolved AS DATE) AS resolved FROM f LEFT JOIN t USING (repo_key, finding_id) LEFT JOIN a USING (repo_key)""")
def win_10_11_clock(s, d):
    """When the clock of a finding starts: its first filing, else its first event, else the audit; and its last resolution."""
    day = F.substring("recorded_at", 1, 10)
    at = lambda c: F.when(c, day)
    t = ledger(s, d).groupBy("repo_key", "finding_id").agg(F.min(at(F.col("source_type") == "jira_filing")).alias("filed"), F.min(day).alias("first"), F.max(at(F.col("resolution").isin("resolved", "fix_verified"))).alias("resolved"))
    audited = repos(s, d).select("repo_key", F.when(F.col("audit_date").rlike(r"^\d{4}-\d\d-\d\d"), F.substring("audit_date", 1, 10)).alias("audited"))
    joined = findings(s, d).select("repo_key", "finding_id").join(t, ["repo_key", "finding_id"], "left").join(audited, "repo_key", "left")
    by = F.when(F.col("filed").isNotNull(), "filed").when(F.col("first").isNotNull(), "event").when(F.col("audited").isNotNull(), "audit")
    return joined.select("repo_key", "finding_id", F.coalesce("filed", "first", "audited").try_cast("date").alias("started"), by.alias("by_what"), F.col("resolved").try_cast("date").alias("resolved"))


@query(f"WITH {L} SELECT dst, count(DISTINCT src) AS sources, sum(coalesce(try_cast(regexp_extract(json_extract_string(attrs, '$.version'), '(\\d+)$', 1) AS BIGINT), 0))::BIGINT AS total FROM l WHERE rel = 'imports_package' GROUP BY 1")
def agg_04_package_sums(s, d):
    """Sum of a number kept in edges' attributes, and distinct sources, per package."""
    number = F.regexp_extract(F.get_json_object("attrs", "$.version"), r"(\d+)$", 1).try_cast("bigint")
    return links(s, d).where("rel = 'imports_package'").groupBy("dst").agg(F.countDistinct("src").alias("sources"), F.sum(F.coalesce(number, F.lit(0))).alias("total"))


@query(f"WITH {FI}, g AS (SELECT repo_key, coalesce(severity, 'none') AS s, count(*) AS n FROM f GROUP BY 1, 2) SELECT repo_key, sum(n)::BIGINT AS total, string_agg(s || '=' || n, ',' ORDER BY s) AS by_severity FROM g GROUP BY 1")
def agg_33_by_severity(s, d):
    """A scan's summary: findings in all and by severity."""
    g = findings(s, d).groupBy("repo_key", F.coalesce("severity", F.lit("none")).alias("s")).agg(F.count("*").alias("n"))
    return g.groupBy("repo_key").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "s", F.col("n").cast("string")))), ",").alias("by_severity"))


# ---- grouped attributes, pivots, products

@query("SELECT kind, coalesce(json_extract_string(attrs, '$.internal'), 'none') AS internal, count(*) AS n FROM (SELECT DISTINCT id, kind, attrs FROM nodes) GROUP BY ALL")
def agg_06_08_grouped_json(s, d):
    return table(s, d, "nodes").select("id", "kind", "attrs").distinct().groupBy("kind", F.coalesce(F.get_json_object("attrs", "$.internal"), F.lit("none")).alias("internal")).agg(F.count("*").alias("n"))


@query(f"WITH {L} SELECT rel, count(DISTINCT src) FILTER (WHERE json_extract_string(attrs, '$.indirect') = 'true') AS n_src_indirect, count(DISTINCT src) AS n_src FROM l GROUP BY 1")
def agg_07_conditional_distinct(s, d):
    return links(s, d).groupBy("rel").agg(F.countDistinct(F.when(F.get_json_object("attrs", "$.indirect") == "true", F.col("src"))).alias("n_src_indirect"), F.countDistinct("src").alias("n_src"))


@query(f"WITH {FI}, p AS (SELECT severity, count(*) FILTER (WHERE validity = 'confirmed') AS confirmed, count(*) FILTER (WHERE validity = 'false_positive') AS false_positive, count(*) FILTER (WHERE validity = 'hardening') AS hardening FROM f GROUP BY 1) SELECT * FROM p")
def agg_32_33_pivot(s, d):
    names = ["confirmed", "false_positive", "hardening"]
    return findings(s, d).groupBy("severity").pivot("validity", names).agg(F.count(F.lit(1))).select("severity", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


@query(f"WITH {L} SELECT DISTINCT l.dst AS repo, l.src AS product FROM l JOIN nodes n ON n.id = l.src AND n.kind IN ('product', 'segment', 'release') WHERE rel IN ('contains', 'includes', 'owns')")
def grf_08_products(s, d):
    kinds = table(s, d, "nodes").where(F.col("kind").isin("product", "segment", "release")).select(F.col("id").alias("src"))
    return links(s, d).where(F.col("rel").isin("contains", "includes", "owns")).join(kinds, "src").select(F.col("dst").alias("repo"), F.col("src").alias("product")).distinct()
