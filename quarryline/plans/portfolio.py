"""Impact of advisories, compliance, owners and the corpus, over the projection and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.operators import portfolio as po
from quarryline.plans.registry import registry
from quarryline.plans.relational import E, FI, L, OPEN, R, findings, ledger, links, open_findings, repos
from quarryline.workspace import table

QUERIES, SQL, query = registry()
x = F.expr

# ---- impact

_NUM = lambda v: f"list_transform(string_split(regexp_extract({v}, '^v?(\\d+\\.\\d+\\.\\d+)', 1), '.'), lambda x: CAST(x AS BIGINT))"
_USE = f"""{L}, u AS (SELECT src AS repo, split_part(dst, ':', 1) AS package, dst, rel, json_extract_string(attrs, '$.version') AS version, json_extract_string(attrs, '$.indirect') AS indirect FROM l WHERE rel IN ('depends_on', 'imports_package', 'consumes_group')),
  adv AS (SELECT DISTINCT 'ADV-' || package AS advisory, package, CASE length(package) % 3 WHEN 0 THEN [1, 5, 0] WHEN 1 THEN [0, 9, 0] ELSE [0, 0, 0] END::BIGINT[] AS low, CASE WHEN length(package) % 2 = 0 THEN [3, 0, 0] ELSE [2, 20, 0] END::BIGINT[] AS high FROM u),
  rg AS (SELECT advisory, repo, u.package, dst, rel, indirect, version, CASE WHEN regexp_matches(version, '^v?\\d+\\.\\d+\\.\\d+') THEN {_NUM('version')} >= low AND {_NUM('version')} < high END AS in_range FROM u JOIN adv USING (package))"""


def uses(s, d):
    e = links(s, d).where("rel in ('depends_on', 'imports_package', 'consumes_group')")
    return e.select(F.col("src").alias("repo"), F.lit("go").alias("ecosystem"), F.substring_index("dst", ":", 1).alias("package"), "dst", "rel", F.get_json_object("attrs", "$.version").alias("version"), F.get_json_object("attrs", "$.indirect").alias("indirect"))


def advisories(s, d):
    names = uses(s, d).select("package").distinct()
    return names.select(F.concat(F.lit("ADV-"), "package").alias("advisory"), F.lit("go").alias("ecosystem"), "package", x("case length(package) % 3 when 0 then '>= v1.5.0, <v9.0.0' when 1 then '>=v0.9.0' else '' end").alias("range"), x("if(length(package) % 2 = 0, 'v3.0.0', 'v2.20.0')").alias("fixed"))


def ranged(s, d):
    both = uses(s, d).join(advisories(s, d), ["ecosystem", "package"])
    return both.withColumn("in_range", po.in_vulnerable_range(F.col("version"), F.col("range"), F.col("fixed"), F.col("ecosystem")))


@query(f"WITH {_USE} SELECT advisory, repo, dst, rel, version, CAST(in_range AS VARCHAR) AS in_range FROM rg")
def join_15_fn_ver_01_02_ranges(s, d):
    return ranged(s, d).select("advisory", "repo", "dst", "rel", "version", F.col("in_range").cast("string").alias("in_range"))


_CLS = f"""{_USE}, im AS (SELECT DISTINCT src FROM l WHERE rel = 'imports_package'), k AS (SELECT rg.*, CASE WHEN in_range = false THEN 'version_not_in_range' WHEN rel = 'depends_on' AND indirect = 'false' AND length(repo) % 4 = 0 THEN 'affected' WHEN length(repo) % 5 = 0 THEN CASE WHEN indirect = 'true' THEN 'likely_affected' ELSE 'affected' END
  WHEN indirect = 'true' THEN 'not_observed' WHEN im.src IS NOT NULL THEN CASE WHEN length(repo) % 7 = 0 OR length(repo) % 5 = 0 THEN 'not_observed' ELSE 'likely_affected' END WHEN length(repo) % 3 = 0 THEN 'likely_affected' WHEN length(repo) % 3 = 1 AND length(repo) % 2 = 0 THEN 'not_observed' WHEN length(repo) % 2 = 0 THEN 'likely_affected' ELSE 'inconclusive' END AS classification FROM rg LEFT JOIN im ON im.src = rg.repo)"""


def classified(s, d):
    imports = links(s, d).where("rel = 'imports_package'").select(F.col("src").alias("repo"), F.lit(True).alias("imported")).distinct()
    r = ranged(s, d).join(imports, "repo", "left")
    evidence = {
        "in_range": F.col("in_range"), "imported": F.col("imported"), "reachability": x("case when indirect = 'true' then 'module_required_not_observed' when rel = 'depends_on' and indirect = 'false' and length(repo) % 4 = 0 then 'symbol_reachable' end"),
        "features": x("case when length(repo) % 5 = 0 then 2 when length(repo) % 7 = 0 then 0 end"), "symbols": x("if(length(repo) % 3 = 0, 'symbols_used', null)"), "manifest": x("if(length(repo) % 3 = 1, 'module_not_in_manifests', null)"), "source": x("if(length(repo) % 2 = 0 and length(repo) % 3 <> 1, 'imports_found', null)"),
    }
    return r.withColumn("classification", po.impact_class(**evidence))


@query(f"WITH {_CLS} SELECT advisory, repo, dst, rel, classification FROM k".replace("WHEN length(repo) % 3 = 1 AND length(repo) % 2 = 0 THEN 'not_observed'", "WHEN length(repo) % 3 = 1 THEN 'not_observed'"))
def job_06_impact(s, d):
    return classified(s, d).select("advisory", "repo", "dst", "rel", "classification")


_SUM = _CLS.replace("WHEN length(repo) % 3 = 1 AND length(repo) % 2 = 0 THEN 'not_observed'", "WHEN length(repo) % 3 = 1 THEN 'not_observed'")


@query(f"""WITH {_SUM}, sf AS (SELECT DISTINCT dst AS repo, src AS surface FROM l WHERE rel IN ('ships', 'contains', 'includes')), h AS (SELECT advisory, string_agg(DISTINCT surface, ',' ORDER BY surface) AS surfaces FROM k JOIN sf USING (repo) WHERE classification IN ('affected', 'likely_affected') GROUP BY 1)
  SELECT k.advisory, {', '.join(f"count(*) FILTER (WHERE classification = '{c}') AS {c}" for c in po.IMPACT_CLASSES)}, count(*) FILTER (WHERE in_range) AS n_in_range, any_value(h.surfaces) AS surfaces FROM k LEFT JOIN h USING (advisory) GROUP BY 1""")
def agg_32_grf_08_summary(s, d):
    surfaces = links(s, d).where("rel in ('ships', 'contains', 'includes')").select(F.col("dst").alias("repo"), F.col("src").alias("surface")).distinct()
    return po.impact_summary(classified(s, d), surfaces)


# ---- compliance

_OWN = f"{R}, ow AS (SELECT repo_key, 'owner-team:' || business_unit AS from_id, 'repo:' || replace(replace(coalesce(repo_url, ''), 'https://', ''), '.git', '') AS to_id FROM r WHERE row_no % 4 > 0)"


def owner_edges(s, d):
    key = F.concat(F.lit("repo:"), F.replace(F.replace(F.coalesce("repo_url", F.lit("")), F.lit("https://"), F.lit("")), F.lit(".git"), F.lit("")))
    return repos(s, d).where("row_no % 4 > 0").select("repo_key", F.concat(F.lit("owner-team:"), "business_unit").alias("from_id"), key.alias("to_id"))


def repo_node():
    return F.concat(F.lit("repo:"), F.replace(F.replace(F.coalesce("repo_url", F.lit("")), F.lit("https://"), F.lit("")), F.lit(".git"), F.lit("")))


@query(f"""WITH {OPEN}, ow AS (SELECT 'owner-team:' || business_unit AS from_id, 'repo:' || replace(replace(coalesce(repo_url, ''), 'https://', ''), '.git', '') AS to_id FROM r WHERE row_no % 4 > 0), t AS (SELECT to_id, min(replace(from_id, 'owner-team:', '')) AS team FROM ow GROUP BY 1),
  x AS (SELECT coalesce(team, '(unassigned)') AS team, regexp_extract_all(control_refs, '[a-z]+:[A-Z]+-\\d+') AS refs FROM o LEFT JOIN t ON t.to_id = 'repo:' || replace(replace(coalesce(o.repo_url, ''), 'https://', ''), '.git', '') WHERE control_refs IS NOT NULL), c AS (SELECT team, count(DISTINCT ref) AS n FROM (SELECT team, unnest(refs) AS ref FROM x) GROUP BY 1)
  SELECT x.team, count(*) AS n_findings, coalesce(any_value(c.n), 0) AS n_controls FROM x LEFT JOIN c USING (team) GROUP BY 1""")
def agg_30_join_03_team_controls(s, d):
    owners = owner_edges(s, d).select(F.col("to_id").alias("repo"), F.replace("from_id", F.lit("owner-team:"), F.lit("")).alias("team"))
    refs = F.regexp_extract_all("control_refs", F.lit(r"([a-z]+:[A-Z]+-\d+)"), F.lit(1))
    return po.team_controls(open_findings(s, d).withColumn("repo", repo_node()), owners, refs)


@query(f"""WITH {_OWN}, both_ways AS (SELECT repo_key, to_id AS node, from_id AS other FROM ow UNION SELECT repo_key, from_id, to_id FROM ow), k AS (SELECT repo_key, 'repo:' || replace(replace(coalesce(repo_url, ''), 'https://', ''), '.git', '') AS node FROM r)
  SELECT k.repo_key, min(b.other) AS owner FROM k JOIN both_ways b USING (node) GROUP BY 1""")
def join_02_owner_of_url(s, d):
    e = owner_edges(s, d)
    ways = e.select(F.col("to_id").alias("node"), F.col("from_id").alias("other")).unionByName(e.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"))).distinct()
    return repos(s, d).select("repo_key", repo_node().alias("node")).join(ways, "node").groupBy("repo_key").agg(F.min("other").alias("owner"))


@query(f"WITH {R}, {E}, m AS (SELECT DISTINCT coalesce(product, '(none)') AS boundary, repo_key AS repo FROM r), a AS (SELECT repo_key AS repo, max(recorded_at) AS made FROM e WHERE source_type = 'verification_report' GROUP BY 1) SELECT boundary, count(*) AS repos, count(made) AS assessed, round(count(made) / count(*), 6) AS share, max(made) AS newest FROM m LEFT JOIN a USING (repo) GROUP BY 1")
def agg_31_boundaries(s, d):
    members = repos(s, d).select(F.coalesce("product", F.lit("(none)")).alias("boundary"), F.col("repo_key").alias("repo"))
    return po.boundary_coverage(members, ledger(s, d).where("source_type = 'verification_report'").select(F.col("repo_key").alias("repo"), F.col("recorded_at").alias("generated_at")))


@query("WITH e AS (SELECT DISTINCT repo_key, source_type, recorded_at, event_id FROM finding_events) SELECT repo_key AS target, source_type AS framework, recorded_at AS generated_at, event_id AS path FROM (SELECT *, row_number() OVER (PARTITION BY repo_key, source_type ORDER BY recorded_at DESC, event_id) AS rn FROM e) WHERE rn = 1")
def win_01_job_15_newest_assessments(s, d):
    e = table(s, d, "finding_events")
    best = e.groupBy("repo_key", "source_type").agg(F.max("recorded_at").alias("generated_at"), F.min_by("event_id", F.struct((-F.unix_seconds(F.substring("recorded_at", 1, 19).cast("timestamp"))).alias("t"), "event_id")).alias("path"))
    return best.select(F.col("repo_key").alias("target"), F.col("source_type").alias("framework"), "generated_at", "path")


@query(f"""WITH {R}, b AS (SELECT DISTINCT product AS boundary, repo_key AS repo FROM r WHERE product IS NOT NULL), i AS (SELECT DISTINCT 'extra' AS boundary, repo_key AS repo FROM r WHERE row_no % 10 = 0), x AS (SELECT DISTINCT product AS boundary, CASE WHEN row_no % 9 = 0 THEN 'gone/' || repo_key ELSE repo_key END AS repo FROM r WHERE product IS NOT NULL AND (row_no % 3 = 0 OR product LIKE 'kelp%')),
  al AS (SELECT * FROM b UNION SELECT * FROM i), st AS (SELECT al.*, CASE WHEN (boundary, repo) IN (SELECT (boundary, repo) FROM x) THEN 'excluded' ELSE 'in' END AS state FROM al UNION ALL SELECT x.*, 'stale_exclude' FROM x WHERE (boundary, repo) NOT IN (SELECT (boundary, repo) FROM al))
  SELECT * FROM st UNION ALL SELECT boundary, NULL, 'empty' FROM (SELECT boundary FROM al UNION SELECT boundary FROM x) n WHERE boundary NOT IN (SELECT boundary FROM st WHERE state = 'in')""")
def set_05_job_16_scope(s, d):
    r = repos(s, d)
    base = r.where("product is not null").select(F.col("product").alias("boundary"), F.col("repo_key").alias("repo"))
    include = r.where("row_no % 10 = 0").select(F.lit("extra").alias("boundary"), F.col("repo_key").alias("repo"))
    exclude = r.where("product is not null and (row_no % 3 = 0 or product like 'kelp%')").select(F.col("product").alias("boundary"), x("if(row_no % 9 = 0, concat('gone/', repo_key), repo_key)").alias("repo"))
    return po.scope(base, include, exclude)


@query(f"""WITH {E}, a AS (SELECT event_id || repo_key AS id, source_type AS adapter, coalesce(resolution, 'none') AS verb, repo_key AS target FROM e)
  SELECT id, reason = 'ok' AS allowed, reason FROM (SELECT id, CASE WHEN adapter = 'triage_report' AND target LIKE 'upstream/%' THEN 'off_limits: upstream/*' WHEN adapter NOT IN ('triage_report', 'human_review') OR (adapter = 'human_review' AND NOT regexp_matches(target, '^findings/.-?.*suite/')) THEN 'not_in_scope' WHEN adapter = 'triage_report' AND verb = 'resolved' AND NOT target LIKE 'findings/harbor%' THEN 'verb_denied: resolved' ELSE 'ok' END AS reason FROM a)""")
def flt_08_scope_verdicts(s, d):
    actions = ledger(s, d).select(F.concat("event_id", "repo_key").alias("id"), F.col("source_type").alias("adapter"), F.coalesce("resolution", F.lit("none")).alias("verb"), F.col("repo_key").alias("target"))
    off = s.createDataFrame([("triage_report", "upstream/*"), ("routing", "*x*")], "adapter string, pattern string").where("adapter = 'triage_report'")
    allowed = s.createDataFrame([("triage_report", "*", ["resolved"]), ("triage_report", "findings/harbor*", []), ("human_review", "findings/?*suite/*", [])], "adapter string, pattern string, denied array<string>")
    return po.scope_verdict(actions, off, allowed, F.lit("2027-01-01").cast("date"), F.lit("2026-06-01").cast("date"))


# ---- owners

_REG = f"""{R}, pm AS (SELECT DISTINCT coalesce(product, label) AS product, 'mod-' || business_unit AS module FROM r WHERE coalesce(product, label) IS NOT NULL AND business_unit IS NOT NULL), ms AS (SELECT DISTINCT 'mod-' || business_unit AS module, 'stream-' || tree || '-' || business_unit AS stream FROM r WHERE business_unit IS NOT NULL),
  su AS (SELECT DISTINCT 'stream-' || tree || '-' || business_unit AS stream, regexp_replace(replace(lower(repo_url), 'https://', ''), '\\.git$', '') AS url FROM r WHERE business_unit IS NOT NULL AND repo_url IS NOT NULL AND row_no % 5 > 0), rp AS (SELECT DISTINCT url, stream, module, product FROM su JOIN ms USING (stream) JOIN pm USING (module))"""


def registry_doc(s, d):
    """One registry document made of the repositories, as JSON that is read back."""
    r = repos(s, d)
    product = F.coalesce("product", "label")
    module, stream = F.concat(F.lit("mod-"), "business_unit"), F.concat_ws("-", F.lit("stream"), "tree", "business_unit")
    unit = r.where("business_unit is not null")
    named = unit.where(product.isNotNull()).groupBy(product.alias("k")).agg(F.struct(F.max(F.upper(product)).alias("name"), F.collect_set(module).alias("ps_modules")).alias("v"))
    people = F.array(F.lower("business_unit"), F.concat(F.lit("+team-"), F.lower("business_unit")))
    modules = unit.groupBy(module.alias("k")).agg(F.struct(
        F.collect_set(stream).alias("ps_update_streams"), F.array(F.max(F.lower("business_unit")), F.lit("boss@example.test")).alias("private_tracker_cc"), F.map_from_arrays(F.array(F.lit("core")), F.array(F.max(people))).alias("component_cc"), F.array(F.lit("boss"), F.max(F.concat(F.lit("Group "), "business_unit"))).alias("default_cc"),
        F.struct(F.min(F.substring(F.col("loaded_at").cast("string"), 1, 10)).alias("supported_from"), F.max(F.when(F.col("row_no") % 2 == 0, F.substring(F.col("loaded_at").cast("string"), 1, 10))).alias("supported_until")).alias("lifecycle"),
    ).alias("v"))
    streams = unit.where("repo_url is not null and row_no % 5 > 0").groupBy(stream.alias("k")).agg(F.struct(F.collect_set(F.struct(F.col("base").alias("name"), F.concat(F.upper("repo_url"), F.lit("/")).alias("git_repo_url"))).alias("managed_service_components")).alias("v"))
    as_map = lambda df, name: df.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name))  # noqa: E731  registries are small documents
    doc = as_map(named, "ps_products").crossJoin(as_map(modules, "ps_modules")).crossJoin(as_map(streams, "ps_update_streams"))  # one row each
    return doc.select(F.to_json(F.struct("*")).alias("text")).select(F.from_json("text", po.REGISTRY).alias("doc"))


@query(f"WITH {_REG} SELECT url, stream, module, product FROM rp")
def join_23_registry(s, d):
    return po.registry_indexes(registry_doc(s, d))["repo_products"].select("url", "stream", "module", "product").distinct()


@query(f"""WITH {_REG}, m AS (SELECT repo_key AS repo, min('chosen-' || tree) AS product FROM r WHERE row_no % 7 = 0 GROUP BY 1), u AS (SELECT url, min(product) AS product FROM rp GROUP BY 1), sl AS (SELECT regexp_replace(lower(product), '[^a-z0-9]', '', 'g') AS slug, min(product) AS product FROM pm GROUP BY 1),
  q AS (SELECT repo_key AS repo, regexp_replace(replace(lower(repo_url), 'https://', ''), '\\.git$', '') AS url, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS slug FROM r)
  SELECT q.repo, CASE WHEN m.product IS NOT NULL THEN 'mapped' WHEN u.product IS NOT NULL THEN 'repo-url' WHEN sl.product IS NOT NULL THEN 'slug' ELSE 'none' END AS match_tier, coalesce(m.product, u.product, sl.product) AS product FROM q LEFT JOIN m USING (repo) LEFT JOIN u ON u.url = q.url LEFT JOIN sl ON sl.slug = q.slug""")
def join_22_job_17_owners(s, d):
    r = repos(s, d)
    mapped = r.where("row_no % 7 = 0").select(F.col("repo_key").alias("repo"), F.concat(F.lit("chosen-"), "tree").alias("product"))
    return po.resolved_owners(r.select(F.col("repo_key").alias("repo"), F.col("repo_url").alias("url"), fx.slugify(F.col("label")).alias("slug")), mapped, po.registry_indexes(registry_doc(s, d)))


@query(f"WITH {_REG}, c AS (SELECT DISTINCT product, lower(replace(module, 'mod-', '')) AS person, 1 AS tier, 'private_tracker_cc' AS field, true AS embargo FROM pm) SELECT * FROM c UNION SELECT DISTINCT product, 'boss', 1, 'private_tracker_cc', true FROM pm")
def agg_41_contacts(s, d):
    return po.product_contacts(po.registry_indexes(registry_doc(s, d)))[0]


@query(f"WITH {_REG}, n AS (SELECT product, count(*) AS mods FROM pm GROUP BY 1) SELECT product, mods + 1 AS kept, 2 * mods AS lost, round(2 * mods / (3 * mods + 1), 6) AS rate, round(2 * mods / (3 * mods + 1), 6) > 0.2 AS warn FROM n")
def agg_42_drop_rate(s, d):
    kept, dropped = po.product_contacts(po.registry_indexes(registry_doc(s, d)))
    return po.drop_rate(kept, dropped)


@query(f"WITH {_REG}, m AS (SELECT 'mod-' || business_unit AS module, strftime(min(loaded_at), '%Y-%m-%d') AS f, strftime(max(loaded_at) FILTER (WHERE row_no % 2 = 0), '%Y-%m-%d') AS u FROM r WHERE business_unit IS NOT NULL GROUP BY 1), p AS (SELECT product, min(f) AS supported_from, CASE WHEN bool_or(u IS NULL) THEN NULL ELSE max(u) END AS supported_until FROM pm JOIN m USING (module) GROUP BY 1) SELECT *, CASE WHEN supported_from > '2025-06-01' THEN 'unreleased' WHEN supported_until < '2025-06-01' THEN 'eol' ELSE 'supported' END AS state FROM p")
def agg_40_lifecycles(s, d):
    index = po.registry_indexes(registry_doc(s, d))
    return po.lifecycle(index["by_module"].join(index["lifecycles"], "module"), "product", F.lit("2025-06-01"))


# ---- corpus

_M = """count(*) AS reports, count(*) FILTER (WHERE is_md_only = 1) AS md_only, count(*) FILTER (WHERE is_branch_audit = 1) AS branch_audits, count(*) FILTER (WHERE is_branch_audit = 0) AS head_reports, count(DISTINCT base_slug) AS slugs, count(findings_current) AS with_current, count(triage_json) AS with_triage, count(threat_model) AS with_model, count(*) FILTER (WHERE product IS NULL) AS shallow_dirs"""


@query(f"""WITH {R}, m AS (SELECT tree, {_M} FROM r GROUP BY ROLLUP (tree)), k AS (SELECT tree, string_agg(c, ',' ORDER BY c) AS kinds FROM (SELECT tree, report_kind || '=' || count(*) AS c FROM r WHERE report_kind IS NOT NULL GROUP BY GROUPING SETS ((tree, report_kind), (report_kind))) GROUP BY 1),
  f AS (SELECT tree, string_agg(c, ',' ORDER BY c) AS refs FROM (SELECT tree, ref || '=' || count(*) AS c FROM r WHERE ref IS NOT NULL GROUP BY GROUPING SETS ((tree, ref), (ref))) GROUP BY 1) SELECT m.*, k.kinds, f.refs FROM m LEFT JOIN k ON k.tree IS NOT DISTINCT FROM m.tree LEFT JOIN f ON f.tree IS NOT DISTINCT FROM m.tree""")
def agg_09_job_19_totals(s, d):
    return po.corpus_totals(repos(s, d))


@query(f"""WITH {R}, v AS (SELECT tree, report_path, base_slug, CASE WHEN row_no % 6 = 0 THEN 'copy' ELSE tree END AS t2, base, regexp_replace(report_path, '/[^/]*$', '') || CASE WHEN row_no % 11 = 0 THEN '/old' ELSE '' END AS folder FROM r),
  w AS (SELECT * FROM v UNION ALL SELECT tree, report_path, base_slug, t2, base, regexp_replace(report_path, '/[^/]*$', '') FROM v WHERE folder LIKE '%/old'), n AS (SELECT DISTINCT base, folder FROM w)
  SELECT 'unregistered_tree' AS warning, t2 AS subject, min(report_path) AS detail FROM w WHERE t2 NOT IN ('findings', 'upstream') GROUP BY 2 UNION ALL SELECT 'several_trees', base_slug, string_agg(DISTINCT t2, ',' ORDER BY t2) FROM w GROUP BY 2 HAVING count(DISTINCT t2) > 1
  UNION ALL SELECT DISTINCT 'nested_duplicate', a.folder, b.folder FROM n a JOIN n b ON a.base = b.base AND starts_with(a.folder, b.folder || '/')""")
def job_19_drift(s, d):
    v = repos(s, d).select("report_path", "base_slug", x("if(row_no % 6 = 0, 'copy', tree)").alias("tree"), "base", "row_no")
    moved = x("concat(regexp_replace(report_path, '/[^/]*$', ''), '/old/', substring_index(report_path, '/', -1))")
    both = v.withColumn("report_path", F.explode(F.when(F.col("row_no") % 11 == 0, F.array("report_path", moved)).otherwise(F.array("report_path"))))
    return po.corpus_drift(both, s.createDataFrame([("findings",), ("upstream",)], "tree string"))


@query(f"WITH {R}, h AS (SELECT base_slug, min(repo_key) AS repo_key, arg_min(repo_url, repo_key) AS repo_url FROM r WHERE is_branch_audit = 0 AND report_kind = 'code-audit' AND repo_url LIKE 'http%' GROUP BY 1) SELECT * FROM h ORDER BY repo_key LIMIT 40")
def flt_04_sort_07_head_repos(s, d):
    return po.outer_reports(repos(s, d), 40)


_PATHS = f"""{FI}, p AS (SELECT DISTINCT CASE WHEN row_no % 9 = 0 THEN '.hidden/' || path WHEN row_no % 5 = 0 THEN 'a/node_modules/' || path ELSE path END AS path FROM (SELECT row_no, unnest(from_json(paths, '["VARCHAR"]')) AS path FROM f))"""


@query(f"WITH {_PATHS} SELECT path, CASE WHEN path LIKE '.hidden%' THEN 'hidden' WHEN path LIKE 'a/node_modules/%' THEN 'vendor' WHEN split_part(path, '/', 1) IN ('util', 'charts') THEN 'noise' ELSE 'source' END AS kind FROM p")
def flt_05_path_kinds(s, d):
    paths = findings(s, d).select("row_no", F.explode(F.from_json("paths", "array<string>")).alias("path"))
    placed = paths.select(x("case when row_no % 9 = 0 then concat('.hidden/', path) when row_no % 5 = 0 then concat('a/node_modules/', path) else path end").alias("path")).distinct()
    return placed.select("path", po.path_class(F.col("path"), fx.VENDOR_ROOTS, ("util", "charts", "testdata")).alias("kind"))


@query(f"WITH {FI}, al AS (SELECT DISTINCT primary_cwe FROM f WHERE validity = 'confirmed' AND severity = 'critical'), h AS (SELECT primary_cwe, severity, (primary_cwe, severity) IN (SELECT (primary_cwe, s) FROM al, (VALUES ('critical'), ('high')) AS v(s)) AS kept FROM f WHERE primary_cwe IS NOT NULL AND severity IS NOT NULL) SELECT 'kept' AS state, primary_cwe, severity, count(*) AS n FROM h WHERE kept GROUP BY 2, 3 UNION ALL SELECT 'suppressed', primary_cwe, severity, count(*) FROM h WHERE NOT kept GROUP BY 2, 3")
def flt_06_allowlist_table(s, d):
    f = findings(s, d).where("primary_cwe is not null and severity is not null").select("primary_cwe", "severity", "validity")
    allow = f.where("validity = 'confirmed' and severity = 'critical'").select("primary_cwe", F.explode(F.array(F.lit("critical"), F.lit("high"))).alias("severity"))
    kept, suppressed = po.allowlisted(f, allow, ["primary_cwe", "severity"])
    return kept.groupBy("primary_cwe", "severity").agg(F.count("*").alias("n")).withColumn("state", F.lit("kept")).unionByName(suppressed.withColumn("state", F.lit("suppressed")))


@query(f"WITH {R}, n AS (SELECT DISTINCT repo_key AS id, 'x.test/mirror/' || array_to_string(string_split(regexp_replace(repo_url, '\\.git$', ''), '/')[-2:], '/') AS url FROM r WHERE row_no % 3 > 0) SELECT r.repo_key FROM r WHERE EXISTS (SELECT 1 FROM n WHERE ends_with(url, array_to_string(string_split(regexp_replace(r.repo_url, '\\.git$', ''), '/')[-2:], '/')))")
def join_11_url_suffix(s, d):
    """Repositories of which another address with the same last two parts is known."""
    tail = lambda c: F.concat_ws("/", F.slice(F.split(F.regexp_replace(c, r"\.git$", ""), "/"), -2, 2))
    r = repos(s, d)
    others = r.where("row_no % 3 > 0").select(F.concat(F.lit("x.test/mirror/"), tail("repo_url")).alias("url")).select(tail("url").alias("tail"), "url").distinct()
    return r.select("repo_key", tail("repo_url").alias("tail")).join(others, "tail", "left_semi").select("repo_key")


@query(f"WITH {R}, {FI} SELECT repo_key FROM r WHERE row_no % 2 = 0 EXCEPT SELECT repo_key FROM f WHERE severity = 'critical'")
def set_03_difference(s, d):
    return repos(s, d).where("row_no % 2 = 0").select("repo_key").subtract(findings(s, d).where("severity = 'critical'").select("repo_key"))


@query("""WITH p AS (SELECT DISTINCT row_no, repo_key, title, from_json(paths, '["VARCHAR"]') AS a FROM findings WHERE title IS NOT NULL), w AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS t, list_distinct(list_transform(a, lambda q: split_part(q, '/', 1))) AS dirs FROM p),
  n AS (SELECT a.row_no, b.row_no AS other, list_concat(a.t, b.t) AS tu, len(list_intersect(a.t, b.t)) AS ti, list_concat(a.dirs, b.dirs) AS du, len(list_intersect(a.dirs, b.dirs)) AS di FROM w a JOIN w b ON a.repo_key = b.repo_key AND b.row_no = a.row_no + 1)
  SELECT row_no, other, round(ti / nullif(len(list_distinct(tu)), 0), 6) AS titles, round(di / nullif(len(list_distinct(du)), 0), 6) AS dirs FROM n""")
def set_07_fn_str_27_jaccard(s, d):
    """How alike neighbouring findings of a repository are, by the words of their titles and the top directories of their paths."""
    from quarryline.operators.relational import jaccard

    words = F.array_distinct(F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    w = table(s, d, "findings").where("title is not null").select("row_no", "repo_key", words.alias("t"), F.array_distinct(F.transform(F.from_json("paths", "array<string>"), lambda p: F.substring_index(p, "/", 1))).alias("dirs")).distinct()
    b = w.select(F.col("row_no").alias("other"), "repo_key", F.col("t").alias("t2"), F.col("dirs").alias("d2"), (F.col("row_no") - 1).alias("row_no"))
    return w.join(b, ["repo_key", "row_no"]).select("row_no", "other", F.round(jaccard(F.col("t"), F.col("t2")), 6).alias("titles"), F.round(jaccard(F.col("dirs"), F.col("d2")), 6).alias("dirs"))


@query(f"WITH {R} SELECT repo_key, CASE WHEN row_no % 3 = 0 THEN NULL ELSE report_path END AS ref FROM r WHERE report_path IS NOT NULL")
def prj_07_refs(s, d):
    """Paths as references below the results' folder; those outside it have none."""
    at = repos(s, d).where("report_path is not null").select("repo_key", x("concat(if(row_no % 3 = 0, '/elsewhere/', '/data/results/./'), report_path)").alias("path"))
    return at.select("repo_key", fx.relative_ref(F.col("path"), "/data/results").alias("ref"))
