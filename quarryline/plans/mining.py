"""Rules mined from confirmed findings: clusters, coverage, precision, worklists, calibration, sweeps, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import text as fx
from quarryline.operators import mining
from quarryline.operators import relational as rel
from quarryline.plans.registry import registry
from quarryline.plans.relational import FI, findings
from quarryline.workspace import table

QUERIES, SQL, query = registry()

#: Rules of the test pack: those weaknesses that most findings show, for a language each; read as a table.
_PACK = "rules AS (SELECT 'r-' || primary_cwe AS rule, primary_cwe AS cwe, l AS language FROM (SELECT primary_cwe FROM findings WHERE primary_cwe IS NOT NULL GROUP BY 1 HAVING count(DISTINCT row_no) >= 40), (VALUES ('go'), ('python'), ('rust')) AS x(l))"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fx.LANGUAGES.items()) + "}"
#: The dominant language by counting pairs of (tier, language) apart, unlike the query.
_TP = f"""{FI}, q AS (SELECT row_no, u.path, u.i, lower(regexp_extract(u.path, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM f, LATERAL (SELECT unnest(from_json(paths, '["VARCHAR"]')) AS path, generate_subscripts(from_json(paths, '["VARCHAR"]'), 1) AS i) AS u WHERE validity = 'confirmed'),
  w AS (SELECT row_no, {_MAP}[ext] AS lang, ext IN ('yaml', 'yml') AS config, count(*) AS n, min(i) AS first FROM q WHERE {_MAP}[ext] IS NOT NULL GROUP BY ALL),
  g AS (SELECT row_no, lang FROM (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY config, n DESC, first) AS rn FROM w) WHERE rn = 1),
  tp AS (SELECT f.row_no, repo_key AS repo, finding_id, coalesce(upper(from_json(cwes, '["VARCHAR"]')[1]), 'CWE-?') AS cwe, coalesce(lang, 'unknown') AS language, title, fingerprint, cwes, paths, severity FROM f LEFT JOIN g USING (row_no) WHERE validity = 'confirmed')"""
_CL = f"{_TP}, {_PACK}, cl AS (SELECT cwe, language, count(*) AS n, count(DISTINCT repo) AS repos FROM tp GROUP BY 1, 2), cv AS (SELECT cl.*, (SELECT string_agg(DISTINCT rule, ',' ORDER BY rule) FROM rules WHERE rules.cwe = cl.cwe AND rules.language = cl.language) AS covered_by FROM cl), st AS (SELECT *, CASE WHEN covered_by IS NOT NULL THEN 'covered' WHEN language IN ('go', 'python', 'typescript', 'javascript', 'java', 'ruby', 'c', 'cpp', 'rust', 'bash', 'php', 'csharp') THEN 'uncovered' ELSE 'not_ruleable' END AS state FROM cv)"


def pack(s, d):
    often = table(s, d, "findings").where("primary_cwe is not null").groupBy("primary_cwe").agg(F.countDistinct("row_no").alias("n")).where("n >= 40")
    return often.select(F.concat(F.lit("r-"), "primary_cwe").alias("rule"), F.col("primary_cwe").alias("cwe"), F.explode(F.array(*map(F.lit, ("go", "python", "rust")))).alias("language"))


def tps(s, d):
    return mining.corpus(findings(s, d))


@query(f"WITH {_TP} SELECT repo, finding_id, cwe, language FROM tp")
def flt_02_win_15_corpus(s, d):
    return tps(s, d).select("repo", "finding_id", "cwe", "language")


@query(f"""WITH {_TP}, n AS (SELECT *, try_cast(regexp_extract(cwe, 'CWE-(\\d+)', 1) AS INT) AS no, from_json(paths, '["VARCHAR"]')[1] AS file FROM tp)
  SELECT repo, finding_id, CASE WHEN no IS NULL THEN 'no_cwe' WHEN coalesce(file, '') = '' THEN 'no_location_anchor' WHEN no IN {mining.DEPENDENCY} THEN 'dependency_version_class'
    WHEN language NOT IN {(*mining.RULEABLE, 'yaml')} THEN 'language_not_ruleable: ' || language WHEN no NOT IN {mining.SYNTACTIC} THEN 'semantic_logic_class' ELSE 'syntactic' END AS reason FROM n""")
def flt_03_expressible(s, d):
    return tps(s, d).select("repo", "finding_id", mining.expressible(F.col("cwe"), F.get("locations", F.lit(0)), F.col("language")).alias("reason"))


@query(f"WITH {_CL}, e AS (SELECT cwe, language, finding_id, row_number() OVER (PARTITION BY cwe, language ORDER BY row_no) AS rn FROM tp) SELECT st.cwe, st.language, n, repos, covered_by, state, (SELECT string_agg(finding_id, ',' ORDER BY rn) FROM e WHERE e.cwe = st.cwe AND e.language = st.language AND rn <= 5) AS examples FROM st")
def agg_21_join_18_clusters(s, d):
    return mining.covered(mining.clusters(tps(s, d)), pack(s, d))


@query(f"""WITH {_CL}, c AS (SELECT language, count(*) FILTER (WHERE state = 'covered') AS covered_clusters, count(*) FILTER (WHERE state = 'uncovered') AS uncovered_clusters, coalesce(sum(n) FILTER (WHERE state = 'uncovered'), 0)::BIGINT AS uncovered_tps FROM st GROUP BY 1),
  k AS (SELECT language, count(DISTINCT rule) AS pack_rules FROM rules GROUP BY 1), t AS (SELECT language, count(*) AS confirmed FROM tp GROUP BY 1)
  SELECT t.language, confirmed, covered_clusters, uncovered_clusters, uncovered_tps, coalesce(pack_rules, 0) AS pack_rules, row_number() OVER (ORDER BY uncovered_tps DESC, confirmed DESC, t.language)::INT AS place FROM t JOIN c USING (language) LEFT JOIN k USING (language)""")
def agg_22_sort_04_languages(s, d):
    own = tps(s, d)
    return mining.language_coverage(own, mining.covered(mining.clusters(own), pack(s, d)), pack(s, d))


@query(f"WITH {_TP}, {_PACK}, c AS (SELECT DISTINCT tp.repo, tp.language, (SELECT count(DISTINCT rule) FROM rules r WHERE r.language = tp.language) AS n FROM tp WHERE tp.language NOT IN ('yaml', 'html', 'terraform', 'unknown')) SELECT repo, coalesce(string_agg(language, ',' ORDER BY language) FILTER (WHERE n > 0 AND n < 30), '') AS thin, coalesce(string_agg(language, ',' ORDER BY language) FILTER (WHERE n = 0), '') AS uncovered FROM c GROUP BY 1")
def agg_43_coverage_block(s, d):
    return mining.coverage_block(tps(s, d).select("repo", "language"), pack(s, d), 30)


#: Hits judged: validity says whether a hit of the weakness's rule was promoted.
_J = "j AS (SELECT primary_cwe AS rule, CASE WHEN validity IN ('confirmed', 'corrected') THEN 'promoted' WHEN validity = 'false_positive' THEN 'dismissed' ELSE validity END AS result, loaded_at FROM f)"
_P = "count(*) FILTER (WHERE result = 'promoted') AS promoted, count(*) FILTER (WHERE result = 'dismissed') AS dismissed, count(*) FILTER (WHERE coalesce(result, '') NOT IN ('promoted', 'dismissed')) AS other"


def judged(s, d):
    result = F.when(F.col("validity").isin("confirmed", "corrected"), " Promoted ").when(F.col("validity") == "false_positive", "dismissed").otherwise(F.col("validity"))
    return findings(s, d).select(F.col("primary_cwe").alias("rule"), result.alias("result"), "loaded_at")


@query(f"WITH {FI}, {_J}, p AS (SELECT rule, {_P} FROM j WHERE rule IS NOT NULL GROUP BY 1) SELECT *, round(promoted / nullif(promoted + dismissed, 0), 3) AS precision FROM p")
def agg_23_rule_precision(s, d):
    return mining.precision(judged(s, d))


@query(f"""WITH {FI}, {_J}, a AS (SELECT rule, {_P} FROM j WHERE rule IS NOT NULL AND loaded_at < TIMESTAMP '2024-09-01' GROUP BY 1), b AS (SELECT rule, {_P} FROM j WHERE rule IS NOT NULL GROUP BY 1),
  x AS (SELECT b.rule, round(a.promoted / nullif(a.promoted + a.dismissed, 0), 3) AS previous, round(b.promoted / nullif(b.promoted + b.dismissed, 0), 3) AS precision FROM b LEFT JOIN a USING (rule))
  SELECT *, CASE WHEN previous IS NULL THEN 'entered_below_gate' WHEN previous >= 0.75 THEN 'fell_below_gate' ELSE 'rose_above_gate' END AS direction FROM x WHERE precision IS NOT NULL AND ((previous IS NULL AND precision < 0.75) OR (previous >= 0.75 AND precision < 0.75) OR (previous < 0.75 AND precision >= 0.75))""")
def win_17_gate_crossings(s, d):
    hits = judged(s, d)
    return mining.gate_crossings(mining.precision(hits.where("loaded_at < timestamp_ntz'2024-09-01'")), mining.precision(hits), 0.75)


@query(f"""WITH {_TP}, {_PACK}, k AS (SELECT DISTINCT cwe, language FROM rules), a AS (SELECT cwe, language, count(*) FILTER (WHERE repo NOT LIKE 'upstream/%') AS o, count(*) FILTER (WHERE repo NOT LIKE 'partner/%') AS n FROM tp WHERE language IN {mining.RULEABLE} AND (cwe, language) NOT IN (SELECT (cwe, language) FROM k) GROUP BY 1, 2)
  SELECT cwe, language, CASE WHEN o = 0 THEN 'new' WHEN n = 0 THEN 'resolved' ELSE 'changed' END AS change, nullif(o, 0) AS previous_n, nullif(n, 0) AS n FROM a WHERE o <> n""")
def join_19_set_03_04_delta(s, d):
    own, rules = tps(s, d), pack(s, d)
    state = lambda df: mining.covered(mining.clusters(df), rules)
    return mining.cluster_delta(state(own.where("repo not like 'upstream/%'")), state(own.where("repo not like 'partner/%'")))


@query(f"WITH {_TP}, {_PACK} SELECT repo, string_agg(DISTINCT rule, ',' ORDER BY rule) AS expected_rules, count(DISTINCT row_no) AS n_findings FROM tp JOIN rules USING (cwe, language) GROUP BY 1")
def join_24_job_10_worklist(s, d):
    return mining.worklist(tps(s, d), pack(s, d))


_AIMS = f"""{_TP}, aim AS (SELECT repo, substr(fingerprint, 1, 12) AS commit, paths, cwes, cwe FROM tp WHERE regexp_full_match(substr(fingerprint, 1, 12), '[0-9a-f]{{7,40}}') AND len(from_json(paths, '["VARCHAR"]')) > 0)"""


def aims(s, d):
    return mining.targets(tps(s, d).withColumn("fingerprint", F.substring("fingerprint", 1, 12)))


@query(f"""WITH {_AIMS} SELECT repo, commit, array_to_string(list_sort(list_distinct(flatten(list(from_json(paths, '["VARCHAR"]')[1:5])))), ',') AS locations, array_to_string(list_sort(list_distinct(flatten(list(list_append(coalesce(from_json(upper(cwes), '["VARCHAR"]'), []), cwe))))), ',') AS cwes, count(*) AS n FROM aim GROUP BY 1, 2""")
def agg_26_targets(s, d):
    return aims(s, d).select("repo", "commit", F.array_join("locations", ",").alias("locations"), F.array_join("cwes", ",").alias("cwes"), "n")


@query(f"""WITH {_AIMS}, c AS (SELECT repo, unnest(list_distinct(list_append(coalesce(from_json(upper(cwes), '["VARCHAR"]'), []), cwe))) AS cwe FROM aim), n AS (SELECT cwe, count(DISTINCT repo) AS n FROM c GROUP BY 1) SELECT n, cwe FROM n ORDER BY n DESC, try_cast(regexp_extract(cwe, '(\\d+)', 1) AS INT) NULLS LAST LIMIT 1""")
def agg_25_reachability(s, d):
    return mining.reachability(aims(s, d))


#: A scan's hits: every path that findings of any validity name, by the rule of their weakness.
_HITS = f"""{_AIMS}, h AS (SELECT repo_key AS repo, primary_cwe AS rule, unnest(from_json(paths, '["VARCHAR"]')) AS path FROM f WHERE coalesce(validity, '') <> 'hardening' AND primary_cwe IS NOT NULL),
  known AS (SELECT DISTINCT repo, unnest(from_json(paths, '["VARCHAR"]')[1:5]) AS path FROM aim), c AS (SELECT h.*, (repo, path) IN (SELECT (repo, path) FROM known) AS again FROM h)"""


def hits(s, d):
    return findings(s, d).where(F.coalesce("validity", F.lit("")) != "hardening").where("primary_cwe is not null").select(F.col("repo_key").alias("repo"), F.col("primary_cwe").alias("rule"), F.explode(F.from_json("paths", "array<string>")).alias("path"))


@query(f"WITH {_HITS} SELECT rule, count(*) AS fires, count(*) FILTER (WHERE again) AS rediscoveries, count(*) FILTER (WHERE NOT again) AS novel, count(DISTINCT repo) AS repos_fired, count(DISTINCT repo) FILTER (WHERE again) AS repos_rediscovered, count(DISTINCT repo) FILTER (WHERE again) >= 3 AS clears_gate FROM c GROUP BY ROLLUP (rule)")
def agg_24_job_13_calibration(s, d):
    return mining.calibration(mining.rediscovered(hits(s, d).withColumn("path", F.concat(F.lit("./"), "path")), aims(s, d)))


@query(f"WITH {_HITS}, o AS (SELECT repo, rule, path, row_number() OVER (ORDER BY repo, rule, path) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT repo, rule, path FROM c WHERE NOT again)) SELECT repo, rule, path FROM o WHERE i % greatest(1, n // 40) = 0 AND i // greatest(1, n // 40) < 40")
def win_13_novel_sample(s, d):
    new = mining.rediscovered(hits(s, d), aims(s, d)).where("kind = 'novel'").select("repo", "rule", "path").distinct()
    return rel.spaced(new, ["repo", "rule", "path"], 40)


_SOURCES = """src AS (SELECT 0 AS rank, 'triage' AS source, * FROM fx WHERE validity = 'not_verified' UNION ALL SELECT 1, 'ledger', * FROM fx WHERE validity = 'confirmed' UNION ALL SELECT 2, 'fast-track', * FROM fx WHERE severity IN ('critical', 'high') UNION ALL SELECT 3, 'rest', * FROM fx),
  one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(repo), file, cwe, lower(substr(title, 1, 60)) ORDER BY rank, row_no) AS rn FROM src) WHERE rn = 1)"""
_FX = f"""{FI}, fx AS (SELECT row_no, repo_key AS repo, from_json(paths, '["VARCHAR"]')[1] AS file, primary_cwe AS cwe, title, validity, severity FROM f)"""


def first_sources(s, d):
    x = findings(s, d).select("row_no", F.col("repo_key").alias("repo"), F.get(F.from_json("paths", "array<string>"), F.lit(0)).alias("file"), F.col("primary_cwe").alias("cwe"), "title", "validity", "severity")
    return mining.first_of_sources([("triage", x.where("validity = 'not_verified'")), ("ledger", x.where("validity = 'confirmed'")), ("fast-track", x.where("severity in ('critical', 'high')")), ("rest", x)])


@query(f"WITH {_FX}, {_SOURCES} SELECT source, cwe, count(*) AS n, count(DISTINCT repo) AS repos FROM one GROUP BY 1, 2")
def agg_27_set_02_sources(s, d):
    return first_sources(s, d).groupBy("source", "cwe").agg(F.count("*").alias("n"), F.countDistinct("repo").alias("repos"))


@query(f"WITH {_HITS}, asked AS (SELECT rule, repo_key AS repo, CASE WHEN is_md_only = 1 THEN 'no report' END AS error FROM (SELECT DISTINCT rule FROM h) CROSS JOIN (SELECT repo_key, max(is_md_only) AS is_md_only FROM repos GROUP BY 1)), n AS (SELECT rule, repo, count(*) AS n FROM h GROUP BY 1, 2) SELECT rule, count(*) AS repos, count(n) AS repos_with_hits, coalesce(sum(n), 0)::BIGINT AS hits, count(error) AS errors FROM asked LEFT JOIN n USING (rule, repo) GROUP BY 1")
def agg_28_job_12_emitted(s, d):
    h = hits(s, d)
    rules = F.array_sort(F.collect_set("rule"))  # of one pack
    asked = table(s, d, "repos").groupBy(F.col("repo_key").alias("repo")).agg(F.when(F.max("is_md_only") == 1, "no report").alias("error"))
    every = asked.join(F.broadcast(h.agg(rules.alias("rules"))), F.lit(True)).select("repo", "error", F.explode("rules").alias("rule"))
    return mining.emitted(every, h)


@query(f"""WITH {FI}, v AS (SELECT repo_key, u.i - 1 AS idx, u.path FROM f, LATERAL (SELECT unnest(from_json(paths, '["VARCHAR"]')) AS path, generate_subscripts(from_json(paths, '["VARCHAR"]'), 1) AS i) AS u WHERE f.severity = 'high'),
  votes AS (SELECT repo_key, (row_no % 3)::BIGINT AS idx, finding_id FROM f WHERE validity = 'confirmed') SELECT votes.repo_key, finding_id, votes.idx::INT AS idx, v.path FROM votes JOIN v ON v.repo_key = votes.repo_key AND v.idx = votes.idx""")
def join_17_votes(s, d):
    """Votes name a candidate by its place in their repository's lists; places beyond a list match nothing."""
    f = findings(s, d)
    candidates = f.where("severity = 'high'").select("repo_key", F.posexplode(F.from_json("paths", "array<string>")).alias("idx", "path"))
    votes = f.where("validity = 'confirmed'").select("repo_key", (F.col("row_no") % 3).cast("int").alias("idx"), "finding_id")
    return votes.join(candidates, ["repo_key", "idx"]).select("repo_key", "finding_id", "idx", "path")


@query(f"""WITH {FI}, x AS (SELECT CASE WHEN row_no % 2 = 0 THEN 'vuln' ELSE 'fixed' END AS variant, repo_key || '/' || finding_id AS id, CASE WHEN row_no % 2 = 0 THEN 'confirmed' ELSE 'refuted' END AS verdict, CASE WHEN NOT isnan(cvss_score) THEN cvss_score END AS score, validation_status, validity, assurance FROM f),
  g AS (SELECT *, CASE validation_status WHEN 'validated' THEN 'confirmed' ELSE coalesce(validation_status, 'missing') END AS got, CASE WHEN validation_status IS NOT NULL AND assurance = 'countersigned' THEN 'weak' END AS flag, CASE WHEN validation_status IS NOT NULL THEN round(score) END AS est FROM x)
  SELECT variant, count(*) AS n, count(*) FILTER (WHERE got = verdict AND flag IS NULL) AS hits, round(avg((got = verdict AND flag IS NULL)::INT), 3) AS metric, round(avg(CASE WHEN variant = 'vuln' AND got = 'confirmed' AND est IS NOT NULL THEN (abs(est - score) <= 0.3)::INT END), 3) AS severity_accuracy FROM g GROUP BY 1""")
def agg_39_join_26_job_14_scores(s, d):
    even = F.col("row_no") % 2 == 0
    score = F.when(~F.isnan("cvss_score"), F.col("cvss_score"))
    x = findings(s, d).select(F.when(even, "vuln").otherwise("fixed").alias("variant"), F.concat_ws("/", "repo_key", "finding_id").alias("id"), F.when(even, "confirmed").otherwise("refuted").alias("verdict"), score.alias("score"), "validation_status", "assurance")
    got = x.where("validation_status is not null").select("variant", "id", F.when(F.col("validation_status") == "validated", "confirmed").otherwise(F.col("validation_status")).alias("verdict"), F.when(F.col("assurance") == "countersigned", "weak").alias("flag"), F.round("score").alias("estimate"))
    return mining.scores(x.select("variant", "id", "verdict", "score"), got, 0.3)


@query("""WITH e AS (SELECT DISTINCT dst AS advisory, split_part(src, ':', 1) AS ecosystem, rel AS package, CASE WHEN json_extract_string(attrs, '$.indirect') = 'true' THEN 'module_required_not_observed' WHEN json_extract_string(attrs, '$.indirect') = 'false' THEN 'symbol_reachable' ELSE 'package_imported_not_observed' END AS level, string_split(src, '-') AS trace, src AS source FROM edges WHERE rel IN ('depends_on', 'imports_package', 'has_ref'))
  SELECT advisory, ecosystem, package, CASE WHEN bool_or(level = 'symbol_reachable') THEN 'symbol_reachable' WHEN bool_or(level LIKE 'package%') THEN 'package_imported_not_observed' ELSE 'module_required_not_observed' END AS reachability, arg_min(array_to_string(trace, ' > '), (len(trace), array_to_string(trace, ' > '))) FILTER (WHERE level = 'symbol_reachable') AS example_trace, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM e GROUP BY 1, 2, 3""")
def agg_37_advisories(s, d):
    indirect = F.get_json_object("attrs", "$.indirect")
    level = F.when(indirect == "true", "module_required_not_observed").when(indirect == "false", "symbol_reachable").otherwise("package_imported_not_observed")
    e = table(s, d, "edges").where(F.col("rel").isin("depends_on", "imports_package", "has_ref")).select(F.col("dst").alias("advisory"), F.substring_index("src", ":", 1).alias("ecosystem"), F.col("rel").alias("package"), level.alias("level"), F.split("src", "-").alias("trace"), F.col("src").alias("source")).distinct()
    return mining.advisory_candidates(e)


@query(f"""WITH {_TP}, {_PACK}, {_J}, k AS (SELECT DISTINCT cwe, language FROM rules), a AS (SELECT cwe, language, count(*) FILTER (WHERE repo NOT LIKE 'upstream/%') AS o, count(*) FILTER (WHERE repo NOT LIKE 'partner/%') AS n FROM tp WHERE language IN {mining.RULEABLE} AND (cwe, language) NOT IN (SELECT (cwe, language) FROM k) GROUP BY 1, 2),
  ch AS (SELECT CASE WHEN o = 0 THEN 'new' WHEN n = 0 THEN 'resolved' ELSE 'changed' END || '_cluster' AS kind, cwe || '/' || language AS subject, CASE WHEN o = 0 THEN '-' ELSE CAST(o AS VARCHAR) END || ' ' || CASE WHEN n = 0 THEN '-' ELSE CAST(n AS VARCHAR) END AS detail FROM a WHERE o <> n),
  p1 AS (SELECT rule, {_P} FROM j WHERE rule IS NOT NULL AND loaded_at < TIMESTAMP '2024-02-01' GROUP BY 1), p2 AS (SELECT rule, {_P} FROM j WHERE rule IS NOT NULL GROUP BY 1), x AS (SELECT p2.rule, round(p1.promoted / nullif(p1.promoted + p1.dismissed, 0), 3) AS was, round(p2.promoted / nullif(p2.promoted + p2.dismissed, 0), 3) AS now FROM p2 LEFT JOIN p1 USING (rule)),
  gx AS (SELECT 'gate' AS kind, rule AS subject, CASE WHEN was IS NULL THEN 'entered_below_gate' WHEN was >= 0.5 THEN 'fell_below_gate' ELSE 'rose_above_gate' END AS detail FROM x WHERE now IS NOT NULL AND ((was IS NULL AND now < 0.5) OR (was >= 0.5 AND now < 0.5) OR (was < 0.5 AND now >= 0.5))), u AS (SELECT * FROM ch UNION ALL SELECT * FROM gx)
  SELECT * FROM u UNION ALL SELECT 'attention', kind, CAST(count(*) AS VARCHAR) FROM u WHERE kind = 'new_cluster' OR (kind = 'gate' AND detail <> 'rose_above_gate') GROUP BY 2 UNION ALL SELECT 'growth', 'confirmed', CAST((SELECT count(*) FROM tp WHERE repo NOT LIKE 'partner/%') - (SELECT count(*) FROM tp WHERE repo NOT LIKE 'upstream/%') AS VARCHAR)""")
def job_11_rule_lane(s, d):
    own, rules, hits = tps(s, d), pack(s, d), judged(s, d)
    state = lambda df: mining.covered(mining.clusters(df), rules)
    old, new = own.where("repo not like 'upstream/%'"), own.where("repo not like 'partner/%'")
    return mining.lane(state(old), state(new), mining.precision(hits.where("loaded_at < timestamp_ntz'2024-02-01'")), mining.precision(hits), (old.count(), new.count()))
