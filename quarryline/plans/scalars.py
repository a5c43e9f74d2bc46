"""Scalar functions over whole tables, each beside SQL of its own making."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import kernels
from quarryline.functions import text as fx
from quarryline.operators import dispositions
from quarryline.plans.registry import registry
from quarryline.plans.relational import findings, ledger
from quarryline.workspace import table

QUERIES, SQL, query = registry()

strings = lambda c: F.from_json(c, "array<string>")
_F = "f AS (SELECT DISTINCT row_no, title, severity, primary_cwe, cwes, paths, validity, resolution, fingerprint, repo_key, finding_id FROM findings)"


def distinct_findings(s, d):
    return table(s, d, "findings").select("row_no", "title", "severity", "primary_cwe", "cwes", "paths", "validity", "resolution", "fingerprint", "repo_key", "finding_id").distinct()


@query("""WITH r AS (SELECT DISTINCT row_no, CASE row_no % 3 WHEN 0 THEN ' <' || repo_url || '> ' WHEN 1 THEN split_part(repo_url, '://', 2) ELSE repo_url END AS raw FROM repos),
  b AS (SELECT *, trim(regexp_replace(trim(raw), '^<(.*)>$', '\\1')) AS bare FROM r)
  SELECT row_no, CASE WHEN NOT contains(bare, '://') AND len(string_split(bare, '/')) >= 3 THEN 'https://' || bare ELSE bare END AS repaired FROM b""")
def fn_str_02_repaired(s, d):
    raw = F.when(F.col("row_no") % 3 == 0, F.concat(F.lit(" <"), "repo_url", F.lit("> "))).when(F.col("row_no") % 3 == 1, F.substring_index("repo_url", "://", -1)).otherwise(F.col("repo_url"))
    return table(s, d, "repos").select("row_no", raw.alias("raw")).distinct().select("row_no", fx.repaired_repository(F.col("raw")).alias("repaired"))


@query("""WITH r AS (SELECT DISTINCT row_no, CASE WHEN row_no % 2 = 0 THEN 'git@' || replace(split_part(repo_url, '://', 2), '/', ':') ELSE upper(repo_url) || '/' END AS raw, repo_url FROM repos)
  SELECT row_no, CASE WHEN row_no % 2 = 0 THEN regexp_replace(regexp_replace(replace(lower(raw), 'git@', ''), '^([^:]+):', '\\1/'), '\\.git$', '') ELSE regexp_replace(replace(lower(repo_url), 'https://', ''), '\\.git$', '') END AS key FROM r""")
def fn_str_03_join_key(s, d):
    raw = F.when(F.col("row_no") % 2 == 0, F.concat(F.lit("git@"), F.replace(F.substring_index("repo_url", "://", -1), F.lit("/"), F.lit(":")))).otherwise(F.concat(F.upper("repo_url"), F.lit("/")))
    return table(s, d, "repos").select("row_no", raw.alias("raw")).distinct().select("row_no", fx.join_url(F.col("raw")).alias("key"))


@query(f"""WITH {_F}, p AS (SELECT row_no, CASE i % 3 WHEN 0 THEN './vendor/' || path WHEN 1 THEN 'a/third_party/b/node_modules/' || path ELSE path END AS path, path AS wanted
    FROM (SELECT row_no, unnest(from_json(paths, '["VARCHAR"]')) AS path, generate_subscripts(from_json(paths, '["VARCHAR"]'), 1) AS i FROM f))
  SELECT row_no, array_to_string(list_sort(list_distinct(list(wanted))), ';') AS component FROM p GROUP BY 1""")
def fn_str_06_07_component(s, d):
    placed = F.transform(strings("paths"), lambda p, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("./vendor/"), p)).when((i + 1) % 3 == 1, F.concat(F.lit("a/third_party/b/node_modules/"), p)).otherwise(p))
    return distinct_findings(s, d).where(F.size(strings("paths")) > 0).select("row_no", F.array_join(fx.component_paths(placed), ";").alias("component"))


@query(f"""WITH {_F} SELECT row_no, regexp_replace(lower(trim(title)), '[\\s_]+', '-', 'g') AS category, lower(severity) AS rule, title AS excerpt FROM f WHERE title IS NOT NULL AND length(title) <= 120""")
def fn_str_08_09_10_names(s, d):
    named = distinct_findings(s, d).where(F.col("title").isNotNull() & (F.length("title") <= 120))
    return named.select("row_no", fx.category_slug(F.concat(F.lit(" "), "title", F.lit("  "))).alias("category"), fx.bare_rule_id(F.concat(F.lit("rules.go."), F.lower("severity"))).alias("rule"), fx.excerpt(F.concat(F.lit("  "), F.replace("title", F.lit(" "), F.lit(" \n ")))).alias("excerpt"))


@query("SELECT DISTINCT id, CASE WHEN id LIKE 'repo:%' THEN 'https://' || substr(id, 6) END AS url, trim(regexp_replace(replace(replace(id, 'repo:', ''), 'git.example.test/', ''), '[^a-zA-Z0-9_-]', '-', 'g'), '-') AS slug, coalesce(regexp_replace(list_extract(string_split(CASE WHEN id LIKE 'repo:%' THEN substr(id, 6) END, '/'), -1), '\\.git$', ''), 'unknown') AS tail FROM nodes")
def fn_str_11_repo_ids(s, d):
    return table(s, d, "nodes").select("id").distinct().select("id", fx.url_of_repo_id(F.col("id")).alias("url"), fx.slug_of_repo_id(F.col("id"), "git.example.test").alias("slug"), fx.slug_of_url(F.concat(fx.url_of_repo_id(F.col("id")), F.lit(".git/"))).alias("tail"))


_LANG = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fx.LANGUAGES.items()) + "}"


@query(f"""WITH {_F}, p AS (SELECT row_no, cwes, unnest(from_json(paths, '["VARCHAR"]')) AS path FROM f)
  SELECT DISTINCT row_no, path, {_LANG}[lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))] AS language, list_min(list_transform(from_json(cwes, '["VARCHAR"]'), lambda c: CAST(regexp_extract(c, '(\\d+)', 1) AS INT))) AS cwe FROM p""")
def fn_str_15_16_17_language(s, d):
    rows = distinct_findings(s, d).select("row_no", "cwes", F.explode(strings("paths")).alias("path"))
    path = fx.plain_path(F.concat(F.lit("././"), "path"))
    return rows.select("row_no", path.alias("path"), fx.language_of(path).alias("language"), fx.lowest_cwe(strings("cwes")).alias("cwe")).distinct()


@query(f"""WITH {_F}, l AS (SELECT row_no, row_no % 50 AS a, row_no % 7 AS b, finding_id, title FROM f)
  SELECT row_no, CASE WHEN a = 0 THEN '' WHEN b = 0 OR b = a THEN CAST(a AS VARCHAR) ELSE a || '-' || b END AS lines, CASE WHEN a > 0 THEN a END::INT AS start, CASE WHEN a > 0 AND b > 0 AND b <> a THEN b END::INT AS stop,
    CASE WHEN a % 2 = 0 THEN finding_id || '/x' END AS slug, '"<\\/' || finding_id || '<\\u0021--"' AS js FROM l""")
def fn_str_18_19_23_ranges(s, d):
    a, b = (F.col("row_no") % 50).cast("int"), (F.col("row_no") % 7).cast("int")
    named = distinct_findings(s, d).select("row_no", fx.written_range(a, b).alias("lines"), F.when(a % 2 == 0, F.concat("finding_id", F.lit("/x"))).otherwise(F.concat(F.lit("-"), "finding_id", F.lit("/x"))).alias("raw"), fx.script_json(F.concat(F.lit('"</'), "finding_id", F.lit('<!--"'))).alias("js"))
    return named.select("row_no", "lines", fx.line_range(F.col("lines"))["start"].alias("start"), fx.line_range(F.col("lines"))["end"].alias("stop"), fx.safe_slug(F.col("raw"), 2).alias("slug"), "js")


@query(f"""WITH {_F} SELECT row_no, replace(title, ' ', '\\|') || ' ]\\(x) javascript\u02d0' AS md, CASE WHEN row_no % 3 = 0 THEN '''=' || title WHEN row_no % 3 = 1 THEN '-' || row_no ELSE title END AS csv,
  '&lt;b&gt;' || replace(title, ' ', '&amp;') || '&quot;&#x27;' AS html, CASE WHEN row_no % 2 = 0 THEN '````' ELSE '```' END AS fence, title AS clean FROM f WHERE title IS NOT NULL""")
def fn_str_20_21_22_24_25_cells(s, d):
    t, odd = F.col("title"), F.col("row_no") % 3
    return distinct_findings(s, d).where("title is not null").select(
        "row_no", fx.md_cell(F.concat(F.replace(t, F.lit(" "), F.lit("|")), F.lit("\n]("), F.lit("x)\r\nJavaScript:"))).alias("md"),
        fx.csv_cell(F.when(odd == 0, F.concat(F.lit("="), t)).when(odd == 1, F.concat(F.lit("-"), F.col("row_no").cast("string"))).otherwise(t)).alias("csv"),
        fx.html_text(F.concat(F.lit("<b>"), F.replace(t, F.lit(" "), F.lit("&")), F.lit("\"'"))).alias("html"), fx.fence(F.when(F.col("row_no") % 2 == 0, F.concat(t, F.lit("```"))).otherwise(t)).alias("fence"),
        fx.no_controls(F.concat(t, F.lit("\u202e\x07"))).alias("clean"),
    )


@query("""WITH e AS (SELECT DISTINCT row_no, recorded_at, CAST(substr(recorded_at, 1, 19) AS TIMESTAMP) AS t FROM finding_events)
  SELECT row_no, CAST(substr(recorded_at, 1, 10) AS DATE) AS day, substr(recorded_at, 1, 7) AS month, round(100.0 / day(t) * day(last_day(t)), 6) AS rate, floor((epoch(TIMESTAMP '2026-01-01') - epoch(t)) / 3600)::BIGINT AS hours FROM e""")
def fn_date_01_03_04_dates(s, d):
    e = table(s, d, "finding_events").select("row_no", "recorded_at").distinct()
    day = fx.iso_date(F.col("recorded_at"))
    return e.select("row_no", day.alias("day"), fx.month_key(F.col("recorded_at")).alias("month"), F.round(fx.run_rate(F.lit(100.0), day), 6).alias("rate"), F.floor(fx.age_hours(F.substring("recorded_at", 1, 19).cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))).cast("bigint").alias("hours"))


@query("SELECT DISTINCT value, nullif(regexp_extract(value, '(\\d+\\.\\d+\\.\\d+)', 1), '') AS version, CASE WHEN regexp_full_match(value, '\\d+\\.\\d+\\.\\d+') THEN list_transform(string_split(value, '.'), lambda x: CAST(x AS BIGINT)) >= [0, 5] ELSE false END AS new_enough FROM meta WHERE key = 'harness_version' AND value IS NOT NULL")
def fn_ver_03_fn_str_28_versions(s, d):
    v = table(s, d, "meta").where("key = 'harness_version' and value is not null").select("value").distinct()
    return v.select("value", F.nullif(F.regexp_extract("value", r"(\d+\.\d+\.\d+)", 1), F.lit("")).alias("version"), fx.at_least(F.col("value"), F.lit("0.5")).alias("new_enough"))


@query(f"""WITH {_F} SELECT row_no, CASE severity WHEN 'critical' THEN 'error 9.5' WHEN 'high' THEN 'error 8.0' WHEN 'medium' THEN 'warning 5.0' WHEN 'low' THEN 'note 2.0' ELSE 'note 0.5' END AS sarif,
  CASE upper(severity) WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'LOW' THEN 'low' ELSE 'medium' END AS advisory, coalesce(severity, 'low') AS hint, CASE row_no % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS reach FROM f""")
def fn_math_03_severity_maps(s, d):
    sarif = fx.mapped(F.col("severity"), {k: " ".join(v) for k, v in fx.SARIF_LEVELS.items()}, "note 0.5")
    reach = F.when(F.col("row_no") % 3 == 0, "symbol_reachable").when(F.col("row_no") % 3 == 1, "module_required_not_observed").otherwise("other")
    return distinct_findings(s, d).select("row_no", sarif.alias("sarif"), fx.mapped(F.upper("severity"), fx.ADVISORY_WORDS, "medium").alias("advisory"), fx.mapped(F.lower(F.coalesce("severity", F.lit("low"))), fx.HINTS, "low").alias("hint"), fx.mapped(reach, fx.REACHABILITY, "medium").alias("reach"))


@query(f"""WITH {_F} SELECT row_no, sha256(repo_key || '|' || array_to_string(list_sort(from_json(paths, '["VARCHAR"]')), ';') || '|' || primary_cwe) AS fingerprint,
  sha256(array_to_string(list_sort(from_json(paths, '["VARCHAR"]')), ';') || '|' || upper(primary_cwe) || '|' || lower(trim(title)) || '|') AS signature, sha256(concat_ws(chr(31), coalesce(title, ''), coalesce(severity, ''), coalesce(primary_cwe, ''), coalesce(paths, ''))) AS claim
  FROM f WHERE paths IS NOT NULL AND primary_cwe IS NOT NULL AND repo_key IS NOT NULL AND title IS NOT NULL""")
def fn_hash_01_02_04_identity(s, d):
    f = distinct_findings(s, d).where("paths is not null and primary_cwe is not null and repo_key is not null and title is not null")
    return f.select("row_no", fx.fingerprint(F.col("repo_key"), strings("paths"), F.col("primary_cwe")).alias("fingerprint"), fx.component_signature(strings("paths"), F.col("primary_cwe"), F.col("title")).alias("signature"), fx.claim_hash(*map(F.col, ("title", "severity", "primary_cwe", "paths"))).alias("claim"))


@query("SELECT DISTINCT row_no, sha256(concat_ws('|', coalesce(source_ref, ''), coalesce(finding_id, ''), coalesce(validity, ''), coalesce(resolution, ''))) AS computed FROM finding_events")
def fn_hash_03_event_ids(s, d):
    return table(s, d, "finding_events").select("row_no", fx.event_id(F.col("source_ref"), F.col("finding_id"), F.col("validity"), F.col("resolution")).alias("computed")).distinct()


@query("""WITH m AS (SELECT build_no, key, max(value) AS value FROM meta WHERE key IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
  SELECT build_no, '{' || string_agg(to_json(key)::VARCHAR || ':' || to_json(value)::VARCHAR, ',' ORDER BY key) || '}' AS json, count(*) AS n FROM m GROUP BY 1""")
def fn_json_02_fn_map_01_canonical(s, d):
    m = table(s, d, "meta").where("key is not null").groupBy("build_no", "key").agg(F.max("value").alias("value"))
    # one build's keys: as many as there are kinds of metadata
    maps = m.groupBy("build_no").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("all")).withColumn("all", F.map_filter("all", lambda k, v: v.isNotNull()))
    return maps.where(F.size("all") > 0).select("build_no", kernels.canonical_map("all").alias("json"), F.size("all").cast("bigint").alias("n"))


@query("SELECT DISTINCT row_no, 'token = \"' || substr(event_id, 1, 5) || '...REDACTED\" at https://bot:' || substr(event_id, 1, 5) || '...REDACTED@git.example.test' AS clean, 'token-assignment,url-credentials' AS classes FROM finding_events")
def fn_str_26_redacted(s, d):
    e = table(s, d, "finding_events").select("row_no", F.concat(F.lit('token = "'), "event_id", F.lit('" at https://bot:'), "event_id", F.lit("@git.example.test")).alias("t")).distinct()
    return e.select("row_no", kernels.redacted("t").alias("clean"), F.array_join(kernels.secret_classes("t"), ",").alias("classes"))


@query("""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_key, finding_id ORDER BY loaded_at DESC, row_no DESC) AS rn FROM findings) WHERE rn = 1 AND removed_at IS NULL),
  e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, repo_key ORDER BY recorded_at DESC, row_no DESC) AS rn FROM finding_events) WHERE rn = 1)
  SELECT f.repo_key, finding_id, coalesce(e.validity, '') IN ('false_positive', 'hardening') AND actor_kind = 'human' AND coalesce(actor_identity, '') <> '' AS human, coalesce(e.validity, '') IN ('false_positive', 'hardening') AND actor_kind = 'machine' AND source_type IN ('triage_report', 'validation_report', 'verification_report') AS machine, count(*) AS n
  FROM f JOIN e USING (repo_key, finding_id) GROUP BY ALL""")
def flt_07_adjudications(s, d):
    e = ledger(s, d).select("repo_key", "finding_id", dispositions.human_verdict().alias("human"), dispositions.machine_verdict().alias("machine"))
    return findings(s, d).select("repo_key", "finding_id").join(e, ["repo_key", "finding_id"]).groupBy("repo_key", "finding_id", "human", "machine").agg(F.count("*").alias("n"))
