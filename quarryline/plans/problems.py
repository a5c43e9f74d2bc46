"""Queries p1 to p6 over the test tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import changefeed, hierarchy, instants, late_events, orphans, schema_drift
from quarryline.workspace import table, workspace


def _references(spark: SparkSession, d: str) -> list[orphans.Reference]:
    events, findings, repos = (table(spark, d, n) for n in ("finding_events", "findings", "repos"))
    recorded = F.substring("recorded_at", 1, 19).try_cast("timestamp_ntz")
    return [
        orphans.Reference("findings", "repo_key", findings, {"repo_key": "repo_key"}, F.col("loaded_at"), repos),
        orphans.Reference("finding_events", "repo_key", events, {"repo_key": "repo_key"}, recorded, repos),
        orphans.Reference("finding_events", "finding_id", events, {"finding_id": "finding_id", "repo_key": "repo_key"}, recorded, findings),
    ]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = [orphans.find_orphans(r) for r in _references(spark, d)]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("table_name", "row_no", "field_name")


def p1_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_references(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.Drift(table(spark, d, "raw_records")).changes()


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.Drift(table(spark, d, "raw_records")).fingerprints()


def p2_casts(spark: SparkSession, d: str) -> DataFrame:
    drift = schema_drift.Drift(table(spark, d, "raw_records"))
    return drift.casts("repos").unionByName(drift.casts("findings")).unionByName(drift.casts("meta"))


def p2_migrations(spark: SparkSession, d: str) -> DataFrame:
    drift, out = schema_drift.Drift(table(spark, d, "raw_records")), None
    for dataset in schema_drift.TARGETS:
        part = drift.migrations(dataset).select(F.lit(dataset).alias("dataset"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _unified(dataset: str):
    return lambda spark, d: schema_drift.Drift(table(spark, d, "raw_records")).unified(dataset)


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.apply_feed(table(spark, d, "event_changes"), workspace(spark), ["event_id", "repo_key"], ["log_no", "log_pos"], ["source_type", "validity", "resolution"], "feed_pos")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_state(spark, d).select("event_id", "repo_key", "log_no", "log_pos")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy_links(table(spark, d, "edges"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_trees(_links(spark, d), paths=False, parents=False).select("node_id", "root_id", "depth")


def p4_trees(spark: SparkSession, d: str) -> DataFrame:
    trees = hierarchy.resolve_trees(_links(spark, d), parents=False)
    return trees.select("node_id", "root_id", "depth", F.when(F.col("path").isNotNull(), F.concat_ws(" > ", "path")).alias("path"), "subtree_size")


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve_trees(_links(spark, d), paths=False))


def p4_dropped_links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.dropped_links(_links(spark, d), hierarchy.resolve_trees(_links(spark, d), paths=False))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    store = late_events.LateStore(spark, workspace(spark))
    store.ingest(table(spark, d, "finding_events"))
    return store.late_cases()


def p5_weekly(spark: SparkSession, d: str) -> DataFrame:
    """The weeks after two runs of ingestion: what was recorded up to the middle of the time covered, and the rest."""
    events, store = table(spark, d, "finding_events"), late_events.LateStore(spark, workspace(spark))
    day = F.unix_date(F.substring("recorded_at", 1, 10).try_cast("date"))
    low, high = events.agg(F.min(day), F.max(day)).first()
    early = F.coalesce(day <= ((low or 0) + (high or 0)) // 2, F.lit(False))
    store.ingest(events.where(early))
    store.ingest(events.where(~early))
    return store.weekly()


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    events, findings, repos = (table(spark, d, n) for n in ("finding_events", "findings", "repos"))
    return (
        instants.by_convention(events, "finding_events", "occurred_at")
        .unionByName(instants.by_convention(findings, "findings", "last_updated"))
        .unionByName(instants.by_convention(repos, "repos", "audit_date"))
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.found(_normalised(spark, d))


QUERIES = {
    "p1_found": p1_found, "p1_orphans_by_month": p1_orphans_by_month, "p2_found": p2_found, "p2_versions": p2_versions,
    "p2_casts": p2_casts, "p2_migrations": p2_migrations, "p2_repos": _unified("repos"), "p2_findings": _unified("findings"), "p2_meta": _unified("meta"),
    "p3_found": p3_found, "p3_state": p3_state, "p4_found": p4_found, "p4_trees": p4_trees, "p4_descendants": p4_descendants, "p4_dropped_links": p4_dropped_links,
    "p5_found": p5_found, "p5_weekly": p5_weekly, "p6_found": p6_found,
}

_REFS = """
refs AS (
  SELECT DISTINCT 'findings' AS table_name, row_no, 'repo_key' AS field_name, repo_key, CAST(NULL AS VARCHAR) AS finding_id, CAST(loaded_at AS TIMESTAMP) AS t FROM findings WHERE repo_key IS NOT NULL
  UNION ALL SELECT DISTINCT 'finding_events', row_no, 'repo_key', repo_key, NULL, CAST(substr(recorded_at, 1, 19) AS TIMESTAMP) FROM finding_events WHERE repo_key IS NOT NULL
  UNION ALL SELECT DISTINCT 'finding_events', row_no, 'finding_id', repo_key, finding_id, CAST(substr(recorded_at, 1, 19) AS TIMESTAMP) FROM finding_events WHERE finding_id IS NOT NULL
),
gone AS (
  SELECT * FROM refs r WHERE field_name = 'repo_key' AND NOT EXISTS (SELECT 1 FROM repos p WHERE p.repo_key = r.repo_key AND p.loaded_at <= r.t AND (p.removed_at IS NULL OR r.t < p.removed_at))
  UNION ALL
  SELECT * FROM refs r WHERE field_name = 'finding_id' AND NOT EXISTS (SELECT 1 FROM findings p WHERE p.repo_key = r.repo_key AND p.finding_id = r.finding_id AND p.loaded_at <= r.t AND (p.removed_at IS NULL OR r.t < p.removed_at))
)"""
_LAST = """
last AS (
  SELECT *, row_number() OVER (PARTITION BY event_id, repo_key ORDER BY log_no DESC, log_pos DESC) AS rn
  FROM event_changes
)"""
_TREE = """
links AS (
  SELECT DISTINCT CASE WHEN rel IN ('in_group', 'owned-by') THEN dst ELSE src END AS parent, CASE WHEN rel IN ('in_group', 'owned-by') THEN src ELSE dst END AS child
  FROM edges WHERE rel IN ('contains', 'includes', 'owns', 'has_ref', 'in_group', 'owned-by')
),
nodes_in AS (SELECT parent AS node_id FROM links UNION SELECT child FROM links),
walk(node_id, root_id, depth, path) AS (
  SELECT node_id, node_id, CAST(0 AS BIGINT), node_id FROM nodes_in WHERE node_id NOT IN (SELECT child FROM links)
  UNION ALL SELECT l.child, w.root_id, w.depth + 1, w.path || ' > ' || l.child FROM walk w JOIN links l ON l.parent = w.node_id
)"""
#: Instants in SQL: written(t, row_no, field, v, tz, ...) -> timed with ms. Zones by name come from the engine's own tables.
_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
_HOURS = "MAP {'UTC': 0, 'GMT': 0, 'Z': 0, 'CET': 60, 'CEST': 120, 'BST': 60, 'EST': -300, 'EDT': -240, 'CST': -360, 'CDT': -300, 'PST': -480, 'PDT': -420, 'JST': 540, 'AEST': 600, 'AEDT': 660, 'IST': 330, 'NZST': 720, 'NZDT': 780}"
_parts = lambda shape, *groups: "[" + ", ".join(f"regexp_extract(x, '{shape}', {i})" for i in groups) + "]"
_TIMED = f"""
trimmed AS (SELECT *, trim(regexp_replace(v, '\\s+', ' ', 'g')) AS x FROM written),
dated AS (SELECT *, CASE WHEN regexp_matches(x, '^\\d{{4}}[-/]\\d\\d[-/]\\d\\d') THEN [substr(x, 1, 4), substr(x, 6, 2), substr(x, 9, 2), substr(x, 11)]
    WHEN regexp_matches(x, '^\\d{{8}}[T ]') THEN [substr(x, 1, 4), substr(x, 5, 2), substr(x, 7, 2), substr(x, 9)] WHEN regexp_matches(x, '^\\d\\d\\.\\d\\d\\.\\d{{4}}') THEN [substr(x, 7, 4), substr(x, 4, 2), substr(x, 1, 2), substr(x, 11)]
    WHEN regexp_matches(x, '^\\d\\d/\\d\\d/\\d{{4}}') THEN [substr(x, 7, 4), substr(x, 1, 2), substr(x, 4, 2), substr(x, 11)]
    WHEN regexp_matches(x, '^([A-Za-z]{{3}}, )?\\d{{1,2}} [A-Z][a-z]+ \\d{{4}}') THEN {_parts('^([A-Za-z]{3}, )?(\\d{1,2}) ([A-Z][a-z]+) (\\d{4})(.*)$', 4, 3, 2, 5)}
    WHEN regexp_matches(x, '^[A-Z][a-z]+ \\d{{1,2}}, \\d{{4}}') THEN {_parts('^([A-Z][a-z]+) (\\d{1,2}), (\\d{4})(.*)$', 3, 1, 2, 4)} END AS p FROM trimmed),
clocked AS (SELECT *, regexp_extract(p[4], '^[T ](\\d{{1,2}}):?(\\d\\d)(?::?(\\d\\d)(?:\\.(\\d+))?)?(?: ?([AP])M)?(?: ?(Z|[+-]\\d\\d(?::?\\d\\d)?|[A-Z]{{2,5}}))?(?:\\[.*\\])?$', ['h', 'mi', 's', 'f', 'ap', 'zo']) AS c, coalesce(list_position({_MONTHS}, lower(substr(p[2], 1, 3)))::VARCHAR, p[2]) AS mo FROM dated),
local AS (SELECT *, nullif(c['zo'], '') AS zo, CASE WHEN p[4] = '' OR c['h'] <> '' THEN try_cast(p[1] || '-' || lpad(mo, 2, '0') || '-' || lpad(p[3], 2, '0') || ' ' || CASE WHEN c['h'] = '' THEN '00' WHEN c['ap'] <> '' THEN lpad((try_cast(c['h'] AS INT) % 12 + CASE c['ap'] WHEN 'P' THEN 12 ELSE 0 END)::VARCHAR, 2, '0') ELSE lpad(c['h'], 2, '0') END || ':' || coalesce(nullif(c['mi'], ''), '00') || ':' || coalesce(nullif(c['s'], ''), '00') AS TIMESTAMP) END AS lo FROM clocked),
zoned AS (SELECT *, timezone(coalesce(tz, 'UTC'), lo) AS u FROM local),
timed AS (SELECT *, CASE WHEN regexp_full_match(x, '\\d+(\\.\\d+)?') THEN CASE WHEN try_cast(split_part(x, '.', 1) AS BIGINT) >= 100000000000 THEN try_cast(split_part(x, '.', 1) AS BIGINT) ELSE try_cast(split_part(x, '.', 1) AS BIGINT) * 1000 + try_cast(substr(split_part(x, '.', 2) || '000', 1, 3) AS BIGINT) END
    ELSE try_cast(substr(coalesce(c['f'], '') || '000', 1, 3) AS BIGINT) + CASE WHEN zo IS NULL THEN CASE WHEN timezone(coalesce(tz, 'UTC'), u - INTERVAL 1 HOUR) = lo THEN epoch_ms(u) - 3600000 ELSE epoch_ms(u) END
      ELSE epoch_ms(lo) - 60000 * CASE WHEN zo[1] IN ('+', '-') THEN try_cast(zo[1] || '1' AS INT) * (try_cast(substr(zo, 2, 2) AS INT) * 60 + try_cast(coalesce(nullif(replace(substr(zo, 4), ':', ''), ''), '0') AS INT)) ELSE {_HOURS}[zo] END END END AS ms FROM zoned)"""
_FORM = "'\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d\\+00:00'"
_WEEKS = f"""WITH once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, repo_key ORDER BY recorded_at, row_no) AS rn FROM finding_events) WHERE rn = 1),
  written AS (SELECT *, occurred_at AS v, site_tz AS tz FROM once), {_TIMED}, placed AS (SELECT *, 345600000 + floor((ms - 345600000) / 604800000)::BIGINT * 604800000 AS week, epoch_ms(CAST(substr(recorded_at, 1, 19) AS TIMESTAMP)) AS came FROM timed WHERE ms IS NOT NULL),
  judged AS (SELECT *, CASE WHEN came < week + 604800000 THEN 'on_time' WHEN came < week + 3024000000 THEN 'corrects' ELSE 'cut' END AS outcome FROM placed)"""
WEEKLY_SQL = f"{_WEEKS} SELECT CAST(epoch_ms(week) AS DATE) AS week, resolution, count(*) FILTER (WHERE outcome = 'on_time') AS n_on_time, count(*) FILTER (WHERE outcome = 'corrects') AS n_corrected, count(*) FILTER (WHERE outcome <> 'cut') AS n_events, count(*) FILTER (WHERE outcome = 'cut') AS n_cut"
_DELETES = "lower(trim(op)) NOT IN ('delete', 'd', 'tombstone', 'remove')"
_TYPE = lambda v: f"CASE json_type({v}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' ELSE 'number' END"
_DRIFT = f"""
recs AS (SELECT DISTINCT producer, dataset, file_no, file_name, body::JSON AS doc FROM raw_records WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
keyed AS (SELECT *, CASE dataset WHEN 'repos' THEN doc->>'repo_key' WHEN 'findings' THEN (doc->>'repo_key') || chr(1) || (doc->>'finding_id') ELSE doc->>'key' END AS rec FROM recs),
cells AS (SELECT DISTINCT producer, dataset, file_name, rec, k AS field, doc->k AS v FROM (SELECT *, unnest(json_keys(doc)) AS k FROM keyed) WHERE json_type(doc->k) <> 'NULL' AND NOT (k = 'repo_key' AND dataset <> 'meta' OR k = 'finding_id' AND dataset = 'findings' OR k = 'key' AND dataset = 'meta')),
typed AS (SELECT file_name, field, array_to_string(list_sort(list_distinct(list(CASE json_type(v) WHEN 'ARRAY' THEN 'array[' || array_to_string(list_sort(list_distinct(list_transform(list_filter(json_extract(v, '$[*]'), lambda e: json_type(e) <> 'NULL'), lambda e: {_TYPE('e')}))), ',') || ']' ELSE {_TYPE('v')} END))), '|') AS types FROM cells GROUP BY 1, 2),
files AS (SELECT DISTINCT producer, dataset, file_no, file_name FROM raw_records), line AS (SELECT file_name, lag(file_name) OVER (PARTITION BY producer, dataset ORDER BY file_no, file_name) AS before FROM files),
pair AS (SELECT * FROM line WHERE before IS NOT NULL), fresh AS (SELECT p.*, t.field, t.types FROM pair p JOIN typed t USING (file_name) WHERE NOT EXISTS (SELECT 1 FROM typed o WHERE o.file_name = p.before AND o.field = t.field)),
gone AS (SELECT p.*, t.field, t.types FROM pair p JOIN typed t ON t.file_name = p.before WHERE NOT EXISTS (SELECT 1 FROM typed o WHERE o.file_name = p.file_name AND o.field = t.field)),
held AS (SELECT DISTINCT file_name, rec FROM keyed WHERE rec IS NOT NULL),
news AS (SELECT f.file_name, f.field, list_sort(list(c.rec || chr(2) || c.v::VARCHAR)) AS mark FROM fresh f JOIN cells c ON c.file_name = f.file_name AND c.field = f.field JOIN held h ON h.file_name = f.before AND h.rec = c.rec GROUP BY 1, 2),
olds AS (SELECT g.file_name, g.field, list_sort(list(c.rec || chr(2) || c.v::VARCHAR)) AS mark FROM gone g JOIN cells c ON c.file_name = g.before AND c.field = g.field JOIN held h ON h.file_name = g.file_name AND h.rec = c.rec GROUP BY 1, 2),
ren AS (SELECT n.file_name, n.field AS now, o.field AS was FROM news n JOIN olds o ON o.file_name = n.file_name AND o.mark = n.mark),
same AS (SELECT p.file_name, t.field, t.types AS a, o.types AS b FROM pair p JOIN typed t USING (file_name) JOIN typed o ON o.file_name = p.before AND o.field = t.field UNION ALL SELECT r.file_name, r.now, f.types, g.types FROM ren r JOIN fresh f ON f.file_name = r.file_name AND f.field = r.now JOIN gone g ON g.file_name = r.file_name AND g.field = r.was)"""
SQL = {
    "p2_versions": f"""WITH {_DRIFT}, fp AS (SELECT file_name, sha256(array_to_string(list_sort(list(field || ':' || types)), ',')) AS fingerprint FROM typed GROUP BY 1), q AS (SELECT f.*, coalesce(fingerprint, sha256('')) AS fingerprint, row_number() OVER w AS seq FROM files f LEFT JOIN fp USING (file_name) WINDOW w AS (PARTITION BY producer, dataset ORDER BY file_no, file_name)),
        c AS (SELECT *, CASE WHEN fingerprint = lag(fingerprint) OVER (PARTITION BY producer, dataset ORDER BY seq) THEN 0 ELSE 1 END AS new FROM q) SELECT producer, dataset, file_name, seq::INT AS seq, sum(new) OVER (PARTITION BY producer, dataset ORDER BY seq)::INT AS version, fingerprint FROM c""",
    "p2_found": f"""WITH {_DRIFT} SELECT DISTINCT file_name, now AS field_name, 'renamed' AS change_kind FROM ren UNION SELECT file_name, field, 'added' FROM fresh WHERE (file_name, field) NOT IN (SELECT (file_name, now) FROM ren)
        UNION SELECT file_name, field, 'removed' FROM gone WHERE (file_name, field) NOT IN (SELECT (file_name, was) FROM ren) UNION SELECT file_name, field, 'retyped' FROM same WHERE a <> b""",
    "p5_found": f"{_WEEKS} SELECT repo_key, event_id, outcome FROM judged WHERE outcome <> 'on_time'",
    "p5_weekly": f"{WEEKLY_SQL}, count(DISTINCT came // 86400000) AS batches FROM judged GROUP BY week, resolution",
    "p6_found": f"""WITH written AS (SELECT DISTINCT 'finding_events' AS table_name, row_no, 'occurred_at' AS field_name, occurred_at AS v, site_tz AS tz FROM finding_events UNION ALL SELECT DISTINCT 'findings', row_no, 'last_updated', last_updated, site_tz FROM findings UNION ALL SELECT DISTINCT 'repos', row_no, 'audit_date', audit_date, site_tz FROM repos), {_TIMED}
        SELECT table_name, row_no, field_name, ms AS epoch_ms FROM timed WHERE ms IS NOT NULL AND NOT regexp_full_match(v, {_FORM})""",
    "p1_found": f"WITH {_REFS} SELECT table_name, row_no, field_name FROM gone",
    "p1_orphans_by_month": f"""WITH {_REFS}, n AS (SELECT table_name, field_name, CAST(date_trunc('month', t) AS DATE) AS month, count(*) AS n_refs FROM refs GROUP BY ALL),
        g AS (SELECT table_name, field_name, CAST(date_trunc('month', t) AS DATE) AS month, count(*) AS n FROM gone GROUP BY ALL)
        SELECT n.table_name, n.field_name, n.month, n_refs, coalesce(g.n, 0) AS n_orphans FROM n LEFT JOIN g USING (table_name, field_name, month)""",
    "p3_found": f"WITH {_LAST} SELECT event_id, repo_key, log_no, log_pos FROM last WHERE rn = 1 AND {_DELETES}",
    "p3_state": f"WITH {_LAST} SELECT event_id, repo_key, log_no, log_pos, source_type, validity, resolution FROM last WHERE rn = 1 AND {_DELETES}",
    "p4_found": f"""WITH RECURSIVE {_TREE},
        chase(start, here) AS (SELECT child, parent FROM links WHERE child NOT IN (SELECT node_id FROM walk) UNION SELECT start, l.parent FROM chase c JOIN links l ON l.child = c.here),
        looped AS (SELECT DISTINCT start FROM chase WHERE start = here)
        SELECT node_id, root_id, depth FROM walk
        UNION ALL SELECT node_id, CASE WHEN node_id IN (SELECT start FROM looped) THEN '(cycle)' ELSE '(below cycle)' END, CAST(-1 AS BIGINT) FROM nodes_in WHERE node_id NOT IN (SELECT node_id FROM walk)""",
    "p4_trees": f"""WITH RECURSIVE {_TREE},
        chase(start, here) AS (SELECT child, parent FROM links WHERE child NOT IN (SELECT node_id FROM walk) UNION SELECT start, l.parent FROM chase c JOIN links l ON l.child = c.here),
        looped AS (SELECT DISTINCT start FROM chase WHERE start = here),
        sizes AS (SELECT w.node_id, count(*) AS n FROM walk w JOIN walk b ON b.root_id = w.root_id AND (b.path = w.path OR starts_with(b.path, w.path || ' > ')) GROUP BY 1)
        SELECT w.node_id, root_id, depth, path, n AS subtree_size FROM walk w JOIN sizes USING (node_id)
        UNION ALL SELECT node_id, CASE WHEN node_id IN (SELECT start FROM looped) THEN '(cycle)' ELSE '(below cycle)' END, CAST(-1 AS BIGINT), NULL, NULL FROM nodes_in WHERE node_id NOT IN (SELECT node_id FROM walk)""",
    "p4_descendants": f"""WITH RECURSIVE {_TREE},
        below(ancestor, node_id, distance) AS (SELECT l.parent, l.child, CAST(1 AS BIGINT) FROM links l WHERE l.child IN (SELECT node_id FROM walk) UNION ALL SELECT b.ancestor, l.child, b.distance + 1 FROM below b JOIN links l ON l.parent = b.node_id)
        SELECT ancestor, node_id, distance FROM below""",
}
