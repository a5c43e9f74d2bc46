"""Usage, journals, orders and streaks over the event tables; sessions are written as JSON lines and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.operators import relational as rel
from quarryline.operators import timeline as tl
from quarryline.plans.registry import registry
from quarryline.plans.relational import FI, findings
from quarryline.sources import readers, sinks
from quarryline.workspace import table, workspace

QUERIES, SQL, query = registry()
x = F.expr
_LINE = "user_id bigint, event_id bigint, at string, type string, model string, usage struct<tokens_in:bigint,tokens_out:bigint,cache_read:bigint,cache_new:bigint>, skill string"
_MSG = """m AS (SELECT user_id AS session, event_id, ts::DATE AS day, event_type AS model, floor(abs(value))::BIGINT AS tokens_in, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_out, event_id % 100 AS cache_read, event_id % 10 AS cache_new, CASE WHEN event_type = 'signup' THEN 's' || event_id % 7 END AS signal FROM events),
  a AS (SELECT * EXCLUDE (signal), coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY session ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unattributed') AS skill FROM m)"""
_SUMS = "sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(cache_read)::BIGINT AS cache_read, sum(cache_new)::BIGINT AS cache_new, count(*) AS messages, count(DISTINCT session) AS sessions"


def messages(s, d):
    """Messages with the skill that was active, from transcripts: JSON lines in the order of each session, some of them broken or of another kind."""
    e = table(s, d, "events")
    usage = F.struct(F.floor(F.abs("value")).alias("tokens_in"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens_out"), (F.col("event_id") % 100).alias("cache_read"), (F.col("event_id") % 10).alias("cache_new"))
    body = F.to_json(F.struct("user_id", "event_id", F.col("ts").cast("string").alias("at"), F.lit("message").alias("type"), F.col("event_type").alias("model"), usage.alias("usage"), x("if(event_type = 'signup', concat('s', event_id % 7), null)").alias("skill")))
    lines = e.select("user_id", "event_id", F.explode(F.when(F.col("event_id") % 9 == 0, F.array(body, F.lit('{"type": "note"}'), F.lit('{"usage": broken'))).otherwise(F.array(body))).alias("value"))
    path = f"{workspace(s)}/transcripts"
    lines.repartition("user_id").sortWithinPartitions("user_id", "event_id").select("value").write.text(path)
    read = readers.json_lines(s, path, _LINE, ['"usage"', '"skill"']).select("path", "line_no", "doc.*")
    known = rel.with_last(read, ["user_id"], ["path", "line_no"], {"active": F.col("skill")})
    return known.select(F.col("user_id").alias("session"), "event_id", F.substring("at", 1, 10).cast("date").alias("day"), "model", "usage.*", F.coalesce("active", F.lit("unattributed")).alias("skill"))


@query(f"WITH {_MSG} SELECT session, event_id, skill FROM a")
def src_06_job_08_attributed(s, d):
    return messages(s, d).select("session", "event_id", "skill")


@query(f"WITH {_MSG} SELECT day, model, {_SUMS} FROM a GROUP BY 1, 2")
def agg_17_job_07_usage(s, d):
    return tl.usage_by(messages(s, d), ["day", "model"])


@query(f"WITH {_MSG} SELECT day, skill, model, {_SUMS}, 'day' AS level FROM a GROUP BY 1, 2, 3 UNION ALL SELECT NULL, skill, NULL, {_SUMS}, 'skill' FROM a GROUP BY 2 UNION ALL SELECT NULL, NULL, NULL, {_SUMS}, 'all' FROM a")
def agg_18_levels(s, d):
    return tl.usage_levels(messages(s, d))


@query(f"WITH {_MSG} SELECT 0::BIGINT AS tokens_in, 0::BIGINT AS tokens_out, 0::BIGINT AS cache_read, 0::BIGINT AS cache_new, 0::BIGINT AS messages, true AS lossless FROM (SELECT count(*) FROM a)")
def agg_19_reconciled(s, d):
    m = messages(s, d)
    return tl.reconciled(tl.usage_by(m, ["day", "model"]), tl.usage_by(m, ["day", "skill", "model"]))


@query(f"WITH {_MSG} SELECT strftime(day, '%Y-%m') AS month, skill AS lane, sum(tokens_in + tokens_out)::BIGINT AS tokens, sum(CASE WHEN skill <> 'unattributed' THEN tokens_in + tokens_out ELSE 0 END)::BIGINT AS in_lanes FROM a GROUP BY GROUPING SETS ((1, 2), (1))")
def agg_16_str_04_lanes(s, d):
    return tl.lanes(messages(s, d))


@query(f"WITH {_MSG}, u AS (SELECT day, model, {_SUMS} FROM a GROUP BY 1, 2), known AS (SELECT * FROM u WHERE day < DATE '2024-01-12' OR (model = 'view' AND day < DATE '2024-01-15')) SELECT * FROM u WHERE day < DATE '2024-01-25' AND (day, model) NOT IN (SELECT (day, model) FROM known)")
def snk_08_completed_days(s, d):
    daily = tl.usage_by(messages(s, d), ["day", "model"])
    return rel.append_completed(daily.where("day < date'2024-01-12' or (model = 'view' and day < date'2024-01-15')"), daily, ["day", "model"], "day", F.lit("2024-01-25").cast("date"))


# ---- journals: one row of metrics for each day and source

_J = "j AS (SELECT event_type AS source, ts::DATE AS place, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2), p AS (SELECT source, 'n' AS key, place, n::DOUBLE AS value FROM j UNION ALL SELECT source, 'total', place, total FROM j UNION ALL SELECT source, 'users', place, users FROM j)"


def journal(s, d):
    j = table(s, d, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("place")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users"))
    return j.select("source", "place", F.create_map(F.lit("n"), F.col("n").cast("string"), F.lit("total"), F.col("total").cast("string"), F.lit("users"), F.col("users").cast("string"), F.lit("note"), F.lit("text")).alias("metrics"))


@query(f"WITH {_J}, l AS (SELECT *, lag(value) OVER (PARTITION BY source, key ORDER BY place) AS previous FROM p), v AS (SELECT *, round(value - previous, 6) AS delta FROM l) SELECT source, key, place, value, previous, delta, CASE WHEN previous IS NULL THEN 'new' WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END AS trend, CASE WHEN previous IS NULL THEN NULL WHEN delta = 0 THEN 'same' WHEN (delta < 0) = (source = 'error') THEN 'better' ELSE 'worse' END AS verdict FROM v")
def win_04_job_20_movement(s, d):
    return tl.movement(tl.series(journal(s, d)), F.col("source") == "error")


@query(f"WITH {_J} SELECT source, key, arg_min(value, place) AS first, arg_max(value, place) AS last, count(*) AS n FROM p GROUP BY 1, 2")
def win_05_ends(s, d):
    return tl.ends(tl.series(journal(s, d)))


@query(f"WITH {_J} SELECT source, max(place) AS place, arg_max(n, place) AS n FROM j WHERE place < DATE '2024-01-20' GROUP BY 1")
def win_02_before(s, d):
    return tl.before(journal(s, d), F.lit("2024-01-20").cast("date")).select("source", "place", F.col("metrics")["n"].cast("bigint").alias("n"))


@query(f"WITH {_J} SELECT source, place, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY place DESC) AS rn FROM j) WHERE rn <= 6")
def sort_06_newest(s, d):
    return tl.newest(journal(s, d), ["source"], "place", 6).select("source", "place", F.col("metrics")["n"].cast("bigint").alias("n"))


# ---- order and streaks

_PARSED = "CASE WHEN regexp_full_match(occurred_at, '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d\\+00:00') THEN CAST(substr(occurred_at, 1, 19) AS TIMESTAMP) END"


@query(f"WITH e AS (SELECT DISTINCT row_no, repo_key, {_PARSED} AS at_time FROM finding_events), o AS (SELECT *, last_value(at_time IGNORE NULLS) OVER (PARTITION BY repo_key ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) SELECT row_no, repo_key, at_time, before FROM o WHERE at_time < before")
def win_07_backward(s, d):
    """Events that happened before the last one of their repository, in the order of the ledger, whose time is written plainly."""
    plain = F.col("occurred_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$")
    e = table(s, d, "finding_events").select("row_no", "repo_key", F.when(plain, F.substring("occurred_at", 1, 19).try_cast("timestamp_ntz")).alias("at_time")).distinct()
    return tl.backward(e, ["repo_key"], ["row_no"], "at_time").select("row_no", "repo_key", "at_time", "before")


@query("""WITH e AS (SELECT DISTINCT row_no, repo_key, coalesce(actor_kind = 'machine', false) AS hit FROM finding_events), g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY repo_key ORDER BY row_no) AS island FROM e)
  SELECT repo_key, min(row_no) AS began, count(*) AS n FROM g WHERE hit GROUP BY repo_key, island HAVING count(*) >= 5""")
def win_16_streaks(s, d):
    """Runs of five machine events and more in a repository, in the order of the ledger."""
    e = table(s, d, "finding_events").select("row_no", "repo_key", (F.col("actor_kind") == "machine").alias("hit")).distinct()
    return tl.streaks(e, ["repo_key"], ["row_no"], F.col("hit"), 5)


_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(f"WITH {FI} SELECT repo_key, finding_id, severity, date_diff('day', CAST(loaded_at AS DATE), DATE '2026-06-01')::INT AS days FROM f WHERE coalesce(resolution, 'open') = 'open' ORDER BY {_RANK} DESC, days DESC, repo_key, finding_id LIMIT 100")
def sort_02_escalations(s, d):
    rank = F.array_position(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("severity"))
    f = findings(s, d).where("coalesce(resolution, 'open') = 'open'").select("repo_key", "finding_id", "severity", F.datediff(F.lit("2026-06-01").cast("date"), F.col("loaded_at").cast("date")).alias("days"))
    return f.orderBy(F.coalesce(rank, F.lit(0)).desc(), F.desc("days"), "repo_key", "finding_id").limit(100)


@query(f"WITH {_J}, r AS (SELECT row_number() OVER (ORDER BY place, source) AS line_no, sha256(source || place || n) AS row_sha FROM j), c AS (SELECT *, lag(row_sha, 1, '') OVER (ORDER BY line_no) AS before FROM r), t AS (SELECT line_no, CASE WHEN line_no % 10 = 0 THEN 'forged' ELSE before END AS prev_sha, row_sha FROM c) SELECT line_no, prev_sha, row_sha FROM t WHERE line_no % 10 = 0")
def win_03_broken_links(s, d):
    """A chained journal of which every tenth row was forged."""
    j = table(s, d, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("place")).agg(F.count("*").alias("n"))
    w = W.orderBy("place", "source")  # a few rows for each day
    r = j.select(F.row_number().over(w).cast("bigint").alias("line_no"), F.sha2(F.concat("source", F.col("place").cast("string"), F.col("n").cast("string")), 256).alias("row_sha"))
    chained = r.withColumn("prev_sha", F.when(F.col("line_no") % 10 == 0, "forged").otherwise(F.lag("row_sha", 1, "").over(W.orderBy("line_no"))))
    return sinks.broken_links(chained)
