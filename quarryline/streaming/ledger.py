"""Structured Streaming forms of the ledger's policies: idempotent events, final days, sessions, carried state, changes only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.operators import late_events
from quarryline.plans.problems import WEEKLY_SQL
from quarryline.workspace import children, workspace


def read_events(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Files of a folder as a stream; files_per_batch bounds what one trigger takes."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process all that is there now, with a checkpoint beside the output, and read the output; a rerun goes on where it stopped."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/progress").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def deduplicated(stream: DataFrame, key: list[str], at: str, delay: str = "24 hours") -> DataFrame:
    """Each key once within the delay; state of older keys is dropped with the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def in_time(stream: DataFrame, at: str, now, ahead: str = "24 hours") -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): rows further in the future than allowed, or without a time, are set apart."""
    good = F.coalesce(F.col(at) <= now + F.expr(f"interval {ahead}"), F.lit(False))
    return stream.where(good), stream.where(~good)


def final_days(stream: DataFrame, at: str, by: list[str], delay: str = "1 day") -> DataFrame:
    """Counts per day, emitted once when the watermark has passed the day's end, and never revised."""
    w = F.window(at, "1 day")
    return stream.withWatermark(at, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), *by, "n")


def sliding(stream: DataFrame, at: str, by: list[str], length: str, slide: str, delay: str) -> DataFrame:
    """Counts in overlapping windows; an extension beside the tumbling ones."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, length, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *by, "n")


def sessions(stream: DataFrame, at: str, by: list[str], gap: str, delay: str) -> DataFrame:
    """Counts of sessions that end with a gap; an extension."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *by, "n")


def attributed(stream: DataFrame, session: str, order: str, signal: str, default: str = "unattributed") -> DataFrame:
    """(session, order, active): the last signal seen in a session, carried over batches as state; rows of a batch go in order."""

    def carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = state.get[0] if state.exists else default
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for s in pdf[signal]:
            active = s if isinstance(s, str) and s else active
            out.append(active)
        state.update((active,))
        yield pd.DataFrame({session: pdf[session], order: pdf[order], "active": out})

    types = dict(stream.dtypes)
    return stream.groupBy(session).applyInPandasWithState(carry, f"`{session}` {types[session]}, `{order}` {types[order]}, active string", "active string", "append", GroupStateTimeout.NoTimeout)


def _each_batch(stream: DataFrame, one, progress: str) -> None:
    stream.writeStream.foreachBatch(one).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def _before(spark: SparkSession, path: str, n: int, schema) -> DataFrame:
    """What the batches before the n-th wrote below path (batch=…); a batch that is run again doesn't see its own."""
    names = [c for c in children(spark, path) if c.startswith("batch=") and int(c[6:]) < n]
    return spark.read.schema(schema).parquet(*[f"{path}/{c}" for c in names]) if names else spark.createDataFrame([], schema)


def changed_only(stream: DataFrame, key: list[str], value: str, at: str, path: str) -> DataFrame:
    """(key, at, value): a row only where a key's value differs from the last one recorded; the table of all batches.

    Rows of a batch go in the order of ``at``. A NULL value is a value. Each batch writes a folder of its own, so one
    that is run again after a stop writes the same rows over it.
    """
    spark, schema = stream.sparkSession, stream.select(*key, at, value).schema

    def one(batch: DataFrame, n: int) -> None:
        known = _before(batch.sparkSession, path, n, schema).groupBy(*key).agg(F.max_by(F.struct(value), at).alias("__k"))
        own = batch.select(*key, at, value).distinct()
        before = F.lag(F.struct(value)).over(W.partitionBy(*key).orderBy(at))
        last = own.withColumn("__b", before).join(known, key, "left").withColumn("__b", F.coalesce("__b", "__k"))
        last.where(F.col("__b").isNull() | ~F.col(value).eqNullSafe(F.col("__b")[value])).select(*key, at, value).write.mode("overwrite").parquet(f"{path}/batch={n}")

    _each_batch(stream, one, f"{path}-progress")
    return _before(spark, path, 1 << 60, schema)


def snapshot_deltas(stream: DataFrame, key: list[str], value: str, path: str) -> DataFrame:
    """(key, change, previous, value, batch) between a snapshot and the one before, each batch of the stream being a whole snapshot; the first gives nothing."""
    spark, schema = stream.sparkSession, stream.select(*key, value).schema
    deltas = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.fields[:-1])}, change string, previous {schema[value].dataType.simpleString()}, {value} {schema[value].dataType.simpleString()}"

    def one(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        now = batch.select(*key, value).distinct()
        names = [int(c[6:]) for c in children(session, f"{path}/snapshots") if c.startswith("batch=") and int(c[6:]) < n]
        now.write.mode("overwrite").parquet(f"{path}/snapshots/batch={n}")
        old = session.read.schema(schema).parquet(f"{path}/snapshots/batch={max(names)}") if names else now
        both = old.withColumnRenamed(value, "previous").withColumn("__o", F.lit(True)).join(now.withColumn("__n", F.lit(True)), key, "full")
        change = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "resolved").when(~F.col("previous").eqNullSafe(F.col(value)), "changed")
        both.select(*key, change.alias("change"), "previous", value).where("change is not null").write.mode("overwrite").parquet(f"{path}/deltas/batch={n}")

    _each_batch(stream, one, f"{path}-progress")
    names = children(spark, f"{path}/deltas")
    parts = [spark.read.schema(deltas).parquet(f"{path}/deltas/{c}").withColumn("batch", F.lit(int(c[6:]))) for c in names if c.startswith("batch=")]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{deltas}, batch int")


def monthly(stream: DataFrame, at: str, by: list[str], path: str) -> DataFrame:
    """Counts per month from partial counts of each batch; months have no fixed length, so they're no event-time windows."""
    spark = stream.sparkSession
    schema = stream.select(F.date_trunc("month", F.col(at)).cast("date").alias("month"), *by).schema.add("n", "long")

    def one(batch: DataFrame, n: int) -> None:
        batch.groupBy(F.date_trunc("month", F.col(at)).cast("date").alias("month"), *by).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={n}")

    _each_batch(stream, one, f"{path}-progress")
    return _before(spark, path, 1 << 60, schema).groupBy("month", *by).agg(F.sum("n").alias("n"))


def weekly_store(stream: DataFrame, path: str, rule: late_events.Lateness = late_events.Lateness()) -> late_events.LateStore:
    """The store of weekly partial counts fed by a stream, a run for each batch; a batch that comes again adds nothing."""
    store = late_events.LateStore(stream.sparkSession, path, rule)
    _each_batch(stream, lambda batch, _: store.ingest(batch), f"{path}-progress")
    return store


def _events(spark: SparkSession, d: str) -> DataFrame:
    batch = spark.read.parquet(f"{d}/events.parquet")
    stream = read_events(spark, d, "events.parquet", batch.schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def str_01_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    doubled = _events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run_to_end(deduplicated(doubled, ["event_id"], "ts", "60 days").select("event_id", "user_id", "event_type"), workspace(spark))


def str_03_final_days(spark: SparkSession, d: str) -> DataFrame:
    return run_to_end(final_days(_events(spark, d), "ts", ["event_type"]), workspace(spark))


def str_05_sessions(spark: SparkSession, d: str) -> DataFrame:
    closed = sessions(_events(spark, d), "ts", ["user_id"], "6 hours", "0 seconds")
    return run_to_end(closed, workspace(spark)).select("user_id", F.col("start").cast("timestamp_ntz").alias("started"), "n")


def str_06_attributed(spark: SparkSession, d: str) -> DataFrame:
    marked = _events(spark, d).select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.concat(F.lit("s"), F.col("event_id").cast("string"))).alias("signal"))
    return run_to_end(attributed(marked, "user_id", "event_id", "signal"), workspace(spark))


def staged(spark: SparkSession, df: DataFrame, stage, n: int) -> DataFrame:
    """df as a stream of n batches: rows whose stage is 0, then 1 and so on."""
    path = f"{workspace(spark)}/staged"
    for i in range(n):
        df.where(stage == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def str_02_quarantined(spark: SparkSession, d: str) -> DataFrame:
    good, late = in_time(_events(spark, d).select("event_id", "ts"), "ts", F.lit("2024-01-20").cast("timestamp"))
    part = lambda df, name: run_to_end(df.select("event_id", F.lit(name).alias("state")), workspace(spark))
    return part(good, "in_time").unionByName(part(late, "quarantine"))


def str_04_months(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderstatus").alias("status"))
    return monthly(staged(spark, e, F.col("o_orderkey") % 3, 3), "at", ["status"], workspace(spark))


def str_05_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = run_to_end(sliding(_events(spark, d), "ts", ["event_type"], "2 days", "1 day", "1 day"), workspace(spark))
    return out.select(F.col("start").cast("timestamp_ntz").alias("started"), "event_type", "n")


def str_07_changed(spark: SparkSession, d: str) -> DataFrame:
    """Each user's kind of event where it differs from the one before, over three batches in the order of time."""
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    day = F.dayofmonth("at.ts")
    out = changed_only(staged(spark, e, F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2), 3), ["user_id"], "event_type", "at", workspace(spark))
    return out.select("user_id", F.col("at.event_id").alias("event_id"), "event_type")


def str_08_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Deltas between three snapshots of how many events each user had by kind."""
    e = spark.read.parquet(f"{d}/events.parquet")
    third = F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")
    counts = e.where(third < 3).groupBy(third.alias("stage"), "user_id", "event_type").agg(F.count("*").alias("n"))
    return snapshot_deltas(staged(spark, counts, F.col("stage"), 3), ["user_id", "event_type"], "n", workspace(spark))


def str_09_weekly_store(spark: SparkSession, d: str) -> DataFrame:
    """The weekly counts of problem 5, fed by a stream of four batches in the order of arrival."""
    e = spark.read.parquet(f"{d}/finding_events.parquet")
    at = F.col("recorded_at")
    stage = F.when(at < "2024-09", 0).when(at < "2025-03", 1).when(at < "2025-09", 2).otherwise(3)
    return weekly_store(staged(spark, e, stage, 4), workspace(spark)).weekly().select("week", "resolution", "n_on_time", "n_corrected", "n_events", "n_cut")


QUERIES = {f.__name__: f for f in (str_01_deduplicated, str_02_quarantined, str_03_final_days, str_04_months, str_05_sessions, str_05_sliding, str_06_attributed, str_07_changed, str_08_snapshots, str_09_weekly_store)}
SQL = {
    "str_01_deduplicated": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "str_03_final_days": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL",
    "str_05_sessions": """WITH c AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS gap, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c)
        SELECT user_id, min(ts) AS started, count(*) AS n FROM i GROUP BY user_id, island HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)""",
    "str_02_quarantined": "SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-21' THEN 'in_time' ELSE 'quarantine' END AS state FROM events",
    "str_09_weekly_store": f"{WEEKLY_SQL} FROM judged GROUP BY week, resolution",
    "str_04_months": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2",
    "str_05_sliding": """WITH w AS (SELECT unnest([CAST(ts::DATE AS TIMESTAMP), CAST(ts::DATE AS TIMESTAMP) - INTERVAL 1 DAY]) AS started, event_type FROM events) SELECT started, event_type, count(*) AS n FROM w WHERE started + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""",
    "str_07_changed": "WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END, ts, event_id) AS was FROM events) SELECT user_id, event_id, event_type FROM l WHERE was IS NULL OR was <> event_type",
    "str_08_snapshots": """WITH s AS (SELECT ((day(ts) - 1) // 10)::INT AS stage, user_id, event_type, count(*) AS n FROM events WHERE day(ts) <= 30 GROUP BY ALL), p AS (SELECT b.batch, coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, o.n AS previous, n.n AS n FROM (VALUES (1), (2)) AS b(batch), LATERAL (SELECT * FROM s WHERE stage = b.batch - 1) o FULL JOIN LATERAL (SELECT * FROM s WHERE stage = b.batch) n ON o.user_id = n.user_id AND o.event_type = n.event_type)
        SELECT user_id, event_type, CASE WHEN previous IS NULL THEN 'new' WHEN n IS NULL THEN 'resolved' ELSE 'changed' END AS change, previous, n, batch FROM p WHERE previous IS DISTINCT FROM n""",
    "str_06_attributed": "SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN 's' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unattributed') AS active FROM events",
}
