"""Counts per week of occurrence that late records correct, until the week is closed for good.

What is kept, under one folder: ``arrivals/run=N`` the events first seen in a run of ingestion, with the week they
belong to and the day they arrived; ``partials/run=N`` their number per week, resolution and day of arrival, which is
all that later steps add up; ``commits/run=N`` written last, so that a run that stopped halfway is as if it had not
been and is done again. Whether a partial count is on time, corrects a week or is refused by a closed one is decided
when partials are combined, per week and day of arrival.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.timestamps import with_readings
from quarryline.workspace import children

WEEK_MS, DAY_MS = 7 * 86_400_000, 86_400_000
MONDAY_MS = 4 * DAY_MS  # 1970-01-05, the first Monday
_ARRIVALS = "event_id string, repo_key string, resolution string, week_ms bigint, arrival_ms bigint"
_PARTIALS = "week_ms bigint, resolution string, arrival_ms bigint, n bigint"


@dataclass(frozen=True)
class Lateness:
    """A period ends after a week; records that arrive within ``open_days`` whole days of its end still correct it."""

    open_days: int = 28


def _floor(ms: Column, width: int, origin: int = 0) -> Column:
    return (F.lit(origin) + F.floor((ms - origin) / F.lit(width)) * width).cast("bigint")


def first_deliveries(events: DataFrame) -> DataFrame:
    """_ARRIVALS of every event that names an instant: the week it happened in and the day its earliest record arrived.

    Exact copies and later deliveries change nothing (of equal records the smallest row counts). Events without a
    readable time of occurrence or arrival are left out. NULL keys form keys of their own.
    """
    read = with_readings(with_readings(events, "occurred_at", "site_tz", "__occurred", alternatives=False), "recorded_at", "site_tz", "__recorded", alternatives=False)
    timed = read.select("event_id", "repo_key", F.get("__recorded", F.lit(0))["ms"].alias("came"), "row_no", F.get("__occurred", F.lit(0))["ms"].alias("at"), "resolution").where("came is not null")
    once = timed.groupBy("event_id", "repo_key").agg(F.min(F.struct("came", "row_no", "at", "resolution")).alias("e"))
    return once.where("e.at is not null").select("event_id", "repo_key", "e.resolution", _floor(F.col("e.at"), WEEK_MS, MONDAY_MS).alias("week_ms"), _floor(F.col("e.came"), DAY_MS).alias("arrival_ms"))


def partials(arrivals: DataFrame) -> DataFrame:
    """One mergeable count per week, resolution and day of arrival."""
    return arrivals.groupBy("week_ms", "resolution", "arrival_ms").agg(F.count(F.lit(1)).alias("n"))


def merge(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """Two sets of partial counts of different events as one; the order of merging doesn't matter."""
    return stored.unionByName(arriving).groupBy("week_ms", "resolution", "arrival_ms").agg(F.sum("n").alias("n"))


def judged(counts: DataFrame, rule: Lateness = Lateness()) -> DataFrame:
    """Partial counts with their outcome: ``on_time`` before the week's end, ``corrects`` while it is open, ``cut`` once it refuses.

    A day of arrival lies wholly on one side of the end of a week and of its closing, so a partial has one outcome.
    """
    over = F.col("week_ms") + WEEK_MS
    return counts.withColumn("outcome", F.when(F.col("arrival_ms") < over, "on_time").when(F.col("arrival_ms") < over + rule.open_days * DAY_MS, "corrects").otherwise("cut"))


def weekly(counts: DataFrame, as_of_ms: int | None = None, rule: Lateness = Lateness()) -> DataFrame:
    """week, resolution, n_on_time, n_corrected, n_events, n_cut, batches; as they stood after the arrivals up to as_of_ms.

    Closed weeks refuse records: those count only in n_cut. A NULL resolution is a group of its own.
    """
    seen = judged(counts if as_of_ms is None else counts.where(F.col("arrival_ms") <= as_of_ms), rule)
    n = lambda *outcomes: F.sum(F.when(F.col("outcome").isin(*outcomes), F.col("n")).otherwise(0)).cast("bigint")
    return (
        seen.groupBy("week_ms", "resolution")
        .agg(n("on_time").alias("n_on_time"), n("corrects").alias("n_corrected"), n("on_time", "corrects").alias("n_events"), n("cut").alias("n_cut"), F.countDistinct("arrival_ms").alias("batches"))
        .select(F.timestamp_millis("week_ms").cast("date").alias("week"), "resolution", "n_on_time", "n_corrected", "n_events", "n_cut", "batches")
    )


class LateStore:
    """Partial counts kept in a folder, to which runs of ingestion add; it can be opened again where it stopped."""

    def __init__(self, spark: SparkSession, path: str, rule: Lateness = Lateness()):
        self.spark, self.path, self.rule = spark, path.rstrip("/"), rule

    def runs(self) -> list[str]:
        """Names of the runs that were finished."""
        return children(self.spark, f"{self.path}/commits")

    def ingest(self, events: DataFrame) -> str:
        """Add a run of arriving records; its name.

        Events that an earlier run holds change nothing, so a delivery in several runs counts once, in the order in
        which runs are ingested. A run that wasn't finished is written over by the next one.
        """
        done = self.runs()
        name = f"run={len(done):06}"
        new = first_deliveries(events)
        if done:
            seen = self.arrivals().select(F.col("event_id").alias("e"), F.col("repo_key").alias("r"))
            new = new.join(seen, F.col("event_id").eqNullSafe(F.col("e")) & F.col("repo_key").eqNullSafe(F.col("r")), "left_anti")
        new.write.mode("overwrite").parquet(f"{self.path}/arrivals/{name}")
        partials(self._read("arrivals", _ARRIVALS, [name])).write.mode("overwrite").parquet(f"{self.path}/partials/{name}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")
        return name

    def _read(self, part: str, schema: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{part}/{n}" for n in names])

    def arrivals(self) -> DataFrame:
        return self._read("arrivals", _ARRIVALS, self.runs())

    def counts(self) -> DataFrame:
        """Partial counts of all finished runs, combined on reading."""
        stored = self._read("partials", _PARTIALS, self.runs())
        return stored.groupBy("week_ms", "resolution", "arrival_ms").agg(F.sum("n").alias("n"))

    def weekly(self, as_of_ms: int | None = None) -> DataFrame:
        return weekly(self.counts(), as_of_ms, self.rule)

    def late_cases(self) -> DataFrame:
        """(repo_key, event_id, outcome) of every event in a partial count that corrected a week or was refused.

        The partials say which; they number the weeks times the days of arrival, whatever the number of events.
        """
        late = judged(self.counts(), self.rule).where("outcome <> 'on_time'").select("week_ms", "arrival_ms", "outcome").distinct()
        return self.arrivals().join(late, ["week_ms", "arrival_ms"]).select("repo_key", "event_id", "outcome")
