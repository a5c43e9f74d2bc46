"""Measures over time: usage by day, skill and model; journals of snapshots and how they move; streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.operators.relational import with_last

TOKENS = ("tokens_in", "tokens_out", "cache_read", "cache_new")


def usage_by(messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the four sums of tokens, messages and distinct sessions of messages (session, and TOKENS)."""
    return messages.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in TOKENS], F.count(F.lit(1)).alias("messages"), F.countDistinct("session").alias("sessions"))


def usage_levels(messages: DataFrame) -> DataFrame:
    """usage by day, skill and model; by skill; and over all: sets of sessions are counted anew on each level, as they don't add up."""
    day = usage_by(messages, ["day", "skill", "model"])
    skill = usage_by(messages, ["skill"]).withColumns({"day": F.lit(None).cast("date"), "model": F.lit(None).cast("string")})
    total = usage_by(messages.withColumn("__all", F.lit(1)), ["__all"]).drop("__all").withColumns({c: F.lit(None).cast(t) for c, t in (("day", "date"), ("skill", "string"), ("model", "string"))})
    return day.withColumn("level", F.lit("day")).unionByName(skill.withColumn("level", F.lit("skill"))).unionByName(total.withColumn("level", F.lit("all")))


def reconciled(one: DataFrame, other: DataFrame, measures: tuple[str, ...] = (*TOKENS, "messages")) -> DataFrame:
    """One row: for each measure by how much two accounts of the same usage differ, and whether they don't."""
    total = lambda df, p: df.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(f"{p}{m}") for m in measures])
    both = total(one, "a_").crossJoin(total(other, "b_"))  # one row each
    deltas = both.select(*[(F.col(f"a_{m}") - F.col(f"b_{m}")).alias(m) for m in measures])
    same = F.lit(True)
    for m in measures:
        same = same & (F.col(m) == 0)
    return deltas.withColumn("lossless", same)


def lanes(messages: DataFrame, lane: str = "skill", rest: str = "unattributed") -> DataFrame:
    """(month, lane, tokens, in_lanes): tokens per month and lane with a row for each month (lane NULL), and those not in the rest."""
    tokens = F.col("tokens_in") + F.col("tokens_out")
    return messages.withColumn("month", F.date_format("day", "yyyy-MM")).rollup("month", lane).agg(F.sum(tokens).alias("tokens"), F.sum(F.when(F.col(lane) != rest, tokens).otherwise(0)).alias("in_lanes")).where("month is not null").select("month", F.col(lane).alias("lane"), "tokens", "in_lanes")


def series(journal: DataFrame) -> DataFrame:
    """(source, key, place, value) of a journal's metrics (source, place, metrics map), one row for each number."""
    return journal.select("source", "place", F.explode("metrics").alias("key", "v")).select("source", "key", "place", F.col("v").try_cast("double").alias("value")).where("value is not null")


def movement(points: DataFrame, down_is_good: Column) -> DataFrame:
    """points with previous, delta, trend (up, down, flat, new) and verdict (better, worse, same), by whether less of the key is good."""
    w = W.partitionBy("source", "key").orderBy("place")
    out = points.withColumn("previous", F.lag("value").over(w)).withColumn("delta", F.round(F.col("value") - F.col("previous"), 6))
    trend = F.when(F.col("previous").isNull(), "new").when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("flat")
    good = F.when(F.col("delta") == 0, "same").when((F.col("delta") < 0) == down_is_good, "better").otherwise("worse")
    return out.withColumns({"trend": trend, "verdict": F.when(F.col("previous").isNotNull(), good)})


def ends(points: DataFrame) -> DataFrame:
    """(source, key, first, last, n) of each series."""
    return points.groupBy("source", "key").agg(F.min_by("value", "place").alias("first"), F.max_by("value", "place").alias("last"), F.count(F.lit(1)).alias("n"))


def before(journal: DataFrame, at: Column) -> DataFrame:
    """The newest row of each source strictly before a moment."""
    return journal.where(F.col("place") < at).groupBy("source").agg(F.max("place").alias("place"), F.max_by("metrics", "place").alias("metrics"))


def newest(rows: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key; Spark keeps only n of each before rows move."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("__n", place).where(F.col("__n") <= n).drop("__n")


def streaks(rows: DataFrame, by: list[str], order: list[str], hit: Column, length: int = 5) -> DataFrame:
    """by, began, n of every run of at least ``length`` rows in a row for which hit holds; began is the first order column's value at its start.

    A run's rows share the last row before them that isn't a hit, which is carried over groups of any size.
    """
    marked = rows.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    known = with_last(marked, by, order, {"__since": F.when(~F.col("__hit"), F.struct(*order))})
    return known.where("__hit").groupBy(*by, "__since").agg(F.min(order[0]).alias("began"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= length).drop("__since")


def backward(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is below the last one before them in the group that isn't NULL, with that one as ``before``."""
    return with_last(rows, by, order, {"before": F.col(value)}, inclusive=False).where(F.col(value) < F.col("before"))
