"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy with more than 1/HEAVY_SHARE of the rows, so there are fewer than HEAVY_SHARE such keys at any size.
HEAVY_SHARE = 200
#: Below so many rows for a key one task copes, whatever its share.
HEAVY_FLOOR = 50_000


def heavy_keys(df: DataFrame, keys: list[str], share: int = HEAVY_SHARE, floor: int = HEAVY_FLOOR) -> DataFrame | None:
    """The keys with more than 1/share of df's rows and more than floor of them; None if there are none.

    Counts are combined before the shuffle. The result has fewer than ``share`` rows whatever df's size, which is
    what makes it safe to broadcast. Keys with a NULL are left out: they match nothing in an equi-join.
    """
    counts = df.where(all_present(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    if total <= floor:
        return None
    rows = counts.where(F.col("__n") > F.lit(max(floor, total // share))).select(*keys).collect()
    return df.sparkSession.createDataFrame(rows, counts.select(*keys).schema) if rows else None


def all_present(keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return condition


def salted(left: DataFrame, right: DataFrame, keys: list[str], spread: str, salts: int = 32, heavy: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a column ``__salt`` to join on besides keys.

    Rows of left whose key is heavy are spread over the salts by a hash of the column ``spread``; right's rows of
    heavy keys are repeated once for each salt. All other rows have the salt 0 on both sides, so nothing is repeated
    for them. Without heavy keys both sides come back with the constant salt.
    """
    if heavy is None:
        return left.withColumn("__salt", F.lit(0)), right.withColumn("__salt", F.lit(0)), [*keys, "__salt"]
    flag = F.broadcast(heavy.withColumn("__heavy", F.lit(True)))
    spread_left = left.join(flag, keys, "left").withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))).drop("__heavy")
    repeated = right.join(flag, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__heavy")
    return spread_left, repeated, [*keys, "__salt"]
