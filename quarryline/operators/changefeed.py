"""A change feed applied to a table of immutable files with delete vectors.

Layout under one folder: ``data/batch=N`` holds row images, ``index/batch=N`` the newest state of every key after
that batch (where its image lies, which change put it there, or that it is deleted), ``vectors/batch=N`` one bitmap
per data file and bucket of 32,768 positions with the rows superseded in that batch, ``commits/batch=N``, written
last, that the batch is whole. Reading drops the positions whose bit is set in any batch; data files are never
rewritten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.workspace import children

#: Spellings of the operations in the feed; fixed values.
UPSERTS = ("insert", "i", "c", "create", "update", "u", "upsert", "r")
DELETES = ("delete", "d", "tombstone", "remove")
BITS = 32_768  # of one bitmap of bitmap_construct_agg


class ChangeTable:
    """State of one table. key: its columns; position: columns that order the changes; both never NULL in a change.

    Opened on a folder that holds batches, it goes on after the last whole one; what a batch that stopped halfway left
    behind isn't read, and the next batch writes over it.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], position: list[str], payload: list[str]):
        self.spark, self.path, self.key, self.position, self.payload = spark, path, key, position, payload
        self.batches = len(children(spark, f"{path}/commits"))

    def apply(self, changes: DataFrame, op: str = "op") -> None:
        """Apply one batch, in whatever order it arrived.

        Of each key only the change with the highest position counts, and it only if it is above the position the
        key has already seen: repeated and late changes change nothing. An update of an unknown key creates the row;
        a delete of an unknown key leaves a tombstone that late older changes can't pass. Changes with an unknown
        operation, a NULL key or a NULL position are skipped. An empty batch is allowed.
        """
        n = self.batches
        kind = F.lower(F.trim(F.col(op)))
        ordered = F.struct(*self.position, (kind.isin(*DELETES)).alias("gone"), *self.payload)
        valid = reduce(lambda a, c: a & F.col(c).isNotNull(), [*self.key, *self.position], kind.isin(*UPSERTS, *DELETES))
        newest = changes.where(valid).groupBy(*self.key).agg(F.max(ordered).alias("c")).select(*self.key, *[F.col(f"c.{x}").alias(x) for x in [*self.position, "gone", *self.payload]])
        before = self._index()
        if before is not None:
            b = before.select(*self.key, F.struct(*self.position).alias("seen"), "file", "pos")
            joined = newest.join(b, self.key, "left").where(F.col("seen").isNull() | (F.struct(*self.position) > F.col("seen"))).drop("seen")
        else:
            joined = newest.select("*", F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("pos"))
        # file and pos are where the superseded image lies; they go into the data file's row and from there to the vectors
        data = f"{self.path}/data/batch={n}"
        joined.withColumnsRenamed({"file": "old_file", "pos": "old_pos"}).write.mode("overwrite").parquet(data)
        at = self._at(data)
        at.select(*self.key, *self.position, F.when(~F.col("gone"), F.col("file")).alias("file"), F.when(~F.col("gone"), F.col("pos")).alias("pos")).write.mode("overwrite").parquet(f"{self.path}/index/batch={n}")
        dead = at.where(F.col("old_file").isNotNull()).select(F.col("old_file").alias("file"), F.col("old_pos").alias("pos"))
        stones = at.where(F.col("gone")).select("file", "pos")
        (
            dead.unionByName(stones)
            .groupBy("file", F.expr(f"pos div {BITS}").alias("bucket"))
            .agg(F.expr(f"bitmap_construct_agg(pos % {BITS})").alias("bits"))
            .write.mode("overwrite").parquet(f"{self.path}/vectors/batch={n}")
        )
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={n}")
        self.batches += 1

    def _at(self, data: str) -> DataFrame:
        """Rows of data files with the file's path from the table's folder and the row's position in the file."""
        return self.spark.read.parquet(data).select("*", F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), F.col("_metadata.file_name")).alias("file"), F.col("_metadata.row_index").alias("pos"))

    def _index(self) -> DataFrame | None:
        """The newest entry of every key: the key's highest position over all batches."""
        if not self.batches:
            return None
        every = self.spark.read.parquet(*[f"{self.path}/index/batch={i}" for i in range(self.batches)])
        entry = F.struct(*self.position, "file", "pos")
        return every.groupBy(*self.key).agg(F.max(entry).alias("e")).select(*self.key, "e.*")

    def read(self) -> DataFrame:
        """The rows that exist now: key, position of the change that gave the content, payload. There must be a batch."""
        rows = reduce(DataFrame.unionByName, [self._at(f"{self.path}/data/batch={i}") for i in range(self.batches)])
        vectors = self.spark.read.parquet(*[f"{self.path}/vectors/batch={i}" for i in range(self.batches)])
        merged = vectors.groupBy("file", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        byte = F.expr(f"cast(conv(hex(substring(bits, cast((pos % {BITS}) div 8 as int) + 1, 1)), 16, 10) as int)")
        marked = F.coalesce(F.getbit(byte, F.expr("cast(pos % 8 as int)")), F.lit(0)) == 1
        live = rows.withColumn("bucket", F.expr(f"pos div {BITS}")).join(merged, ["file", "bucket"], "left").where(~marked)
        return live.select(*self.key, *self.position, *self.payload)


def apply_feed(feed: DataFrame, path: str, key: list[str], position: list[str], payload: list[str], arrival: str, batches: int = 3) -> DataFrame:
    """Rebuild a table from a feed cut into batches of equal range of the arrival column, as a running job gets it.

    Rows without an arrival number come with the first batch. An empty feed gives an empty table.
    """
    spark = feed.sparkSession
    state = ChangeTable(spark, path, key, position, payload)
    low, high = feed.agg(F.min(arrival), F.max(arrival)).first()
    low, high = low or 0, high or 0
    step = max(1, -(-(high - low + 1) // batches))
    for i in range(batches):
        begin = F.coalesce(F.col(arrival), F.lit(low))
        state.apply(feed.where((begin >= low + i * step) & (begin < low + (i + 1) * step)))
    return state.read()
