"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.skew import heavy_keys, salted


@dataclass(frozen=True)
class Reference:
    """One foreign key: which field of which table names records of which parent, and when it was written."""

    table_name: str
    field_name: str
    children: DataFrame
    #: child column -> parent column; field_name's own column is the one that must not be NULL.
    keys: dict[str, str]
    at: Column
    parents: DataFrame
    loaded: str = "loaded_at"
    removed: str = "removed_at"


def find_orphans(ref: Reference, row_id: str = "row_no") -> DataFrame:
    """Rows (table_name, row_no, field_name, ref_time) of references without a parent that existed at their time.

    Distinct foreign keys with their time are anti-joined against the parents' lifetimes, then joined back to the
    rows. A NULL in field_name's column is no reference. A NULL in another key column, or a time that can't be read,
    matches no parent, so the reference is an orphan. Exact copies of a row give one row. Parents with a NULL key or
    without a start never match. Empty tables: no children gives nothing, no parents makes every reference an orphan.
    Only the columns named here are read; others may have any name.
    """
    names = [f"k{i}" for i in range(len(ref.keys))]
    rows = ref.children.where(F.col(ref.field_name).isNotNull()).select(F.col(row_id).alias("row_no"), *[F.col(c).alias(n) for c, n in zip(ref.keys, names)], ref.at.alias("ref_time"))
    wanted = rows.select(*names, "ref_time").distinct()
    lifetimes = ref.parents.select(*[F.col(c).alias(n) for c, n in zip(ref.keys.values(), names)], F.col(ref.loaded).alias("born"), F.col(ref.removed).alias("died")).where(F.col("born").isNotNull()).distinct()
    left, right, on = salted(wanted, lifetimes, names, "ref_time", heavy=heavy_keys(rows.select(*names), names))
    left, right = left.alias("w"), right.alias("p")
    alive = (F.col("p.born") <= F.col("w.ref_time")) & (F.col("p.died").isNull() | (F.col("w.ref_time") < F.col("p.died")))
    for name in on:
        alive = alive & (F.col(f"w.{name}") == F.col(f"p.{name}"))
    missing = left.join(right, alive, "left_anti").select(*names, "ref_time")
    back = F.lit(True)
    for name in [*names, "ref_time"]:
        back = back & F.col(f"r.{name}").eqNullSafe(F.col(f"m.{name}"))
    return (
        rows.alias("r").join(missing.alias("m"), back, "left_semi")
        .select(F.lit(ref.table_name).alias("table_name"), F.col("row_no"), F.lit(ref.field_name).alias("field_name"), F.col("ref_time"))
        .distinct()
    )


def orphan_counts(refs: list[Reference]) -> DataFrame:
    """Per table, field and month: references, orphans among them. Months of NULL times come out as NULL."""
    out = None
    for ref in refs:
        every = ref.children.where(F.col(ref.field_name).isNotNull()).select(F.col("row_no"), ref.at.alias("ref_time")).distinct()
        month = F.date_trunc("month", F.col("ref_time")).cast("date").alias("month")
        total = every.groupBy(month).agg(F.count(F.lit(1)).alias("n_refs"))
        gone = find_orphans(ref).groupBy(month).agg(F.count(F.lit(1)).alias("n_orphans"))
        t, g = total.alias("t"), gone.alias("g")
        part = t.join(g, F.col("t.month").eqNullSafe(F.col("g.month")), "left").select(F.lit(ref.table_name).alias("table_name"), F.lit(ref.field_name).alias("field_name"), F.col("t.month").alias("month"), F.col("n_refs"), F.coalesce(F.col("n_orphans"), F.lit(0)).cast("bigint").alias("n_orphans"))
        out = part if out is None else out.unionByName(part)
    return out
