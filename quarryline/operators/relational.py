"""Relational building blocks that the reference spells as loops: upserts, carried values, overlaps, chains."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarryline.workspace import materialize, workspace


def last_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the highest order (NULL is lowest); an aggregate, so hot keys combine before the shuffle.

    NULL keys are keys of their own. Equal orders take the greatest row by all columns; no rows give no rows.
    """
    rest = [c for c in df.columns if c not in (*key, *order)]
    best = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("__best"))
    return best.select(*key, *[F.col(f"__best.`{c}`").alias(c) for c in [*order, *rest]]).select(*df.columns)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """As last_per_key where the order leaves no tie but between copies: columns that nobody asks for aren't read.

    Spark keeps each key's highest row before the shuffle (a limit within groups), so hot keys combine early.
    """
    place = F.row_number().over(W.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in order]))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def first_wins(existing: DataFrame, arriving: DataFrame, key: list[str], order: str) -> DataFrame:
    """existing plus the first arriving row of each key that isn't there yet (insert or ignore)."""
    rest = [c for c in arriving.columns if c not in (*key, order)]
    new = arriving.join(existing.select(*key).distinct(), key, "left_anti").groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("__b"))
    return existing.unionByName(new.select(*key, *[F.col(f"__b.{c}").alias(c) for c in [order, *rest]]).select(*existing.columns))


def upsert(existing: DataFrame, arriving: DataFrame, key: list[str], order: str) -> DataFrame:
    """existing with the last arriving row of each key in place of its own."""
    newest = last_per_key(arriving, key, [order])
    return existing.join(newest.select(*key), key, "left_anti").unionByName(newest)


def preserve_merge(old: DataFrame, new: DataFrame, key: str, attrs: str, keep: Iterable[str]) -> DataFrame:
    """Full outer merge of attribute maps: new ones win; of the old ones only the keys in keep survive an update."""
    o, n = old.select(key, F.col(attrs).alias("__old")), new.select(key, F.col(attrs).alias("__new"))
    kept = F.map_filter("__old", lambda k, _: k.isin(*keep) & ~F.map_contains_key("__new", k))
    merged = F.when(F.col("__new").isNull(), F.col("__old")).when(F.col("__old").isNull(), F.col("__new")).otherwise(F.map_concat(kept, "__new"))
    return o.join(n, key, "full").select(key, merged.alias(attrs))


def json_updated(df: DataFrame, attrs: str, changes: str) -> DataFrame:
    """df with the map ``changes`` (NULL: nothing) written over the top-level keys of the JSON object ``attrs``; the map is dropped.

    Values become text; attrs that isn't a JSON object counts as an empty one where something changes.
    """
    old = F.coalesce(F.from_json(attrs, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(changes, k))
    return df.withColumn(attrs, F.when(F.col(changes).isNotNull(), F.to_json(F.map_concat(kept, changes))).otherwise(F.col(attrs))).drop(changes)


def append_completed(recorded: DataFrame, arriving: DataFrame, key: list[str], day: str, today: Column) -> DataFrame:
    """Arriving rows of completed days whose key isn't recorded; a recorded key is never revised."""
    return arriving.where(F.col(day) < today).join(recorded.select(*key).distinct(), key, "left_anti")


def with_last(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """df with a column for each of values: its last value that isn't NULL in the group so far, the row itself included or not.

    Groups may be of any size: rows are put in order by ranges, of each range and group the last values are taken (as
    many rows as there are groups and ranges), carried on along a group's ranges, and only within a range does a window
    run over rows. NULL groups are one group; rows equal in the order come in any order.
    """
    base = workspace(df.sparkSession)
    ranged = df.withColumns({f"__v_{n}": c for n, c in values.items()}).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # a row's number is its range's times 2^33 plus its place in it
    placed = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), f"{base}/placed").withColumn("__part", F.shiftright("__id", 33))
    last = placed.groupBy(*by, "__part").agg(*[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col("__id"))).alias(f"__l_{n}") for n in values])
    along = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*by, "__part", *[F.last(f"__l_{n}", ignorenulls=True).over(along).alias(f"__c_{n}") for n in values]).select(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__part").alias("__p"), *[f"__c_{n}" for n in values])
    inside = W.partitionBy(*by, "__part").orderBy("__id").rowsBetween(W.unboundedPreceding, W.currentRow if inclusive else -1)
    own = placed.select("*", *[F.last(f"__v_{n}", ignorenulls=True).over(inside).alias(f"__o_{n}") for n in values])
    on = F.col("__part") == F.col("__p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    return own.join(carried, on, "left").select(*df.columns, *[F.coalesce(f"__o_{n}", f"__c_{n}").alias(n) for n in values])


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two arrays' distinct elements; NULL if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def spaced(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """At most n rows evenly spaced in the order: every k-th, with k the whole part of their number by n, one at least.

    Places come from a sort by ranges: rows are counted per range, the counts of the ranges before are added (as many
    numbers as there are ranges), and no task holds all rows.
    """
    base = workspace(rows.sparkSession)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id is the range's number times 2^33 plus the place in it
    placed = materialize(ranged.withColumn("__id", F.monotonically_increasing_id()), f"{base}/placed")
    part = F.shiftright("__id", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    total, before = 0, {}
    for r in counts:
        before[r.part] = total
        total += r.n
    if not total:
        return rows.limit(0)
    step = max(1, total // n)
    shift = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    place = shift[part] + F.col("__id") - F.shiftleft(part, 33)
    return placed.withColumn("__i", place).where((F.col("__i") % step == 0) & (F.col("__i") < step * n)).drop("__i", "__id")


def prefix_join(names: DataFrame, name: str, prefixes: DataFrame, prefix: str, separator: str = "/") -> DataFrame:
    """names with the longest prefix that ends at a separator (or is the whole name); an equi-join on all prefixes of a name."""
    parts = F.split(F.col(name), separator)
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    tried = names.select(F.col(name).alias("__name"), F.explode(every).alias("__prefix")).distinct()
    best = tried.join(prefixes.select(F.col(prefix).alias("__prefix")).distinct(), "__prefix").groupBy("__name").agg(F.max_by("__prefix", F.length("__prefix")).alias(prefix))
    return names.join(best.withColumnRenamed("__name", name), name, "left")


def reach(edges: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(origin, node, depth) of nodes reached over directed edges (src, dst) from start (origin) in at most max_depth steps, by the least depth.

    Every step's new nodes are written, so that a step reads what the ones before found and computes none of it again.
    """
    base = workspace(edges.sparkSession)
    schema = start.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth"))
    steps = [materialize(schema.distinct(), f"{base}/depth=0")]
    for d in range(1, max_depth + 1):
        seen = reduce(DataFrame.unionByName, steps)
        stepped = steps[-1].join(edges, steps[-1]["node"] == edges["src"]).select("origin", F.col("dst").alias("node"), F.lit(d).alias("depth")).distinct()
        steps.append(materialize(stepped.join(seen.select("origin", "node"), ["origin", "node"], "left_anti"), f"{base}/depth={d}"))
    return reduce(DataFrame.unionByName, steps)
