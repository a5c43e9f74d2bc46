"""Parent-child links to whole trees by peeling leaves and splicing chains.

Each round takes away the nodes whose children are all gone, which send their subtree's size to their parents, and, of
the nodes with one child left, those with a greater hash than the child and the parent: their link is joined to the
child's. So rounds are the logarithm of the number of nodes, however deep a tree is. The rounds in reverse order give
every node its root, depth and path from its parent's. What is never peeled comes down to one node per cycle that is
its own parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarryline.workspace import discard, materialize, workspace

#: Relations of the portfolio graph that lead from parent to child, and from child to parent; fixed values.
DOWN = ("contains", "includes", "owns", "has_ref")
UP = ("in_group", "owned-by")
CYCLE, BELOW = "(cycle)", "(below cycle)"
#: node; parent: nearest ancestor that is left; steps: links to it; between: nodes spliced out on the way, if paths are
#: asked for; size: nodes peeled below, itself included; passed: sizes of the nodes spliced out on the way to the parent;
#: state: `stays`, `leaf` (peeled next), `spliced` (with the child that is left below it and the sizes above that child).
_STATE = "node string, parent string, steps bigint, between array<string>, size bigint, passed bigint, state string, child string, child_passed bigint"
_DONE = "node string, root string, depth bigint, path array<string>, size bigint"


def hierarchy_links(edges: DataFrame) -> DataFrame:
    """Distinct links (parent, child) of the hierarchy's relations; links with a NULL end are left out."""
    up = F.col("rel").isin(*UP)
    return (
        edges.where(F.col("rel").isin(*DOWN, *UP) & F.col("src").isNotNull() & F.col("dst").isNotNull())
        .select(F.when(up, F.col("dst")).otherwise(F.col("src")).alias("parent"), F.when(up, F.col("src")).otherwise(F.col("dst")).alias("child"))
        .distinct()
    )


def resolve_trees(links: DataFrame, paths: bool = True, parents: bool = True) -> DataFrame:
    """One row per node at an end of a link: node_id, root_id, depth, path (root first), subtree_size, parent_id.

    A node on a cycle has root_id ``(cycle)`` and depth -1, one below a cycle ``(below cycle)`` and -1; their path
    and subtree_size are NULL. Of several parents a node keeps the smallest; if that leads to a cycle that the node
    isn't on, the smallest that has a root. parent_id is the one kept, dropped_links() lists the others. No links
    give no rows. Repeated links and links with a NULL end change nothing. Without ``paths`` the path is NULL, and
    no row grows with the depth; without ``parents`` the parent_id is NULL.
    """
    base = workspace(links.sparkSession)
    clean = materialize(links.where(F.col("parent").isNotNull() & F.col("child").isNotNull()).select("parent", "child").distinct(), f"{base}/clean")
    most = Observation()
    first = clean.groupBy("child").agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n")).observe(most, F.max("n").alias("n"))
    kept = materialize(first.select("child", "parent", "n"), f"{base}/kept=0")
    contested = (most.get["n"] or 0) > 1
    rivals = clean.join(kept.where("n > 1").select("child"), "child", "left_semi")
    kept = kept.select("child", "parent")
    roots = clean.select(F.col("parent").alias("node")).distinct().join(kept.select(F.col("child").alias("node")), "node", "left_anti")
    step = 0
    while True:
        done = _resolve(kept.withColumnRenamed("child", "node").unionByName(roots.withColumn("parent", F.lit(None).cast("string"))), paths, f"{base}/{step}")
        if not contested:
            break
        rooted = done.where("depth >= 0").select(F.col("node").alias("parent"))
        lost = done.where(F.col("root") == BELOW).select(F.col("node").alias("child"))
        better = rivals.join(lost, "child", "left_semi").join(rooted, "parent", "left_semi").groupBy("child").agg(F.min("parent").alias("better"))
        better = materialize(better, f"{base}/better={step}")
        if better.isEmpty():
            break
        step += 1
        kept = materialize(kept.join(better, "child", "left").select("child", F.coalesce("better", "parent").alias("parent")), f"{base}/kept={step}")
    if not parents:
        return done.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", "path", F.col("size").alias("subtree_size"), F.lit(None).cast("string").alias("parent_id"))
    return done.join(kept.select(F.col("child").alias("node"), F.col("parent").alias("parent_id")), "node", "left").select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", "path", F.col("size").alias("subtree_size"), "parent_id")


def dropped_links(links: DataFrame, trees: DataFrame) -> DataFrame:
    """(parent, child, kept): links of nodes with several parents that the trees don't follow, and the parent they follow."""
    clean = links.where(F.col("parent").isNotNull() & F.col("child").isNotNull()).select("parent", "child").distinct()
    own = trees.select(F.col("node_id").alias("child"), F.col("parent_id").alias("kept"))
    return clean.join(own, "child").where("parent <> kept").select("parent", "child", "kept")


def _resolve(nodes: DataFrame, paths: bool, base: str) -> DataFrame:
    """nodes (node, parent) to _DONE."""
    spark = nodes.sparkSession
    between = F.array().cast("array<string>") if paths else F.lit(None).cast("array<string>")
    parents = nodes.where(F.col("parent") != F.col("node")).select(F.col("parent").alias("node")).distinct().withColumn("has", F.lit(True))
    leaf = F.col("has").isNull() & ~F.coalesce(F.col("parent") == F.col("node"), F.lit(False))
    first = nodes.join(parents, "node", "left").select("node", "parent", F.lit(1).cast("bigint").alias("steps"), between.alias("between"), F.lit(1).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("passed"), F.when(leaf, "leaf").otherwise("stays").alias("state"), F.lit(None).cast("string").alias("child"), F.lit(None).cast("bigint").alias("child_passed"))
    rounds, moving = 0, _write_counted(first, f"{base}/round=0")
    while moving:
        rounds += 1
        moving = _write_counted(_round(spark.read.schema(_STATE).parquet(f"{base}/round={rounds - 1}").where("state <> 'spliced'"), rounds, paths), f"{base}/round={rounds}")
    # what is left is its own parent: one node of each cycle
    rest = spark.read.schema(_STATE).parquet(f"{base}/round={rounds}").where("state = 'stays'")
    none = F.lit(None).cast("array<string>")
    rest.select("node", F.lit(CYCLE).alias("root"), F.lit(-1).cast("bigint").alias("depth"), none.alias("path"), F.lit(None).cast("bigint").alias("size")).write.parquet(f"{base}/done/round={rounds + 1}")
    for at in range(rounds, 0, -1):
        known = spark.read.schema(_DONE).parquet(f"{base}/done").drop("round")
        peeled = spark.read.schema(_STATE).parquet(f"{base}/round={at - 1}").where("state = 'leaf'")
        spliced = spark.read.schema(_STATE).parquet(f"{base}/round={at}").where("state = 'spliced'")
        _assigned(peeled.unionByName(spliced), known, paths).write.parquet(f"{base}/done/round={at}")
        discard(spark, f"{base}/round={at}")
    return spark.read.schema(_DONE).parquet(f"{base}/done").drop("round")


def _round(now: DataFrame, seed: int, paths: bool) -> DataFrame:
    """The next round's rows: leaves are gone, their sizes sent on; chains are spliced.

    A node that lost a leaf in this round isn't spliced, so that the leaf's parent is there when rounds are taken back.
    Few seeds are used, so that rounds share their generated code.
    """
    rank = lambda c: f"xxhash64({c}, {seed % 4})"
    between = "if(a.up_node is not null, concat(a.up_between, array(a.up_node), r.between), r.between)" if paths else "r.between"
    return now.sparkSession.sql(f"""
        WITH sent AS (
          SELECT parent AS at, count_if(state = 'leaf') AS gone, count_if(state <> 'leaf') AS left_over, sum(if(state = 'leaf', size + passed, NULL)) AS more,
            min(if(state <> 'leaf', node, NULL)) AS child, sum(if(state <> 'leaf', passed, NULL)) AS child_passed
          FROM {{now}} WHERE parent IS NOT NULL AND parent <> node GROUP BY parent),
        rest AS (
          SELECT node, parent, steps, between, n.size + coalesce(more, 0) AS size, passed, s.child, s.child_passed,
            CASE WHEN parent <> node AND left_over = 1 AND gone = 0 AND {rank("node")} > {rank("s.child")} AND {rank("node")} > {rank("parent")} THEN 'spliced'
              WHEN coalesce(left_over, 0) = 0 AND NOT coalesce(parent = node, false) THEN 'leaf' ELSE 'stays' END AS state
          FROM {{now}} n LEFT JOIN sent s ON n.node = s.at WHERE n.state <> 'leaf'),
        above AS (SELECT child AS at, parent AS up_parent, steps AS up_steps, between AS up_between, node AS up_node, size + passed AS up_passed FROM rest WHERE state = 'spliced')
        SELECT r.node, if(a.up_node IS NOT NULL, a.up_parent, r.parent) AS parent, r.steps + coalesce(a.up_steps, 0) AS steps, {between} AS between, r.size, r.passed + coalesce(a.up_passed, 0) AS passed, r.state,
          if(r.state = 'spliced', r.child, NULL) AS child, if(r.state = 'spliced', r.child_passed, NULL) AS child_passed
        FROM rest r LEFT JOIN above a ON r.node = a.at""", now=now)  # fmt: skip


def _assigned(rows: DataFrame, known: DataFrame, paths: bool) -> DataFrame:
    """_DONE of rows whose parent, and child if they were spliced out, are known."""
    path = "if(r.parent IS NULL OR u.depth >= 0, concat(coalesce(u.path, CAST(array() AS array<string>)), r.between, array(r.node)), NULL)" if paths else "CAST(NULL AS array<string>)"
    return rows.sparkSession.sql(f"""
        SELECT r.node, CASE WHEN r.parent IS NULL THEN r.node WHEN l.root = '{CYCLE}' THEN '{CYCLE}' WHEN u.depth < 0 THEN '{BELOW}' ELSE u.root END AS root,
          CAST(CASE WHEN r.parent IS NULL THEN 0 WHEN u.depth >= 0 THEN u.depth + r.steps ELSE -1 END AS bigint) AS depth, {path} AS path,
          if(r.parent IS NULL OR u.depth >= 0, r.size + if(r.state = 'spliced', r.child_passed + l.size, 0), NULL) AS size
        FROM {{rows}} r LEFT JOIN {{known}} u ON r.parent = u.node LEFT JOIN {{known}} l ON r.child = l.node""", rows=rows, known=known)  # fmt: skip


def _write_counted(state: DataFrame, path: str) -> int:
    """Write a round; the number of its rows that aren't on cycles' last nodes is counted on the way, without another job."""
    seen = Observation()
    more = (F.col("state") != "spliced") & ~((F.col("state") == "stays") & F.coalesce(F.col("parent") == F.col("node"), F.lit(False)))
    state.observe(seen, F.count_if(more).alias("n")).write.parquet(path)
    return seen.get["n"]


def descendants(trees: DataFrame) -> DataFrame:
    """(ancestor, node_id, distance) for every node below another one, from the kept parents by doubling.

    No list is collected: known pairs are carried on to the ancestors twice as far, so rounds are the logarithm of
    the depth. Nodes without a root (cycles and below) give no rows.
    """
    spark = trees.sparkSession
    base = workspace(spark)
    jump = materialize(trees.where("depth > 0").select("node_id", F.col("parent_id").alias("ancestor")), f"{base}/jump=0")
    pairs = [materialize(jump.select("ancestor", "node_id", F.lit(1).cast("bigint").alias("distance")), f"{base}/pairs=0")]
    reach, step = 1, 0
    while True:
        step += 1
        known = pairs[0]
        for p in pairs[1:]:
            known = known.unionByName(p)
        here = jump.select(F.col("node_id").alias("low"), F.col("ancestor").alias("node_id"))
        farther = known.join(here, "node_id").select("ancestor", F.col("low").alias("node_id"), (F.col("distance") + reach).alias("distance"))
        pairs.append(materialize(farther, f"{base}/pairs={step}"))
        if pairs[-1].isEmpty():
            return known
        jump = materialize(jump.join(jump.select(F.col("node_id").alias("ancestor"), F.col("ancestor").alias("far")), "ancestor").select("node_id", F.col("far").alias("ancestor")), f"{base}/jump={step}")
        reach *= 2
