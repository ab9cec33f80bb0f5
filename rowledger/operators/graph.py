"""Closures over reference edges by a frontier loop: each round joins only what is new, and lineage is cut by checkpoint()."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowledger.operators.tasks import shared_out
from rowledger.sources.pointers import delete


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct nodes reachable from seeds (node) over edges (src, dst), seeds included; cycles end by themselves.

    Each round writes its frontier once; what was seen is the union of the frontiers written so far, so that no node is
    written twice, and a frontier's number of rows comes with the job that writes it.
    """
    edges = edges.select("src", "dst").distinct().checkpoint()
    seen = frontier = seeds.select("node").distinct().checkpoint()
    rounds = 0
    while True:
        step = frontier.join(edges.hint("merge"), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        met = Observation()
        frontier = step.join(seen.hint("merge"), "node", "left_anti").observe(met, F.count("*").alias("n")).checkpoint()
        if not met.get["n"]:
            return seen
        rounds += 1
        # Once in a while the union becomes one frame, so that a deep graph does not make a long plan.
        seen = seen.union(frontier) if rounds % 16 else seen.union(frontier).checkpoint()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def dependencies(edges: DataFrame, roots: DataFrame, recursive: bool = True) -> DataFrame:
    """What roots depend on; the whole closure includes them, one step does not."""
    if recursive:
        return reach(edges, roots)
    return roots.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()


def impact(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Reachable in either direction."""
    return reach(edges.select("src", "dst").union(reverse(edges)), seeds)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (src, dst), whatever their direction: root is the smallest node that is connected.

    Contraction: every node points to its smallest neighbour, or to itself; doubling the pointers turns these trees into stars in as many
    steps as the logarithm of their depth; then the edges join roots, of which there are at most half as many nodes.
    So a chain of n nodes takes about log n rounds, not n, and a round's work shrinks with the nodes that are left. No
    table of a round is sent to the driver. Null nodes are none.
    """
    spark = edges.sparkSession
    edges, _ = written(edges.where("src is not null and dst is not null").select("src", "dst"))
    left, old_left = written(shared_out(edges.union(reverse(edges)).where("src <> dst"), 2 * edges.count(), "src", "dst").distinct())
    levels = []
    while n := left.count():
        least = shared_out(left, n, "src").groupBy("src").agg(F.min("dst").alias("dst"))
        stars, path = _stars(least.select(F.col("src").alias("node"), F.least("src", "dst").alias("root")))
        levels.append((stars, path))
        # Plain joins between shuffled sides: Spark splits the partition of a node with very many edges.
        at = lambda c, stars=stars: stars.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")).hint("merge")
        met = left.join(at("src"), "src").join(at("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).where("src <> dst")
        left, new_left = written(shared_out(met, n, "src", "dst").distinct())
        delete(spark, old_left)
        old_left = new_left
    delete(spark, old_left)
    # Roots of a round are nodes of the next one, which is smaller: from the last round back each node is joined once.
    roots, old_roots = edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).where("false"), None
    for stars, path in reversed(levels):
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("_root")).hint("merge")
        roots, new_roots = written(stars.join(above, "root", "left").select("node", F.coalesce("_root", "root").alias("root")))
        delete(spark, path, *[old_roots] if old_roots else [])
        old_roots = new_roots
    # A node without an edge to another one is its own root.
    alone = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(roots.select("node").hint("merge"), "node", "left_anti")
    return roots.union(alone.select("node", F.col("node").alias("root")))


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table in the shared folder of spark.checkpoint.dir, and its path. Unlike checkpoint() it brings its real size and no
    constraints along, which would double from one round to the next; and the caller can delete it when it is done."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{folder}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _stars(trees: DataFrame) -> tuple[DataFrame, str]:
    """(node, root) of pointers (node, root) that lead to a node that points to itself: each pointer is doubled until none moves."""
    trees, path = written(trees)
    while True:
        met = Observation()
        above = trees.select(F.col("node").alias("root"), F.col("root").alias("_r"))
        made = trees.join(above.hint("merge"), "root").select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("_up"))
        before = path
        trees, path = written(made.observe(met, F.count_if("_up").alias("n")).drop("_up"))
        delete(trees.sparkSession, before)
        if not met.get["n"]:
            return trees, path


def dependents_changed(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Nodes that depend, over any number of steps, on a changed node; a changed one only if a cycle leads back."""
    back = reverse(edges).distinct().checkpoint()
    first = changed.join(back, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
    return reach(back, first)


def plan_delete(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, action): deleted by closure over CASCADE owners, then blocking owners outside of it, then owners to clear.

    edges (src, dst, policy): src refers to dst.
    """
    gone = reach(reverse(edges.where("policy = 'CASCADE'")), targets)
    owners = edges.join(gone.withColumnRenamed("node", "dst"), "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
    held = owners.where("policy in ('BLOCK', 'SET_NULL')").groupBy("src").agg(F.max((F.col("policy") == "BLOCK").cast("int")).alias("b"))
    return gone.select("node", F.lit("delete").alias("action")).union(held.select(F.col("src").alias("node"), F.when(F.col("b") == 1, "block").otherwise("set_null").alias("action")))


def affected(edges: DataFrame, seeds: DataFrame, provider: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Nodes that a change of seeds (node) touches: they alone, unless a provider of (edges, seeds), such as impact, adds more."""
    nodes = seeds.select("node")
    return (nodes.union(provider(edges, seeds).select("node")) if provider else nodes).distinct()
