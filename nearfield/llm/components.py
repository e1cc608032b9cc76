"""Connected components of an edge table, by alternating large and small stars.

Every star is an aggregate and a join; a node's neighbours are never gathered, and each star's
edges are written to the staging folder, so plans stay short and lost executors re-read them. (A star reads
its edges several times; on top of another star that is not written yet its plan would hold that one as often.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.plans.staging import Stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours (the larger ones, or the smaller ones and itself) on the smallest."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else both.filter("v < u")
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    wanted = both.filter("v > u") if large else both.filter("v < u")
    moved = wanted.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, stage: Stage, name: str = "components") -> DataFrame:
    """Rows (node, root) of all nodes with an edge; root is the component's smallest node.

    ``edges`` has long columns u and v; loops and repeats do no harm.
    """
    edges = edges.select("u", "v").filter("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage.save(edges, f"{name}-edges")
    before = None
    sums = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    for i in range(1_000_000):
        large = stage.save(_star(edges, True), f"{name}-{i}-large")
        edges, facts = stage.save_with(_star(large, False), f"{name}-{i}", *sums)
        now = (facts["n"], facts["s"])
        if now == before or not facts["n"]:
            break
        before = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(roots).distinct()
