"""Points to cells, and counts per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.geometry import axes_of
from nearfield.functions.grid import grid_cell
from nearfield.functions.tree import tree_path
from nearfield.plans.staging import BROADCAST_ROWS, lookup


def assign_grid(points: DataFrame, n: int, dims: int = 2) -> DataFrame:
    """Add the grid ``cell`` of each point."""
    return points.withColumn("cell", grid_cell([F.col(a) for a in axes_of(dims)], n))


def assign_tree(
    points: DataFrame, leaves: DataFrame, dims: int = 2, *, how: str = "inner"
) -> DataFrame:
    """Add the path ``cell`` of the leaf that holds each point.

    Each point is spread over the prefixes of its path, at the depths that leaves have, and
    joined on equality; leaves do not overlap, so one prefix matches. Points outside the unit
    box have no leaf: they are dropped, or with ``how="left"`` keep a null cell.
    """
    axes = axes_of(dims)
    facts = leaves.agg(
        F.collect_set("depth").alias("depths"),
        F.count(F.lit(1)).alias("leaves"),
    ).first()
    if not facts.leaves:
        raise ValueError("the tree has no leaves")
    inside = None
    for a in axes:
        here = (F.col(a) >= 0) & (F.col(a) < 1)
        inside = here if inside is None else inside & here
    deepest = max(facts.depths)
    depth = F.explode(F.array(*[F.lit(d) for d in sorted(facts.depths)]))
    spread = (
        points.filter(inside)
        .withColumn("path", tree_path([F.col(a) for a in axes], deepest))
        .withColumn("depth", depth)
        .withColumn("cell", F.expr("substring(path, 1, depth)"))
        .drop("path", "depth")
    )
    table = leaves.select(F.col("path").alias("cell"))
    if facts.leaves > BROADCAST_ROWS:
        # What the sample counted need not be how these points lie, so count them.
        found = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("leaf_rows"))
        table = table.join(found.hint("merge"), "cell")
        total = points.count()
    else:
        table, total = table.withColumn("leaf_rows", F.lit(0)), 0
    placed = lookup(spread, table, ["cell"], "leaf_rows", total, facts.leaves)
    placed = placed.select(*points.columns, "cell")
    if how == "inner":
        return placed
    outside = points.filter(~inside).withColumn("cell", F.lit(None).cast("string"))
    return placed.unionByName(outside)


def cell_histogram(cells: DataFrame) -> DataFrame:
    """Points per occupied cell: ``(cell, n)``."""
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def cells_with_queries(t_cells: DataFrame, q_cells: DataFrame) -> DataFrame:
    """Rows of ``t_cells`` whose cell holds at least one query point."""
    return t_cells.join(q_cells.select("cell").distinct(), "cell", "left_semi").select(
        t_cells.columns
    )
