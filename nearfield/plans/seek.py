"""Descent by single queries, for few queries or for queries that name their cells.

Every query walks the training pyramid by itself, so no pyramid of the queries is needed and the whole
walk is one lazy plan: a level is a left join with the nodes' children (leaves have none and stay) and
a window by query that tightens the bound. Points are then met by an equi-join on the leaf key, whose
training side is bounded by the leaf's capacity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.geometry import (
    axes_of,
    box_max_dist,
    box_min_dist,
    distance,
    longest_side,
    point,
)
from nearfield.plans.meet import PairCount
from nearfield.plans.pyramid import ROOT, Pyramid, box_names, high, holds, key_names, low
from nearfield.plans.staging import Stage, lookup

# Levels that are walked before the frontier is written, which keeps plans short.
LAZY_LEVELS = 8


def query_rows(q: DataFrame, dims: int) -> DataFrame:
    """Queries as ``(qid, qx, qy[, qz], ub)``."""
    bound = F.col("ub") if "ub" in q.columns else F.lit(float("inf"))
    axes = [F.col(a).alias(f"q{a}") for a in axes_of(dims)]
    return q.select(F.col("id").alias("qid"), *axes, bound.alias("ub"))


def top_nodes(training: Pyramid) -> DataFrame:
    """The nodes without a parent, as ``t_*``."""
    return _node_columns(training.nodes.filter(F.col("plvl") == ROOT), training.dims, "t_")


def _node_columns(nodes: DataFrame, dims: int, prefix: str, *extra: Column) -> DataFrame:
    names = [*key_names(dims), *box_names(dims), "leaf", "n", "rows"]
    names += ["ids"] if "ids" in nodes.columns else []
    return nodes.select(*extra, *[F.col(c).alias(f"{prefix}{c}") for c in names])


def from_the_top(q: DataFrame, training: Pyramid) -> DataFrame:
    """Every query with the few nodes at the top of the pyramid."""
    queries = query_rows(q, training.dims).withColumn("root", F.lit(0))
    return queries.join(top_nodes(training).withColumn("root", F.lit(0)), "root").drop("root")


def seek_leaves(stage: Stage, pairs: DataFrame, training: Pyramid, k: int | None) -> DataFrame:
    """The leaves that each query has to visit: ``qid, qx, qy[, qz], reach, t_*``.

    ``pairs`` are queries (``query_rows``) with the nodes they start from (``top_nodes``); ``ub`` bounds
    the distance from the start. With ``k`` the nearer nodes that hold as many points bound it too.
    """
    dims = training.dims
    axes, t_keys = axes_of(dims), key_names(dims, "t_")
    parent = [F.col(f"p{c}").alias(f"s_{c}") for c in key_names(dims)]
    inner = training.nodes.filter(F.col("plvl") != ROOT)
    children = _node_columns(inner, dims, "c_", *parent)
    names = [c[2:] for c in children.columns if c.startswith("c_")]
    kept = _near(pairs, dims, k)
    for i in range(1, len(training.levels)):
        on = [F.col(f"t_{c}") == F.col(f"s_{c}") for c in key_names(dims)]
        moved = kept.join(children, on, "left")
        swap = {f"t_{c}": F.coalesce(f"c_{c}", f"t_{c}") for c in names}
        moved = moved.withColumns(swap).select("qid", *[f"q{a}" for a in axes], "ub", *swap)
        kept = _near(moved, dims, k)
        if i % LAZY_LEVELS == 0:
            kept = stage.save(kept, f"seek-{i}")
    boxes = [f"t_{c}" for c in box_names(dims)]
    return kept.select(
        "qid", *[f"q{a}" for a in axes], F.col("ub").alias("reach"), *t_keys, "t_rows", *boxes
    )


def _near(pairs: DataFrame, dims: int, k: int | None) -> DataFrame:
    qp, lo, hi = point("q", dims), low(dims, "t_"), high(dims, "t_")
    gap = box_min_dist(qp, lo, hi)
    if k is None:
        return pairs.filter(gap <= F.col("ub"))
    query = Window.partitionBy("qid")
    by_far = query.orderBy("far", *key_names(dims, "t_"))
    running = by_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = F.min(F.when(F.col("held"), F.col("far"))).over(query)
    return (
        pairs.withColumn("gap", gap)
        .filter(F.col("gap") <= F.col("ub"))
        .withColumn("far", box_max_dist(qp, lo, hi))
        .withColumn("held", holds(pairs, k, running))
        .withColumn("ub", F.least("ub", bound))
        .filter(F.col("gap") <= F.col("ub"))
        .drop("gap", "far", "held")
    )


def meet_leaves(
    stage: Stage,
    visits: DataFrame,
    t,
    training: Pyramid,
    k: int | None,
    *,
    exclude_self: bool = False,
    unique: bool = True,
    count: PairCount | None = None,
) -> DataFrame:
    """Pairs ``(qid, tid, dist)`` within reach. ``t`` are points or a ``PointIndex``."""
    dims = training.dims
    axes, keys, t_keys = axes_of(dims), key_names(dims), key_names(dims, "t_")
    visits = stage.save(visits, "visits")
    boxes = box_names(dims)
    wanted = visits.select(
        *[F.col(f"t_{c}").alias(c) for c in [*keys, "rows", *boxes]]
    ).dropDuplicates(keys)
    pile = longest_side(low(dims), high(dims)) <= 0
    pile = pile & (F.col("rows") > k) if k is not None else F.lit(False)
    wanted, facts = stage.save_with(
        wanted.withColumn("pile", pile),
        "wanted",
        F.count(F.lit(1)).alias("leaves"),
        F.count_if("pile").alias("piles"),
    )
    members = wanted_points(t, training, wanted, facts["leaves"], facts["piles"], k, unique)
    members = members.select(
        *[F.col(c).alias(n) for c, n in zip(keys, t_keys, strict=True)],
        F.col("id").alias("tid"),
        *[F.col(a).alias(f"t{a}") for a in axes],
    )
    qp, tp = point("q", dims), point("t", dims)
    near = distance(qp, tp) <= F.col("reach")
    if exclude_self:
        near = near & (F.col("qid") != F.col("tid"))
    met = visits.join(members, t_keys)
    if count is not None:
        met = met.observe(count.rest, F.count(F.lit(1)).alias("pairs"))
    met = met.filter(near)
    return met.select("qid", "tid", distance(qp, tp).alias("dist"))


def wanted_points(
    t, training: Pyramid, wanted: DataFrame, size: int, piles: int, k: int | None, unique: bool
) -> DataFrame:
    """Points of the leaves ``wanted (key, rows, lo_*, pile)`` with their key; of a pile just ``k`` ids."""
    keys = key_names(training.dims)
    if hasattr(t, "points_of"):
        spread = t.points_of(wanted)
    else:
        spread = training.place(t, wanted, training.leaf_levels, size)
    found = lookup(spread, wanted.select(*keys, "rows", "pile"), keys, "rows", training.rows, size)
    if not piles:
        return found
    thin = found.filter("pile")
    if not unique:
        thin = thin.dropDuplicates([*keys, "id"])
    first = Window.partitionBy(*keys).orderBy("id")
    thin = thin.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k)
    return found.filter(~F.col("pile")).unionByName(thin.drop("nth"))
