"""Pruning descent: for each group of query points, the training leaves that can matter.

The frontier pairs query nodes with training nodes. Each round splits training nodes that
are not small against their query node, splits query nodes, and then prunes: ordered by
the farthest distance, the first training nodes that together hold ``k`` points give an upper
bound for the k-th neighbour distance of every query in the node, and training nodes that
start beyond it are dropped. No node that holds a true neighbour is ever dropped, because
the boxes are exact bounds of the points in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.geometry import axes_of, box_gap, box_span, longest_side
from nearfield.plans.pyramid import POINT, ROOT, Pyramid, box_names, high, holds, key_names, low
from nearfield.plans.staging import Stage, merged_if_big

# Candidate leaves, by dims, above which a query node is split if that can help; a query leaf
# bears eight times as many.
WIDE_FRONTIER = {2: 64, 3: 300}


def _named(df: DataFrame, prefix: str, dims: int, *extra: str) -> DataFrame:
    names = [*key_names(dims), *box_names(dims), *extra]
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in names])


def _side(dims: int, prefix: str) -> Column:
    return longest_side(low(dims, prefix), high(dims, prefix))


def _prune(pairs: DataFrame, dims: int, k: int | None, repeated: bool) -> DataFrame:
    """Tighten the bound ``ub`` per query node and drop pairs that start beyond it."""
    q_lo, q_hi = low(dims, "q_"), high(dims, "q_")
    t_lo, t_hi = low(dims, "t_"), high(dims, "t_")
    node = key_names(dims, "q_")
    if "q_ub" in pairs.columns:
        pairs = pairs.withColumn("ub", F.least("ub", "q_ub"))
    all_rows = Window.partitionBy(*node)
    kept = pairs.withColumn("gap", box_gap(q_lo, q_hi, t_lo, t_hi)).filter(
        F.col("gap") <= F.col("ub")
    )
    if repeated:
        # Of nodes that hold one id only, those that start beyond the end of another one with
        # the same id have just farther places of it.
        same = Window.partitionBy(*node, "t_id_lo", "t_id_hi")
        far = box_span(q_lo, q_hi, t_lo, t_hi)
        one_id = F.col("t_id_lo") == F.col("t_id_hi")
        kept = (
            kept.withColumn("nearest", F.min(far).over(same))
            .filter(~one_id | (F.col("gap") <= F.col("nearest")))
            .drop("nearest")
        )
    if k is not None:
        by_far = all_rows.orderBy("far", *key_names(dims, "t_"))
        running = by_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bound = F.min(F.when(F.col("held"), F.col("far"))).over(all_rows)
        kept = (
            kept.withColumn("far", box_span(q_lo, q_hi, t_lo, t_hi))
            .withColumn("held", holds(kept, k, running))
            .withColumn("ub", F.least("ub", bound))
            .filter(F.col("gap") <= F.col("ub"))
        )
    q_side, t_side = _side(dims, "q_"), _side(dims, "t_")
    big_enough = (t_side * 4 >= q_side) | (q_side <= 0)
    open_t = F.max(~F.col("t_leaf")).over(all_rows)
    tiny_t = F.max(~F.col("t_leaf") & ~big_enough).over(all_rows)
    # A smaller query node sees fewer cells, but only if its size makes much of the bound.
    limit = F.when(F.col("q_leaf"), 8 * WIDE_FRONTIER[dims]).otherwise(WIDE_FRONTIER[dims])
    wide = (F.count(F.lit(1)).over(all_rows) > limit) & (q_side * 4 > F.col("ub"))
    # A query leaf falls apart into single queries only where training nodes are far smaller.
    breaks = (~F.col("q_leaf") & open_t) | tiny_t | wide
    return (
        kept.withColumn("q_split", breaks & (q_side > 0))
        .withColumn("active", open_t | F.col("q_split"))
        .withColumn("t_split", F.col("active") & ~F.col("t_leaf") & big_enough)
        .drop("gap", "far", "held")
    )


def _children(nodes: DataFrame, prefix: str, dims: int, *extra: str) -> DataFrame:
    """Nodes by their parent's key ``s_*``."""
    parent = [F.col(f"p{c}").alias(f"s_{c}") for c in key_names(dims)]
    names = [*key_names(dims), *box_names(dims), *extra]
    return nodes.filter(F.col("plvl") != ROOT).select(
        *parent, *[F.col(c).alias(f"{prefix}{c}") for c in names]
    )


def _replace(
    pairs: DataFrame, children: DataFrame, prefix: str, dims: int, *rows: int
) -> DataFrame:
    """Swap the ``prefix`` side of each pair for that node's children; ``rows`` are about those of the two tables."""
    keys = key_names(dims)
    gone = [c for c in children.columns if c.startswith(prefix)]
    kept = [c for c in pairs.columns if c not in gone]
    named = pairs.select(*kept, *[F.col(f"{prefix}{c}").alias(f"s_{c}") for c in keys])
    joined = named.join(merged_if_big(children, *rows), [f"s_{c}" for c in keys])
    return joined.select(*pairs.columns)


def candidate_leaves(
    stage: Stage,
    queries: Pyramid,
    query_points: DataFrame,
    training: Pyramid,
    k: int | None,
    *,
    radius: float = float("inf"),
    own_cell_only: bool = False,
    repeated: bool = False,
) -> DataFrame:
    """Pairs of query node (``q_*``) and training leaf (``t_*``) that survive, with the bound
    ``ub``. Query nodes partition the query points; a node at level
    ``POINT`` is a single query, keyed by its id.

    ``radius`` is a bound to start from, and so is ``ub``, the bound that the queries of a node bring
    along; they are the only ones if ``k`` is None. ``repeated`` says that training ids may occur more than once and count at their nearest place. ``own_cell_only`` starts from pairs of equal top cells instead of one common root.
    """
    dims = training.dims
    facts_of_t = ["leaf", "n", "rows"] + (["id_lo", "id_hi"] if repeated else [])
    facts_of_t += ["ids"] if "ids" in training.nodes.columns else []
    facts_of_q = ["leaf", "rows"] + (["ub"] if "ub" in queries.nodes.columns else [])
    q_nodes = _named(queries.nodes.filter(F.col("plvl") == ROOT), "q_", dims, *facts_of_q)
    t_nodes = _named(training.nodes.filter(F.col("plvl") == ROOT), "t_", dims, *facts_of_t)
    # Top nodes share one root, or one key per cell; either way the join is on equality.
    if own_cell_only:
        start = q_nodes.join(t_nodes, [F.col(f"q_{c}") == F.col(f"t_{c}") for c in key_names(dims)])
    else:
        root = F.lit(ROOT).alias("root")
        start = q_nodes.select("*", root).join(t_nodes.select("*", root), "root").drop("root")
    pairs = start.withColumn("ub", F.lit(float(radius)))
    q_moves = _children(queries.nodes, "q_", dims, *facts_of_q)
    t_moves = _children(training.nodes, "t_", dims, *facts_of_t)
    point_moves = None
    done = []
    while True:
        frontier, facts = stage.save_with(
            _prune(pairs, dims, k, repeated),
            f"frontier-{len(done)}",
            F.count_if("active").alias("open"),
            F.count_if("t_split").alias("t_split"),
            F.count_if(F.col("q_split") & ~F.col("q_leaf")).alias("q_nodes"),
            F.count_if(F.col("q_split") & F.col("q_leaf")).alias("q_points"),
        )
        done.append(frontier.filter(~F.col("active")))
        if not facts["open"]:
            break
        live = frontier.filter("active")
        pairs = live.filter(~F.col("t_split"))
        if facts["t_split"]:
            size = facts["t_split"], training.leaf_count
            moved = _replace(live.filter("t_split"), t_moves, "t_", dims, *size)
            pairs = pairs.unionByName(moved)
        branches = [pairs.filter(~F.col("q_split"))]
        if facts["q_nodes"]:
            split = pairs.filter(F.col("q_split") & ~F.col("q_leaf"))
            size = facts["q_nodes"], queries.leaf_count
            branches.append(_replace(split, q_moves, "q_", dims, *size))
        if facts["q_points"]:
            if point_moves is None:
                point_moves = _point_children(queries, query_points)
            split = pairs.filter(F.col("q_split") & F.col("q_leaf"))
            size = facts["q_points"], queries.rows
            branches.append(_replace(split, point_moves, "q_", dims, *size))
        pairs = branches[0]
        for branch in branches[1:]:
            pairs = pairs.unionByName(branch)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.drop("active", "q_split", "t_split", "q_ub")


def _point_children(queries: Pyramid, query_points: DataFrame) -> DataFrame:
    """Single queries as nodes, by the key ``s_*`` of the leaf that holds them."""
    dims = queries.dims
    keys, axes = key_names(dims), axes_of(dims)
    placed = queries.assign(query_points)
    zero = F.lit(0).cast("bigint")
    own_key = [F.lit(POINT), F.col("id"), *[zero for _ in axes[1:]]]
    boxes = [F.col(a).alias(f"q_{side}_{a}") for a in axes for side in ("lo", "hi")]
    return placed.select(
        *[F.col(c).alias(f"s_{c}") for c in keys],
        *[v.alias(f"q_{c}") for c, v in zip(keys, own_key, strict=True)],
        *boxes,
        F.lit(True).alias("q_leaf"),
        F.lit(1).cast("bigint").alias("q_rows"),
        *([F.col("ub").alias("q_ub")] if "ub" in query_points.columns else []),
    )
