"""kNN inside one's own cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.grid import check_n
from nearfield.operators.cells import assign_tree
from nearfield.operators.neighbors import check_k, empty_neighbors, topk
from nearfield.plans.aknn import (
    METHODS,
    QUERY_CAPACITY,
    plain_points,
    plain_weight,
    refuse_repeated_ids,
    settle_dims,
    weigh,
)
from nearfield.plans.descent import candidate_leaves
from nearfield.plans.meet import meet_points, query_visits, tile_candidates
from nearfield.plans.pyramid import build_pyramid, extent_of
from nearfield.plans.staging import Stage


def local_knn(
    q: DataFrame,
    t: DataFrame,
    k: int,
    *,
    dims: int | None = None,
    n: int | None = None,
    leaves: DataFrame | None = None,
    method: str = "bf",
    unique_ids: bool | None = None,
    unique_query_ids: bool | None = None,
) -> DataFrame:
    """The ``k`` nearest training points in each query's own cell: ``(qid, rank, tid, dist)``.

    Cells are those of the grid with ``n`` per axis or of the tree ``leaves``. A query whose
    cell holds fewer than ``k`` points gets those. Crowded cells are split further inside.
    Null or non-finite values and repeated query ids are an error.
    """
    k = check_k(k)
    if (n is None) == (leaves is None):
        raise ValueError("give either n or leaves")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    dims = settle_dims(q, t, dims)
    q, t = plain_points(q, dims, "q"), plain_points(t, dims, "t")
    # Points outside a tree are left out below, so both sides are looked at whole first.
    q_extent, t_extent = extent_of(q, dims, "q"), extent_of(t, dims, "t")
    if not unique_query_ids:
        refuse_repeated_ids(q)
    stage = Stage(q.sparkSession)
    if leaves is not None:
        leaves = stage.save(leaves.select("path", "depth", "n_sample"), "leaves")
        q, t = (in_leaves(side, leaves, dims) for side in (q, t))
        q_extent, t_extent = extent_of(q, dims), extent_of(t, dims)
        base = {"level_column": "leaf_level", "width": 1.0}
    else:
        base = {"level": 0, "width": 1.0 / check_n(n)}
    if not q_extent.rows or not t_extent.rows:
        return empty_neighbors(q.sparkSession)

    weighed, unique = weigh(t, dims, unique_ids)
    common = {"top": 0, "rooted": False, **base}
    training = build_pyramid(
        stage, "training", weighed, dims, max(64, 4 * k), extent=t_extent, **common
    )
    queries = build_pyramid(
        stage, "queries", plain_weight(q), dims, QUERY_CAPACITY, extent=q_extent, **common
    )
    pairs = candidate_leaves(
        stage, queries, q, training, k, own_cell_only=True, repeated=not unique
    )
    found = tile_candidates(stage, pairs, queries, k)
    visits = query_visits(stage, q, found, queries, k)
    met = meet_points(
        stage, visits, t, found, queries, training, k, method, exclude_self=False, unique=unique
    )
    return topk(met, k, distinct=not unique, within="tile")


def in_leaves(points: DataFrame, leaves: DataFrame, dims: int) -> DataFrame:
    """Points inside the tree, with the depth of their leaf."""
    placed = assign_tree(points, leaves, dims)
    return placed.withColumn("leaf_level", F.length("cell")).drop("cell")
