"""Which cells can hold neighbours of a query.

Here cells are the whole boxes of the grid or tree, as the partitioning has them, and only
cells with training points count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.geometry import axes_of, box_min_dist
from nearfield.functions.grid import check_n, grid_decode
from nearfield.functions.tree import axis_index, tree_cell
from nearfield.operators.cells import assign_grid, assign_tree
from nearfield.operators.neighbors import (
    check_k,
    empty_neighbors,
    local_radius,
    merge_topk,
    topk,
)
from nearfield.plans.aknn import (
    QUERY_CAPACITY,
    plain_points,
    plain_weight,
    refuse_repeated_ids,
    settle_dims,
    weigh,
    weigh_first_places,
)
from nearfield.plans.descent import candidate_leaves
from nearfield.plans.local import in_leaves, local_knn
from nearfield.plans.meet import query_visits, tile_candidates
from nearfield.plans.pyramid import (
    Pyramid,
    box_names,
    build_pyramid,
    cell_coord,
    density_level,
    extent_of,
    key_names,
    top_level,
)
from nearfield.plans.seek import meet_leaves, query_rows, seek_leaves, top_nodes
from nearfield.plans.staging import BROADCAST_ROWS, Stage

# Pairs of a query and a cell that one key of a join may make.
KEY_PAIRS = 20_000_000
OVERLAP_SCHEMA = "qid bigint, cell {type}, complete boolean"


def occupied_cells(
    cells: DataFrame, *, dims: int = 2, n: int | None = None, leaves: DataFrame | None = None
) -> DataFrame:
    """Cells of a histogram ``(cell, n)`` with their nested key and box, for ``range_cells``."""
    if (n is None) == (leaves is None):
        raise ValueError("give either n or leaves")
    axes = axes_of(dims)
    if n is not None:
        level, width = F.lit(0), 1.0 / check_n(n)
        index = grid_decode(F.col("cell"), n, dims)
    else:
        cells = cells.join(leaves.select(F.col("path").alias("cell")), "cell", "left_semi")
        level, width = F.length("cell"), 1.0
        index = [axis_index(F.col("cell"), a) for a in axes]
    keyed = cells.select(
        "cell",
        "n",
        level.alias("lvl"),
        *[i.alias(f"c{a}") for i, a in zip(index, axes, strict=True)],
    )
    return keyed.withColumns(cell_box(dims, width))


def cell_box(dims: int, width: float) -> dict[str, Column]:
    side = F.pow(F.lit(2.0), -F.col("lvl")) * F.lit(width)
    box = {}
    for a in axes_of(dims):
        box[f"lo_{a}"] = F.col(f"c{a}") * side
        box[f"hi_{a}"] = (F.col(f"c{a}") + 1) * side
    return box


def range_cells(
    q: DataFrame, cells: DataFrame, *, dims: int = 2, n: int | None = None
) -> DataFrame:
    """Cells no farther than ``r`` from each query ``(id, x, y[, z], r)``: ``(qid, cell)``.

    ``cells`` comes from ``occupied_cells``; give its ``n`` for a grid. Each query looks for
    cells at the level whose side is about ``r``, where at most 3 per axis touch the circle,
    and finds the cells inside those; a tree's wider leaves it finds at their own level. So the
    join is on equality whatever the radius is, and meets few cells that are too far.
    """
    axes, keys = axes_of(dims), [*key_names(dims), "wider"]
    width = 1.0 if n is None else 1.0 / check_n(n)
    # Level at which one cell spans the whole unit domain.
    coarsest = 0 if n is None else -(check_n(n) - 1).bit_length()
    facts = cells.agg(
        F.collect_set("lvl").alias("depths"),
        F.count(F.lit(1)).alias("cells"),
        *[F.min(f"lo_{a}").alias(f"lo_{a}") for a in axes],
        *[F.max(f"hi_{a}").alias(f"hi_{a}") for a in axes],
    ).first()
    if not facts.cells:
        return q.sparkSession.createDataFrame([], "qid bigint, cell string").select(
            "qid", F.col("cell").cast(cells.schema["cell"].dataType)
        )
    depths = sorted(facts.depths) or [0]
    fit = F.floor(F.log2(F.lit(width) / F.col("r")))
    own = F.when(F.col("r") > 0, F.least(F.lit(depths[-1]), fit)).otherwise(F.lit(depths[-1]))
    look = q.withColumn("own", F.greatest(F.lit(coarsest), own).cast("int"))
    levels = F.array(F.col("own"), *[F.lit(d) for d in depths[:-1]])
    look = (
        look.withColumn("lvl", F.explode(F.array_distinct(levels)))
        .filter(F.col("lvl") <= F.col("own"))
        .withColumn("wider", F.col("lvl") < F.col("own"))
    )
    pad = F.col("r") * (1.0 + 1e-12) + F.lit(1e-9 * width)
    for a in axes:
        # No key beyond the occupied cells, however large the radius is.
        least, most = F.lit(facts[f"lo_{a}"]), F.lit(facts[f"hi_{a}"])
        first = cell_coord(F.greatest(F.col(a) - pad, least), width, F.col("lvl"))
        last = cell_coord(F.least(F.col(a) + pad, most), width, F.col("lvl"))
        keys_here = F.when(first <= last, F.sequence(first, last))
        look = look.withColumn(f"c{a}", F.explode(keys_here))
    look = look.select(F.col("id").alias("qid"), *axes, "r", *keys)
    rest = ["cell", *box_names(dims)]
    itself = cells.select(*rest, *key_names(dims), F.lit(True).alias("wider"))
    above = cells.withColumn("up", F.explode(F.sequence(F.lit(coarsest), F.col("lvl"))))
    above = above.select(
        *rest,
        F.col("up").alias("lvl"),
        *[F.expr(f"shiftright(c{a}, lvl - up)").alias(f"c{a}") for a in axes],
        F.lit(False).alias("wider"),
    )
    spread = itself.unionByName(above)
    if facts.cells * (depths[-1] - coarsest + 2) <= BROADCAST_ROWS:
        spread = F.broadcast(spread)
    else:
        look, spread = _parted(look, spread, keys)
        keys = [*keys, "part"]
    lo, hi = [F.col(f"lo_{a}") for a in axes], [F.col(f"hi_{a}") for a in axes]
    gap = box_min_dist([F.col(a) for a in axes], lo, hi)
    return look.join(spread, keys).filter(gap <= F.col("r")).select("qid", "cell")


def _parted(look: DataFrame, spread: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``part``: queries of a key that meets very many cells are dealt over several."""
    asked = look.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked"))
    here = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("here"))
    load = asked.join(here.hint("merge"), keys).filter(F.col("asked") * F.col("here") > KEY_PAIRS)
    # There can be no more of these than all pairs hold KEY_PAIRS.
    parts = F.ceil(F.col("asked") * F.col("here") / KEY_PAIRS)
    crowded = F.broadcast(load.select(*keys, F.least("asked", parts).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    look = look.join(crowded, keys, "left")
    look = look.withColumn("part", F.pmod(F.xxhash64("qid"), parts).cast("int")).drop("parts")
    spread = spread.join(crowded, keys, "left")
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return look, spread.hint("merge")


def overlaps_grid(
    q: DataFrame, t: DataFrame, k: int, n: int, *, dims: int | None = None
) -> DataFrame:
    """Grid cells that can hold one of the ``k`` nearest points: ``(qid, cell, complete)``.

    A query whose own cell holds ``k`` points and whose list cannot improve elsewhere has one
    row, its own cell with ``complete`` true. Any other has its occupied other cells within
    reach: no farther than the k-th neighbour of its own cell, if there is one, nor than
    the distance within which whole cells hold ``k`` points. A training id that occurs more than
    once is one point: a list has it once, and it counts in the cell of its smallest place only.
    """
    return _overlaps(q, t, k, dims, n=n)


def overlaps_tree(
    q: DataFrame, t: DataFrame, k: int, leaves: DataFrame, *, dims: int | None = None
) -> DataFrame:
    """The same for the leaves of a tree; points outside it are left out."""
    return _overlaps(q, t, k, dims, leaves=leaves)


def _overlaps(
    q: DataFrame,
    t: DataFrame,
    k: int,
    dims: int | None,
    n: int | None = None,
    leaves: DataFrame | None = None,
    lists: DataFrame | None = None,
) -> DataFrame:
    """Overlap cells; ``lists`` are those of ``local_knn`` where they are at hand."""
    k = check_k(k)
    dims = settle_dims(q, t, dims)
    q, t = plain_points(q, dims, "q"), plain_points(t, dims, "t")
    axes = axes_of(dims)
    q_extent, t_extent = extent_of(q, dims, "q"), extent_of(t, dims, "t")
    refuse_repeated_ids(q)
    stage = Stage(q.sparkSession)
    if leaves is None:
        width, base = 1.0 / check_n(n), {"level": 0}
        own, q_in, t_in = assign_grid(q, n, dims), q, t
    else:
        leaves = stage.save(leaves.select("path", "depth", "n_sample"), "leaves")
        width, base = 1.0, {"level_column": "leaf_level"}
        own = assign_tree(q, leaves, dims)
        q_in, t_in = in_leaves(q, leaves, dims).drop("leaf_level"), in_leaves(t, leaves, dims)
        q_extent, t_extent = extent_of(q_in, dims), extent_of(t_in, dims)
    if not q_extent.rows or not t_extent.rows:
        kind = "bigint" if leaves is None else "string"
        return q.sparkSession.createDataFrame([], OVERLAP_SCHEMA.format(type=kind))

    weighed, unique = weigh_first_places(t_in, dims)
    if lists is None:
        lists = local_knn(
            q, t, k, dims=dims, n=n, leaves=leaves, unique_ids=unique, unique_query_ids=True
        )
    own = own.select(F.col("id").alias("qid"), F.col("cell").alias("own"))
    # All that follows reads these, so none is made twice.
    own = stage.save(own.join(local_radius(lists, k), "qid", "left"), "own-cells")
    # A border point may lie a rounding error outside its cell's box.
    slack = F.lit(1e-9 * width)
    # No cell matters beyond the k-th neighbour at home.
    known = own.select(F.col("qid").alias("id"), (F.col("r") * (1.0 + 1e-12) + slack).alias("ub"))
    q_in = q_in.join(known, "id", "left")
    q_in = q_in.withColumn("ub", F.coalesce("ub", F.lit(float("inf"))))

    top = min(0, top_level(q_extent.union(t_extent), dims, width))
    training = build_pyramid(
        stage, "training", weighed, dims, None, width=width, extent=t_extent, top=top, **base
    )
    boxes = training.nodes.withColumns(cell_box(dims, width))
    training = Pyramid(
        boxes,
        dims,
        width,
        training.rows,
        training.levels,
        training.leaf_count,
        training.leaf_levels,
    )
    queries = build_pyramid(
        stage,
        "queries",
        plain_weight(q_in),
        dims,
        QUERY_CAPACITY,
        width=width,
        extent=q_extent,
        top=top,
        level=density_level(q_extent, dims, width, QUERY_CAPACITY),
    )
    pairs = candidate_leaves(stage, queries, q_in, training, k)
    found = tile_candidates(stage, pairs, queries, k)
    visits = query_visits(stage, q_in, found, queries, k)
    index = [F.col(f"t_c{a}") for a in axes]
    if leaves is None:
        cell = index[0]
        for power, i in enumerate(index[1:], start=1):
            cell = cell + i * F.lit(n**power).cast("bigint")
    else:
        cell = tree_cell(index, F.col("t_lvl"))
    visits = visits.select("qid", "reach", "gap", cell.alias("cell"))

    reach = F.least("reach", "r") * (1.0 + 1e-12) + slack
    others = (
        visits.join(own, "qid")
        .filter((F.col("gap") <= reach) & (F.col("cell") != F.col("own")))
        .select("qid", "cell", F.lit(False).alias("complete"))
    )
    others = stage.save(others, "other-cells")
    done = own.filter(F.col("r").isNotNull()).join(others, "qid", "left_anti")
    return others.unionByName(
        done.select("qid", F.col("own").alias("cell"), F.lit(True).alias("complete"))
    )


def probe_overlaps(
    q: DataFrame,
    t: DataFrame,
    overlaps: DataFrame,
    k: int,
    *,
    dims: int | None = None,
    n: int | None = None,
    leaves: DataFrame | None = None,
    bound: str | None = None,
) -> DataFrame:
    """The second phase: the ``k`` nearest points in each query's overlap cells.

    ``overlaps`` comes from ``overlaps_grid`` (give its ``n``) or ``overlaps_tree`` (its
    ``leaves``). Queries that are complete have no row here. Crowded cells are split by their points, and
    a query meets only the parts that can hold one of its ``k``; ``bound`` names a column of ``q``
    with the distance beyond which it wants none (null is no bound).
    """
    if (n is None) == (leaves is None):
        raise ValueError("give either n or leaves")
    k = check_k(k)
    dims = settle_dims(q, t, dims)
    q, t = plain_points(q, dims, "q", bound), plain_points(t, dims, "t")
    axes, stage = axes_of(dims), Stage(q.sparkSession)
    if leaves is None:
        base = {"level": 0, "width": 1.0 / check_n(n)}
        level, index = F.lit(0), grid_decode(F.col("cell"), n, dims)
    else:
        leaves = stage.save(leaves.select("path", "depth", "n_sample"), "leaves")
        t, base = in_leaves(t, leaves, dims), {"level_column": "leaf_level", "width": 1.0}
        level, index = F.length("cell"), [axis_index(F.col("cell"), a) for a in axes]
    extent = extent_of(t, dims, "t")
    if not extent.rows:
        return empty_neighbors(q.sparkSession)
    weighed, unique = weigh(t, dims, None)
    training = build_pyramid(
        stage, "cells", weighed, dims, max(64, 4 * k), extent=extent, top=0, rooted=False, **base
    )
    asked = overlaps.filter(~F.col("complete")).select(
        "qid", level.alias("t_lvl"), *[i.alias(f"t_c{a}") for i, a in zip(index, axes, strict=True)]
    )
    asked = asked.join(query_rows(q, dims), "qid")
    pairs = asked.join(top_nodes(training), key_names(dims, "t_"))
    visits = seek_leaves(stage, pairs, training, k)
    met = meet_leaves(stage, visits, t, training, k, unique=unique)
    return topk(met, k, distinct=not unique)


def two_phase_join(
    q: DataFrame,
    t: DataFrame,
    k: int,
    *,
    dims: int | None = None,
    n: int | None = None,
    leaves: DataFrame | None = None,
) -> DataFrame:
    """The all-k-nearest-neighbour join in two phases: own cell, then overlap cells, merged.

    The rows are those of ``aknn_join`` (points outside a tree are left out). The second phase looks no
    farther than the k-th neighbour that the first one found.
    """
    stage = Stage(q.sparkSession)
    if leaves is not None:
        leaves = stage.save(leaves.select("path", "depth", "n_sample"), "leaves")
    own = stage.save(local_knn(q, t, k, dims=dims, n=n, leaves=leaves), "own-lists")
    overlaps = _overlaps(q, t, k, dims, n=n, leaves=leaves, lists=own)
    reach = local_radius(own, k).select(F.col("qid").alias("id"), F.col("r").alias("own_reach"))
    bounded = q.withColumn("id", F.col("id").cast("bigint")).join(reach, "id", "left")
    rest = probe_overlaps(
        bounded, t, overlaps, k, dims=dims, n=n, leaves=leaves, bound="own_reach"
    )
    return merge_topk(own, rest, k)


def completeness(q: DataFrame, overlaps: DataFrame) -> DataFrame:
    """For every query whether its own cell already settles its list: ``(qid, complete)``."""
    done = overlaps.filter("complete").select("qid", "complete")
    ids = q.select(F.col("id").cast("bigint").alias("qid"))
    return ids.join(done, "qid", "left").select(
        "qid", F.coalesce("complete", F.lit(False)).alias("complete")
    )
