"""All-k-nearest-neighbour join.

Cells decide first, points last: a count pyramid of each side and the pruning descent work
on cells only, then every query point meets the points of its few candidate leaves through
equi-joins on the leaf key, and a per-query window keeps the ``k`` best. Leaves are bounded
by ``capacity``, so no cell, however crowded, is joined all against all.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.geometry import axes_of, distance, point
from nearfield.functions.grid import check_n
from nearfield.operators.cells import assign_tree
from nearfield.operators.neighbors import check_k, empty_neighbors, topk
from nearfield.plans.descent import candidate_leaves
from nearfield.plans.index import PointIndex
from nearfield.plans.meet import PairCount, meet_points, query_visits, tile_candidates
from nearfield.plans.pyramid import build_pyramid, density_level, extent_of, id_mark, top_level
from nearfield.plans.seek import from_the_top, meet_leaves, seek_leaves
from nearfield.plans.staging import Stage
from nearfield.sources.points import infer_dims

# Share of a leaf's capacity to aim at; what a cell's parent holds must exceed the capacity.
LEAF_FILL = 0.3
# Query rows per query leaf.
QUERY_CAPACITY = 128
# Up to so many queries walk the cells one by one, which takes fewer jobs than cells of their own.
SMALL_QUERIES = 2_000
# Training points that all places of a repeated query id meet: no more than any leaf may hold.
FEW_POINTS = 64
# Places of a repeated query id, and the share of all, from which on they are not brought together.
MANY_PLACES = 100_000
PLACES_SHARE = 1_000
# Parts of a repeated id that its places share.
SHARES = 1 << 20
METHODS = ("bf", "ps")
PARTITIONINGS = ("gd", "qt")


def aknn_join(
    q: DataFrame,
    t: DataFrame | PointIndex,
    k: int,
    *,
    dims: int | None = None,
    partitioning: str = "gd",
    method: str = "bf",
    n: int | None = None,
    leaves: DataFrame | None = None,
    exclude_self: bool = False,
    unique_ids: bool | None = None,
    unique_query_ids: bool | None = None,
    capacity: int | None = None,
    bound: str | None = None,
    count: PairCount | None = None,
) -> DataFrame:
    """The ``k`` points of ``t`` nearest to every point of ``q``: ``(qid, rank, tid, dist)``.

    ``q`` and ``t`` are ``(id, x, y[, z])``; with a z on both sides, that is not null throughout,
    the join is in 3D. Null or non-finite values are an error. Equal distances go to the smaller ``tid``; fewer
    than ``k`` training ids give as many rows as there are. A training id that occurs more
    than once counts once, at its nearest place; pass ``unique_ids=True`` to skip the check
    for that when ids are known to be unique. A query id at several places gets one list, of the
    points nearest to any of them (``unique_query_ids=True`` skips that check); ``exclude_self`` then
    leaves its own id out at all of them.

    ``t`` may be a ``PointIndex``, which has its own cells; otherwise ``partitioning`` sets the cells
    training points are counted in: a grid of ``n`` per axis
    (by density when ``n`` is not given) or the tree ``leaves`` of ``build_leaves``.
    ``method`` sets how a query meets a leaf: all its points (``bf``) or those of the strips
    along x that its band touches (``ps``).
    The result does not depend on any of these. ``bound`` names a column of ``q`` with the distance beyond
    which a query wants no neighbours; null is no bound. If ``q`` and ``t`` are the same DataFrame with unique
    ids, its cells are counted once for both sides. ``count`` tells, once the join has run, how
    many pairs were compared. The cell-level steps run at once and leave small
    tables in ``spark.checkpoint.dir``; the join itself runs with the returned DataFrame.
    """
    k = check_k(k)
    index = t if isinstance(t, PointIndex) else None
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if partitioning not in PARTITIONINGS:
        raise ValueError(f"partitioning must be one of {PARTITIONINGS}, not {partitioning!r}")
    if index is not None and (partitioning == "qt" or n or leaves is not None or capacity):
        raise ValueError("an index has its own cells")
    if partitioning == "qt" and leaves is None:
        raise ValueError("partitioning 'qt' needs leaves")
    alone = q is t and bound is None
    if index is not None:
        dims = settle_dims(q, index, dims)
        unique_ids = index.unique
    else:
        dims = settle_dims(q, t, dims)
        t = plain_points(t, dims, "t")
    q = plain_points(q, dims, "q", bound)
    # Both sides' cells are prepared by jobs of their own, side by side, in this thread's job group.
    own = inheritable_thread_target(q.sparkSession)
    with ThreadPoolExecutor(4) as jobs:
        submit = lambda f, *args, **named: jobs.submit(own(f), *args, **named)
        q_job = submit(extent_of, q, dims, "q")
        repeats = None if unique_query_ids or alone else submit(has_repeated_ids, q)
        if index is None:
            t_job = q_job if alone else submit(extent_of, t, dims, "t")
            weighed, unique = submit(weigh, t, dims, unique_ids).result()
            t_extent = t_job.result()
        else:
            unique, t_extent = index.unique, index.extent
        q_extent = q_job.result()
        repeated_queries = not unique if alone else repeats is not None and repeats.result()
    if not q_extent.rows or not t_extent.rows:
        return empty_neighbors(q.sparkSession)

    stage = Stage(q.sparkSession)
    if repeated_queries and index is None and t_extent.rows <= FEW_POINTS:
        return _lists_of_places(stage, q, t, k, dims, q_extent.rows, exclude_self, count)
    if repeated_queries:
        # Each place is a query of its own; an id's lists are then merged.
        places = q.distinct().withColumn("place", F.monotonically_increasing_id())
        places = stage.save(places, "query-places")
        near = aknn_join(
            places.drop("id").withColumnRenamed("place", "id"),
            t,
            k + 1 if exclude_self else k,
            dims=dims,
            partitioning=partitioning,
            method=method,
            n=n,
            leaves=leaves,
            unique_ids=unique,
            unique_query_ids=True,
            capacity=capacity,
            bound="ub" if bound else None,
            count=count,
        )
        near = near.withColumnRenamed("qid", "place").join(places.select("place", "id"), "place")
        near = near.select(F.col("id").alias("qid"), "tid", "dist")
        if exclude_self:
            near = near.filter(F.col("qid") != F.col("tid"))
        return topk(near, k, distinct=True)
    wanted = k + 1 if exclude_self else k
    capacity = capacity or max(64, 4 * wanted)
    level, level_column, width = 0, None, 1.0
    if index is not None:
        width, top = index.pyramid.width, index.top
    else:
        if partitioning == "qt":
            # Points outside the tree's unit box are counted like those of the root.
            leaves = stage.save(leaves.select("path", "depth", "n_sample"), "leaves")
            weighed = with_leaf_level(weighed, leaves, dims)
            level_column = "leaf_level"
        elif n:
            width = 1.0 / check_n(n)
        elif t_extent.side > 0:
            # Evenly spread points fill cells of this width to LEAF_FILL of the capacity.
            cells = max(1.0, t_extent.rows / (LEAF_FILL * capacity))
            width = t_extent.side / cells ** (1.0 / dims)
        top = top_level(q_extent.union(t_extent), dims, width)

    few = q_extent.rows <= SMALL_QUERIES
    with ThreadPoolExecutor(2) as jobs:
        submit = lambda f, *args, **named: jobs.submit(own(f), *args, **named)
        if index is None:
            training = submit(
                build_pyramid,
                stage,
                "training",
                weighed,
                dims,
                capacity,
                width=width,
                top=top,
                extent=t_extent,
                level=level,
                level_column=level_column,
            )
        if not few and not alone:
            # An index has tops by its own extent, so these queries get tops by theirs.
            q_top = top if index is None else top_level(q_extent, dims, width)
            queries = submit(
                build_pyramid,
                stage,
                "queries",
                plain_weight(q),
                dims,
                QUERY_CAPACITY,
                width=width,
                top=q_top,
                extent=q_extent,
                level=density_level(q_extent, dims, width, QUERY_CAPACITY),
            )
        training = index.pyramid if index is not None else training.result()
        if few:
            visits = seek_leaves(stage, from_the_top(q, training), training, wanted)
            met = meet_leaves(
                stage,
                visits,
                t,
                training,
                wanted,
                exclude_self=exclude_self,
                unique=unique,
                count=count,
            )
            return topk(met, k, distinct=not unique)
        queries = training if alone else queries.result()
    pairs = candidate_leaves(stage, queries, q, training, wanted, repeated=not unique)
    found = tile_candidates(stage, pairs, queries, wanted)
    visits = query_visits(stage, q, found, queries, wanted)
    met = meet_points(
        stage,
        visits,
        t,
        found,
        queries,
        training,
        wanted,
        method,
        exclude_self=exclude_self,
        unique=unique,
        count=count,
    )
    return topk(met, k, distinct=not unique, within="tile")


def _lists_of_places(
    stage: Stage,
    q: DataFrame,
    t: DataFrame,
    k: int,
    dims: int,
    rows: int,
    exclude_self: bool,
    count: PairCount | None,
) -> DataFrame:
    """One list for every id of ``q``, each of whose places meets all of the few points of ``t``.

    The places of an id are brought together, so nothing but ``q`` is shuffled, once. Ids at very many
    places stay where they are, and what each task found for them is merged.
    """
    limit = max(MANY_PLACES, rows // PLACES_SHARE)
    often = q.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit)
    often, facts = stage.save_with(often.select("id"), "often", F.count(F.lit(1)).alias("ids"))
    few = q
    if facts["ids"]:
        few = q.join(F.broadcast(often), "id", "left_anti")
    sides = [few.repartition("id")]
    if facts["ids"]:
        sides.append(q.join(F.broadcast(often), "id", "left_semi"))
    axes = axes_of(dims)
    points = F.broadcast(t.select(F.col("id").alias("tid"), *[F.col(a).alias(f"t{a}") for a in axes]))
    dist = distance(point("q", dims), point("t", dims))
    lists = []
    for i, side in enumerate(sides):
        met = side.withColumnsRenamed({"id": "qid", **{a: f"q{a}" for a in axes}}).crossJoin(points)
        if count is not None:
            count.swept = len(sides) > 1
            met = met.observe(count.home if i else count.rest, F.count(F.lit(1)).alias("pairs"))
        if "ub" in q.columns:
            met = met.filter(dist <= F.col("ub"))
        if exclude_self:
            met = met.filter(F.col("qid") != F.col("tid"))
        lists.append(topk(met.select("qid", "tid", dist.alias("dist")), k, distinct=True))
    return lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])


def check_same_axes(q: DataFrame, t: DataFrame | PointIndex) -> None:
    if ("z" in q.columns) != ("z" in t.columns):
        raise ValueError("one side has a z column and the other has not")


def settle_dims(q: DataFrame, t: DataFrame | PointIndex, dims: int | None) -> int:
    """The number of axes: as asked for, or 3 if both sides have a z that is not null throughout."""
    check_same_axes(q, t)
    if isinstance(t, PointIndex):
        if dims not in (None, t.dims):
            raise ValueError(f"the index has {t.dims} dimensions, not {dims!r}")
        return t.dims
    if dims is None:
        if "z" not in q.columns:
            return 2
        both = {infer_dims(q), infer_dims(t)}
        if len(both) > 1:
            raise ValueError("one side has z values and the other has none")
        return both.pop()
    if len(axes_of(dims)) == 2 and "z" in q.columns:
        raise ValueError("dims=2 would drop the z column; select the columns to join on")
    return dims


def has_repeated_ids(points: DataFrame) -> bool:
    twice = points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return not twice.isEmpty()


def refuse_repeated_ids(q: DataFrame) -> None:
    """Lists by cell are lists of one place, so an id must have one."""
    twice = q.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").count()
    if twice:
        raise ValueError(f"q: {twice} ids occur more than once")


def plain_points(df: DataFrame, dims: int, side: str, bound: str | None = None) -> DataFrame:
    """Points with their id and coordinates only and, if asked for, a bound ``ub``; null is none."""
    axes = axes_of(dims)
    missing = {"id", *axes, *([bound] if bound else [])} - set(df.columns)
    if missing:
        raise ValueError(f"{side} has no column {sorted(missing)}; dims={dims}")
    columns = [F.col(a).cast("double").alias(a) for a in axes]
    if bound:
        endless = F.lit(float("inf"))
        known = F.col(f"`{bound}`").cast("double")
        columns.append(F.nanvl(F.coalesce(known, endless), endless).alias("ub"))
    return df.select(F.col("id").cast("bigint").alias("id"), *columns)


def plain_weight(points: DataFrame) -> DataFrame:
    one = F.lit(1).cast("bigint")
    return points.withColumns({"rows": one, "n": one})


def weigh(t: DataFrame, dims: int, unique_ids: bool | None) -> tuple[DataFrame, bool]:
    """Weights for the pyramid: every row counts for splitting, every id once for bounds.

    An id that repeats counts in equal shares at all its places, so what cells hold is never more than the
    ids in them, wherever the places lie. Shares are multiples of ``1 / SHARES``, which doubles add up exactly;
    the remainder goes to the first place. ``ids`` tells ids apart.
    """
    if unique_ids is None:
        unique_ids = not has_repeated_ids(t)
    if unique_ids:
        return plain_weight(t), True
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    share = F.floor(F.lit(SHARES) / F.col("places"))
    ids = _first_places(t, dims)
    places = t.join(ids.select("id", "places"), "id")
    places = places.select(*t.columns, one.alias("rows"), (share / SHARES).alias("n"))
    left = (F.lit(SHARES) - share * F.col("places")) / SHARES
    ids = ids.select(*t.columns, zero.alias("rows"), left.alias("n")).filter("n > 0")
    weighed = places.unionByName(ids).withColumn("ids", id_mark())
    return Stage(t.sparkSession).save(weighed, "weighed"), False


def weigh_first_places(t: DataFrame, dims: int) -> tuple[DataFrame, bool]:
    """The same, but an id that repeats counts in the cell of its smallest place only."""
    if not has_repeated_ids(t):
        return plain_weight(t), True
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ids = _first_places(t, dims).drop("places")
    places = t.withColumns({"rows": one, "n": zero})
    return places.unionByName(ids.withColumns({"rows": zero, "n": one})), False


def _first_places(t: DataFrame, dims: int) -> DataFrame:
    """Every id at its smallest place, with the number of its ``places``; what else a row says goes by the place."""
    axes = axes_of(dims)
    rest = [c for c in t.columns if c != "id" and c not in axes]
    ids = t.groupBy("id").agg(F.min(F.struct(*axes, *rest)).alias("p"), F.count(F.lit(1)).alias("places"))
    return ids.select("id", *[F.col(f"p.{c}").alias(c) for c in (*axes, *rest)], "places")


def with_leaf_level(points: DataFrame, leaves: DataFrame, dims: int) -> DataFrame:
    placed = assign_tree(points, leaves, dims, how="left")
    return placed.withColumn("leaf_level", F.coalesce(F.length("cell"), F.lit(0))).drop("cell")


