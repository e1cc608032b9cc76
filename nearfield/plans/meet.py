"""Where queries and training points meet: tiles, visits and leaf members.

Queries are grouped into tiles of neighbouring query nodes, at most ``TILE_ROWS`` rows each (a radius join
sets its own limit); a
crowded node becomes several. Each training leaf is copied to the tiles that need it, so all
candidates of a query meet in its tile: queries are shuffled by tile once, and neither
their candidates nor the ranking move again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from nearfield.functions.geometry import (
    axes_of,
    box_max_dist,
    box_min_dist,
    distance,
    longest_side,
    point,
    x_distance,
)
from nearfield.plans.pyramid import POINT, ROOT, Pyramid, box_names, high, holds, key_names, low
from nearfield.plans.staging import (
    BROADCAST_ROWS,
    HEAVY_KEYS,
    Stage,
    level_mask,
    lookup,
    masked_levels,
    merged_if_big,
)

# Tiles per shuffle partition that a query table is cut into, however small.
TILES_PER_PARTITION = 8
# Query rows of a partition, above so many of which partitions are numbered: Spark would else put them
# together by what they hold before their rows meet, which is little of what comes out.
PARTITION_ROWS = 5_000
COUNTED_ROWS = 25_000
# Query rows that share one copy of their candidate leaves. Tiles are dealt by hash: with few of them to a
# partition, the fullest would hold several times its share.
TILE_ROWS = PARTITION_ROWS // TILES_PER_PARTITION
# Tiles served by one copy of a training leaf.
LEAF_TILES = 1_000
# Strips along x that a leaf is cut into at most, and rows in each for a search without k.
STRIPS = 64
STRIP_ROWS = 8


@dataclass(frozen=True)
class Candidates:
    """Staged cell-level tables: query nodes with their tile, and their candidate leaves."""

    nodes: DataFrame
    node_count: int
    node_levels: list[int]
    pairs: DataFrame
    tile_count: int
    pile_count: int
    leaf_count: int  # about


def tile_candidates(
    stage: Stage, pairs: DataFrame, queries: Pyramid, k: int | None, limit: int | None = None
) -> Candidates:
    """``limit`` are the query rows of a tile, ``tile_rows`` unless given."""
    dims = queries.dims
    q_keys, t_keys = key_names(dims, "q_"), key_names(dims, "t_")
    base = min(queries.levels)
    single = F.col("q_lvl") == POINT
    nodes, facts = stage.save_with(
        _tiled_nodes(pairs, queries, dims, limit or tile_rows(queries)),
        "query-nodes",
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(single).alias("points"),
        level_mask(F.when(~single, F.col("q_lvl")), base).alias("levels"),
    )
    levels = masked_levels(facts["levels"], base) + ([POINT] if facts["points"] else [])
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    marks = ["t_ids"] if "t_ids" in pairs.columns else []
    tiled = (
        pairs.drop("q_rows")
        .join(merged_if_big(nodes, facts["nodes"]), q_keys)
        .withColumn("salt", salts)
        .withColumn("tile", _tile())
        .select(
            *["tile", *q_keys, *t_keys, "t_n", "t_rows", "ub", *marks],
            *[f"t_{c}" for c in box_names(dims)],
        )
    )
    pairs, seen = stage.save_with(
        tiled,
        "candidates",
        F.approx_count_distinct("tile").alias("tiles"),
        F.count_if(_is_pile(dims, k)).alias("piles"),
        F.approx_count_distinct(F.xxhash64(*t_keys)).alias("leaves"),
    )
    return Candidates(
        nodes, facts["nodes"], levels, pairs, seen["tiles"], seen["piles"], seen["leaves"]
    )


def _is_pile(dims: int, k: int | None) -> Column:
    """Leaves of more than ``k`` rows on one position, of which ``k`` ids are enough."""
    if k is None:
        return F.lit(False)
    return (F.col("t_rows") > k) & (longest_side(low(dims, "t_"), high(dims, "t_")) <= 0)


def _tile() -> Column:
    return F.xxhash64("tile", "salt")


def tile_rows(queries: Pyramid) -> int:
    partitions = int(queries.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(TILE_ROWS, queries.rows // (TILES_PER_PARTITION * partitions)))


def by_tile(rows: DataFrame, queries: Pyramid) -> DataFrame:
    """``rows`` partitioned by tile, in as many partitions as the queries ask for."""
    if queries.rows <= COUNTED_ROWS:
        return rows.repartition("tile")
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-queries.rows // PARTITION_ROWS)), "tile")


def query_visits(
    stage: Stage, q: DataFrame, found: Candidates, queries: Pyramid, k: int | None
) -> DataFrame:
    """Each query with the leaves it has to visit: ``tile, qid, qx, qy[, qz], reach, t_*``.

    ``reach`` is the distance within which the nearer leaves hold ``k`` points, and no more
    than the node's bound or the query's own (``ub``). With ``k`` it is written once, a row for each query,
    so that every use of the visits only compares it with the candidates' boxes.
    """
    dims = queries.dims
    axes, q_keys, t_keys = axes_of(dims), key_names(dims, "q_"), key_names(dims, "t_")
    own = ["q_ub"] if "ub" in q.columns else []
    placed = _placed_queries(q, found, queries)
    placed = (
        placed.withColumn("salt", F.pmod(F.xxhash64("qid"), F.col("salts")).cast("int"))
        .withColumn("tile", _tile())
        .select("tile", "qid", *[f"q{a}" for a in axes], *q_keys, *own)
    )
    placed = by_tile(placed, queries)
    met = _candidates_of(placed, found, dims)
    if own:
        met = met.withColumn("ub", F.least("ub", "q_ub"))
    met = met.filter(F.col("gap") <= F.col("ub"))
    if k is None:
        met = met.withColumn("reach", F.col("ub"))
    else:
        qp, lo, hi = point("q", dims), low(dims, "t_"), high(dims, "t_")
        by_query = Window.partitionBy("tile", "qid")
        by_far = by_query.orderBy("far", *t_keys)
        running = by_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        met = met.withColumn("far", box_max_dist(qp, lo, hi)).withColumn("held", holds(met, k, running))
        bound = F.min(F.when(F.col("held"), F.col("far")))
        reach = met.groupBy("tile", "qid").agg(
            F.least(F.min("ub"), bound).alias("reach"),
            *[F.first(c).alias(c) for c in [*[f"q{a}" for a in axes], *q_keys]],
        )
        placed = by_tile(_whole(stage.save(reach, "reaches"), *reach.columns), queries)
        met = _candidates_of(placed, found, dims).filter(F.col("gap") <= F.col("reach"))
    strip = ["t_lo_x", "t_hi_x", "t_rows"]
    return met.select("tile", "qid", *[f"q{a}" for a in axes], "reach", "gap", *t_keys, *strip)


def _whole(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows``, whose ``columns`` are never null. Said here, every use of them is filtered alike, and those that
    shuffle them share one shuffle."""
    return rows.filter(reduce(and_, [F.col(c).isNotNull() for c in columns]))


def _candidates_of(placed: DataFrame, found: Candidates, dims: int) -> DataFrame:
    """Placed queries with the candidate leaves of their node, and the ``gap`` between the two.

    A broadcast of either side would leave the other where it lies: visits, which are many, are to come out by tile.
    """
    pairs = _whole(found.pairs, "tile", *key_names(dims, "q_"), *key_names(dims, "t_"))
    met = placed.join(pairs.hint("merge"), ["tile", *key_names(dims, "q_")])
    return met.withColumn("gap", box_min_dist(point("q", dims), low(dims, "t_"), high(dims, "t_")))


@dataclass
class PairCount:
    """How many pairs of query and point a join has compared, once it has run."""

    home: Observation = field(default_factory=Observation)
    rest: Observation = field(default_factory=Observation)
    swept: bool = False

    @property
    def pairs(self) -> int:
        return self.rest.get["pairs"] + (self.home.get["pairs"] if self.swept else 0)


def _strip(x: Column, prefix: str, strip_rows: int) -> Column:
    """The strip of a leaf that ``x`` falls in: never decreasing in ``x``, whatever is rounded."""
    lo, hi, rows = (F.col(f"{prefix}{c}") for c in ("lo_x", "hi_x", "rows"))
    count = F.least(F.lit(STRIPS), F.ceil(rows / strip_rows)).cast("double")
    at = F.when(hi > lo, F.floor((x - lo) * (count / (hi - lo)))).otherwise(F.lit(0))
    return F.greatest(F.lit(0.0), F.least(at.cast("double"), count - 1)).cast("int")


def _sweep(visits: DataFrame, strip_rows: int) -> DataFrame:
    """A visit for every strip that the query's x-band touches."""
    # Wider than the rounding of a difference of coordinates.
    pad = F.col("reach") * (1.0 + 1e-12) + F.abs("qx") * 1e-15
    first, last = (_strip(x, "t_", strip_rows) for x in (F.col("qx") - pad, F.col("qx") + pad))
    return visits.withColumn("strip", F.explode(F.sequence(first, last)))


def _shortened(
    visits: DataFrame,
    members: DataFrame,
    dims: int,
    k: int,
    strip_rows: int,
    unique: bool,
    count: PairCount | None,
) -> DataFrame:
    """Visits with the reach cut to the k-th neighbour found around home.

    Home is the query's strip, and the ones beside it, of the leaf whose box is nearest (each of them, if
    several are). Queries with fewer than ``k`` points at home keep their reach.
    """
    qp, tp = point("q", dims), point("t", dims)
    own = _strip(F.col("qx"), "t_", strip_rows)
    beside = F.sequence(own - 1, own + 1)
    least = F.min("gap").over(Window.partitionBy("tile", "qid"))
    home = visits.withColumn("least", least).filter(F.col("gap") <= F.col("least")).drop("least")
    home = home.withColumn("strip", F.explode(beside))
    near = home.join(members, ["tile", *key_names(dims, "t_"), "strip"])
    if count is not None:
        near = near.observe(count.home, F.count(F.lit(1)).alias("pairs"))
    near = near.select("tile", "qid", "tid", distance(qp, tp).alias("dist"))
    if not unique:
        near = near.groupBy("tile", "qid", "tid").agg(F.min("dist").alias("dist"))
    # With the id, members have the same columns here as in the join that follows, and one shuffle serves both.
    nearest = Window.partitionBy("tile", "qid").orderBy("dist", "tid")
    found = near.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k)
    found = found.filter(F.col("nth") == k).select("tile", "qid", F.col("dist").alias("found"))
    known = visits.join(found, ["tile", "qid"], "left")
    known = known.withColumn("reach", F.least("reach", "found")).drop("found")
    return known.filter(F.col("gap") <= F.col("reach"))


def meet_points(
    stage: Stage,
    visits: DataFrame,
    t,
    found: Candidates,
    queries: Pyramid,
    training: Pyramid,
    k: int | None,
    method: str,
    *,
    exclude_self: bool,
    unique: bool,
    count: PairCount | None = None,
    strip_rows: int = STRIP_ROWS,
) -> DataFrame:
    """Pairs ``(tile, qid, tid, dist)`` within each query's reach.

    With ``method="ps"`` a leaf is cut into strips along x. A query first meets the strips around it, whose
    k-th distance shortens its reach, and then only the leaves within that reach and of them the strips
    that its band ``[x - reach, x + reach]`` touches. All of it happens inside the tile. ``strip_rows`` are the rows
    of a strip for a search without ``k``.
    """
    dims = training.dims
    qp, tp = point("q", dims), point("t", dims)
    strip_rows = max(4, k) if k is not None else strip_rows
    sweep = method == "ps"
    wants = found.pairs if k is None else visits
    members = _members(stage, t, found, wants, training, k, unique, strip_rows if sweep else None)
    members = by_tile(_whole(members, "tid", *[f"t{a}" for a in axes_of(dims)]), queries)
    keys = ["tile", *key_names(dims, "t_")]
    near = distance(qp, tp) <= F.col("reach")
    if sweep:
        if k is not None:
            visits = _shortened(visits, members, dims, k, strip_rows, unique, count)
        visits, keys = _sweep(visits, strip_rows), [*keys, "strip"]
        near = (x_distance(qp, tp) <= F.col("reach")) & near
    if exclude_self:
        near = near & (F.col("qid") != F.col("tid"))
    met = visits.join(members, keys)
    if count is not None:
        count.swept = sweep and k is not None
        met = met.observe(count.rest, F.count(F.lit(1)).alias("pairs"))
    met = met.filter(near)
    return met.select("tile", "qid", "tid", distance(qp, tp).alias("dist"))


def _tiled_nodes(pairs: DataFrame, queries: Pyramid, dims: int, limit: int) -> DataFrame:
    """Query nodes with the coarse query cell that is their ``tile`` and its ``salts``.

    The tile of a node is the widest cell around it with at most ``limit`` rows. A node
    with more rows is a tile of its own, cut into parts.
    """
    keys, q_keys = key_names(dims), key_names(dims, "q_")
    corners = [f"q_lo_{a}" for a in axes_of(dims)]
    nodes = pairs.select(*q_keys, "q_rows", *corners).dropDuplicates(q_keys)

    def tiled(rows: DataFrame, tile_keys: list[str], size: str) -> DataFrame:
        parts = F.greatest(F.lit(1), F.ceil(F.col(size) / limit)).cast("int")
        return rows.select(
            *q_keys,
            "q_rows",
            *corners,
            F.xxhash64(*tile_keys).alias("tile"),
            parts.alias("salts"),
        )

    big = tiled(nodes.filter(F.col("q_rows") > limit), q_keys, "q_rows")
    fits = (F.col("rows") <= limit) | F.col("leaf")
    tiles = queries.nodes.filter(
        fits & ((F.col("plvl") == ROOT) | (F.col("parent_rows") > limit))
    )
    facts = tiles.agg(F.collect_set("lvl").alias("levels"), F.count(F.lit(1)).alias("n")).first()
    # The low corner of a node's box lies in all cells around the node.
    small = nodes.filter(F.col("q_rows") <= limit).withColumns(
        {a: F.col(f"q_lo_{a}") for a in axes_of(dims)}
    )
    spread = queries.place(small, tiles.select(*keys, *box_names(dims)), facts.levels, facts.n)
    found = lookup(spread, tiles.select(*keys, "rows"), keys, "rows", queries.rows, facts.n)
    return big.unionByName(tiled(found, keys, "rows"))


def _placed_queries(q: DataFrame, found: Candidates, queries: Pyramid) -> DataFrame:
    """Queries ``(qid, qx, qy[, qz])`` with the key ``q_*`` of their node and its tile."""
    dims = queries.dims
    axes, keys, q_keys = axes_of(dims), key_names(dims), key_names(dims, "q_")
    cells = found.nodes.withColumnsRenamed(
        {f"q_{c}": c for c in [*keys, *[f"lo_{a}" for a in axes]]}
    )
    spread = queries.place(q, cells, found.node_levels, found.node_count)
    single = F.col("lvl") == POINT
    own = [F.col("id"), *[F.lit(0).cast("bigint") for _ in axes[1:]]]
    spread = spread.select(
        F.col("id").alias("qid"),
        *[F.col(a).alias(f"q{a}") for a in axes],
        F.col("lvl").alias("q_lvl"),
        *[
            F.when(single, own[i]).otherwise(F.col(f"c{a}")).alias(f"q_c{a}")
            for i, a in enumerate(axes)
        ],
        *([F.col("ub").alias("q_ub")] if "ub" in q.columns else []),
    )
    nodes = found.nodes.select(*q_keys, "q_rows", "tile", "salts")
    return lookup(spread, nodes, q_keys, "q_rows", queries.rows, found.node_count)


def _members(
    stage: Stage,
    t,
    found: Candidates,
    wants: DataFrame,
    training: Pyramid,
    k: int | None,
    unique: bool,
    strip_rows: int | None = None,
) -> DataFrame:
    """Training points of the leaves that tiles want, one copy per tile. ``t`` are points or a ``PointIndex``.

    ``wants`` has the leaves by tile: the candidates or, of these, what the tile's queries visit.

    With ``strip_rows`` they have the number of their ``strip``.

    Where the candidates are few of all leaves, points of other leaves are dropped before anything
    is shuffled: by the leaves themselves if these are few enough to broadcast, else by the coarse cells
    around them.

    A leaf is crowded if it is a pile or if very many tiles want it. Crowded leaves are
    joined apart: a pile keeps the ids that can win, a wanted leaf is split over its tiles.
    """
    dims = training.dims
    axes, keys, t_keys = axes_of(dims), key_names(dims), key_names(dims, "t_")
    strip = ["lo_x", "hi_x", "rows"] if strip_rows else []
    needs = wants.select("tile", *t_keys, *[f"t_{c}" for c in strip]).distinct()
    crowded = 0
    if found.pile_count or found.tile_count > LEAF_TILES:
        leaves, facts = _wanted_leaves(stage, found, training, k)
        levels, size, crowded = facts["levels"], facts["leaves"], facts["crowded"]
        levels = masked_levels(levels, min(training.levels))
    else:
        leaves, levels, size = training.leaves, training.leaf_levels, training.leaf_count
    indexed = hasattr(t, "points_of")
    few = found.leaf_count * 2 <= training.leaf_count
    if indexed or few:
        corners = [*keys, *[f"lo_{a}" for a in axes]]
        wanted = found.pairs.select(*[F.col(f"t_{c}").alias(c) for c in corners]).dropDuplicates(keys)
        # The count is an estimate with a standard error of 5 %.
        most = int(found.leaf_count * 1.3) + 1
        spread = t.points_of(wanted) if indexed else training.place(t, wanted, levels, most)
        if few and most <= BROADCAST_ROWS:
            spread = spread.join(F.broadcast(wanted.select(*keys)), keys, "left_semi")
    else:
        spread = training.place(t, leaves, levels, size)
    needs = needs.select("tile", *[F.col(f"t_{c}").alias(c) for c in [*keys, *strip]])
    plain = needs
    if crowded:
        special = leaves.filter("crowded").select(*keys, "rows", "pile", "parts")
        plain = needs.join(merged_if_big(special, crowded), keys, "left_anti")
    ordinary = spread
    if crowded:
        # Rows of a heavy pile must not travel to a join that drops them.
        heavy = special.filter(F.col("rows") >= training.rows / HEAVY_KEYS).select(*keys)
        ordinary = spread.join(F.broadcast(heavy), keys, "left_anti")
    members = ordinary.join(merged_if_big(plain, training.rows), keys).select("tile", *keys, "id", *axes, *strip)
    if crowded:
        split = lookup(spread, special, keys, "rows", training.rows, crowded)
        if k:
            thin = split.filter("pile")
            if not unique:
                thin = thin.dropDuplicates([*keys, "id"])
            first = Window.partitionBy(*keys).orderBy("id")
            thin = thin.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k)
            split = split.filter("not pile").unionByName(thin.drop("nth"))
        split = split.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        apart = needs.join(merged_if_big(special.select(*keys, "parts"), crowded), keys).select(
            "tile",
            *keys,
            *strip,
            F.pmod(F.xxhash64("tile"), F.col("parts")).cast("int").alias("part"),
        )
        split = split.select(*keys, "id", *axes, "part")
        split = split.join(merged_if_big(apart, training.rows), [*keys, "part"])
        members = members.unionByName(split.select("tile", *keys, "id", *axes, *strip))
    if strip_rows:
        members = members.withColumn("strip", _strip(F.col("x"), "", strip_rows))
    return members.select(
        "tile",
        *[F.col(c).alias(t) for c, t in zip(keys, t_keys, strict=True)],
        F.col("id").alias("tid"),
        *[F.col(a).alias(f"t{a}") for a in axes],
        *(["strip"] if strip_rows else []),
    )


def _wanted_leaves(
    stage: Stage, found: Candidates, training: Pyramid, k: int | None
) -> tuple[DataFrame, dict]:
    """Candidate leaves with the number of tiles that want them."""
    dims = training.dims
    keys, t_keys = key_names(dims), key_names(dims, "t_")
    boxes = [f"t_{c}" for c in box_names(dims)]
    wanted = (
        found.pairs.select("tile", *t_keys, "t_rows", *boxes)
        .distinct()
        .groupBy(*t_keys, "t_rows", *boxes)
        .agg(F.count(F.lit(1)).alias("tiles"))
        .withColumn("pile", _is_pile(dims, k))
        .withColumn("crowded", F.col("pile") | (F.col("tiles") > LEAF_TILES))
        .withColumn("parts", F.ceil(F.col("tiles") / LEAF_TILES).cast("int"))
    )
    return stage.save_with(
        wanted.withColumnsRenamed({f"t_{c}": c for c in [*keys, *box_names(dims), "rows"]}),
        "wanted-leaves",
        level_mask(F.col("lvl"), min(training.levels)).alias("levels"),
        F.count(F.lit(1)).alias("leaves"),
        F.count_if("crowded").alias("crowded"),
    )
