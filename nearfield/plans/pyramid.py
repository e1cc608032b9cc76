"""Count pyramid: nested cells with exact counts and tight bounds, split where data is dense.

A cell at level ``l`` has side ``width / 2^l``; its coordinates are ``floor(x / width * 2^l)``.
Scaling by a power of two is exact, so cells of different levels nest without gaps whatever
``width`` is. A cell with more than ``capacity`` rows is split into its children, up to 4 in
2D and 8 in 3D; all others are leaves, as is a cell whose rows share one position (a pile). Levels at which
the rows of a cell would all stay together are skipped.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from nearfield.functions.geometry import axes_of, longest_side
from nearfield.plans.staging import (
    BROADCAST_ROWS,
    HEAVY_KEYS,
    Stage,
    level_mask,
    lookup,
    masked_levels,
)

ROOT = -1000
POINT = 1000
# Levels below the top that a cell may be split to. Each halves the cells, so this covers extents of
# 4e18 times the smallest leaf; a double's own 53 bits end sooner, unless points lie around zero.
LEVEL_RANGE = 62
# Bits that tell repeated ids apart.
MARKS = 64


def key_names(dims: int, prefix: str = "") -> list[str]:
    return [f"{prefix}lvl"] + [f"{prefix}c{a}" for a in axes_of(dims)]


def low(dims: int, prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}lo_{a}") for a in axes_of(dims)]


def high(dims: int, prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}hi_{a}") for a in axes_of(dims)]


def box_names(dims: int, prefix: str = "") -> list[str]:
    return [f"{prefix}{side}_{a}" for a in axes_of(dims) for side in ("lo", "hi")]


def cell_coord(coord: Column, width: float, level: Column) -> Column:
    return F.floor(coord / F.lit(width) * F.pow(F.lit(2.0), level)).cast("bigint")


def with_cell(points: DataFrame, dims: int, width: float, level: Column) -> DataFrame:
    """Add the key of the cell at ``level`` that holds the point."""
    keyed = points.withColumn("lvl", level.cast("int"))
    return keyed.withColumns(
        {f"c{a}": cell_coord(F.col(a), width, F.col("lvl")) for a in axes_of(dims)}
    )


def at_levels(points: DataFrame, dims: int, width: float, levels: Sequence[int]) -> DataFrame:
    """One row per point and level, with that cell's key."""
    if len(levels) == 1:
        return with_cell(points, dims, width, F.lit(levels[0]))
    spread = points.withColumn("lvl", F.explode(F.array(*[F.lit(v) for v in sorted(levels)])))
    return with_cell(spread, dims, width, F.col("lvl"))


@dataclass(frozen=True)
class Extent:
    """Row count and bounding box of a point table."""

    rows: int
    lo: tuple[float, ...]
    hi: tuple[float, ...]

    @property
    def side(self) -> float:
        return max((h - l for l, h in zip(self.lo, self.hi, strict=True)), default=0.0)

    def union(self, other: Extent) -> Extent:
        return Extent(
            self.rows + other.rows,
            tuple(map(min, self.lo, other.lo)),
            tuple(map(max, self.hi, other.hi)),
        )


def extent_of(points: DataFrame, dims: int, side: str = "points") -> Extent:
    """One aggregate row, read on the driver. Rows that no join can place are an error."""
    axes = axes_of(dims)
    unplaced = F.col("id").isNull()
    endless = F.lit(False)
    for a in axes:
        unplaced = unplaced | F.col(a).isNull()
        endless = endless | F.isnan(a) | (F.abs(a) == F.lit(math.inf))
    row = points.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(unplaced).alias("missing"),
        F.count_if(endless).alias("endless"),
        *[F.min(a).alias(f"lo_{a}") for a in axes],
        *[F.max(a).alias(f"hi_{a}") for a in axes],
    ).first()
    if row.missing or row.endless:
        raise ValueError(
            f"{side}: {row.missing} of {row.rows} rows have a null id or coordinate and"
            f" {row.endless} one that is not finite; validate_points splits them off"
        )
    if not row.rows:
        return Extent(0, (), ())
    return Extent(
        row.rows,
        tuple(row[f"lo_{a}"] for a in axes),
        tuple(row[f"hi_{a}"] for a in axes),
    )


@dataclass(frozen=True)
class Pyramid:
    nodes: DataFrame
    dims: int
    width: float
    rows: int
    levels: tuple[int, ...]
    leaf_count: int
    leaf_levels: tuple[int, ...]

    @property
    def leaves(self) -> DataFrame:
        return self.nodes.filter("leaf")

    def place(
        self, points: DataFrame, cells: DataFrame, levels: Sequence[int], size: int
    ) -> DataFrame:
        """Rows of ``points`` with the keys of the cells among ``cells`` that may hold them.

        ``cells`` (key, ``lo_*``) are ``size`` disjoint cells at ``levels``, at or below this
        pyramid's leaves or inner nodes; level ``POINT`` stands for a single point's own key.
        A big table is first reduced to a directory: coarse cells, few enough to broadcast,
        with the levels that occur inside, so that a point is not spread over all levels.
        """
        if size <= BROADCAST_ROWS or len(levels) < 3:
            return at_levels(points, self.dims, self.width, levels)
        axes, keys = axes_of(self.dims), key_names(self.dims)
        coarse = self._directory_level()
        corners = cells.select(
            F.col("lvl").alias("inner"), *[F.col(f"lo_{a}").alias(a) for a in axes]
        )
        entry = F.least(F.col("inner"), F.lit(coarse))
        directory = (
            with_cell(corners, self.dims, self.width, entry)
            .groupBy(*keys)
            .agg(F.collect_set("inner").alias("inner"))
        )
        outer = sorted({min(v, coarse) for v in levels})
        found = at_levels(points, self.dims, self.width, outer).join(F.broadcast(directory), keys)
        found = found.drop(*keys).withColumn("inner", F.explode("inner"))
        return with_cell(found, self.dims, self.width, F.col("inner")).drop("inner")

    def _directory_level(self) -> int:
        """Deepest level above which the pyramid has few nodes."""
        seen = 0
        for row in self.nodes.groupBy("lvl").count().orderBy("lvl").collect():
            seen += row["count"]
            if seen > HEAVY_KEYS:
                return row["lvl"] - 1
        return max(self.levels)

    def assign(self, points: DataFrame) -> DataFrame:
        """Add the key of the leaf that holds each point."""
        keys = key_names(self.dims)
        spread = self.place(points, self.leaves, self.leaf_levels, self.leaf_count)
        leaves = self.leaves.select(*keys, "rows")
        return lookup(spread, leaves, keys, "rows", self.rows, self.leaf_count).drop("rows")


def top_level(extent: Extent, dims: int, width: float) -> int:
    """Level at which the extent spans a few cells per axis."""
    if extent.side <= 0.0:
        return 0
    cells = 16.0 if dims == 2 else 5.0
    return math.floor(math.log2(cells * width / extent.side))


def density_level(extent: Extent, dims: int, width: float, capacity: int) -> int:
    """Level at which evenly spread rows would fill cells to about half the capacity."""
    if extent.side <= 0.0:
        return 0
    per_axis = max(1.0, (2.0 * extent.rows / capacity) ** (1.0 / dims))
    return round(math.log2(per_axis * width / extent.side))


def _measures(dims: int, own: Sequence[str]) -> list[Column]:
    return [
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.min("id_lo").alias("id_lo"),
        F.max("id_hi").alias("id_hi"),
        *[(F.max if c == "ub" else F.bit_or)(c).alias(c) for c in own],
    ] + [
        agg(f"{side}_{a}").alias(f"{side}_{a}")
        for a in axes_of(dims)
        for side, agg in (("lo", F.min), ("hi", F.max))
    ]


def _own_columns(points: DataFrame) -> list[str]:
    return [c for c in ("ub", "ids") if c in points.columns]


def id_mark() -> Column:
    """One of ``MARKS`` bits for an id: as many bits as rows set between them, so many ids they have at least."""
    return F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64("id"), F.lit(MARKS)).cast("int")
    )


def holds(nodes: DataFrame, k: int, running: WindowSpec) -> Column:
    """Whether the training nodes (``t_*``) of a window are known to hold ``k`` ids between them."""
    known = F.sum("t_n").over(running) >= k
    if "t_ids" in nodes.columns and k <= MARKS:
        known = known | (F.bit_count(F.bit_or("t_ids").over(running)) >= k)
    return known


def _histogram(keyed: DataFrame, dims: int) -> DataFrame:
    """Counts and bounds per cell; ``stop`` is the level to roll up to, ``base`` its parent's."""
    own = _own_columns(keyed)
    boxes = {f"{side}_{a}": F.col(a) for a in axes_of(dims) for side in ("lo", "hi")}
    boxes |= {"id_lo": F.col("id"), "id_hi": F.col("id")}
    return (
        keyed.withColumns(boxes)
        .groupBy(*key_names(dims), "stop", "base")
        .agg(*_measures(dims, own))
    )


def _roll_up(
    hist: DataFrame, dims: int, capacity: int | None, last: int, rooted: bool
) -> DataFrame:
    """Ancestors of the histogram's cells up to ``stop``, kept where the parent is split."""
    axes, keys = axes_of(dims), key_names(dims)
    own = _own_columns(hist)
    spread = hist.withColumn("up", F.explode(F.sequence("stop", "lvl")))
    at_stop = F.col("stop") == F.col("up")
    moved = spread.select(
        F.col("up").alias("lvl"),
        *[F.expr(f"shiftright(c{a}, lvl - up)").alias(f"c{a}") for a in axes],
        "rows",
        "n",
        "id_lo",
        "id_hi",
        *own,
        *box_names(dims),
        (F.col("lvl") == F.col("up")).alias("deepest"),
        F.when(at_stop, F.col("base")).otherwise(F.col("up") - 1).alias("plvl"),
    )
    flags = [F.max(c).alias(c) for c in ("deepest", "plvl")]
    cells = moved.groupBy(*keys).agg(*_measures(dims, own), *flags)
    is_top = F.col("plvl") == ROOT
    for a in axes:
        root = F.lit(0).cast("bigint") if rooted else F.col(f"c{a}")
        up = F.expr(f"shiftright(c{a}, lvl - plvl)")
        cells = cells.withColumn(f"pc{a}", F.when(is_top, root).otherwise(up))
    if capacity is None:
        return cells.withColumn("leaf", F.col("deepest")).withColumn(
            "parent_rows", F.lit(None).cast("bigint")
        )
    siblings = Window.partitionBy(*key_names(dims, "p"))
    parent_side = F.greatest(
        *[F.max(f"hi_{a}").over(siblings) - F.min(f"lo_{a}").over(siblings) for a in axes]
    )
    side = longest_side(low(dims), high(dims))
    return (
        cells.withColumn("parent_rows", F.sum("rows").over(siblings))
        .withColumn("parent_side", parent_side)
        .filter(is_top | ((F.col("parent_rows") > capacity) & (F.col("parent_side") > 0)))
        .withColumn("leaf", (F.col("rows") <= capacity) | (side <= 0) | (F.col("lvl") >= last))
        .drop("parent_side")
    )


def _stopped(dims: int, capacity: int | None, last: int) -> Column:
    """Leaves over capacity that only the last level keeps from being split."""
    if capacity is None:
        return F.lit(False)
    spread = longest_side(low(dims), high(dims)) > 0
    return F.col("leaf") & spread & (F.col("rows") > capacity) & (F.col("lvl") >= last)


def build_pyramid(
    stage: Stage,
    name: str,
    points: DataFrame,
    dims: int,
    capacity: int | None,
    *,
    width: float,
    extent: Extent,
    top: int,
    level: int | None = None,
    level_column: str | None = None,
    last: int | None = None,
    rooted: bool = True,
) -> Pyramid:
    """Build the pyramid of ``points(id, x, y[, z], rows, n[, ub][, ids])``.

    ``rows`` weighs a row for the split test, ``n`` for neighbour counting; ``ub`` is a query's own
    bound, of which a cell has the largest, ``ids`` the mark of a repeated id (``id_mark``). The first
    histogram is taken at ``level`` (or per row at ``level_column``) and rolled up to ``top``;
    cells still over capacity are then split alone, each straight to the level that its own
    bounds and count ask for, ``last`` at most. With ``rooted`` the cells at ``top`` share one
    root; without it each cell of the first histogram is a root of its own. Without a
    ``capacity`` the cells of the first histogram are the leaves as they are.
    """
    keys, axes = key_names(dims), axes_of(dims)
    last = top + LEVEL_RANGE if last is None else last
    if level_column is not None:
        first = F.greatest(F.lit(top), F.col(level_column)) if rooted else F.col(level_column)
    else:
        first = F.lit(max(top, level if level is not None else top))
    own = _own_columns(points)
    source = points.select("id", *axes, "rows", "n", *own, first.cast("int").alias("lvl"))
    stop = F.lit(top) if rooted else F.col("lvl")
    keyed = with_cell(source, dims, width, F.col("lvl"))
    keyed = keyed.withColumn("stop", stop).withColumn("base", F.lit(ROOT))
    parts, summaries = [], []
    while True:
        hist = _histogram(keyed, dims)
        is_open = F.col("deepest") & ~F.col("leaf")
        part, facts = stage.save_with(
            _roll_up(hist, dims, capacity, last, rooted),
            f"{name}-{len(parts)}",
            F.count_if(is_open).alias("cells"),
            level_mask(F.when(is_open, F.col("lvl")), top).alias("levels"),
            F.count_if("leaf").alias("leaves"),
            F.count_if(_stopped(dims, capacity, last)).alias("stopped"),
            level_mask(F.when(F.col("leaf"), F.col("lvl")), top).alias("leaf_levels"),
            level_mask(F.col("lvl"), top).alias("node_levels"),
        )
        parts.append(part)
        summaries.append(facts)
        if facts["stopped"]:
            warnings.warn(
                f"{facts['stopped']} cells of {name} hold more than {capacity} rows at the last level",
                stacklevel=2,
            )
        open_cells = part.filter(is_open)
        if not facts["cells"]:
            break
        side = longest_side(low(dims), high(dims))
        # Levels at which the rows of a cell still share one cell or straddle two per axis.
        empty = F.floor(F.log2(F.pow(F.lit(2.0), -F.col("lvl")) * F.lit(width) / side))
        stop = F.least(F.lit(last), F.col("lvl") + F.greatest(empty, F.lit(1)))
        full = F.ceil(F.log2(F.col("rows") / F.lit(float(capacity))) / dims)
        goal = F.least(F.lit(last), stop + full)
        goals = open_cells.select(
            *keys, goal.cast("int").alias("goal"), stop.cast("int").alias("stop"), "rows"
        )
        spread = at_levels(
            points.select("id", *axes, F.col("rows").alias("r"), "n", *own),
            dims,
            width,
            masked_levels(facts["levels"], top),
        )
        found = lookup(spread, goals, keys, "rows", extent.rows, facts["cells"])
        found = found.select(
            "id", *axes, F.col("r").alias("rows"), "n", *own, "goal", "stop", F.col("lvl").alias("base")
        )
        keyed = with_cell(found, dims, width, F.col("goal"))
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    levels, leaf_levels = (
        tuple(sorted({v for facts in summaries for v in masked_levels(facts[name], top)}))
        for name in ("node_levels", "leaf_levels")
    )
    return Pyramid(
        nodes.drop("deepest"),
        dims,
        width,
        extent.rows,
        levels,
        sum(facts["leaves"] for facts in summaries),
        leaf_levels,
    )
