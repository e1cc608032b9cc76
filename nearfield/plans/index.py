"""A training table kept by cell, for joins that start from it again and again.

The folder holds the count pyramid (``nodes``: every cell with its box, rows and ids), the points with
their leaf's key (``points``), and one row of facts. Points are sorted along a Z-order curve of the leaves and
laid in directories by the curve's first digits, about ``BUCKET_ROWS`` rows each if spread evenly and
4,096 directories at most. A join reads the directories of the leaves
it wants, and within them the row groups whose stretch of the curve it wants; neither the extent, the check
for repeated ids nor the pyramid is made again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.geometry import axes_of
from nearfield.operators.neighbors import check_k
from nearfield.plans.pyramid import (
    Extent,
    Pyramid,
    build_pyramid,
    density_level,
    extent_of,
    key_names,
    top_level,
)
from nearfield.plans.staging import Stage

# Digits per axis of the curve, by dims: a child's number takes as many bits as there are axes.
CURVE_DIGITS = {2: 28, 3: 18}
# Digits of the curve that name a directory, at most.
BUCKET_DIGITS = {2: 6, 3: 4}
BUCKET_ROWS = 100_000
LEAF_CAPACITY = 64
# Stretches of the curve that one scan is asked for.
STRETCHES = 32


def curve_position(dims: int, top: int, origin: list[int], level: Column, cell: list[Column]) -> Column:
    """Place of a cell's low corner on the curve through the cells ``CURVE_DIGITS`` below about ``top``.

    ``origin`` is the lowest cell at ``top``; the bits of the axes take turns.
    """
    digits, spare = CURVE_DIGITS[dims], 5
    fine = top + digits - spare
    code = F.lit(0).cast("bigint")
    for i, (c, least) in enumerate(zip(cell, origin, strict=True)):
        deeper = F.expr("0") + F.lit(fine) - level
        there = F.when(deeper >= 0, _shift_left(c, deeper)).otherwise(_shift_right(c, -deeper))
        there = there - F.lit(least << (fine - top)).cast("bigint")
        there = F.greatest(F.lit(0), F.least(there, F.lit((1 << digits) - 1)))
        for bit in range(digits):
            code = code.bitwiseOR(
                F.shiftleft(F.shiftright(there, bit).bitwiseAND(F.lit(1).cast("bigint")), bit * dims + i)
            )
    return code


def _shift_left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by.cast("int"))


def _shift_right(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by.cast("int"))


@dataclass(frozen=True)
class PointIndex:
    """An index as read from its folder."""

    spark: SparkSession
    folder: str
    pyramid: Pyramid
    top: int
    origin: tuple[int, ...]
    unique: bool
    extent: Extent
    digits: int

    @property
    def dims(self) -> int:
        return self.pyramid.dims

    @property
    def columns(self) -> list[str]:
        return ["id", *axes_of(self.dims)]

    def curve(self) -> Column:
        cell = [F.col(f"c{a}") for a in axes_of(self.dims)]
        return curve_position(self.dims, self.top, list(self.origin), F.col("lvl"), cell)

    def points(self) -> DataFrame:
        """All points: key of the leaf, place on the curve, id and coordinates."""
        return self.spark.read.parquet(f"{self.folder}/points")

    def points_of(self, leaves: DataFrame) -> DataFrame:
        """The points in files and row groups that may hold these leaves' points, with their key.

        What the leaves' stretches of the curve are is one small aggregate by directory, read on the
        driver: at most as many rows as there are directories.
        """
        placed = leaves.withColumn("curve", self.curve())
        ends = placed.groupBy(bucket_of(self.dims, self.digits).alias("bucket"))
        ends = ends.agg(F.min("curve").alias("low"), F.max("curve").alias("high")).collect()
        ends.sort(key=lambda r: r.bucket)
        step = -(-len(ends) // STRETCHES) or 1
        stretch = F.lit(False)
        for part in (ends[i : i + step] for i in range(0, len(ends), step)):
            stretch = stretch | F.col("curve").between(part[0].low, part[-1].high)
        points = self.points().filter(F.col("bucket").isin([r.bucket for r in ends]) & stretch)
        return points.select(*key_names(self.dims), *self.columns)


def bucket_of(dims: int, digits: int) -> Column:
    return F.shiftright("curve", (CURVE_DIGITS[dims] - digits) * dims).cast("int")


def index_points(
    t: DataFrame,
    path: str,
    *,
    dims: int | None = None,
    capacity: int = LEAF_CAPACITY,
    unique_ids: bool | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> PointIndex:
    """Write ``t`` to ``path`` in the layout above; an existing folder is an error.

    Values and repeated ids are as in ``aknn_join``. An empty table makes an index without points.
    """
    from nearfield.plans.aknn import LEAF_FILL, plain_points, settle_dims, weigh

    capacity = check_k(capacity)
    dims = settle_dims(t, t, dims)
    t = plain_points(t, dims, "t")
    extent = extent_of(t, dims, "t")
    weighed, unique = weigh(t, dims, unique_ids)
    spark, stage = t.sparkSession, Stage(t.sparkSession)
    width = 1.0
    if extent.side > 0:
        width = extent.side / max(1.0, extent.rows / (LEAF_FILL * capacity)) ** (1.0 / dims)
    top = top_level(extent, dims, width) if extent.rows else 0
    level = density_level(extent, dims, width, capacity) if extent.rows else 0
    pyramid = build_pyramid(
        stage, "training", weighed, dims, capacity, width=width, extent=extent, top=top, level=max(top, level, 0)
    )
    axes = axes_of(dims)
    least = pyramid.nodes.filter(F.col("lvl") == top).agg(*[F.min(f"c{a}") for a in axes]).first()
    origin = tuple(v or 0 for v in least)
    # The curve covers some 2 ** 5 cells per axis at the top, of which points take about half.
    spare = 1 if extent.rows > bucket_rows else 0
    digits = round(math.log2(max(1.0, extent.rows / bucket_rows)) / dims) + spare
    digits = min(BUCKET_DIGITS[dims], digits)
    index = PointIndex(spark, path.rstrip("/"), pyramid, top, origin, unique, extent, digits)
    pyramid.nodes.write.parquet(f"{index.folder}/nodes")
    placed = pyramid.assign(t).withColumn("curve", index.curve()).withColumn("bucket", bucket_of(dims, digits))
    keys = key_names(dims)
    placed = placed.select(*keys, "curve", "id", *axes, "bucket")
    ordered = placed.repartitionByRange("curve", *keys).sortWithinPartitions("curve", *keys)
    ordered.write.partitionBy("bucket").parquet(f"{index.folder}/points")
    facts = [
        (dims, width, extent.rows, list(pyramid.levels), pyramid.leaf_count, list(pyramid.leaf_levels), top,
         list(origin), unique, list(map(float, extent.lo)), list(map(float, extent.hi)), digits)
    ]
    spark.createDataFrame(facts, FACTS).coalesce(1).write.parquet(f"{index.folder}/facts")
    return read_index(spark, index.folder)


FACTS = (
    "dims int, width double, n_rows bigint, levels array<int>, leaf_count bigint, leaf_levels array<int>, top int, "
    "origin array<bigint>, unique_ids boolean, low array<double>, high array<double>, digits int"
)


def read_index(spark: SparkSession, path: str) -> PointIndex:
    """An index that ``index_points`` has written."""
    path = path.rstrip("/")
    f = spark.read.schema(FACTS).parquet(f"{path}/facts").first()
    nodes = spark.read.parquet(f"{path}/nodes")
    pyramid = Pyramid(nodes, f.dims, f.width, f.n_rows, tuple(f.levels), f.leaf_count, tuple(f.leaf_levels))
    extent = Extent(f.n_rows, tuple(f.low), tuple(f.high))
    return PointIndex(spark, path, pyramid, f.top, tuple(f.origin), f.unique_ids, extent, f.digits)
