"""Point tables: ``id BIGINT, x DOUBLE, y DOUBLE`` and, in 3D, ``z DOUBLE``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.geometry import axes_of


def read_points(
    spark: SparkSession,
    path: str,
    dims: int = 2,
    sep: str = "\t",
    *,
    on_error: str = "fail",
    partitions: int | None = None,
) -> DataFrame:
    """Read ``id, x, y[, z]`` text lines.

    A line with another field count or a value that is no number stops the read
    (``on_error="fail"``) or is kept with its text in ``bad_line`` (``"keep"``, see
    ``validate_points``). Blank lines are skipped.
    """
    if on_error not in ("fail", "keep"):
        raise ValueError(f"on_error must be 'fail' or 'keep', not {on_error!r}")
    axes = axes_of(dims)
    schema = "id bigint, " + ", ".join(f"{a} double" for a in axes)
    reader = (
        spark.read.option("sep", sep)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
    )
    if on_error == "fail":
        points = reader.schema(schema).option("mode", "FAILFAST").csv(path)
    else:
        points = (
            reader.schema(f"{schema}, bad_line string")
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "bad_line")
            .csv(path)
        )
    return points if partitions is None else points.repartition(partitions)


@dataclass(frozen=True)
class Checked:
    """``good`` rows, ``bad`` rows with a ``reason``, and ids that ``good`` rows repeat."""

    good: DataFrame
    bad: DataFrame
    duplicate_ids: DataFrame


def validate_points(points: DataFrame, dims: int = 2) -> Checked:
    """Split off rows that are malformed, incomplete, not finite or outside ``[0, 1)``."""
    axes = axes_of(dims)
    gap = F.col("id").isNull()
    off, infinite = F.lit(False), F.lit(False)
    for a in axes:
        c = F.col(a)
        gap = gap | c.isNull()
        infinite = infinite | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        off = off | (c < 0) | (c >= 1)
    reason = F.when(gap, "missing value").when(infinite, "not finite").when(off, "outside domain")
    if "bad_line" in points.columns:
        reason = F.when(F.col("bad_line").isNotNull(), "malformed line").otherwise(reason)
    marked = points.withColumn("reason", reason)
    good = marked.filter(F.col("reason").isNull()).select("id", *axes)
    twice = good.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return Checked(good, marked.filter(F.col("reason").isNotNull()), twice)


def normalize_points(points: DataFrame, reference: DataFrame | None = None, dims: int = 2) -> DataFrame:
    """Scale points into ``[0, 1)`` with one factor for all axes, so distances keep their order.

    The box comes from ``reference`` (by default the points themselves): pass the union of both
    sides of a join to scale them alike.
    """
    axes = axes_of(dims)
    source = points if reference is None else reference
    # One aggregate row, joined back as constants.
    row = source.agg(
        *[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes]
    ).first()
    if row[0] is None:
        return points
    side = max(row[f"hi_{a}"] - row[f"lo_{a}"] for a in axes) or 1.0
    # A little more than the side, so that the largest value stays below 1.
    scale = F.lit(side * (1.0 + 1e-9))
    return points.withColumns({a: (F.col(a) - F.lit(row[f"lo_{a}"])) / scale for a in axes})


def sample_points(points: DataFrame, percent: float, seed: int | None = None) -> DataFrame:
    """Keep about ``percent`` in 100 rows."""
    if not 0 < percent <= 100:
        raise ValueError(f"percent must be above 0 and at most 100, not {percent!r}")
    return points if percent == 100 else points.sample(fraction=percent / 100.0, seed=seed)


def count_points(points: DataFrame, dims: int = 2) -> DataFrame:
    """One row: rows, distinct ids and rows per null pattern of the last axis."""
    return points.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("id").alias("n_ids"),
        F.count(axes_of(dims)[-1]).alias("n_complete"),
    )


def infer_dims(points: DataFrame) -> int:
    """3 if every row has a z, 2 if none has; mixed tables are an error."""
    if "z" not in points.columns:
        return 2
    row = points.agg(F.count(F.lit(1)).alias("n"), F.count("z").alias("z")).first()
    if row.z == 0:
        return 2
    if row.z != row.n:
        raise ValueError(f"{row.z} of {row.n} points have a z; 2D and 3D points cannot be mixed")
    return 3
