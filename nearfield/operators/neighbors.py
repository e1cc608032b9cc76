"""Bounded neighbour lists: top-k, merging and preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEIGHBOR_SCHEMA = "qid bigint, rank int, tid bigint, dist double"


def check_k(k: int) -> int:
    if int(k) != k or k < 1:
        raise ValueError(f"k must be a whole number of at least 1, not {k!r}")
    return int(k)


def empty_neighbors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NEIGHBOR_SCHEMA)


def topk(
    pairs: DataFrame, k: int, *, distinct: bool = False, within: str | None = None
) -> DataFrame:
    """The ``k`` nearest of ``(qid, tid, dist)`` per query, ties to the smaller ``tid``.

    ``distinct`` first keeps the smallest distance of each (qid, tid). ``within`` names a
    column that is the same in all rows of a query and by which they may be partitioned.
    """
    k = check_k(k)
    query = ["qid"] if within is None else [within, "qid"]
    if distinct:
        pairs = pairs.groupBy(*query, "tid").agg(F.min("dist").alias("dist"))
    nearest = Window.partitionBy(*query).orderBy("dist", "tid")
    ranked = pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("qid", "rank", "tid", "dist")


def merge_topk(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Merge two tables of neighbour lists; an id found in both counts once."""
    columns = ["qid", "tid", "dist"]
    return topk(left.select(columns).unionByName(right.select(columns)), k, distinct=True)


def preview(neighbors: DataFrame, rows: int) -> DataFrame:
    """The first rows by query and rank."""
    return neighbors.orderBy("qid", "rank").limit(rows)


def local_radius(neighbors: DataFrame, k: int) -> DataFrame:
    """Distance of the k-th neighbour, ``(qid, r)``, for the lists that have ``k``."""
    return neighbors.filter(F.col("rank") == check_k(k)).select("qid", F.col("dist").alias("r"))
