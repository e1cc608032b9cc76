"""Neighbour lists that follow a growing training table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.neighbors import check_k, local_radius, merge_topk
from nearfield.plans.aknn import aknn_join
from nearfield.plans.index import PointIndex

KNOWN = "known_reach"


def extend_neighbors(
    lists: DataFrame, q: DataFrame, new_t: DataFrame | PointIndex, k: int, **options
) -> DataFrame:
    """``lists`` brought up to date with new training points: ``(qid, rank, tid, dist)``.

    ``lists`` is ``aknn_join(q, t, k)`` or longer; the rows are those of a join with ``t`` and ``new_t`` together.
    A query looks among the new points no farther than the k-th neighbour it has, so most of them meet no
    query at all; a query with fewer than ``k`` neighbours, or none, looks everywhere. An id in both tables counts at
    its nearest place. Query ids must be unique here. ``options`` are those of ``aknn_join``.
    """
    k = check_k(k)
    known = local_radius(lists, k).select(F.col("qid").alias("id"), F.col("r").alias(KNOWN))
    bounded = q.withColumn("id", F.col("id").cast("bigint")).join(known, "id", "left")
    near = aknn_join(bounded, new_t, k, bound=KNOWN, **options)
    return merge_topk(lists.filter(F.col("rank") <= k), near, k)
