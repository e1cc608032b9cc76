"""What the joins do with points they cannot place, repeated ids and unusual extents."""

from __future__ import annotations

import math

import numpy as np
import pytest

import nearfield as nf
from tests.points import brute_force, frame, rows, uniform

SCHEMA = "id bigint, x double, y double"


def table(spark, points):
    return spark.createDataFrame(points, SCHEMA)


@pytest.mark.parametrize("bad", [(9, None, 0.5), (None, 0.5, 0.5), (9, math.nan, 0.5), (9, 0.5, math.inf)])
def test_unplaced_rows_are_an_error(spark, bad):
    good = [(i, i / 10, 0.5) for i in range(5)]
    for q, t in (([*good, bad], good), (good, [*good, bad])):
        q, t = table(spark, q), table(spark, t)
        for join in (
            lambda q=q, t=t: nf.aknn_join(q, t, 2),
            lambda q=q, t=t: nf.local_knn(q, t, 2, n=3),
            lambda q=q, t=t: nf.radius_join(q, t, 0.1),
            lambda q=q, t=t: nf.overlaps_grid(q, t, 2, 3),
        ):
            with pytest.raises(ValueError, match="1 of 6 rows|and 1 one"):
                join()


@pytest.mark.parametrize("partitions", ["1", "32"])
def test_repeated_query_ids_have_one_list(spark, partitions):
    rng = np.random.default_rng(31)
    q, t = uniform(rng, 200, 2), uniform(rng, 300, 2)
    q_ids = np.repeat(np.arange(100), 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rows(nf.aknn_join(frame(spark, q_ids, q), frame(spark, range(300), t), 5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = set()
    for i in range(100):
        best = {}
        for j in (2 * i, 2 * i + 1):
            for _, _, tid, dist in brute_force([i], q[j : j + 1], range(300), t, 5):
                best[tid] = min(dist, best.get(tid, math.inf))
        ranked = sorted((d, tid) for tid, d in best.items())[:5]
        want |= {(i, r, tid, d) for r, (d, tid) in enumerate(ranked, start=1)}
    assert got == want
    with pytest.raises(ValueError, match="100 ids"):
        nf.local_knn(frame(spark, q_ids, q), frame(spark, range(300), t), 5, n=3)


def test_dimensions_come_from_the_columns(spark):
    q = frame(spark, [1], [[0.5, 0.5, 0.1]])
    t = frame(spark, [1, 2], [[0.5, 0.5, 0.9], [0.6, 0.5, 0.1]])
    assert [r.tid for r in nf.aknn_join(q, t, 1).collect()] == [2]
    with pytest.raises(ValueError, match="z column"):
        nf.aknn_join(q, t, 1, dims=2)
    with pytest.raises(ValueError, match="z column"):
        nf.aknn_join(q.drop("z"), t, 1)
    flat = t.selectExpr("id", "x", "y", "cast(null as double) as z")
    assert [r.tid for r in nf.aknn_join(q.selectExpr("id", "x", "y", "cast(null as double) as z"), flat, 1).collect()] == [1]


def test_an_outlier_leaves_no_crowded_leaf(spark):
    from nearfield.plans import pyramid
    from nearfield.plans.aknn import plain_points, plain_weight
    from nearfield.plans.staging import Stage

    rng = np.random.default_rng(32)
    coords = np.vstack([uniform(rng, 3000, 2), [[1e13, 1e13]]])
    points = frame(spark, range(3001), coords)
    extent = pyramid.extent_of(points, 2)
    built = pyramid.build_pyramid(
        Stage(spark), "t", plain_weight(plain_points(points, 2, "t")), 2, 64, width=1.0, extent=extent,
        top=pyramid.top_level(extent, 2, 1.0),
    )
    assert built.leaves.agg({"rows": "max"}).first()[0] <= 64
    q = uniform(rng, 20, 2)
    got = nf.aknn_join(frame(spark, range(20), q), points, 3)
    assert rows(got) == brute_force(range(20), q, range(3001), coords, 3)


def test_a_tight_cluster_is_split_to_capacity(spark):
    rng = np.random.default_rng(33)
    coords = 0.3 + uniform(rng, 400, 2) * 2.0**-30
    coords[:50] = 0.7
    leaves = nf.build_leaves(frame(spark, range(400), coords), capacity=20)
    crowded = leaves.filter("n_sample > 20").collect()
    assert len(crowded) == 1 and crowded[0].xmin <= 0.7 < crowded[0].xmax
    assert leaves.agg({"n_sample": "sum"}).first()[0] == 400
    overlaps = nf.overlaps_tree(frame(spark, [1], [[0.3, 0.3]]), frame(spark, range(400), coords), 3, leaves)
    paths = {r.path for r in leaves.collect()}
    assert {r.cell for r in overlaps.collect()} <= paths


def test_staged_tables_can_be_dropped(spark, tmp_path):
    from nearfield.plans.staging import Stage

    stage = Stage(spark)
    saved = stage.save(spark.range(3), "numbers")
    assert saved.count() == 3
    stage.drop()
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(f"{stage.folder}/numbers").count()
