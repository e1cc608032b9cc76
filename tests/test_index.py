from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

import nearfield as nf
from nearfield.plans import aknn, meet
from nearfield.plans.staging import staging_folder
from tests.points import brute_force, clustered, frame, piled, rows, uniform


def place(spark):
    return f"{staging_folder(spark)}/index-{uuid.uuid4().hex}"


@pytest.mark.parametrize("few", [0, 2000])
@pytest.mark.parametrize(("shape", "dims"), [(clustered, 2), (uniform, 3), (piled, 2)])
def test_join_with_an_index(spark, monkeypatch, few, shape, dims):
    monkeypatch.setattr(aknn, "SMALL_QUERIES", few)
    rng = np.random.default_rng(31)
    t = shape(rng, 1500, dims)
    index = nf.index_points(frame(spark, range(1500), t), place(spark))
    assert index.dims == dims and index.points().count() == 1500
    for method in ("bf", "ps"):
        q = 1.2 * uniform(rng, 120, dims) - 0.1
        got = rows(nf.aknn_join(frame(spark, range(120), q), index, 7, method=method))
        assert got == brute_force(range(120), q, range(1500), t, 7)


@pytest.mark.parametrize("few", [0, 2000])
def test_index_with_repeated_ids_and_shuffles(spark, tiny_limits, monkeypatch, few):
    monkeypatch.setattr(aknn, "SMALL_QUERIES", few)
    rng = np.random.default_rng(32)
    ids, t = rng.integers(0, 150, 500), piled(rng, 500, 2)
    index = nf.read_index(spark, nf.index_points(frame(spark, ids, t), place(spark), capacity=8).folder)
    assert not index.unique
    q = uniform(rng, 60, 2)
    got = rows(nf.aknn_join(frame(spark, range(60), q), index, 6, exclude_self=True))
    assert got == brute_force(range(60), q, ids, t, 6, exclude_self=True)


def test_index_of_nothing_and_misuse(spark):
    none = nf.index_points(frame(spark, [], np.zeros((0, 2))).select("id", "x", "y"), place(spark), dims=2)
    q = frame(spark, [1], [[0.5, 0.5]])
    assert nf.aknn_join(q, none, 3).count() == 0
    assert nf.radius_join(q, none, 3.0).count() == 0
    one = nf.index_points(q, place(spark))
    assert rows(nf.aknn_join(frame(spark, [9], [[9.0, -4.0]]), one, 3)) == brute_force([9], [[9.0, -4.0]], [1], [[0.5, 0.5]], 3)
    with pytest.raises(ValueError, match="cells"):
        nf.aknn_join(q, one, 3, n=5)
    with pytest.raises(ValueError, match="dimensions"):
        nf.aknn_join(q, one, 3, dims=3)


def test_a_join_reads_the_wanted_part_in_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(aknn, "SMALL_QUERIES", 2000)
    rng = np.random.default_rng(33)
    t = uniform(rng, 40_000, 2)
    index = nf.index_points(frame(spark, range(40_000), t), place(spark), unique_ids=True, bucket_rows=200)
    q = 0.02 * uniform(rng, 50, 2) + 0.4
    read = []
    original = type(index).points_of

    def counted(self, leaves):
        found = original(self, leaves)
        read.append((found.count(), len(found.filter(F.lit(True)).select(F.input_file_name()).distinct().collect())))
        return found

    monkeypatch.setattr(type(index), "points_of", counted)
    got = rows(nf.aknn_join(frame(spark, range(50), q), index, 5))
    assert got == brute_force(range(50), q, range(40_000), t, 5)
    files = index.points().select(F.input_file_name()).distinct().count()
    assert read[0][0] < 40_000 / 10 and read[0][1] <= files / 10

    monkeypatch.setattr(type(index), "points_of", original)
    context, group = spark.sparkContext, uuid.uuid4().hex
    queries = frame(spark, range(50), q).coalesce(1)
    context.setJobGroup(group, "join")
    joined = nf.aknn_join(queries, index, 5, unique_query_ids=True)
    eager = len(context.statusTracker().getJobIdsForGroup(group))
    context.setJobGroup("", "")
    assert eager <= 10 and joined.count() == 250


def test_points_of_unwanted_leaves_are_not_shuffled(spark):
    rng = np.random.default_rng(34)
    t, q = uniform(rng, 20_000, 2), 0.05 * uniform(rng, 100, 2)
    joined = nf.aknn_join(frame(spark, range(100), q), frame(spark, range(20_000), t), 5, unique_ids=True, unique_query_ids=True)
    assert rows(joined) == brute_force(range(100), q, range(20_000), t, 5)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_sweep_compares_fewer_pairs(spark):
    rng = np.random.default_rng(35)
    t = clustered(rng, 3000, 2)
    q = t[::8] + 1e-5 * rng.normal(size=(375, 2))
    seen = {}
    for method in ("bf", "ps"):
        watch = nf.PairCount()
        joined = nf.aknn_join(frame(spark, range(375), q), frame(spark, range(3000), t), 4, method=method, count=watch)
        assert rows(joined) == brute_force(range(375), q, range(3000), t, 4)
        seen[method] = watch.pairs
    assert seen["ps"] < 0.6 * seen["bf"]


def test_strips_hold_every_point_of_the_band(spark):
    rng = np.random.default_rng(36)
    edge = [0.0, 0.1, 0.3, 1 / 3, 0.7, 1.0, 1e-300, 5e15]
    cases = []
    for _ in range(3000):
        lo, hi = sorted(rng.choice([*edge, *rng.random(4)], 2))
        t = float(np.clip(rng.choice([lo, hi, lo + (hi - lo) * rng.random()]), lo, hi))
        qx = float(rng.choice([t, lo, hi, rng.random()]))
        cases.append((float(lo), float(hi), int(rng.integers(1, 200)), t, qx, abs(qx - t)))
    table = spark.createDataFrame(cases, "t_lo_x double, t_hi_x double, t_rows int, x double, qx double, reach double")
    table = table.withColumns({"lo_x": F.col("t_lo_x"), "hi_x": F.col("t_hi_x"), "rows": F.col("t_rows")})
    swept = meet._sweep(table, 4).filter(F.col("strip") == meet._strip(F.col("x"), "", 4))
    assert swept.count() == len(cases)


@pytest.mark.parametrize("few", [0, 2000])
@pytest.mark.parametrize("dims", [2, 3])
def test_a_radius_for_each_query(spark, monkeypatch, few, dims):
    monkeypatch.setattr(aknn, "SMALL_QUERIES", few)
    rng = np.random.default_rng(37)
    q, t = uniform(rng, 150, dims), clustered(rng, 600, dims)
    r = rng.random(150) ** 4
    r[0], r[1] = 0.0, np.inf
    table = frame(spark, range(150), q).join(
        spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "id long, far double"), "id"
    )
    want = set()
    for i, p in enumerate(q):
        d = np.zeros(len(t))
        for a in range(dims):
            d = d + (p[a] - t[:, a]) * (p[a] - t[:, a])
        want |= {(i, j, v) for j, v in enumerate(np.sqrt(d).tolist()) if v <= r[i]}
    tf = frame(spark, range(600), t)
    assert rows(nf.radius_join(table, tf, "far")) == want
    assert rows(nf.radius_join(table, nf.index_points(tf, place(spark)), "far", method="ps")) == want
    with pytest.raises(ValueError, match="radius"):
        nf.radius_join(table.withColumn("far", F.lit(None).cast("double")), tf, "far")


@pytest.mark.parametrize("few", [0, 2000])
def test_lists_follow_new_points(spark, monkeypatch, few):
    monkeypatch.setattr(aknn, "SMALL_QUERIES", few)
    rng = np.random.default_rng(38)
    q, t = uniform(rng, 150, 2), clustered(rng, 900, 2)
    ids = np.concatenate([np.arange(500), np.arange(300, 700)])
    qf = frame(spark, range(150), q)
    for first in (500, 3):
        old, new = frame(spark, ids[:first], t[:first]), frame(spark, ids[first:], t[first:])
        lists = nf.aknn_join(qf, old, 5)
        watch, whole = nf.PairCount(), nf.PairCount()
        grown = nf.extend_neighbors(lists, qf, new, 5, count=watch)
        assert rows(grown) == brute_force(range(150), q, ids, t, 5)
        nf.aknn_join(qf, new, 5, count=whole).count()
        if first == 500:
            assert watch.pairs < whole.pairs


def test_self_join_counts_its_cells_once(spark):
    rng = np.random.default_rng(39)
    t = clustered(rng, 700, 2)
    tf = frame(spark, range(700), t)
    assert rows(nf.aknn_join(tf, tf, 4)) == brute_force(range(700), t, range(700), t, 4)
    assert rows(nf.aknn_join(tf, tf, 4, exclude_self=True)) == brute_force(range(700), t, range(700), t, 4, exclude_self=True)
    ids = np.arange(700) // 2
    twice = frame(spark, ids, t)
    got = rows(nf.aknn_join(twice, twice, 3))
    two = frame(spark, ids, t)
    assert got == rows(nf.aknn_join(twice, two, 3))


@pytest.mark.parametrize("tree", [False, True])
def test_two_phases_with_repeated_ids(spark, tree):
    q = [[0.05, 0.05]]
    t = np.vstack([np.full((10, 2), 0.06), 0.11 + 0.02 * np.arange(18).reshape(9, 2)])
    ids = np.concatenate([np.ones(10, dtype=int), np.arange(2, 11)])
    qf, tf = frame(spark, [7], q), frame(spark, ids, t)
    where = {"leaves": nf.build_leaves(tf, capacity=10)} if tree else {"n": 10}
    assert rows(nf.two_phase_join(qf, tf, 5, **where)) == brute_force([7], q, ids, t, 5)
    rng = np.random.default_rng(40)
    q, t, ids = uniform(rng, 60, 2), piled(rng, 300, 2), rng.integers(0, 80, 300)
    qf, tf = frame(spark, range(60), q), frame(spark, ids, t)
    where = {"leaves": nf.build_leaves(tf, capacity=10, max_depth=6)} if tree else {"n": 10}
    assert rows(nf.two_phase_join(qf, tf, 5, **where)) == brute_force(range(60), q, ids, t, 5)


def test_large_k_is_cut_before_the_shuffle(spark):
    rng = np.random.default_rng(41)
    q, t = uniform(rng, 3, 2), uniform(rng, 2600, 2)
    nf.configure(spark)
    joined = nf.aknn_join(frame(spark, range(3), q), frame(spark, range(2600), t), 2000)
    assert rows(joined) == brute_force(range(3), q, range(2600), t, 2000)
    assert "WindowGroupLimit" in joined._jdf.queryExecution().executedPlan().toString()
