from __future__ import annotations

import numpy as np
import pytest

from nearfield import aknn_join, build_leaves
from tests.points import brute_force, clustered, frame, piled, rows, uniform

VARIANTS = [("gd", "bf"), ("gd", "ps"), ("qt", "bf"), ("qt", "ps")]


def check(spark, q, t, k, *, q_ids=None, t_ids=None, **options):
    q_ids = np.arange(len(q)) + 1000 if q_ids is None else q_ids
    t_ids = np.arange(len(t)) if t_ids is None else t_ids
    dims = np.shape(q)[1]
    got = aknn_join(frame(spark, q_ids, q), frame(spark, t_ids, t), k, dims=dims, **options)
    assert got.columns == ["qid", "rank", "tid", "dist"]
    found = got.collect()
    expected = brute_force(q_ids, q, t_ids, t, k, options.get("exclude_self", False))
    assert len(found) == len(expected)
    assert {tuple(r) for r in found} == expected


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize(("partitioning", "method"), VARIANTS)
def test_variants_agree_with_brute_force(spark, dims, partitioning, method):
    rng = np.random.default_rng(1)
    q, t = uniform(rng, 300, dims), clustered(rng, 1500, dims)
    options = {}
    if partitioning == "qt":
        sample = frame(spark, np.arange(0, 1500, 5), t[::5])
        options["leaves"] = build_leaves(sample, capacity=20, dims=dims)
    check(spark, q, t, 10, partitioning=partitioning, method=method, n=None, **options)


@pytest.mark.parametrize("n", [1, 7, 500])
def test_any_grid(spark, n):
    rng = np.random.default_rng(2)
    check(spark, clustered(rng, 200, 2), clustered(rng, 800, 2), 5, n=n)


@pytest.mark.parametrize(("shape", "dims"), [(uniform, 3), (clustered, 2), (piled, 2)])
def test_shuffle_branches(spark, tiny_limits, shape, dims):
    rng = np.random.default_rng(3)
    q, t = shape(rng, 100, dims), shape(rng, 400, dims)
    check(spark, q, t, 3, capacity=12)


def test_dense_queries_far_from_one_cluster(spark, tiny_limits):
    rng = np.random.default_rng(4)
    q = np.vstack([np.full((100, 2), 0.9), rng.random((100, 2))])
    t = 0.1 + rng.random((300, 2)) * 1e-6
    check(spark, q, t, 4, capacity=8)


@pytest.mark.parametrize("count", [1, 7])
def test_fewer_training_points_than_k(spark, count):
    rng = np.random.default_rng(5)
    check(spark, uniform(rng, 40, 2), uniform(rng, count, 2), 10, n=500)


def test_empty_sides(spark):
    some, none = np.array([[0.1, 0.2]]), np.empty((0, 2))
    assert aknn_join(frame(spark, [], none), frame(spark, [1], some), 3).count() == 0
    assert aknn_join(frame(spark, [1], some), frame(spark, [], none), 3).count() == 0


def test_self_join(spark):
    rng = np.random.default_rng(6)
    t, ids = piled(rng, 300, 2), np.arange(300)
    for exclude_self in (False, True):
        check(spark, t, t, 4, q_ids=ids, t_ids=ids, exclude_self=exclude_self, capacity=20)


def test_repeated_training_ids_count_once(spark):
    rng = np.random.default_rng(7)
    t = clustered(rng, 600, 2)
    ids = np.where(rng.random(600) < 0.4, 7, np.arange(600) % 200)
    check(spark, uniform(rng, 80, 2), t, 6, t_ids=ids, capacity=16)


def test_ties_go_to_the_smaller_id(spark):
    t = [[0.4, 0.5], [0.6, 0.5], [0.5, 0.4], [0.5, 0.6]]
    t = np.array(t) * 0.5
    got = rows(aknn_join(frame(spark, [1], [[0.25, 0.25]]), frame(spark, [9, 3, 5, 4], t), 2))
    assert got == brute_force([1], [[0.25, 0.25]], [9, 3, 5, 4], t, 2)
    same = frame(spark, [9, 3, 5, 4], [[0.5, 0.25]] * 4)
    got = rows(aknn_join(frame(spark, [1], [[0.25, 0.25]]), same, 2))
    assert got == {(1, 1, 3, 0.25), (1, 2, 4, 0.25)}


def test_points_outside_the_unit_box(spark):
    rng = np.random.default_rng(8)
    q, t = rng.normal(size=(100, 2)) * 50, rng.normal(size=(500, 2)) * 50
    check(spark, q, t, 5, n=20)
    leaves = build_leaves(frame(spark, np.arange(500), np.abs(t) / 400), capacity=20)
    check(spark, q, t, 5, partitioning="qt", leaves=leaves)


def test_golden(spark):
    t = frame(spark, [1, 2, 3, 4], [[0.1, 0.1], [0.12, 0.1], [0.5, 0.5], [0.9, 0.9]])
    q = frame(spark, [10, 11], [[0.1, 0.1], [0.5, 0.4]])
    got = [(r.qid, r.rank, r.tid, round(r.dist, 10)) for r in aknn_join(q, t, 2).collect()]
    assert sorted(got) == [
        (10, 1, 1, 0.0),
        (10, 2, 2, 0.02),
        (11, 1, 3, 0.1),
        (11, 2, 2, 0.4841487375),
    ]
    t3 = frame(spark, [1, 2, 3], [[0.1, 0.1, 0.1], [0.1, 0.1, 0.3], [0.5, 0.5, 0.9]])
    q3 = frame(spark, [10], [[0.1, 0.1, 0.15]])
    got = [(r.rank, r.tid, round(r.dist, 10)) for r in aknn_join(q3, t3, 2, dims=3).collect()]
    assert sorted(got) == [(1, 1, 0.05), (2, 2, 0.15)]


def test_bad_arguments(spark):
    p2 = frame(spark, [1], [[0.1, 0.1]])
    with pytest.raises(ValueError, match="k must"):
        aknn_join(p2, p2, 0)
    with pytest.raises(ValueError, match="no column"):
        aknn_join(p2, p2, 1, dims=3)
    with pytest.raises(ValueError, match="dims"):
        aknn_join(p2, p2, 1, dims=4)
    with pytest.raises(ValueError, match="leaves"):
        aknn_join(p2, p2, 1, partitioning="qt")
    with pytest.raises(ValueError, match="method"):
        aknn_join(p2, p2, 1, method="kd")
    with pytest.raises(ValueError, match="partitioning"):
        aknn_join(p2, p2, 1, partitioning="kd")


def test_mixed_dimensions_are_an_error(spark):
    p2, p3 = frame(spark, [1], [[0.1, 0.1]]), frame(spark, [1], [[0.1, 0.1, 0.1]])
    with pytest.raises(ValueError, match="z"):
        aknn_join(p2, p3, 1)


def test_one_id_at_many_places(spark):
    """Half of the rows are places of one id, in a region of their own."""
    rng = np.random.default_rng(9)
    t = np.vstack([rng.random((400, 2)) * 0.5, 0.5 + rng.random((400, 2)) * 0.5])
    ids = np.concatenate([np.full(400, 5), np.arange(1000, 1400)])
    check(spark, rng.random((80, 2)) * 0.6, t, 4, t_ids=ids, capacity=16)
