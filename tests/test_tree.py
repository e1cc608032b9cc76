from __future__ import annotations

import numpy as np
import pytest

import nearfield as nf
from tests.points import clustered, frame, rows

GOLDEN = [[0.1, 0.1], [0.2, 0.2], [0.3, 0.3], [0.8, 0.8], [0.9, 0.1]]


def paths(leaves):
    return sorted(r.path for r in leaves.select("path").collect())


def string(leaves):
    return nf.tree_string(leaves).first().tree


def test_capacity_golden(spark):
    leaves = nf.build_leaves(frame(spark, range(5), GOLDEN), capacity=2)
    assert paths(leaves) == ["0", "1", "20", "21", "22", "23", "3"]
    assert string(leaves) == "100100000"
    assert {r.path: r.n_sample for r in leaves.collect()}["22"] == 2


def test_other_policies_golden(spark):
    points = frame(spark, range(5), GOLDEN)
    all_children = nf.build_leaves(points, capacity=2, policy="all_children")
    assert paths(all_children) == sorted(a + b for a in "0123" for b in "0123")
    assert string(all_children) == "110000100001000010000"
    assert paths(nf.build_leaves(points, capacity=2, policy="avg_width")) == paths(all_children)
    wide = nf.build_leaves(points, capacity=2, policy="avg_width", avg_width=1.0)
    assert paths(wide) == ["0", "1", "20", "21", "22", "23", "3"]


@pytest.mark.parametrize(("dims", "marks"), [(2, "10000"), (3, "100000000")])
def test_one_split(spark, dims, marks):
    points = frame(spark, range(3), [[0.1] * dims, [0.9] * dims, [0.2] * dims])
    assert string(nf.build_leaves(points, capacity=2, dims=dims)) == marks
    single = nf.build_leaves(points, capacity=3, dims=dims)
    assert string(single) == "0" and paths(single) == [""]
    stats = nf.tree_stats(single).first()
    assert (stats.n_leaves, stats.n_internal, stats.max_depth, stats.n_sample) == (1, 0, 0, 3)


@pytest.mark.parametrize("policy", ["capacity", "all_children", "avg_width"])
@pytest.mark.parametrize("dims", [2, 3])
def test_leaves_tile_the_box_and_hold_each_point_once(spark, policy, dims):
    rng = np.random.default_rng(11)
    data = clustered(rng, 800, dims)
    points = frame(spark, range(800), data)
    leaves = nf.build_leaves(points, capacity=30, dims=dims, policy=policy, max_depth=10)
    table = leaves.collect()
    assert sum(2.0 ** (-dims * r.depth) for r in table) == 1.0
    placed = nf.assign_tree(points, leaves, dims).collect()
    assert sorted(r.id for r in placed) == list(range(800))
    boxes = {r.path: r for r in table}
    counts = dict.fromkeys(boxes, 0)
    for p in placed:
        box = boxes[p.cell]
        counts[p.cell] += 1
        for axis in "xyz"[:dims]:
            assert box[f"{axis}min"] <= p[axis] < box[f"{axis}max"]
    assert counts == {path: r.n_sample for path, r in boxes.items()}
    assert all(r.n_sample <= 30 or r.depth == 10 for r in table)


def test_pile_stops_at_max_depth(spark):
    leaves = nf.build_leaves(frame(spark, range(50), [[0.3, 0.3]] * 50), capacity=5, max_depth=6)
    assert nf.tree_stats(leaves).first().max_depth == 6


def test_points_outside_the_box(spark):
    points = frame(spark, [1, 2, 3], [[1.0, 0.5], [-0.1, 0.5], [0.0, 0.0]])
    leaves = nf.build_leaves(points, capacity=1)
    assert [r.id for r in nf.assign_tree(points, leaves).collect()] == [3]
    kept = nf.assign_tree(points, leaves, how="left").collect()
    assert {r.id: r.cell for r in kept} == {1: None, 2: None, 3: ""}


def test_write_and_read(spark, tmp_path):
    leaves = nf.build_leaves(frame(spark, range(5), GOLDEN), capacity=2)
    nf.write_leaves(leaves, str(tmp_path / "tree"))
    again = nf.read_leaves(spark, str(tmp_path / "tree"))
    assert again.columns == leaves.columns and rows(again) == rows(leaves)


def test_bad_arguments(spark):
    points = frame(spark, [1], [[0.5, 0.5]])
    with pytest.raises(ValueError, match="policy"):
        nf.build_leaves(points, capacity=2, policy="other")
    with pytest.raises(ValueError, match="capacity"):
        nf.build_leaves(points, capacity=0)
