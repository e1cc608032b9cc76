from __future__ import annotations

import numpy as np
import pytest

import nearfield as nf
from tests.points import brute_force, clustered, frame, piled, rows, uniform


def pairs_within(q_ids, q, t_ids, t, r):
    out = set()
    for qid, p in zip(q_ids, q, strict=True):
        total = np.zeros(len(t))
        for axis in range(q.shape[1]):
            d = p[axis] - t[:, axis]
            total = total + d * d
        dist = np.sqrt(total)
        out |= {(int(qid), int(t_ids[j]), dist[j]) for j in np.nonzero(dist <= r)[0]}
    return out


@pytest.mark.parametrize(("shape", "dims"), [(clustered, 3), (piled, 2)])
def test_radius_join(spark, shape, dims):
    rng = np.random.default_rng(21)
    q, t = shape(rng, 120, dims), shape(rng, 500, dims)
    q_ids, t_ids = np.arange(120), np.arange(500)
    got = nf.radius_join(frame(spark, q_ids, q), frame(spark, t_ids, t), 0.1, dims=dims)
    assert rows(got) == pairs_within(q_ids, q, t_ids, t, 0.1)


def test_radius_join_with_shuffles(spark, tiny_limits):
    rng = np.random.default_rng(22)
    q, t = piled(rng, 60, 2), piled(rng, 200, 2)
    got = nf.radius_join(frame(spark, range(60), q), frame(spark, range(200), t), 0.1, method="ps")
    assert rows(got) == pairs_within(range(60), q, range(200), t, 0.1)
    with pytest.raises(ValueError, match="negative"):
        nf.radius_join(frame(spark, [1], [[0, 0]]), frame(spark, [1], [[0, 0]]), -1)


def own_cell_lists(q, t, cell, k):
    out = set()
    q_cells, t_cells = cell(q), cell(t)
    for c in set(q_cells) & set(t_cells):
        qi = [i for i, v in enumerate(q_cells) if v == c]
        ti = [i for i, v in enumerate(t_cells) if v == c]
        out |= brute_force(qi, q[qi], ti, t[ti], k)
    return out


def test_local_knn_splits_crowded_cells(spark):
    rng = np.random.default_rng(23)
    q, t = clustered(rng, 120, 2), clustered(rng, 900, 2)
    got = nf.local_knn(frame(spark, range(120), q), frame(spark, range(900), t), 4, n=3)

    def cell(points):
        return [tuple(np.floor(p / (1.0 / 3)).astype(int)) for p in points]

    assert rows(got) == own_cell_lists(q, t, cell, 4)
    with pytest.raises(ValueError, match="either"):
        nf.local_knn(frame(spark, [1], [[0, 0]]), frame(spark, [1], [[0, 0]]), 1)


@pytest.mark.parametrize("tree", [False, True])
def test_overlaps_hold_every_true_neighbour(spark, tree):
    rng = np.random.default_rng(24)
    q, t = uniform(rng, 80, 2), piled(rng, 400, 2)
    qf, tf = frame(spark, range(80), q), frame(spark, range(400), t)
    if tree:
        leaves = nf.build_leaves(tf, capacity=30, max_depth=8)
        overlaps = nf.overlaps_tree(qf, tf, 5, leaves)
        place = lambda points: nf.assign_tree(points, leaves)
    else:
        overlaps = nf.overlaps_grid(qf, tf, 5, 6)
        place = lambda points: nf.assign_grid(points, 6)
    table = overlaps.collect()
    cells = {(r.qid, r.cell) for r in table}
    cells |= {(r.id, r.cell) for r in place(qf).collect()}
    t_cell = {r.id: r.cell for r in place(tf).collect()}
    for qid, _, tid, _ in brute_force(range(80), q, range(400), t, 5):
        assert (qid, t_cell[tid]) in cells
    done = {r.qid for r in table if r.complete}
    assert all(r.complete == (r.qid in done) for r in table)
    flags = nf.completeness(qf, overlaps).collect()
    assert len(flags) == 80 and {r.qid for r in flags if r.complete} == done


def test_two_pass_form_gives_the_join(spark):
    """Own cell first, then the cells within reach, then merged lists."""
    rng = np.random.default_rng(25)
    q, t = uniform(rng, 60, 2), uniform(rng, 600, 2)
    qf, tf = frame(spark, range(60), q), frame(spark, range(600), t)
    first = nf.local_knn(qf, tf, 5, n=5).cache()
    radius = nf.local_radius(first, 5)
    cells = nf.occupied_cells(nf.cell_histogram(nf.assign_grid(tf, 5)), n=5)
    near = nf.range_cells(qf.join(radius.withColumnRenamed("qid", "id"), "id"), cells, n=5)
    points = nf.assign_grid(tf, 5).select("cell", "id").withColumnRenamed("id", "tid")
    probed = near.join(points, "cell").select("qid", "tid").collect()
    second = spark.createDataFrame(
        [
            (p.qid, p.tid, float(np.sqrt(((q[p.qid] - t[p.tid]) ** 2)[0] + ((q[p.qid] - t[p.tid]) ** 2)[1])))
            for p in probed
        ],
        "qid bigint, tid bigint, dist double",
    )
    merged = rows(nf.merge_topk(first, second, 5))
    full = {r for r in brute_force(range(60), q, range(600), t, 5)}
    have = {r.qid for r in radius.collect()}
    assert have and {r for r in merged if r[0] in have} == {r for r in full if r[0] in have}


def test_plan_of_the_join(spark):
    rng = np.random.default_rng(26)
    qf, tf = frame(spark, range(200), uniform(rng, 200, 2)), frame(spark, range(900), uniform(rng, 900, 2))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    nf.configure(spark)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = nf.aknn_join(qf, tf, 5, method="ps", unique_ids=True)
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert word not in plan
    assert "WindowGroupLimit" in plan
    # Above the shuffle by tile neither the candidates nor the ranking are shuffled again.
    assert "Exchange hashpartitioning(qid" not in plan
    assert ", qid" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_nothing_within_reach(spark, tmp_path):
    left, right = frame(spark, [1, 2], [[0.1, 0.1], [0.15, 0.1]]), frame(spark, [7], [[0.9, 0.9]])
    assert nf.radius_join(left, right, 0.01).count() == 0
    assert nf.local_knn(left, right, 2, n=4).count() == 0
    leaves = nf.build_leaves(left.union(right), capacity=1)
    assert nf.local_knn(left, right, 2, leaves=leaves).count() == 0
    overlaps = nf.overlaps_grid(left, right, 1, 4)
    assert [(r.qid, r.cell, r.complete) for r in overlaps.orderBy("qid").collect()] == [
        (1, 15, False),
        (2, 15, False),
    ]


@pytest.mark.parametrize("dims", [2, 3])
def test_range_cells_of_a_tree(spark, tiny_limits, dims):
    rng = np.random.default_rng(27)
    q, t = uniform(rng, 50, dims), clustered(rng, 500, dims)
    leaves = nf.build_leaves(frame(spark, range(500), t), capacity=20, dims=dims, max_depth=8)
    placed = nf.assign_tree(frame(spark, range(500), t), leaves, dims)
    cells = nf.occupied_cells(nf.cell_histogram(placed), leaves=leaves, dims=dims)
    radii = rng.random(50) ** 3
    radii[0] = 0.0
    table = spark.createDataFrame(
        [(i, *map(float, q[i]), float(radii[i])) for i in range(50)],
        "id bigint, " + ", ".join(f"{a} double" for a in "xyz"[:dims]) + ", r double",
    )
    got = nf.range_cells(table, cells, dims=dims).collect()
    expected = set()
    for box in leaves.filter("n_sample > 0").collect():
        lo = np.array([box[f"{a}min"] for a in "xyz"[:dims]])
        hi = np.array([box[f"{a}max"] for a in "xyz"[:dims]])
        for i in range(50):
            gap = np.maximum(np.maximum(lo - q[i], q[i] - hi), 0.0)
            if np.sqrt((gap * gap).sum()) <= radii[i]:
                expected.add((i, box.path))
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
