"""Work that has to grow with the tables and no faster."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest

import nearfield as nf
from nearfield.operators import leaves as leaves_module
from nearfield.plans import aknn, meet, overlaps, staging, within
from nearfield.plans.meet import PairCount
from nearfield.plans.pyramid import Extent
from nearfield.plans.staging import Stage
from tests.points import brute_force, frame, rows, uniform


def spread_ids(rng, ids=300, places=20):
    """Every id at places all over the square, so its smallest place says little about the others."""
    return np.repeat(np.arange(ids), places), uniform(rng, ids * places, 2)


@pytest.mark.parametrize("k", [4, 70])
def test_repeated_ids_do_not_widen_the_search(spark, k):
    rng = np.random.default_rng(1)
    ids, t = spread_ids(rng)
    q = uniform(rng, 100, 2)
    count = PairCount()
    joined = nf.aknn_join(frame(spark, range(100), q), frame(spark, ids, t), k, count=count)
    assert rows(joined) == brute_force(range(100), q, ids, t, k)
    # All would be 6,000 pairs a query.
    assert count.pairs <= 100 * (250 if k == 4 else 4500)


def test_overlap_cells_of_repeated_ids_start_from_the_own_list(spark, monkeypatch):
    rng = np.random.default_rng(2)
    ids, t = spread_ids(rng)
    q = frame(spark, range(100), uniform(rng, 100, 2) * 0.5 + 0.5)
    seen = []
    found = overlaps.candidate_leaves

    def counted(*args, **named):
        pairs = found(*args, **named)
        seen.append((pairs.count(), pairs.select("q_lvl", "q_cx", "q_cy").distinct().count()))
        return pairs

    monkeypatch.setattr(overlaps, "candidate_leaves", counted)
    cells = nf.overlaps_grid(q, frame(spark, ids, t), 4, 8)
    assert cells.select("qid").distinct().count() == 100
    pairs, nodes = seen[0]
    assert pairs <= 16 * nodes


def test_two_phases_with_ids_spread_over_the_square(spark):
    rng = np.random.default_rng(3)
    ids, t = spread_ids(rng, 60, 10)
    q = uniform(rng, 40, 2)
    got = nf.two_phase_join(frame(spark, range(40), q), frame(spark, ids, t), 5, n=6)
    assert rows(got) == brute_force(range(40), q, ids, t, 5)


@pytest.mark.parametrize("policy", ["capacity", "all_children", "avg_width"])
def test_prefix_counts_are_never_broadcast(spark, policy, tmp_path):
    points = frame(spark, range(500), uniform(np.random.default_rng(4), 500, 3))
    points.write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    tree = nf.build_leaves(points, capacity=20, dims=3, policy=policy, max_depth=16)
    assert "BroadcastHashJoin" not in tree._jdf.queryExecution().executedPlan().toString()
    assert leaves_module.tree_stats(tree).first().n_sample == 500


def test_partitions_follow_the_queries(spark, monkeypatch):
    monkeypatch.setattr(meet, "COUNTED_ROWS", 100)
    monkeypatch.setattr(meet, "PARTITION_ROWS", 50)
    rng = np.random.default_rng(5)
    q, t = uniform(rng, 500, 2), uniform(rng, 300, 2)
    joined = nf.aknn_join(frame(spark, range(500), q), frame(spark, range(300), t), 3)
    assert joined.rdd.getNumPartitions() == 10
    assert rows(joined) == brute_force(range(500), q, range(300), t, 3)


@pytest.mark.parametrize("dims", [2, 3])
def test_leaves_of_a_radius_join_grow_with_the_density(spark, dims):
    side = (0.0,) * dims, (1.0,) * dims
    few, many = (within.leaf_capacity(Extent(n, *side), 0.05, dims) for n in (1_000, 10_000_000))
    assert few == within.LEAF_CAPACITY and many > 10 * few
    rng = np.random.default_rng(6)
    q, t = uniform(rng, 60, dims), uniform(rng, 3000, dims)
    apart = np.zeros((60, 3000))
    for axis in range(dims):
        d = q[:, None, axis] - t[None, :, axis]
        apart = apart + d * d
    for method in ("bf", "ps"):
        got = nf.radius_join(frame(spark, range(60), q), frame(spark, range(3000), t), 0.3, method=method)
        assert got.count() == (np.sqrt(apart) <= 0.3).sum()


def test_crowded_keys_of_range_cells_are_dealt_over_parts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    q, t = frame(spark, range(200), uniform(rng, 200, 2)), frame(spark, range(400), uniform(rng, 400, 2))
    cells = nf.occupied_cells(nf.cell_histogram(nf.assign_grid(t, 20)), n=20)
    asked = q.selectExpr("*", "cast(0.1 as double) as r")
    plain = rows(nf.range_cells(asked, cells, n=20))
    monkeypatch.setattr(overlaps, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(overlaps, "KEY_PAIRS", 50)
    look = overlaps._parted
    parts = []

    def noted(*args):
        left, right = look(*args)
        parts.append(left.agg({"part": "max"}).first()[0])
        return left, right

    monkeypatch.setattr(overlaps, "_parted", noted)
    assert rows(nf.range_cells(asked, cells, n=20)) == plain
    assert parts[0] > 0


def test_a_partition_has_many_tiles_however_many_queries(spark):
    for rows in (10**6, 10**8):
        queries = SimpleNamespace(rows=rows, nodes=spark.range(1))
        assert meet.PARTITION_ROWS >= meet.TILES_PER_PARTITION * meet.tile_rows(queries)
    tiles = spark.range(1000).withColumnRenamed("id", "tile")
    queries = SimpleNamespace(rows=10**6, nodes=tiles)
    assert meet.by_tile(tiles, queries).rdd.getNumPartitions() == 10**6 // meet.PARTITION_ROWS


def test_tasks_hold_few_queries_from_small_tables_on(spark):
    tiles = spark.range(1000).withColumnRenamed("id", "tile")
    for rows in (30_000, 90_000, 10**6):
        parts = meet.by_tile(tiles, SimpleNamespace(rows=rows, nodes=tiles)).rdd.getNumPartitions()
        assert rows / parts <= 7_500


@pytest.mark.parametrize("crowd", [10**6, 20])
@pytest.mark.parametrize("dims", [2, 3])
def test_places_of_an_id_meet_few_points_at_once(spark, monkeypatch, dims, crowd):
    monkeypatch.setattr(aknn, "MANY_PLACES", crowd, raising=False)
    saved, save = [], Stage.save_with
    monkeypatch.setattr(Stage, "save_with", lambda s, df, name, *f: saved.append(name) or save(s, df, name, *f))
    rng = np.random.default_rng(9)
    ids = np.concatenate([np.repeat(np.arange(30), 6), np.zeros(40, dtype=int)])
    q, t = uniform(rng, len(ids), dims), uniform(rng, 25, dims)
    at = np.arange(25) % 20  # some training ids at two places
    count = PairCount()
    joined = nf.aknn_join(frame(spark, ids, q), frame(spark, at, t), 5, exclude_self=True, count=count)
    want = []
    for i in range(30):
        dist = {}
        for a in q[ids == i]:
            for tid, b in zip(at.tolist(), t, strict=True):
                total = 0.0
                for x, y in zip(a, b, strict=True):
                    total += (x - y) * (x - y)
                if tid != i:
                    dist[tid] = min(dist.get(tid, np.inf), float(np.sqrt(total)))
        best = sorted((d, tid) for tid, d in dist.items())[:5]
        want += [(i, r, tid, d) for r, (d, tid) in enumerate(best, 1)]
    assert rows(joined) == set(want)
    assert count.pairs == len(ids) * 25
    assert "query-places" not in saved


def test_tiles_get_the_points_of_visited_leaves_by_one_shuffle(spark, monkeypatch):
    seen = {}

    def noted(module, name):
        made = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **named: seen.setdefault(name, made(*a, **named)))

    noted(aknn, "query_visits")
    noted(meet, "_members")
    monkeypatch.setattr(meet, "TILE_ROWS", 20)
    rng = np.random.default_rng(12)
    q, t = uniform(rng, 300, 3), uniform(rng, 3000, 3)
    joined = nf.aknn_join(frame(spark, range(300), q), frame(spark, range(3000), t), 4, method="ps")
    assert rows(joined) == brute_force(range(300), q, range(3000), t, 4)
    leaf = ["tile", "t_lvl", "t_cx", "t_cy", "t_cz"]
    copies, visited = (rows(seen[name].select(*leaf).distinct()) for name in ("_members", "query_visits"))
    assert copies == visited
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        plan = joined.filter("rank > 0")._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    reused = [line for line in plan.splitlines() if "ReusedExchange" in line]
    assert sum("tid#" in line for line in reused) == 1
    assert sum("t_rows#" in line for line in reused) == 2


def test_large_sides_are_not_broadcast_for_the_size_of_their_files(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(13)
    q, t = uniform(rng, 400, 2), uniform(rng, 3000, 2)
    for name, points in (("q", q), ("t", t)):
        frame(spark, range(len(points)), points).write.parquet(str(tmp_path / name))
    made, members = [], meet._members
    monkeypatch.setattr(meet, "_members", lambda *a: made.append(members(*a)) or made[-1])
    monkeypatch.setattr(staging, "BROADCAST_ROWS", 0)
    sides = [spark.read.parquet(str(tmp_path / name)) for name in ("q", "t")]
    joined = nf.aknn_join(*sides, 4)
    assert rows(joined) == brute_force(range(400), q, range(3000), t, 4)
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("dims, own", [(2, False), (2, True), (3, False)])
def test_points_of_a_radius_join_go_to_few_tiles(spark, monkeypatch, dims, own):
    made, members = [], meet._members
    monkeypatch.setattr(meet, "_members", lambda *a: made.append(members(*a)) or made[-1])
    monkeypatch.setattr(meet, "TILE_ROWS", 1)
    monkeypatch.setattr(within, "LEAF_CAPACITY", 4)
    monkeypatch.setattr(within, "COUNTED_ROWS", 100, raising=False)
    rng = np.random.default_rng(14)
    q, t = uniform(rng, 4000, dims), uniform(rng, 2000, dims)
    far = 0.002 + 0.04 * q[:, 0] * q[:, 0] if own else np.full(4000, 0.02 if dims == 2 else 0.06)
    apart = np.zeros((4000, 2000))
    for axis in range(dims):
        d = q[:, None, axis] - t[None, :, axis]
        apart = apart + d * d
    asked = frame(spark, range(4000), q)
    if own:
        asked = asked.selectExpr("*", "cast(0.002 as double) + cast(0.04 as double) * x * x as far")
    got = nf.radius_join(asked, frame(spark, range(2000), t), "far" if own else float(far[0]))
    near = np.argwhere(np.sqrt(apart) <= far[:, None])
    assert rows(got.select("qid", "tid")) == {(int(a), int(b)) for a, b in near}
    assert got.count() == len(near)
    assert made[0].count() <= 12 * len(t)


def test_query_nodes_of_a_radius_join_grow_with_the_radius(spark, monkeypatch):
    made, tiled = [], within.tile_candidates
    monkeypatch.setattr(within, "tile_candidates", lambda *a: made.append(tiled(*a)) or made[-1])
    monkeypatch.setattr(within, "QUERY_CAPACITY", 4)
    rng = np.random.default_rng(15)
    q, t = uniform(rng, 4000, 3), uniform(rng, 300, 3)
    apart = np.zeros((4000, 300))
    for axis in range(3):
        d = q[:, None, axis] - t[None, :, axis]
        apart = apart + d * d
    got = nf.radius_join(frame(spark, range(4000), q), frame(spark, range(300), t), 0.2)
    assert got.count() == (np.sqrt(apart) <= 0.2).sum()
    assert made[0].node_count <= 700
