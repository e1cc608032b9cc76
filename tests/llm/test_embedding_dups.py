from __future__ import annotations

import math

import numpy as np
import pytest

from nearfield.llm import embedding_dups as dups

SCHEMA = "vec_id long, embedding array<float>, n int, unit string"


def brute(rows):
    good = []
    for at, (name, v) in enumerate(rows):
        if name is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = np.array(v, dtype=np.float32).astype(float)
        if np.abs(x).max() > 0:
            good.append((at, x / np.linalg.norm(x)))
    links = {at: 0 for at in range(len(rows))}
    root = {name: name for name, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(good):
        for b, y in good[:i]:
            if len(x) == len(y) and x @ y >= 0.9:
                links[a] += 1
                links[b] += 1
                p, q = find(rows[a][0]), find(rows[b][0])
                if p != q:
                    root[max(p, q)] = min(p, q)
    return [(name, links[at], find(name) if name is not None else None) for at, (name, _) in enumerate(rows)]


def vectors(seed, n, d, noise):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, d))
    out = []
    for i in range(n):
        x = centres[rnd.integers(12)] + noise * rnd.normal(size=d) if rnd.random() < 0.7 else rnd.normal(size=d)
        out.append([float(t) for t in x.astype(np.float32)])
    return list(zip(rnd.permutation(10 * n)[:n].tolist(), out, strict=True))


def run(spark, rows):
    table = spark.createDataFrame([(*r, 1, "u") for r in rows], SCHEMA)
    got = dups.near_duplicate_vectors(table).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str)


@pytest.mark.parametrize(("block", "tile", "noise"), [(4096, 1024, 0.2), (40, 16, 0.25), (17, 5, 0.3)])
def test_same_as_all_pairs(spark, monkeypatch, block, tile, noise):
    monkeypatch.setattr(dups, "BLOCK", block)
    monkeypatch.setattr(dups, "TILE", tile)
    rows = vectors(block, 240, 16, noise)
    copies = [(100_000 + i, rows[0][1]) for i in range(60)]
    scaled = [(200_000, [4 * x for x in rows[1][1]])]
    odd = [
        (300_000, None), (300_001, []), (300_002, [0.0] * 16), (300_003, [1.0] * 15 + [None]),
        (300_004, [1.0] * 15 + [math.nan]), (300_005, [math.inf] * 16), (300_006, [1.0, 2.0]),
        (None, rows[0][1]), (rows[2][0], rows[3][1]),
    ]
    rows = rows + copies + scaled + odd
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_every_length_links(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [0.0, 1.0]), (4, [1.0, 2.0, 0.0]), (5, [1.0, 2.0, 0.0]), (6, [1.0])]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_partners_are_all_blocks_in_reach():
    rnd = np.random.default_rng(8)
    for reach in (0.0, 0.1, 0.447, 3.0):
        edges = np.sort(rnd.uniform(-1, 1, 30))
        batch = dups.pa.RecordBatch.from_pydict(
            {"node": list(range(31)), "n": [1] * 31, "along": [*edges, 1.0], "y": [b""] * 31}
        )
        lows, highs = [-np.inf, *edges], [*edges, np.inf]
        for row in next(dups._placed(edges, reach)([batch])).to_pylist():
            a = row["own"]
            near = [b for b in range(31) if lows[b] - highs[a] <= reach and lows[a] - highs[b] <= reach]
            assert list(range(row["first"], row["last"] + 1)) == near


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(7, [1.0, 2.0])]) == [(7, 0, 7)]
    assert run(spark, [(7, None)]) == [(7, 0, 7)]


def test_pairs_near_the_threshold():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 24)) * np.linspace(3, 0.2, 24)
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = dups.linked_pairs(x, x, 0.9)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(x @ x.T >= 0.9)), strict=True))
