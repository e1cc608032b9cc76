"""Point sets and a brute-force reference, both plain numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd

AXES = ("x", "y", "z")


def frame(spark, ids, coords):
    coords = np.asarray(coords, dtype=float)
    columns = {"id": np.asarray(ids, dtype="int64")}
    columns |= {a: coords[:, i] for i, a in enumerate(AXES[: coords.shape[1]])}
    schema = "id bigint, " + ", ".join(f"{a} double" for a in AXES[: coords.shape[1]])
    if not len(coords):
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(pd.DataFrame(columns), schema)


def brute_force(q_ids, q, t_ids, t, k, exclude_self=False):
    """Set of (qid, rank, tid, dist), ties to the smaller id, each id at its nearest place."""
    out = set()
    q, t = np.asarray(q, float), np.asarray(t, float)
    t_ids = np.asarray(t_ids)
    for qid, p in zip(q_ids, q, strict=True):
        total = np.zeros(len(t))
        for axis in range(q.shape[1]):
            d = p[axis] - t[:, axis]
            total = total + d * d
        best: dict[int, float] = {}
        for tid, dist in zip(t_ids.tolist(), np.sqrt(total).tolist(), strict=True):
            if not (exclude_self and tid == qid):
                best[tid] = min(dist, best.get(tid, np.inf))
        ranked = sorted((dist, tid) for tid, dist in best.items())[:k]
        out |= {(int(qid), r, tid, dist) for r, (dist, tid) in enumerate(ranked, start=1)}
    return out


def rows(df):
    return {tuple(r) for r in df.collect()}


def uniform(rng, n, dims):
    return rng.random((n, dims))


def clustered(rng, n, dims):
    """Tight clusters of very different scales over a thin background."""
    centres = rng.random((4, dims)) * 0.8 + 0.1
    scale = np.array([1e-1, 1e-3, 1e-5, 1e-7])
    which = rng.integers(0, 4, n)
    points = centres[which] + rng.normal(size=(n, dims)) * scale[which][:, None] * 0.1
    loose = rng.random(n) < 0.05
    points[loose] = rng.random((int(loose.sum()), dims))
    return np.clip(points, 0.0, 1.0 - 1e-9)


def piled(rng, n, dims):
    """A third of all points on one position, the rest on a lattice of cell borders."""
    points = rng.integers(0, 10, (n, dims)) / 10.0
    points[: n // 3] = 0.3
    return points
