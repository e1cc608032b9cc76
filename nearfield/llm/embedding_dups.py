"""Embedding near-dedup: exact cosine links by a PCA-ordered, tiled comparison.

Unit vectors are rotated onto the principal axes of the whole table, so that most of a product comes
from its first terms. Blocks of about ``BLOCK`` vectors follow the first axis; two blocks whose
ranges there lie further apart than linked unit vectors can are never brought together. A pair of
blocks is compared tile by tile: products are accumulated a few axes at a time, what is still to come
is bounded by the product of the vectors' suffix norms, rows and columns that cannot reach the
threshold any more drop out, and the rest is finished in double precision.

Equal vectors are compared once and counted with their multiplicity. A block pair gives a row for each
linked vector (links found, and the smallest member of its local component), never a row per link.

Vectors of different lengths do not link; each length has axes and blocks of its own. Null and empty
vectors, zero vectors, vectors with null or non-finite components, and rows with a null id, link with nothing. Rows that share an id are one node of a component; each
row has its own vector's links. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.components import components
from nearfield.plans.staging import Stage

THRESHOLD = 0.9
BLOCK = 4096
TILE = 1024
STEPS = 8  # parts in which the axes are accumulated
SPARSE = 0.02  # share of pairs below which they are finished one by one
SLACK = 1e-9  # far above the rounding of a product of unit vectors


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, unit = batch.column("id"), []
        for row, value in enumerate(batch.column("embedding")):
            vector = np.array(value.as_py() or [], dtype=np.float64)
            unit.append(None)
            if not len(vector) or not ids[row].is_valid or not np.isfinite(vector).all():
                continue
            largest = np.abs(vector).max()
            if largest > 0:
                vector = vector / largest
                unit[-1] = (vector / np.linalg.norm(vector) + 0.0).astype("<f8").tobytes()
        yield pa.RecordBatch.from_pydict({"id": ids, "unit": pa.array(unit, pa.binary())})


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, length)


def principal_axes(units: DataFrame, length: int) -> np.ndarray:
    """Columns are the axes of the unit vectors' second moments, by falling share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, length))
        for batch in batches:
            x = _matrix(batch.column("unit"), length)
            total += x.T @ x
        cell = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "v": pa.array(total.ravel()[cell])})

    rows = units.select("unit").mapInArrow(run, "cell long, v double")
    table = rows.groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    moments = np.zeros(length * length)
    moments[table["cell"].to_numpy(dtype=np.int64)] = table["v"].to_numpy(dtype=float)
    moments = moments.reshape(length, length)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]


def _rotated(axes, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column("unit"), length) @ axes.value
            yield pa.RecordBatch.from_pydict(
                {
                    "node": batch.column("node"),
                    "n": batch.column("n"),
                    "along": pa.array(np.ascontiguousarray(y[:, 0])),
                    "y": pa.array([r.astype("<f8").tobytes() for r in y], pa.binary()),
                }
            )

    return run


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (in a, in b) with a product of at least ``threshold``.

    Columns are accumulated in order; a pair is given up once its product so far plus the product of
    both suffix norms is below the threshold.
    """
    length = a.shape[1]
    stops = np.unique(np.linspace(0, length, STEPS + 1).astype(int))[1:]
    suffix = lambda x: np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], 0))
    tail_a, tail_b = (np.hstack([suffix(x), np.zeros((len(x), 1))]) for x in (a, b))
    rows, columns = np.arange(len(a)), np.arange(len(b))
    product, at = np.zeros((len(a), len(b))), 0
    for stop in stops:
        product += a[rows, at:stop] @ b[columns, at:stop].T
        at = stop
        alive = product + np.outer(tail_a[rows, stop], tail_b[columns, stop]) >= threshold - SLACK
        count = np.count_nonzero(alive)
        if not count:
            return rows[:0], columns[:0]
        if stop == length or count <= SPARSE * alive.size:
            break
        live_rows, live_columns = alive.any(axis=1), alive.any(axis=0)
        if min(live_rows.mean(), live_columns.mean()) < 0.8:
            product = product[np.ix_(live_rows, live_columns)]
            rows, columns = rows[live_rows], columns[live_columns]
    i, j = np.nonzero(alive)
    i, j = rows[i], columns[j]
    exact = np.concatenate(
        [np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
    )
    return i[exact >= threshold], j[exact >= threshold]


def _local_roots(n: int, i: np.ndarray, j: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each of n vertices, the smallest name it reaches over edges (i, j)."""
    root = name.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        if (root == before).all():
            return root


def compare_blocks(
    a: np.ndarray, b: np.ndarray | None, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs between two blocks, or within one (each pair once), tile by tile."""
    for lo in range(0, len(a), TILE):
        if b is None:
            for other in range(lo, len(a), TILE):
                i, j = linked_pairs(a[lo : lo + TILE], a[other : other + TILE], threshold)
                once = (i < j) if other == lo else slice(None)
                yield i[once] + lo, j[once] + other
        else:
            for other in range(0, len(b), TILE):
                i, j = linked_pairs(a[lo : lo + TILE], b[other : other + TILE], threshold)
                yield i + lo, j + other


def _links(length: int, threshold: float):
    def found(place, group):
        nodes = np.array([r[1] for r in group], dtype=np.int64)
        n = np.array([r[2] for r in group], dtype=np.int64)
        y = np.frombuffer(b"".join(r[3] for r in group), dtype="<f8").reshape(-1, length)
        right = np.array([r[0] for r in group], dtype=bool)
        if place[0] == place[1]:
            pairs = compare_blocks(y, None, threshold)
            parts = [(i, j) for i, j in pairs if len(i)]
        else:
            left_at, right_at = np.flatnonzero(~right), np.flatnonzero(right)
            if not len(left_at) or not len(right_at):
                return None
            pairs = compare_blocks(y[left_at], y[right_at], threshold)
            parts = [(left_at[i], right_at[j]) for i, j in pairs if len(i)]
        if not parts:
            return None
        count, root = np.zeros(len(nodes), dtype=np.int64), nodes
        for i, j in parts:
            count += np.bincount(i, weights=n[j], minlength=len(nodes)).astype(np.int64)
            count += np.bincount(j, weights=n[i], minlength=len(nodes)).astype(np.int64)
        i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
        root = _local_roots(len(nodes), i, j, nodes)
        some = count > 0
        return pa.RecordBatch.from_pydict(
            {"node": pa.array(nodes[some]), "links": pa.array(count[some]), "root": pa.array(root[some])}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, group = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != place:
                    if group and (out := found(place, group)):
                        yield out
                    place, group = row[:2], []
                group.append(row[2:])
        if group and (out := found(place, group)):
            yield out

    return run


def _placed(edges: np.ndarray, reach: float):
    """Each vector's block between the edges, and the blocks that begin or end within reach of that one."""
    lows, highs = np.append(-np.inf, edges), np.append(edges, np.inf)
    first = np.searchsorted(highs, lows - reach)
    last = np.searchsorted(lows, highs + reach, side="right") - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.searchsorted(edges, batch.column("along").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("node", "n", "y")),
                    *(pa.array(x, pa.int32()) for x in (own, first[own], last[own])),
                ],
                names=["node", "n", "y", "own", "first", "last"],
            )

    return run


def _in_blocks(vectors: DataFrame, count: int, threshold: float) -> DataFrame:
    """Rows (a, b, right, node, n, y): every vector in each pair of blocks that may link."""
    blocks = max(1, -(-count // BLOCK))
    shares = [i / blocks for i in range(1, blocks)]
    edges = []
    if shares:
        edges = vectors.select(F.percentile_approx("along", F.lit(shares), F.lit(100 * blocks)).alias("p"))
        edges = sorted(set(edges.first()["p"] or []))
    # Unit vectors with this cosine are at most so far apart, also along one axis.
    reach = np.sqrt(2 - 2 * threshold) + SLACK
    rows = vectors.mapInArrow(
        _placed(np.array(edges, dtype=np.float64), reach),
        "node long, n long, y binary, own int, first int, last int",
    )
    rows = rows.withColumn("other", F.explode(F.sequence("first", "last")))
    return rows.select(
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).alias("right"),
        "node", "n", "y",
    )


def _linked(stage: Stage, valid: DataFrame, kinds: DataFrame, length: int, threshold: float) -> DataFrame:
    """Rows (node, links, root) of the vectors of one length that have links."""
    axes = stage.spark.sparkContext.broadcast(principal_axes(valid, length))
    rotated, facts = stage.save_with(
        kinds.select(F.col("vector").alias("node"), "n", "unit").mapInArrow(
            _rotated(axes, length), "node long, n long, along double, y binary"
        ),
        f"rotated-{length}",
        F.count(F.lit(1)).alias("rows"),
    )
    pairs = _in_blocks(rotated, facts["rows"], threshold)
    pairs = pairs.repartition("a", "b").sortWithinPartitions("a", "b", "node")
    links = pairs.mapInArrow(_links(length, threshold), "node long, links long, root long")
    return stage.save(links, f"links-{length}")


def near_duplicate_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    stage = Stage(spark)
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("embedding")
    )
    units = stage.save(rows.mapInArrow(_units, "id long, unit binary"), "units")
    units = units.withColumn("vector", F.when(F.col("unit").isNotNull(), F.xxhash64("unit")))
    valid = units.filter("unit is not null")
    kinds = valid.groupBy("vector").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit")
    )
    lengths = valid.groupBy(F.expr("octet_length(unit) div 8").alias("d")).count().collect()
    found = None
    for length in sorted(r["d"] for r in lengths) or [1]:
        alike = F.octet_length("unit") == 8 * length
        links = _linked(stage, valid.filter(alike), kinds.filter(alike), length, threshold)
        found = links if found is None else found.unionByName(links)

    direct = found.groupBy("node").agg(F.sum("links").alias("links"))
    kinds = stage.save(kinds.select("vector", "least", "n"), "kinds")
    names = kinds.select(F.col("vector").alias("node"), "least")
    edges = found.select("node", "root").distinct().join(names.withColumnRenamed("least", "u"), "node")
    edges = edges.drop("node").join(names.withColumnsRenamed({"node": "root", "least": "v"}), "root")
    # All ids of a vector hang on its least id.
    same = valid.select("vector", "id").join(kinds, "vector").select(F.col("id").alias("u"), F.col("least").alias("v"))
    classes = components(edges.select("u", "v").unionByName(same), stage)

    out = units.select("id", "vector").join(kinds.select("vector", "n"), "vector", "left")
    out = out.join(direct.withColumnRenamed("node", "vector"), "vector", "left")
    out = out.join(classes, F.col("id") == F.col("node"), "left")
    component = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias(id_column),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
