"""Bottom-k sketches of word shingles: mergeable document fingerprints.

A fingerprint is the ``K`` smallest distinct 48-bit hashes of a text's five-word shingles, as base64.
Equal texts have equal fingerprints; the fingerprint of a union is made from the parts' fingerprints
alone. A text of one to four words has one shingle; a text without words (null counts as empty) has
the empty fingerprint, which is 1 like itself and 0 like any other.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.words import slices

K = 128
HASH_BYTES = 6
_SPACE = float(1 << 8 * HASH_BYTES)


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct values, ascending."""
    take = 2 * k
    while len(hashes) > take:
        small = np.unique(np.partition(hashes, take)[:take])
        if len(small) >= k:
            return small[:k]
        take *= 4
    return np.unique(hashes)[:k]


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sketch of every whole text of a column."""
    out = []
    for part in slices(texts):
        grams, first = part.shingles()
        grams >>= np.uint64(64 - 8 * HASH_BYTES)
        out += [bottom_k(grams[first[i] : first[i + 1]], k) for i in range(len(part))]
    return out


def encode(sketch: np.ndarray) -> str:
    raw = np.ascontiguousarray(sketch, dtype=">u8").view(np.uint8).reshape(-1, 8)
    return base64.b64encode(raw[:, 8 - HASH_BYTES :].tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, HASH_BYTES)
    full = np.zeros((len(raw), 8), dtype=np.uint8)
    full[:, 8 - HASH_BYTES :] = raw
    return full.view(">u8").ravel().astype(np.uint64)


def merged(parts: Sequence[np.ndarray], k: int = K) -> np.ndarray:
    return bottom_k(np.concatenate(parts), k) if parts else np.zeros(0, dtype=np.uint64)


def distinct_count(sketch: np.ndarray, k: int = K) -> float:
    """Distinct shingles; exact below ``k``."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) * _SPACE / (float(sketch[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Shared part of the union's shingles (Jaccard), from the union's own sketch."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    # The union's sketch is the smallest k values of both sketches.
    union = merged([a, b], k)
    return float(np.searchsorted(both, union[-1], side="right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Part of ``a``'s shingles that ``b`` has too."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return 1.0 if not na else min(1.0, j * (na + nb) / ((1 + j) * na))


def fingerprint_texts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K
) -> DataFrame:
    """One row per document: id, ``fingerprint`` and estimated ``n_shingles``. Order is free, repeated
    rows and ids are fingerprinted each; other columns are ignored."""
    docs = docs.select(id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column(text_column), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_column),
                    pa.array([encode(s) for s in found], pa.string()),
                    pa.array([distinct_count(s, k) for s in found], pa.float64()),
                ],
                names=[id_column, "fingerprint", "n_shingles"],
            )

    return docs.mapInArrow(run, f"`{id_column}` {kind}, fingerprint string, n_shingles double")


def merge_fingerprints(
    rows: DataFrame, key: str, column: str = "fingerprint", k: int = K
) -> DataFrame:
    """The fingerprint of all texts of each key. Hashes are made distinct before they meet, and every
    task passes on at most ``k`` of a key, so no key is gathered whole. Null fingerprints add nothing."""
    size = HASH_BYTES
    raw = F.unbase64(F.col(column))
    n = (F.length(raw) / size).cast("int")
    places = F.sequence(F.lit(0), n - 1)
    hashes = F.when(n > 0, F.transform(places, lambda i: raw.substr(i * size + 1, F.lit(size))))
    flat = rows.select(F.col(key), F.explode_outer(hashes).alias("h")).distinct()
    first = Window.partitionBy(key).orderBy(F.col("h").asc_nulls_last())
    kept = flat.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k)
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list("h")), F.hex))
    text = F.translate(F.base64(F.unhex(joined)), "\r\n", "")
    return kept.groupBy(key).agg(text.alias(column))


# --- documents next to each other -----------------------------------------------------

_LEAST = -(1 << 63)


def _bucket_edges(docs: DataFrame, key: Column, n: int) -> list[int]:
    """Ascending ids that part the rows into about equal buckets."""
    shares = [i / n for i in range(1, n)]
    if not shares:
        return []
    row = docs.select(F.percentile_approx(key, F.lit(shares), F.lit(100 * n)).alias("p")).first()
    return sorted(set(row["p"] or []))


def with_next(docs: DataFrame, id_column: str, text_column: str, buckets: int) -> DataFrame:
    """Rows (bucket, guard, id, text), one bucket in one partition and sorted, in which every row that
    is no guard is followed by its next document.

    The order is descending id (nulls last), then ascending text. A bucket ends with a guard: the
    first document of the bucket after it, or of the first bucket after the last one. Only the largest
    id of each bucket passes the driver.
    """
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(_LEAST))
    docs = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), key.alias("key")
    )
    edges = _bucket_edges(docs, F.col("key"), buckets)
    index = F.aggregate(
        F.lit(edges).cast("array<bigint>"), F.lit(0), lambda n, e: n + (e <= F.col("key")).cast("int")
    )
    docs = docs.withColumn("bucket", index)
    tops = sorted(
        (r["bucket"], r["top"])
        for r in docs.groupBy("bucket").agg(F.max("key").alias("top")).collect()
    )
    # The rows with a bucket's largest id also guard the next larger bucket (after the smallest: the largest).
    guards = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    if guards:
        pairs = F.create_map(*[F.lit(x) for pair in guards.items() for x in pair])
        extra = F.element_at(pairs, F.col("key"))
    else:
        extra = F.lit(None).cast("int")
    places = F.array_compact(
        F.array(
            F.struct(F.col("bucket"), F.lit(False).alias("guard")),
            F.when(extra.isNotNull(), F.struct(extra.alias("bucket"), F.lit(True).alias("guard"))),
        )
    )
    rows = docs.select("id", "text", "key", F.explode(places).alias("p"))
    rows = rows.select("p.bucket", "p.guard", "id", "key", "text")
    return rows.repartition(max(1, buckets // 4), "bucket").sortWithinPartitions(
        "bucket", "guard", F.col("key").desc(), "text"
    )


EDIT_SCHEMA = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, n_shingles double, in_next double"
)


def _edit_batches(k: int, rows_at_once: int = 256, chars_at_once: int = 1 << 20):
    def described(waiting):
        """Rows of the first of each pair (id, text, next text)."""
        texts = [t for _, t, _ in waiting]
        following = [t for _, _, t in waiting]
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
        own, new, after = (
            sketches(pa.array(x, pa.large_string()), k) for x in (texts, edited, following)
        )
        columns = [
            pa.array([i for i, _, _ in waiting], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([encode(s) for s in own], pa.string()),
            pa.array([encode(s) for s in new], pa.string()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, new, strict=True)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, after, strict=True)], pa.float64()),
            pa.array([distinct_count(s, k) for s in own], pa.float64()),
            pa.array([containment(a, b, k) for a, b in zip(own, after, strict=True)], pa.float64()),
        ]
        names = ["doc_id", *[f.split()[0] for f in EDIT_SCHEMA.split(", ")]]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, waiting, chars = None, [], 0
        for batch in batches:
            flags = zip(*[batch.column(c).to_pylist() for c in ("bucket", "guard", "id")], strict=True)
            texts = batch.column("text")
            for i, (bucket, guard, doc) in enumerate(flags):
                text = texts[i].as_py()
                if before and before[0] == bucket:
                    waiting.append((before[1], before[2], text))
                    chars += len(before[2]) + len(text)
                    if chars >= chars_at_once or len(waiting) >= rows_at_once:
                        yield described(waiting)
                        waiting, chars = [], 0
                before = None if guard else (bucket, doc, text)
        if waiting:
            yield described(waiting)

    return run


def fingerprint_edits(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K
) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text ends with the next document's beginning (see ``with_next``) in place of its own
    last half; the only document is next to itself. Ids that occur twice are ordered by text.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, id_column, text_column, buckets)
    out = rows.select("bucket", "guard", "id", "text").mapInArrow(
        _edit_batches(k), "doc_id long, " + EDIT_SCHEMA
    )
    return out if id_column == "doc_id" else out.withColumnRenamed("doc_id", id_column)
