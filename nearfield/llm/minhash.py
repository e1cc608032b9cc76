"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

Texts are bags of five-word shingles. A shingle weighs its count times 1 + ln((1+N)/(1+df)) / ln(1+N),
between 1 and 2, so edits to text that many documents share are not blown up. ``df`` is counted for
every shingle over the whole corpus and staged. Links are decided by these exact counts, which are
joined to the texts that have candidates. Samples only find candidates: they know the exact ``df`` of
the ``FREQUENT`` most frequent shingles at most (those with at least 1/``FREQUENT`` of all rows, so no
more can exist), which is broadcast, and take the rest as unique.

1. Equal texts become one class; its smallest id stands for it from here on.
2. ``BANDS * ROWS`` samples of every text are drawn; two texts agree in one with the probability of
   their weighted Jaccard similarity. Texts that agree in all samples of a band share a bucket. The
   random triples of a sample come from a fixed table that the shingle's hash addresses.
3. In each bucket, the text with the most company over all its buckets is the hub, and the others are
   compared with it: as many pairs as members. Pairs are verified by exact weighted Jaccard
   similarity of whole texts, and links at or above the threshold make components.
4. In buckets that still hold texts of several components, each text outside the bucket's main
   component is compared with all texts of other components. Pairs are left out that cannot be alike
   (a shingle that no other text of these buckets has is in no overlap, so what remains of either
   text bounds it), and those whose samples agree in less than ``LEAST_AGREEMENT`` of all (for a
   pair at the threshold, four standard deviations below what is expected). Crowded buckets are
   split over tasks. Components are then taken of all links.

A text of one to four words has one shingle. Null texts, and texts without words, are in no one's
class but their own; rows with a null id get a null class. Rows that share an id share a class. Only
id and text are read, so other columns cannot clash; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.components import components
from nearfield.llm.words import mix, slices
from nearfield.llm.steps import Steps

THRESHOLD = 0.8
BANDS = 16
ROWS = 6
FREQUENT = 1 << 18
DF_BUCKETS = 1 << 18  # for counts of a few texts by hash, with which all pairs are compared
PARTS = 1 << 12  # ranges of hashes that are counted apart
HELD = 1 << 20  # hashes that a task gathers before it sends them
TRIPLES = 1 << 16
LEAST_AGREEMENT = 0.64
BUCKET_ROWS = 4000

_U = np.uint64


def _triples() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(20)
    r = rnd.gamma(2, 1, TRIPLES)
    c = rnd.gamma(2, 1, TRIPLES)
    return tuple(x.astype(np.float32) for x in (r, np.log(c), rnd.random(TRIPLES)))


_R, _LOG_C, _BETA = _triples()
_SALTS = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U)) | _U(1)


# --- weights --------------------------------------------------------------------------


def _bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes and their counts, text by text."""
    for part in slices(texts):
        grams, first = part.shingles()
        for i in range(len(part)):
            yield np.unique(grams[first[i] : first[i + 1]], return_counts=True)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - DF_BUCKETS.bit_length() + 1)).astype(np.int64)


def _packed(cut: np.ndarray, values: np.ndarray) -> pa.Array:
    """``values[cut[i]:cut[i + 1]]`` as binary rows."""
    offsets = (cut * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, hashes, counts, texts): document frequencies within some texts, by hash range."""
    edges = np.arange(PARTS, dtype=_U) << _U(64 - PARTS.bit_length() + 1)
    held, size, texts = [], 0, 0

    def sums():
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        cut = np.append(np.searchsorted(hashes, edges), len(hashes))
        used = np.diff(cut) > 0
        used[0] = True  # its row has the number of texts
        seen = np.zeros(PARTS, dtype=np.int64)
        seen[0] = texts
        return pa.RecordBatch.from_pydict(
            {
                "part": pa.array(np.arange(PARTS, dtype=np.int32)),
                "hashes": _packed(cut, hashes),
                "counts": _packed(cut, counts.astype("<u4")),
                "texts": pa.array(seen),
            }
        ).filter(pa.array(used))

    for batch in batches:
        for hashes, _ in _bags(batch.column("text")):
            held.append(hashes)
            size, texts = size + len(hashes), texts + 1
            if size >= HELD:
                yield sums()
                held, size, texts = [], 0, 0
    if held:
        yield sums()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each part, which come sorted by part; only shingles of several texts stay."""
    place, held = None, []

    def sums():
        hashes = np.frombuffer(b"".join(r[0] for r in held), dtype=_U)
        counts = np.frombuffer(b"".join(r[1] for r in held), dtype="<u4").astype(np.int64)
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        total = int(counts.sum())
        if len(hashes):
            starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            hashes, counts = hashes[starts], np.add.reduceat(counts, starts)
        often = counts > 1
        return pa.RecordBatch.from_pydict(
            {
                "hashes": pa.array([hashes[often].tobytes()], pa.binary()),
                "counts": pa.array([counts[often].tobytes()], pa.binary()),
                "total": pa.array([total], pa.int64()),
                "texts": pa.array([sum(r[2] for r in held)], pa.int64()),
            }
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "hashes", "counts", "texts")]
        for part, *row in zip(*columns, strict=True):
            if part != place and held:
                yield sums()
                held = []
            place = part
            held.append(row)
    if held:
        yield sums()


def _unpacked(least: int, below: int | None):
    """Rows (h, n) of the shingles whose document frequency is in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(batch.column("hashes"), batch.column("counts"), strict=True):
                h, n = (np.frombuffer(x.as_buffer(), dtype=np.int64) for x in (hashes, counts))
                keep = n >= least if below is None else (n >= least) & (n < below)
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[keep]), "n": pa.array(n[keep])})

    return run


@dataclass
class Frequencies:
    """The number of texts, and the document frequencies of the most frequent shingles, by hash."""

    texts: int
    hashes: np.ndarray
    counts: np.ndarray

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the shingles are among the most frequent, and the frequencies of all, else 1."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool), np.ones(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        return found, np.where(found, self.counts[at], 1)


def document_frequencies(docs: DataFrame, stage: Steps) -> tuple[Frequencies, DataFrame]:
    """What is broadcast, and rows (h, n) of all other shingles that several texts have."""
    rows = docs.select("text").mapInArrow(_ranges, "part int, hashes binary, counts binary, texts long")
    rows = rows.repartition("part").sortWithinPartitions("part")
    rows = rows.mapInArrow(_repeated, "hashes binary, counts binary, total long, texts long")
    rows = stage.save(rows, "frequencies")
    total, texts = rows.agg(F.sum("total"), F.sum("texts")).first()
    limit = max(2, -(-(total or 0) // FREQUENT))
    table = rows.mapInArrow(_unpacked(limit, None), "h long, n long").toArrow()
    hashes = table["h"].to_numpy().view(_U)
    order = np.argsort(hashes)
    most = Frequencies(texts or 0, hashes[order], table["n"].to_numpy()[order])
    return most, rows.mapInArrow(_unpacked(2, limit), "h long, n long")


def inverse(frequency: np.ndarray, texts: int) -> np.ndarray:
    """What one occurrence of a shingle weighs, by its document frequency."""
    n = max(2.0, 1.0 + texts)
    return (1 + np.log(n / (1 + np.minimum(frequency, n - 1))) / np.log(n)).astype(np.float32)


def idf_table(counts: np.ndarray) -> np.ndarray:
    return inverse(counts[:-1], counts[-1])


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of distinct shingles with their weights."""
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    wa, wb = wa.astype(np.float64), wb.astype(np.float64)
    total, both = wa.sum() + wb.sum(), np.minimum(wa[ia], wb[ib]).sum()
    return float(both / (total - both)) if total else 0.0


def weighted_jaccard(a: np.ndarray, b: np.ndarray, idf: np.ndarray) -> float:
    """Of two bags given as sorted hashes with repeats, by an ``idf_table``."""
    (ha, na), (hb, nb) = (np.unique(x, return_counts=True) for x in (a, b))
    return similarity(ha, na * idf[_bucket(ha)].astype(np.float64), hb, nb * idf[_bucket(hb)].astype(np.float64))


# --- samples --------------------------------------------------------------------------


def samples(hashes: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Consistent weighted samples (texts, BANDS * ROWS) of texts with at least one shingle each.

    The shingles of text i are ``first[i]:first[i + 1]``. A sample is a hash of the chosen shingle
    and its quantised weight.
    """
    begin, sizes = first[:-1], np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    log_w = np.log(weight)
    # Most shingles occur once and are not among the frequent: what they cost goes by the triple alone.
    kinds, seen = np.unique(log_w, return_counts=True)
    usual = kinds[seen.argmax()]
    usual_cost = _usual_cost(float(usual))
    other = np.flatnonzero(log_w != usual)
    other_w = log_w[other]
    key = np.empty(len(hashes), dtype=_U)
    cost = np.empty(len(hashes), dtype=np.float32)
    shift = _U(64 - TRIPLES.bit_length() + 1)
    out = np.empty((len(sizes), len(_SALTS)), dtype=np.uint32)
    for k, salt in enumerate(_SALTS):
        np.multiply(hashes, salt, out=key)
        np.right_shift(key, shift, out=key)
        at = key.view(np.int64)
        np.take(usual_cost, at, out=cost, mode="clip")
        if len(other):
            cost[other] = _levels(other_w, at[other])[1]
        least = np.minimum.reduceat(cost, begin)
        hit = np.flatnonzero(cost == np.repeat(least, sizes))
        level = _levels(log_w[hit], at[hit])[0]
        value = mix(hashes[hit] + level.astype(np.int64).astype(_U) * salt)
        starts = np.flatnonzero(np.diff(owner[hit], prepend=-1))
        out[:, k] = (np.minimum.reduceat(value, starts) >> _U(32)).astype(np.uint32)
    return out


def _levels(log_w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised log weights and costs of shingles by the triples they have."""
    r, beta = _R[at], _BETA[at]
    level = np.floor(log_w / r + beta)
    return level, _LOG_C[at] - r * (level - beta + 1)


@lru_cache(maxsize=4)
def _usual_cost(log_w: float) -> np.ndarray:
    """The cost of a shingle of one weight with each of the triples."""
    return _levels(np.full(TRIPLES, log_w, dtype=np.float32), np.arange(TRIPLES))[1]


def band_keys(sample: np.ndarray) -> np.ndarray:
    """A 64-bit key (texts, BANDS) of each band's samples."""
    n = len(sample)
    parts = sample.reshape(n, BANDS, ROWS).astype(_U)
    key = np.tile(np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15), (n, 1))
    for j in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def _signatures(most):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            digests = [hashlib.blake2b(t.as_buffer() if t.is_valid else b"", digest_size=16).digest() for t in texts]
            bags = _bags(texts)
            for at in range(0, len(batch), 64):
                some = [next(bags) for _ in range(min(64, len(batch) - at))]
                sizes = np.array([len(h) for h, _ in some])
                used = np.flatnonzero(sizes)
                drawn = [None] * len(some)
                if len(used):
                    hashes = np.concatenate([some[i][0] for i in used])
                    weight = inverse(most.value.known(hashes)[1], most.value.texts)
                    weight = np.concatenate([some[i][1] for i in used]).astype(np.float32) * weight
                    first = np.concatenate([[0], sizes[used].cumsum()])
                    for i, s in zip(used, samples(hashes, weight, first), strict=True):
                        drawn[i] = s.astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc": batch.column("doc").slice(at, len(some)),
                        "key": pa.array(digests[at : at + 64], pa.binary()),
                        "sample": pa.array(drawn, pa.binary()),
                    }
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        raw = b"".join(batch.column("sample").to_pylist())
        keys = band_keys(np.frombuffer(raw, dtype="<u4").reshape(len(batch), -1))
        docs = np.repeat(batch.column("doc").to_numpy(), BANDS)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(keys.ravel()), "doc": pa.array(docs)})


# --- verification ---------------------------------------------------------------------


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All shingle hashes of each text, sorted, with repeats."""
    for batch in batches:
        row = 0
        for part in slices(batch.column("text")):
            grams, first = part.shingles()
            bags = [np.sort(grams[first[i] : first[i + 1]]).tobytes() for i in range(len(part))]
            yield pa.RecordBatch.from_pydict(
                {"doc": batch.column("doc").slice(row, len(part)), "bag": pa.array(bags, pa.binary())}
            )
            row += len(part)


def _asked(most):
    """Rows (h, doc): the distinct shingles of each text whose frequency was not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, bag in zip(batch.column("doc").to_pylist(), batch.column("bag"), strict=True):
                hashes = np.unique(np.frombuffer(bag.as_buffer(), dtype=_U))
                hashes = hashes[~most.value.known(hashes)[0]]
                docs = np.full(len(hashes), doc, dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"h": pa.array(hashes.view(np.int64)), "doc": pa.array(docs)})

    return run


def _weighted(most):
    """Distinct shingles of each text, sorted, and their weights by exact document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"hashes": [], "weights": []}
            for bag, h, n in zip(*(batch.column(c) for c in ("bag", "h", "n")), strict=True):
                hashes, counts = np.unique(np.frombuffer(bag.as_buffer(), dtype=_U), return_counts=True)
                frequency = most.value.known(hashes)[1]
                if h.is_valid:
                    told = h.values.to_numpy().view(_U)
                    frequency[np.searchsorted(hashes, told)] = n.values.to_numpy()
                weight = counts.astype(np.float32) * inverse(frequency, most.value.texts)
                rows["hashes"].append(hashes.tobytes())
                rows["weights"].append(weight.tobytes())
            yield pa.RecordBatch.from_pydict(
                {"doc": batch.column("doc"), **{c: pa.array(x, pa.binary()) for c, x in rows.items()}}
            )

    return run


def _with_weights(bags: DataFrame, others: DataFrame, most) -> DataFrame:
    """Rows (doc, hashes, weights) of texts (doc, bag); ``others`` are the frequencies not broadcast.

    A shingle among them is in fewer than 1/``FREQUENT`` of all rows, so no key of the join is heavy.
    """
    told = bags.mapInArrow(_asked(most), "h long, doc long").join(others, "h")
    told = told.groupBy("doc").agg(F.collect_list(F.struct("h", "n")).alias("told"))
    told = told.select("doc", F.col("told.h").alias("h"), F.col("told.n").alias("n"))
    rows = bags.join(told, "doc", "left")
    return rows.mapInArrow(_weighted(most), "doc long, hashes binary, weights binary")


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"hashes_u": _U, "weights_u": "<f4", "hashes_v": _U, "weights_v": "<f4"}
        for batch in batches:
            columns = [[np.frombuffer(x.as_buffer(), dtype=k) for x in batch.column(c)] for c, k in kinds.items()]
            alike = [similarity(*row) >= threshold for row in zip(*columns, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(alike, pa.bool_()))

    return run


def _links(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) that are alike."""
    u, v = (
        vectors.select(F.col("doc").alias(x), F.col("hashes").alias(f"hashes_{x}"), F.col("weights").alias(f"weights_{x}"))
        for x in ("u", "v")
    )
    rows = pairs.join(v, "v").join(u, "u").select("u", "v", "hashes_u", "weights_u", "hashes_v", "weights_v")
    return rows.mapInArrow(_verified(threshold), "u long, v long")


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc, w): the weight of every distinct shingle of each text."""
    for batch in batches:
        columns = (batch.column(c) for c in ("hashes", "weights"))
        for doc, hashes, weight in zip(batch.column("doc").to_pylist(), *columns, strict=True):
            h = np.frombuffer(hashes.as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "h": pa.array(h),
                    "doc": pa.array(np.full(len(h), doc, dtype=np.int64)),
                    "w": pa.array(np.frombuffer(weight.as_buffer(), dtype="<f4")),
                }
            )


def _shared_weights(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (doc, total, shared): a text's weight, and that of its shingles that others of ``docs`` have."""
    parts = vectors.join(docs, "doc", "left_semi").mapInArrow(_shares, "h long, doc long, w float")
    kinds = parts.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"), F.min("w").alias("w")
    )
    alone = kinds.filter("n = 1").groupBy("doc").agg(F.sum("w").alias("alone"))
    totals = parts.groupBy("doc").agg(F.sum("w").alias("total"))
    shared = F.col("total") - F.coalesce("alone", F.lit(0.0))
    return totals.join(alone, "doc", "left").select("doc", "total", shared.alias("shared"))


def _other_pairs(threshold: float):
    """Pairs of members of a (bucket, part) in different components that may be alike.

    Rows (bucket, part, loose, own, doc, root, sample, total, shared) come sorted by bucket and part.
    ``loose`` marks texts outside the main component: they are compared with every row that is ``own``
    to the part.
    """
    least = int(np.ceil(LEAST_AGREEMENT * BANDS * ROWS))

    def pairs_of(group):
        loose = np.flatnonzero([r[0] for r in group])
        own = np.flatnonzero([r[1] for r in group])
        if not len(loose) or not len(own):
            return
        docs = np.array([r[2] for r in group])
        roots = np.array([r[3] for r in group])
        drawn = np.frombuffer(b"".join(r[4] for r in group), dtype="<u4").reshape(len(group), -1)
        total, shared = (np.array([r[c] for r in group]) for c in (5, 6))
        for i in loose:
            # Two loose texts meet twice over all parts; the smaller one speaks.
            other = own[(roots[own] != roots[i])]
            flags = np.array([group[j][0] for j in other], dtype=bool)
            other = other[~flags | (docs[other] > docs[i])]
            both = np.minimum(shared[other], shared[i])
            # A little slack for weights that were added up in another order.
            other = other[both >= (threshold - 1e-4) * (total[other] + total[i] - both)]
            agree = (drawn[other] == drawn[i]).sum(axis=1)
            chosen = docs[other[agree >= least]]
            if len(chosen):
                u, v = np.maximum(chosen, docs[i]), np.minimum(chosen, docs[i])
                yield pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, group = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != place:
                    yield from pairs_of(group)
                    place, group = row[:2], []
                group.append(row[2:])
        yield from pairs_of(group)

    return run


def _rest(
    crowded: DataFrame, roots: DataFrame, samples_of: DataFrame, vectors: DataFrame, threshold: float,
    stage: Steps,
) -> DataFrame:
    """Pairs between components that share a bucket, each text of all but the main one against all."""
    rows = crowded.join(roots, F.col("doc") == F.col("node"), "left")
    rows = rows.select("bucket", "doc", F.coalesce("root", "doc").alias("root"))
    sizes = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy("bucket").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"),
        F.count(F.lit(1)).alias("kinds"),
        F.ceil(F.sum("n") / BUCKET_ROWS).cast("int").alias("parts"),
    )
    rows = stage.save(rows.join(mains.filter("kinds > 1"), "bucket"), "mixed")
    facts = stage.save(_shared_weights(vectors, rows.select("doc").distinct()), "shared")
    facts = samples_of.join(facts, "doc")
    loose = F.col("root") != F.col("main")
    mine = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")
    parts = F.when(loose, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(mine))
    rows = rows.select("bucket", "doc", "root", loose.alias("loose"), mine.alias("mine"), F.explode(parts).alias("part"))
    rows = rows.join(facts, "doc").select(
        "bucket", "part", "loose", (F.col("part") == F.col("mine")).alias("own"), "doc", "root", "sample",
        "total", "shared",
    )
    rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "doc")
    return rows.mapInArrow(_other_pairs(threshold), "u long, v long").distinct()


# --- classes --------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: id and class_id, the smallest id of its class."""
    spark = docs.sparkSession
    stage = Steps(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    most, others = document_frequencies(rows, stage)
    most = spark.sparkContext.broadcast(most)
    drawn = stage.save(rows.mapInArrow(_signatures(most), "doc long, key binary, sample binary"), "samples")

    # One document of each text, and of each id, stands for the rest.
    named = drawn.filter("doc is not null and sample is not null")
    firsts = named.groupBy("key").agg(F.min("doc").alias("doc"))
    same = named.select("key", F.col("doc").alias("node")).join(firsts, "key")
    same = same.filter("node <> doc").select(F.col("node").alias("u"), F.col("doc").alias("v")).distinct()
    texts = stage.save(
        named.join(firsts, ["key", "doc"]).groupBy("key", "doc").agg(F.first("sample").alias("sample")),
        "texts",
    )
    # An id with several texts is told apart by the text's key until classes are joined.
    texts = texts.withColumn("text_id", F.xxhash64("key"))
    stands = texts.select(F.col("text_id").alias("doc"), "sample")

    buckets = stands.mapInArrow(_bands, "bucket long, doc long")
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = stage.save(buckets.join(sizes, "bucket"), "buckets")
    company = stage.save(crowded.groupBy("doc").agg(F.sum("n").alias("company")), "company")
    hubs = crowded.join(company, "doc").groupBy("bucket").agg(
        F.max_by("doc", F.struct("company", "doc")).alias("hub")
    )
    stars = crowded.join(hubs, "bucket").filter("doc <> hub")
    stars = stars.select(F.greatest("doc", "hub").alias("u"), F.least("doc", "hub").alias("v")).distinct()

    wanted = company.select(F.col("doc").alias("text_id")).join(texts.select("text_id", "key", "doc"), "text_id")
    whole = rows.join(wanted.select("text_id", "doc", "key"), "doc")
    whole = whole.select(F.col("text_id").alias("doc"), "key", "text")
    bags = stage.save(
        whole.mapInArrow(_own_text, "doc long, text string")
        .mapInArrow(_vectors, "doc long, bag binary")
        .dropDuplicates(["doc"]),
        "bags",
    )
    vectors = stage.save(_with_weights(bags, others, most), "vectors")
    links = stage.save(_links(stage.save(stars, "stars"), vectors, threshold), "links")
    roots = stage.save(components(links, stage, "star"), "roots")
    rest = stage.save(_rest(crowded.select("bucket", "doc"), roots, stands, vectors, threshold, stage), "pairs")
    links = links.unionByName(stage.save(_links(rest, vectors, threshold), "more"))

    ids = texts.select("text_id", "doc")
    by_id = links.join(ids.withColumnsRenamed({"text_id": "u", "doc": "a"}), "u")
    by_id = by_id.join(ids.withColumnsRenamed({"text_id": "v", "doc": "b"}), "v")
    edges = by_id.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same)
    classes = components(edges, stage, "classes")
    out = drawn.select("doc").join(classes, F.col("doc") == F.col("node"), "left")
    return out.select(F.col("doc").alias(id_column), F.coalesce("root", "doc").alias("class_id"))


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the wanted key (an id may have several texts)."""
    for batch in batches:
        keys = batch.column("key").to_pylist()
        fits = [
            t.is_valid and hashlib.blake2b(t.as_buffer(), digest_size=16).digest() == k
            for t, k in zip(batch.column("text"), keys, strict=True)
        ]
        yield batch.select(["doc", "text"]).filter(pa.array(fits, pa.bool_()))


def keep_one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of its class; null ids stay."""
    classes = near_duplicates(docs, id_column, text_column, threshold)
    gone = classes.filter(F.col("class_id") < F.col(id_column)).select(F.col(id_column).alias("_nf_gone"))
    return docs.join(gone.distinct(), F.col(id_column) == F.col("_nf_gone"), "left_anti")
