"""Hidden Markov language model: Baum-Welch over the corpus, exact likelihood of whole texts.

A word is emitted in two parts. The state emits a bucket: each of the ``TOP`` most frequent training
words has its own, a rarer word shares that of its last three bytes, and the text's end has one. Within
a shared bucket the word is drawn by its training count plus a half, and an unseen word has a half, so
the whole vocabulary counts and every text has a probability. Transitions, starts and emissions are
trained by Baum-Welch over all training texts; the expected counts are summed by Spark, cell by cell,
so the driver gets as many numbers as the model has. The first emissions come from how the most
frequent words occur together in documents.

Texts are encoded once. A block holds some consecutive documents as numbers into the block's own
dictionary, and is written to the staging folder; every later pass reads blocks, not texts. Dictionary
entries, not words, are shuffled: to be counted by word, and back to their blocks with the count over
the corpus. No vocabulary is collected or broadcast.

In training, texts are cut into stretches of ``STRETCH`` words that all start from the same
distribution; scoring runs the scaled forward recursion over whole texts. A null or empty text is the
end token alone. Rows with a null id are scored, but neither learnt from nor held out. Repeated rows are
scored alike and each counts in training. Without training texts, every word is unseen and the states
are alike. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.words import FOLDED_CODES, slices
from nearfield.plans.staging import Stage

STATES = 8
TOP = 2048
SUFFIXES = 2048
SUFFIX_BYTES = 3
TOGETHER = 256  # frequent words whose joint occurrence starts the emissions
ROUNDS = 4
STRETCH = 64
BLOCK_WORDS = 6_000_000
END = TOP + SUFFIXES
BUCKETS = END + 1
LN10 = np.log(10.0)

_U = np.uint64


# --- blocks ---------------------------------------------------------------------------


def _suffixes(part) -> np.ndarray:
    """A bucket number from each word's last bytes."""
    folded = part.data.copy()
    folded[(folded >= 0x41) & (folded <= 0x5A)] += 32
    h = np.zeros(len(part.starts), dtype=_U)
    for i in range(1, SUFFIX_BYTES + 1):
        at = part.ends - i
        byte = np.where(at >= part.starts, folded[np.maximum(at, 0)], 0).astype(_U)
        h = (h << _U(8)) | byte
    h *= _U(0x9E3779B97F4A7C15)
    return (h >> _U(64 - SUFFIXES.bit_length() + 1)).astype(np.uint16)


class _Block:
    """Documents gathered until they hold ``BLOCK_WORDS`` words."""

    def __init__(self):
        self.ids, self.held, self.learn = [], [], []
        self.sizes, self.hashes, self.suffixes, self.words = [], [], [], 0

    def row(self, number: int) -> tuple:
        hashes = np.concatenate(self.hashes) if self.hashes else np.zeros(0, _U)
        suffixes = np.concatenate(self.suffixes) if self.suffixes else np.zeros(0, np.uint16)
        sizes = np.concatenate(self.sizes)
        kinds, first, code, n = np.unique(
            hashes, return_index=True, return_inverse=True, return_counts=True
        )
        rank = np.empty(len(kinds), dtype=np.uint32)  # frequent words get small numbers
        order = np.argsort(-n, kind="stable")
        rank[order] = np.arange(len(kinds), dtype=np.uint32)
        code = rank[code]
        learnt = np.repeat(np.array(self.learn, dtype=bool), sizes)
        counts = np.bincount(code[learnt], minlength=len(kinds)).astype("<u4")
        return (
            number, self.ids, self.held, self.learn, sizes.astype("<i8").tobytes(),
            (code & 0xFFFF).astype("<u2").tobytes(), (code >> 16).astype("<u2").tobytes(),
            kinds[order].astype("<u8").tobytes(), suffixes[first[order]].astype("<u2").tobytes(),
            counts.tobytes(),
        )


def _blocks(fields: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block()

        def batch_of(row):
            arrays = [pa.array([v], f.type) for v, f in zip(row, fields, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=fields)

        for batch in batches:
            ids, held, learn = (batch.column(c).to_pylist() for c in ("id", "held", "learn"))
            for part in slices(batch.column("text")):
                rows = slice(part.row, part.row + len(part))
                block.ids += ids[rows]
                block.held += held[rows]
                block.learn += learn[rows]
                block.sizes.append(np.diff(part.first))
                block.hashes.append(part.hashes(seen_as=FOLDED_CODES))
                block.suffixes.append(_suffixes(part))
                block.words += len(part.starts)
                if block.words >= BLOCK_WORDS:
                    yield batch_of(block.row(number))
                    number, block = number + 1, _Block()
        if block.ids:
            yield batch_of(block.row(number))

    return run


def encode_blocks(docs: DataFrame, stage: Stage, id_column: str, text_column: str) -> DataFrame:
    """Write all documents as blocks."""
    share = F.crc32(F.col(id_column).cast("string").cast("binary")) % 5
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        F.coalesce(share == 1, F.lit(False)).alias("held"),
        F.coalesce(share != 1, F.lit(False)).alias("learn"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"block long, ids array<{kind}>, held array<boolean>, learn array<boolean>, sizes binary,"
        " low binary, high binary, hashes binary, suffixes binary, counts binary"
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = docs.sparkSession.createDataFrame([], schema).schema
    return stage.save(rows.mapInArrow(_blocks(to_arrow_schema(empty)), schema), "blocks")


def _array(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind) if value.is_valid else np.zeros(0, kind)


@dataclass
class Texts:
    """A block's documents: words of document i are ``code[first[i]:first[i + 1]]``."""

    ids: list
    held: list
    learn: np.ndarray
    first: np.ndarray
    code: np.ndarray
    hashes: np.ndarray
    suffixes: np.ndarray


def _texts(batch: pa.RecordBatch, i: int) -> Texts:
    get = lambda name: batch.column(name)[i]
    sizes = _array(get("sizes"), "<i8")
    code = _array(get("low"), "<u2").astype(np.uint32)
    code |= _array(get("high"), "<u2").astype(np.uint32) << 16
    return Texts(
        get("ids").as_py(), get("held").as_py(), np.array(get("learn").as_py(), dtype=bool),
        np.concatenate([[0], sizes.cumsum()]), code,
        _array(get("hashes"), "<u8"), _array(get("suffixes"), "<u2"),
    )


# --- counts over the corpus -----------------------------------------------------------


def _entries(with_place: bool):
    """Dictionary entries: (h, s, c), or (h, block, place) of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                hashes = _array(batch.column("hashes")[i], "<i8")
                if with_place:
                    block = np.full(len(hashes), batch.column("block")[i].as_py(), dtype=np.int64)
                    place = np.arange(len(hashes), dtype=np.int32)
                    columns = {"h": hashes, "block": block, "place": place}
                else:
                    counts = _array(batch.column("counts")[i], "<u4").astype(np.int64)
                    seen = counts > 0
                    suffixes = _array(batch.column("suffixes")[i], "<u2").astype(np.int32)
                    columns = {"h": hashes[seen], "s": suffixes[seen], "c": counts[seen]}
                for at in range(0, len(columns["h"]), 200_000):
                    part = {k: pa.array(v[at : at + 200_000]) for k, v in columns.items()}
                    yield pa.RecordBatch.from_pydict(part)

    return run


@dataclass
class Vocabulary:
    """What the driver knows of the training words: totals, the frequent ones, bucket sums."""

    texts: int
    tokens: int
    kinds: int
    top: np.ndarray  # hashes, ascending
    top_bucket: np.ndarray
    mass: np.ndarray  # by bucket: training tokens
    unit: np.ndarray  # by bucket: tokens + half of (kinds + 1), over which words are shared out

    def buckets(self, hashes: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        out = TOP + suffixes.astype(np.int32)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            hit = self.top[at] == hashes
            out[hit] = self.top_bucket[at[hit]]
        return out


def count_words(blocks: DataFrame, stage: Stage) -> tuple[DataFrame, Vocabulary]:
    """The counts (h, c) of all training words, and their summary."""
    counts = blocks.select("hashes", "suffixes", "counts").mapInArrow(_entries(False), "h long, s int, c long")
    counts = counts.groupBy("h").agg(F.min("s").alias("s"), F.sum("c").alias("c"))
    counts, facts = stage.save_with(
        counts, "counts", F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("words")
    )
    texts = blocks.select(F.sum(F.size(F.filter("learn", lambda x: x))).alias("n")).first()["n"] or 0
    top = counts.orderBy(F.col("c").desc(), "h").limit(TOP).collect()
    mass, unit = np.zeros(BUCKETS), np.full(BUCKETS, 0.5)
    for r in counts.groupBy("s").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        mass[TOP + r["s"]] = r["c"]
        unit[TOP + r["s"]] += r["c"] + 0.5 * r["n"]
    for i, r in enumerate(top):  # frequent words leave the shared buckets
        mass[TOP + r["s"]] -= r["c"]
        unit[TOP + r["s"]] -= r["c"] + 0.5
        mass[i] = r["c"]
    mass[END] = texts
    hashes = np.array([r["h"] for r in top], dtype=np.int64).view(_U)
    order = np.argsort(hashes)
    tokens = (facts["words"] or 0) + texts
    kinds = facts["kinds"] + (texts > 0)
    return counts.select("h", "c"), Vocabulary(
        texts, tokens, kinds, hashes[order], order.astype(np.int32), mass, unit
    )


# --- the model ------------------------------------------------------------------------


@dataclass
class Hmm:
    start: np.ndarray  # (states,)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (buckets, states)


def _stretches(texts: Texts, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observations of the training texts, and lengths of their stretches, longest first.

    Rows are stretches, columns are steps; beyond a stretch's length there is no meaning."""
    obs, first = _with_ends(texts, buckets)
    sizes = np.diff(first)
    chosen = np.flatnonzero(texts.learn)
    pieces = -(-sizes[chosen] // STRETCH)
    begin = np.repeat(first[:-1][chosen], pieces)
    inner = np.arange(pieces.sum()) - np.repeat(pieces.cumsum() - pieces, pieces)
    begin = begin + inner * STRETCH
    length = np.minimum(np.repeat(first[1:][chosen], pieces) - begin, STRETCH)
    order = np.argsort(-length, kind="stable")
    at = begin[order, None] + np.arange(STRETCH)
    return obs[np.minimum(at, max(len(obs) - 1, 0))], length[order]


def _with_ends(texts: Texts, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, with the end after each document."""
    n = len(texts.first) - 1
    first = texts.first + np.arange(n + 1)
    obs = np.full(first[-1], END, dtype=np.int32)
    obs[np.arange(len(texts.code)) + np.repeat(np.arange(n), np.diff(texts.first))] = buckets[texts.code]
    return obs, first


def expected_counts(model: Hmm, obs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Baum-Welch counts (start, step, emit) of stretches sorted by falling length."""
    n, k = len(lengths), len(model.start)
    longest = int(lengths[0]) if n else 0
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(longest + 1)]
    active = [int((lengths > t).sum()) for t in range(longest)] if n else active
    emit, step = model.emit.astype(np.float32), model.step.astype(np.float32)
    forward, scale, seen = [], [], []
    for t in range(longest):
        m = active[t]
        e = emit[obs[:m, t]]
        a = model.start.astype(np.float32) * e if t == 0 else (forward[-1][:m] @ step) * e
        s = a.sum(axis=1, keepdims=True)
        forward.append(a / s)
        scale.append(s)
        seen.append(e)
    start, steps = np.zeros(k), np.zeros((k, k))
    emits = np.zeros((BUCKETS, k))
    backward = np.ones((active[-1] if n else 0, k), dtype=np.float32)
    for t in range(longest - 1, -1, -1):
        if t < longest - 1:
            m = active[t + 1]
            onward = seen[t + 1] * backward / scale[t + 1]
            steps += forward[t][:m].T.astype(np.float64) @ onward
            backward = np.concatenate(
                [onward @ step.T, np.ones((active[t] - m, k), dtype=np.float32)]
            )
        share = forward[t] * backward
        share /= share.sum(axis=1, keepdims=True)
        for j in range(k):
            emits[:, j] += np.bincount(obs[: active[t], t], weights=share[:, j], minlength=BUCKETS)
        if t == 0:
            start += share.sum(axis=0)
    return start, steps * model.step, emits


def forward_log10(model: Hmm, obs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log10 likelihood of every document's whole sequence, by the scaled forward recursion."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, total = first[:-1][order], np.zeros(len(order))
    falling = -sizes[order]
    alpha = None
    for t in range(int(sizes.max()) if len(sizes) else 0):
        m = int(np.searchsorted(falling, -t, side="left"))
        e = model.emit[obs[begin[:m] + t]]
        alpha = model.start * e if t == 0 else (alpha[:m] @ model.step) * e
        s = alpha.sum(axis=1)
        alpha /= s[:, None]
        total[:m] += np.log(s)
    out = np.zeros(len(order))
    out[order] = total / LN10
    return out


def _share(values: np.ndarray, axis: int) -> np.ndarray:
    return values / values.sum(axis=axis, keepdims=True)


def _smooth_emissions(counts: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Counts with some of the corpus's own rate, and with a little of any bucket."""
    rate = (mass + 0.5) / (mass + 0.5).sum()
    return _share(counts + 20 * rate[:, None], axis=0)


def first_model(vocabulary: Vocabulary, together: np.ndarray, states: int) -> Hmm:
    """Group the most frequent words by the words they occur with; each group tilts one state."""
    rate = _smooth_emissions(np.zeros((BUCKETS, 1)), vocabulary.mass)[:, 0]
    emit = np.repeat(rate[:, None], states, axis=1)
    own = np.diag(together).copy()
    used = np.flatnonzero(own > 0)
    if len(used) >= states:
        joint = together[np.ix_(used, used)]
        lift = joint * max(1, vocabulary.texts) / np.outer(own[used], own[used])
        vectors = np.log(lift + 0.05)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
        centres = [int(own[used].argmax())]
        while len(centres) < states:  # the word least like all centres so far
            near = (vectors @ vectors[centres].T).max(axis=1)
            near[centres] = 2
            centres.append(int(near.argmin()))
        centre = vectors[centres]
        for _ in range(20):
            group = (vectors @ centre.T).argmax(axis=1)
            for s in range(states):
                if (group == s).any():
                    centre[s] = vectors[group == s].mean(axis=0)
                    centre[s] /= np.linalg.norm(centre[s]) + 1e-9
        for s in range(states):
            emit[used[group == s], s] *= 8
    emit *= 1 + 0.05 * np.random.default_rng(1).random(emit.shape)
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9)
    return Hmm(np.full(states, 1 / states), _share(step, 1), _share(emit, 0))


def _cells(batches, make, size: int) -> Iterator[pa.RecordBatch]:
    """One task's sums as rows (cell, value)."""
    total = np.zeros(size)
    for batch in batches:
        for i in range(len(batch)):
            for part in make(_texts(batch, i)):
                total += part
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict(
        {"cell": pa.array(cell.astype(np.int32)), "value": pa.array(total[cell])}
    )


def _summed(blocks: DataFrame, make, size: int) -> np.ndarray:
    """Sums over all blocks, cell by cell."""
    rows = blocks.mapInArrow(lambda batches: _cells(batches, make, size), "cell int, value double")
    out = np.zeros(size)
    for r in rows.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out


def _together(vocabulary: Vocabulary):
    """In how many training texts two of the most frequent words occur."""

    def make(texts: Texts) -> Iterator[np.ndarray]:
        buckets = vocabulary.buckets(texts.hashes, texts.suffixes)[texts.code]
        text = np.repeat(np.arange(len(texts.learn)), np.diff(texts.first))
        chosen = (buckets < TOGETHER) & texts.learn[text]
        for lo in range(0, len(texts.learn), 4096):
            here = chosen & (text >= lo) & (text < lo + 4096)
            has = np.zeros((4096, TOGETHER), dtype=np.float32)
            has[text[here] - lo, buckets[here]] = 1
            yield (has.T @ has).ravel().astype(np.float64)

    return make


def _expectation(vocabulary: Vocabulary, model: Hmm):
    def make(texts: Texts) -> Iterator[np.ndarray]:
        if not texts.learn.any():
            return
        obs, lengths = _stretches(texts, vocabulary.buckets(texts.hashes, texts.suffixes))
        for at in range(0, len(lengths), 4096):
            counts = expected_counts(model, obs[at : at + 4096], lengths[at : at + 4096])
            yield np.concatenate([c.ravel() for c in counts])

    return make


def train_hmm(blocks: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over all training texts of the blocks."""
    dictionary = blocks.drop("ids", "held", "counts").withColumns(
        {"ids": F.lit(None).cast("array<bigint>"), "held": F.lit(None).cast("array<boolean>")}
    )
    if not vocabulary.texts:
        return first_model(vocabulary, np.zeros((TOGETHER, TOGETHER)), states)
    together = _summed(dictionary, _together(vocabulary), TOGETHER**2).reshape(TOGETHER, TOGETHER)
    model = first_model(vocabulary, together, states)
    size = states + states**2 + BUCKETS * states
    for _ in range(rounds):
        counts = _summed(dictionary, _expectation(vocabulary, model), size)
        start, step, emit = np.split(counts, [states, states + states**2])
        model = Hmm(
            _share(start + 1e-3, 0),
            _share(step.reshape(states, states) + 1e-3, 1),
            _smooth_emissions(emit.reshape(BUCKETS, states), vocabulary.mass),
        )
    return model


# --- scores ---------------------------------------------------------------------------


def _pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, place, c), sorted, to one row (block, places, counts) for each block."""

    def packed(block, places, counts):
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block], pa.int64()),
                "places": pa.array([np.concatenate(places).astype("<u4").tobytes()], pa.binary()),
                "known": pa.array([np.concatenate(counts).astype("<u8").tobytes()], pa.binary()),
            }
        )

    now, places, counts = None, [], []
    for batch in batches:
        block = batch.column("block").to_numpy()
        for part in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
            if not len(part):
                continue
            if block[part[0]] != now and places:
                yield packed(now, places, counts)
                places, counts = [], []
            now = int(block[part[0]])
            places.append(batch.column("place").to_numpy()[part])
            counts.append(batch.column("c").to_numpy()[part])
    if places:
        yield packed(now, places, counts)


def _by_text(values: np.ndarray, texts: Texts) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, values.dtype), values[texts.code].cumsum()])
    return sums[texts.first[1:]] - sums[texts.first[:-1]]


def score_texts(
    texts: Texts, known: np.ndarray, vocabulary: Vocabulary, model: Hmm
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each document: tokens, known tokens, base score and score. ``known`` counts the words of the
    block's dictionary over all training texts."""
    whole = vocabulary.tokens + 0.5 * (vocabulary.kinds + 1)
    base = np.log10((known + 0.5) / whole)
    buckets = vocabulary.buckets(texts.hashes, texts.suffixes)
    within = np.where(buckets < TOP, 0.0, np.log10((known + 0.5) / vocabulary.unit[buckets]))
    obs, first = _with_ends(texts, buckets)
    return (
        np.diff(first),
        _by_text((known > 0).astype(np.int64), texts) + (vocabulary.texts > 0),
        _by_text(base, texts) + np.log10((vocabulary.texts + 0.5) / whole),
        _by_text(within, texts) + forward_log10(model, obs, first),
    )


def score_language(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    states: int = STATES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    stage = Stage(spark)
    blocks = encode_blocks(docs, stage, id_column, text_column)
    counts, vocabulary = count_words(blocks, stage)
    shared = spark.sparkContext.broadcast((vocabulary, train_hmm(blocks, vocabulary, states, rounds)))
    entries = blocks.select("block", "hashes").mapInArrow(_entries(True), "h long, block long, place int")
    known = entries.join(counts, "h").select("block", "place", "c")
    known = known.repartition("block").sortWithinPartitions("block")
    known = known.mapInArrow(_pack_counts, "block long, places binary, known binary")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        for batch in batches:
            for i in range(len(batch)):
                texts = _texts(batch, i)
                known = np.zeros(len(texts.hashes))
                known[_array(batch.column("places")[i], "<u4")] = _array(batch.column("known")[i], "<u8")
                tokens, seen, base, score = score_texts(texts, known, vocabulary, model)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(texts.ids, batch.schema.field("ids").type.value_type),
                        pa.array(texts.held, pa.bool_()),
                        pa.array(tokens.astype(np.int64)),
                        pa.array(seen.astype(np.int64)),
                        pa.array(np.full(len(tokens), vocabulary.tokens, dtype=np.int64)),
                        pa.array(base),
                        pa.array(score),
                    ],
                    names=[
                        "id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                    ],
                )

    rows = blocks.drop("counts").join(known, "block", "left").mapInArrow(
        run,
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double",
    )
    return rows.withColumnRenamed("id", id_column)
