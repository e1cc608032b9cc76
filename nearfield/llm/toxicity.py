"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (letters, digits and bytes from 0x80, A-Z folded) is embedded as the sum of two hashed rows:
one of the whole word, one of its first four bytes, which stands for its stem. Filters of widths 1, 2
and 3 run over all words of a text; each filter's maximum feeds a logistic output. The embeddings
start from how far a bucket's rate among toxic documents is off its overall rate, then all weights are
trained by Adam. Only maxima have gradients, so a step costs little more than scoring.

Thresholds are calibrated on a fifth of the labelled documents by the text's language, which is guessed from its own
function words (never read from a column): the score is the logistic output shifted so that the language's threshold
is 0.5. All labelled documents are learnt from, whole. Up to ``TASK_WORDS`` words and ``PART_DOCS`` documents
are gone through by one task. More are dealt over parts of about ``PART_DOCS`` documents by the hash of the id: bucket counts are added up over
all parts; in each of ``ROUNDS`` every part trains on all its documents from the same weights, and a weight's changes
are averaged over the parts that changed it; thresholds are cut through counts of all calibration documents' outputs,
rounded to 1/``OUTPUT_STEPS``. Only weights and such counts reach the driver, whose size does not grow with the documents.
A caller may ask for a bounded sample instead (``max_per_class``, ``max_words``); no query does.

Null and empty texts have no words and get the score of the bias. Without labelled documents of both
kinds, every score is 0; if there are both, but a bound on words leaves only one, that is an error. Null labels are
skipped; of a document's repeated labels the largest counts, of rows with the same id the smallest text; rows with a
null id are scored but not learnt from. Other columns are never inputs.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.steps import Steps, let_go
from nearfield.llm.words import FOLDED_CODES, slices
from nearfield.plans.staging import BROADCAST_ROWS

TASK_WORDS = 6_000_000  # what one task trains on alone
LOT_WORDS = 1_000_000  # what a task of a fit in parts holds at once
PART_DOCS = 32_768
SLICES = 4  # in which many documents are joined to their labels, one after the other
ROUNDS = 3
RARE = 100  # of a label with fewer documents none is kept for calibration by a fit in parts
OUTPUT_STEPS = 256
BLOCK = 1 << 14  # weights or counts that are merged in one group
WIDEST = 0.02  # share of a bound on words
POOLED_WORDS = 1 << 17  # whose filters are held at once
BUCKETS = 1 << 16
DIMS = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
STEM_BYTES = 4
EPOCHS = 3
LEAST_STEPS = 200  # small samples are gone through more often
BATCH_WORDS = 30_000
ENCODED_BYTES = 1 << 18
BATCHES = 20  # at least, in every epoch
CALIBRATION = 5  # one in so many documents calibrates the thresholds instead of being learnt from
RATE = 0.003

# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "is", "that", "it", "was"),
    "de": ("der", "die", "und", "das", "von", "ist", "nicht", "mit"),
    "fr": ("le", "les", "et", "des", "du", "est", "dans", "pour"),
    "es": ("el", "los", "las", "del", "y", "por", "con", "se"),
}
LANGUAGES = (*FUNCTION_WORDS, "other")

_WORD_BYTES = np.zeros(256, dtype=bool)
_WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Encoded:
    """Texts as 16-bit bucket numbers: words of text i are ``first[i]`` up to ``first[i + 1]``."""

    word: np.ndarray
    stem: np.ndarray
    first: np.ndarray
    language: np.ndarray


@functools.cache
def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    names = [(w, i) for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws]
    (part,) = slices(pa.array([" ".join(w for w, _ in names)]), word_bytes=_WORD_BYTES)
    hashes = part.hashes(seen_as=FOLDED_CODES)
    order = np.argsort(hashes)
    return hashes[order], np.array([i for _, i in names])[order]


def _languages(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The language with the most function words in each text; the last of ``LANGUAGES`` if none."""
    n = len(first) - 1
    known, language = _function_hashes()
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = np.flatnonzero(known[at] == hashes)
    text = np.searchsorted(first, hit, side="right") - 1
    counts = np.zeros((n, len(LANGUAGES)))
    np.add.at(counts, (text, language[at[hit]]), 1)
    counts[:, -1] = 0.5
    return counts.argmax(axis=1)


def encoded(texts: pa.Array) -> Iterator[Encoded]:
    """Slices of a text column, in order."""
    for part in slices(texts, ENCODED_BYTES, _WORD_BYTES):
        whole = part.hashes(seen_as=FOLDED_CODES)
        stem = part.hashes(STEM_BYTES, FOLDED_CODES)
        shift = np.uint64(64 - BUCKETS.bit_length() + 1)
        yield Encoded(
            (whole >> shift).astype(np.uint16),
            (stem >> shift).astype(np.uint16),
            part.first,
            _languages(whole, part.first),
        )


# --- the network ----------------------------------------------------------------------


@dataclass
class Model:
    """Weights; the last row of both embeddings is zero and stands for what is beyond a text's end."""

    words: np.ndarray
    stems: np.ndarray
    filters: list[np.ndarray]  # for each width: (width * DIMS, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # logits by language
    trained: bool = True


def _padded(x: Encoded, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers with ``pad`` empty words after every text, and where texts begin in them."""
    n = len(x.first) - 1
    shift = np.repeat(np.arange(n) * pad, np.diff(x.first))
    at = np.arange(len(x.word)) + shift
    word = np.full(len(x.word) + n * pad, BUCKETS, dtype=np.int32)
    stem = word.copy()
    word[at], stem[at] = x.word, x.stem
    return word, stem, x.first + np.arange(n + 1) * pad


def _pooled(model: Model, x: Encoded, keep: bool = False):
    """The largest value of every filter in every text, at least 0; with ``keep``, also where."""
    pad = max(WIDTHS) - 1
    word, stem, begin = _padded(x, pad)
    n = len(begin) - 1
    real = begin[1:] - pad > begin[:-1]
    pooled = np.zeros((n, len(WIDTHS) * FILTERS), dtype=np.float32)
    where = np.full(pooled.shape, -1, dtype=np.int64)
    if not real.any():
        return pooled, where, word, stem
    texts, start, end = np.flatnonzero(real), begin[:-1][real], begin[1:][real] - pad
    # A long text is gone through in pieces, each with the words after it that its last filters reach.
    for a in range(0, len(word), POOLED_WORDS):
        b = min(a + POOLED_WORDS, len(word))
        inside = slice(np.searchsorted(end, a, side="right"), np.searchsorted(start, b))
        own = texts[inside]
        if not len(own):
            continue
        embedded = model.words[word[a : b + pad]] + model.stems[stem[a : b + pad]]
        edges = np.stack([np.maximum(start[inside], a), np.minimum(end[inside], b)], axis=1).ravel() - a
        for k, width in enumerate(WIDTHS):
            value = model.biases[k] + embedded @ model.filters[k][:DIMS]
            for j in range(1, width):
                shifted = embedded[j:] @ model.filters[k][j * DIMS : (j + 1) * DIMS]
                value[: len(shifted)] += shifted
            best = np.maximum.reduceat(value, edges[:-1] if edges[-1] == len(value) else edges, axis=0)[::2]
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            if keep:
                for i, (c, d), top in zip(own, edges.reshape(-1, 2), best, strict=True):
                    place = a + c + value[c:d].argmax(axis=0)
                    old = where[i, columns]
                    where[i, columns] = np.where((old < 0) | (top > pooled[i, columns]), place, old)
            pooled[own, columns] = np.maximum(best, pooled[own, columns])
    if keep:
        # Rounding decides between equal words at several places, and differs by piece: the first of them stands for all.
        for k, first in enumerate(_first_alike(word, stem, begin)):
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            where[:, columns] = np.where(where[:, columns] < 0, -1, first[where[:, columns]])
    return pooled, where, word, stem


def _first_alike(word: np.ndarray, stem: np.ndarray, begin: np.ndarray):
    """For every width and place the first place in the same text that has the same words there."""
    n = len(word)
    tokens = np.unique(word.astype(np.int64) * (BUCKETS + 1) + stem, return_inverse=True)[1]
    alike = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    for j in range(max(WIDTHS)):
        alike = alike * n
        alike[: n - j] += tokens[j:]
        _, first, alike = np.unique(alike, return_index=True, return_inverse=True)
        if j + 1 in WIDTHS:
            yield first[alike]


def logits(model: Model, x: Encoded) -> np.ndarray:
    pooled = _pooled(model, x)[0]
    return (pooled @ model.out + model.out_bias).astype(np.float64)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The calibrated score of every whole text."""
    if not model.trained:
        return np.zeros(len(texts))
    parts = [_sigmoid(logits(model, x) - model.thresholds[x.language]) for x in encoded(texts)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class _Adam:
    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights
        self.mean = [np.zeros_like(w) for w in weights]
        self.square = [np.zeros_like(w) for w in weights]
        self.n = 0

    def step(self, gradients: list) -> None:
        """A gradient is an array, or (rows, array) for some rows."""
        self.n += 1
        fix = np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for w, m, v, g in zip(self.weights, self.mean, self.square, gradients, strict=True):
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.999 * v[rows] + 0.001 * g * g
            w[rows] -= RATE * fix * m[rows] / (np.sqrt(v[rows]) + 1e-7)


def _some(x: Encoded, texts: np.ndarray) -> Encoded:
    sizes = np.diff(x.first)[texts]
    first = np.concatenate([[0], sizes.cumsum()])
    at = np.arange(first[-1]) + np.repeat(x.first[texts] - first[:-1], sizes)
    return Encoded(x.word[at], x.stem[at], first, x.language[texts])


def _bucket_counts(x: Encoded, texts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of every word and stem bucket the number of documents and of toxic ones: (word or stem, seen or toxic, bucket)."""
    counts = np.zeros((2, 2, BUCKETS))
    for i, label in zip(texts, y, strict=True):
        for kind, bucket in enumerate((x.word, x.stem)):
            own = np.unique(bucket[x.first[i] : x.first[i + 1]])
            counts[kind, 0, own] += 1
            counts[kind, 1, own] += label
    return counts


def _tilt(seen: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """How far each bucket's documents are toxic beyond the share of all, in standard deviations."""
    z = (toxic - seen * share) / (np.sqrt(seen * share * (1 - share)) + 1)
    return np.clip(z, -5, 5).astype(np.float32) / 5


def _start(x: Encoded, texts: np.ndarray, y: np.ndarray) -> Model:
    return _fresh(_bucket_counts(x, texts, y), y.mean())


def _fresh(counts: np.ndarray, share: float) -> Model:
    """The weights that training starts from."""
    rnd = np.random.default_rng(1)
    normal = lambda *shape: rnd.normal(0, 1, shape).astype(np.float32)
    words, stems = 0.05 * normal(BUCKETS + 1, DIMS), 0.05 * normal(BUCKETS + 1, DIMS)
    words[:-1, 0] = _tilt(*counts[0], share)
    stems[:-1, 1] = _tilt(*counts[1], share)
    words[-1], stems[-1] = 0, 0
    filters = [0.1 * normal(w * DIMS, FILTERS) for w in WIDTHS]
    for f in filters:
        f[:2] += 1
    n = len(WIDTHS) * FILTERS
    biases = [np.full(FILTERS, -0.5, dtype=np.float32) for _ in WIDTHS]
    return Model(words, stems, filters, biases, np.full(n, 2 / n, np.float32), -1.0, np.zeros(len(LANGUAGES)))


def _gradients(model: Model, x: Encoded, y: np.ndarray) -> list:
    pooled, where, word, stem = _pooled(model, x, keep=True)
    error = _sigmoid(pooled @ model.out + model.out_bias) - y
    error = (error / len(y)).astype(np.float32)
    upstream = error[:, None] * model.out * (pooled > 0)
    rows_w, rows_s, parts, filters, biases = [], [], [], [], []
    for k, width in enumerate(WIDTHS):
        g = upstream[:, k * FILTERS : (k + 1) * FILTERS]
        at = where[:, k * FILTERS : (k + 1) * FILTERS]
        text, column = np.nonzero(g)
        value, place = g[text, column], at[text, column]
        f = np.zeros_like(model.filters[k])
        for j in range(width):
            own = slice(j * DIMS, (j + 1) * DIMS)
            rows_w.append(word[place + j])
            rows_s.append(stem[place + j])
            embedded = model.words[rows_w[-1]] + model.stems[rows_s[-1]]
            np.add.at(f[own].T, column, value[:, None] * embedded)
            parts.append(value[:, None] * model.filters[k][own].T[column])
        filters.append(f)
        biases.append(g.sum(axis=0))
    change = np.concatenate(parts)

    def by_row(rows):
        rows = np.concatenate(rows)
        kinds, place = np.unique(rows, return_inverse=True)
        total = np.zeros((len(kinds), DIMS), dtype=np.float32)
        np.add.at(total, place, change)
        total[kinds == BUCKETS] = 0
        return kinds, total

    return [by_row(rows_w), by_row(rows_s), *filters, *biases, pooled.T @ error, np.array([error.sum()])]


def _thresholds(z: np.ndarray, y: np.ndarray, language: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """For each language the middle of the widest cut with the best F1; the overall one where a
    language has fewer than five documents of either kind. Each row stands for ``n`` documents, else one."""
    n = np.ones(len(z)) if n is None else n

    def cut(z, y, n):
        order = np.argsort(-z, kind="stable")
        z, y, n = z[order], y[order], n[order]
        hits = np.cumsum(y * n)
        f1 = 2 * hits / (np.cumsum(n) + hits[-1])
        f1[:-1][z[:-1] == z[1:]] = -1
        best = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[0])
        below = z[best + 1] if best + 1 < len(z) else z[best] - 2
        return (z[best] + below) / 2

    overall = cut(z, y, n)
    out = np.full(len(LANGUAGES), overall)
    for i in range(len(LANGUAGES)):
        own = language == i
        if min((y * n)[own].sum(), ((1 - y) * n)[own].sum()) >= 5:
            out[i] = cut(z[own], y[own], n[own])
    return out


def _batches(sizes: np.ndarray, words: int) -> list[np.ndarray]:
    """Consecutive numbers of texts, about ``words`` words in each batch."""
    batch = np.cumsum(sizes) // words
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(batch)) + 1)


class _Learner:
    """Trains a model in place, with Adam's moments kept from one lot of texts to the next."""

    def __init__(self, model: Model, seed: int | list[int]):
        self.model = model
        self.bias = np.array([model.out_bias], dtype=np.float32)
        self.weights = [model.words, model.stems, *model.filters, *model.biases, model.out, self.bias]
        self.adam = _Adam(self.weights)
        self.rnd = np.random.default_rng(seed)

    def learn(self, x: Encoded, y: np.ndarray, texts: np.ndarray, batch_words: int, epochs: int = 1) -> None:
        sizes = np.diff(x.first) + 2
        for _ in range(epochs):
            order = texts[self.rnd.permutation(len(texts))]
            for batch in _batches(sizes[order], batch_words):
                self.adam.step(_gradients(self.model, _some(x, order[batch]), y[order[batch]]))
                self.model.out_bias = float(self.bias[0])


def _flat_weights(model: Model) -> np.ndarray:
    bias = np.array([model.out_bias], dtype=np.float32)
    weights = [model.words, model.stems, *model.filters, *model.biases, model.out, bias]
    return np.concatenate([w.ravel() for w in weights])


def _with_weights(model: Model, flat: np.ndarray) -> Model:
    """A model with the shapes of ``model`` and its own copy of the weights."""
    at = 0

    def like(w):
        nonlocal at
        at += w.size
        return flat[at - w.size : at].reshape(w.shape).copy()

    words, stems = like(model.words), like(model.stems)
    filters, biases = [like(f) for f in model.filters], [like(b) for b in model.biases]
    return Model(words, stems, filters, biases, like(model.out), float(flat[-1]), model.thresholds)


def _untrained() -> Model:
    return Model(*[np.zeros(0)] * 2, [], [], np.zeros(0), 0.0, np.zeros(len(LANGUAGES)), trained=False)


def train(x: Encoded, labels: np.ndarray) -> Model:
    """Fit the network to encoded texts and their labels (0 or 1).

    Beyond the texts it takes the weights, Adam's moments and one batch.
    """
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return _untrained()
    # Every fifth document of each label is kept from training to calibrate the thresholds.
    turn = np.zeros(len(y), dtype=int)
    for label in (0, 1):
        turn[y == label] = np.arange((y == label).sum()) % CALIBRATION
    fit = np.flatnonzero(turn != CALIBRATION - 1)
    model = _start(x, fit, y[fit])
    sizes = np.diff(x.first) + 2
    batch_words = min(BATCH_WORDS, -(-sizes[fit].sum() // BATCHES))
    epochs = max(EPOCHS, -(-LEAST_STEPS * batch_words // sizes[fit].sum()))
    _Learner(model, 2).learn(x, y, fit, batch_words, epochs)
    rest = np.flatnonzero(turn == CALIBRATION - 1)
    if len(rest) and y[rest].min() < y[rest].max():
        z = [logits(model, _some(x, rest[batch])) for batch in _batches(sizes[rest], BATCH_WORDS)]
        model.thresholds = _thresholds(np.concatenate(z), y[rest], x.language[rest])
    return model


# --- on Spark -------------------------------------------------------------------------


def id_share(id_column: str, n: int = 5) -> Column:
    """CRC-32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


ENCODED = "codes binary, language int, size long"


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their text replaced by word and stem numbers side by side, compressed."""
    let_go()
    for batch in batches:
        text, row = batch.schema.get_field_index("text"), 0
        others = [i for i in range(batch.num_columns) if i != text]
        for x in encoded(batch.column(text)):
            n = len(x.first) - 1
            pairs = np.stack([x.word, x.stem], axis=1).astype("<u2")
            codes = [pa.compress(pairs[x.first[i] : x.first[i + 1]].tobytes(), "zstd", asbytes=True) for i in range(n)]
            new = [pa.array(codes, pa.binary()), pa.array(x.language, pa.int32()), pa.array(np.diff(x.first), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).slice(row, n) for i in others] + new,
                names=[batch.schema.field(i).name for i in others] + ["codes", "language", "size"],
            )
            row += n
    let_go()


def _decoded(batch: pa.RecordBatch) -> Encoded:
    sizes = batch.column("size").to_numpy()
    first = np.concatenate([[0], np.cumsum(sizes)])
    pairs = np.empty((first[-1], 2), dtype="<u2")
    for i, codes in enumerate(batch.column("codes")):
        if sizes[i]:
            raw = pa.decompress(codes.as_buffer(), int(sizes[i]) * 4, "zstd")
            pairs[first[i] : first[i + 1]] = np.frombuffer(raw, dtype="<u2").reshape(-1, 2)
    return Encoded(pairs[:, 0].copy(), pairs[:, 1].copy(), first, batch.column("language").to_numpy())


def _joined(parts: list[Encoded]) -> Encoded:
    sizes = np.concatenate([np.diff(x.first) for x in parts])
    return Encoded(
        np.concatenate([x.word for x in parts]), np.concatenate([x.stem for x in parts]),
        np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([x.language for x in parts]),
    )


def _sampled_ids(labels: DataFrame, id_column: str, label_column: str, max_per_class: int | None) -> DataFrame:
    """Ids with their label and hash, (id, y, o); with a bound about ``max_per_class`` of each label.

    For a bound labels are counted first; then a label's ids stay whose hash lies in a share of all hashes.
    """
    marked = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y"))
    marked = marked.filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    marked = marked.filter(id_share("id") != 0)
    hashed = marked.withColumn("o", F.xxhash64("id"))
    if max_per_class is None:
        return hashed
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, max_per_class / n) for y, n in counts.items()}
    limit = lambda y: F.lit(int(share.get(y, 1.0) * (1 << 32)))
    # The upper half of the hash decides, all of it orders the sample.
    upper = F.shiftrightunsigned("o", 32)
    return hashed.filter(upper < F.when(F.col("y") == 1, limit(1)).otherwise(limit(0)))


def _labelled(steps: Steps, docs: DataFrame, marked: DataFrame) -> tuple[DataFrame, dict]:
    """Encoded texts of the marked ids, (part, y, o, held, codes, language, size), and their numbers.

    Texts are encoded where they are read and only then shuffled, by id: a partition is a part. Of many documents
    a slice of the ids is done at a time, and its shuffle files are gone before the next. Of a repeated id the smallest
    text is looked for first, among the texts of such ids alone.
    """
    one, zero = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    places = docs.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("places"))
    repeats = F.count_if(F.col("places") > 1).alias("repeats")
    marked, seen = steps.save_with(places.join(marked, "id"), "marked", one.alias("ones"), zero.alias("zeros"), repeats)
    total = seen["ones"] + seen["zeros"]
    slices = SLICES if total > SLICES * PART_DOCS else 1
    n = max(1, -(-total // (slices * PART_DOCS)))
    kind = docs.schema["id"].dataType.simpleString()
    held = F.pmod("o", F.lit(CALIBRATION)) == CALIBRATION - 1
    held &= F.when(F.col("y") == 1, F.lit(seen["ones"] >= RARE)).otherwise(F.lit(seen["zeros"] >= RARE))
    facts = {
        "ones": one, "zeros": zero, "words": F.coalesce(F.sum("size"), F.lit(0)),
        "fit": F.count_if(~F.col("held")), "fit_ones": F.count_if((F.col("y") == 1) & ~F.col("held")),
    }
    facts = [fact.alias(name) for name, fact in facts.items()]
    tables, found = [], []
    for i in range(slices):
        inside = F.pmod(F.xxhash64("id"), F.lit(slices)) == i
        own = marked.filter(inside)
        rows = docs.filter("id is not null").filter(inside).filter(id_share("id") != 0)
        if seen["repeats"]:
            repeated = own.filter("places > 1").select("id")
            repeated = F.broadcast(repeated) if seen["repeats"] <= BROADCAST_ROWS else repeated.hint("merge")
            smallest = rows.join(repeated, "id").groupBy("id").agg(F.min("text").alias("text"))
            rows = rows.join(repeated, "id", "left_anti").unionByName(smallest)
        rows = rows.mapInArrow(_encode_rows, f"id {kind}, {ENCODED}")
        # An id has one row with its label and one with its text at most; both lie in its part.
        both = rows.unionByName(own.select("id", "y", "o"), allowMissingColumns=True).repartition(n, "id")
        columns = ["y", "o", "codes", "language", "size"]
        rows = both.groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
        rows = rows.filter("y is not null and codes is not null")
        rows = rows.withColumn("part", F.pmod(F.hash("id"), F.lit(n)) + i * n).withColumn("held", held)
        rows, sums = steps.save_with(rows.select("part", "y", "o", "held", *columns[2:]), f"labelled-{i}", *facts)
        tables.append(rows)
        found.append(sums)
    return functools.reduce(DataFrame.unionByName, tables), {k: sum(f[k] for f in found) for k in found[0]}


def train_toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", max_per_class: int | None = None, max_words: int | None = None,
) -> Model:
    """Learn from all labelled documents whose ``id_share`` is not 0, or from a sample of them if a bound is given.

    Encoded documents are staged. Up to ``TASK_WORDS`` words one task trains on them; more are gone through in parts.
    """
    steps = Steps(docs.sparkSession)
    marked = _sampled_ids(labels, id_column, label_column, max_per_class)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows, seen = _labelled(steps, texts, marked)
    if not (seen["ones"] and seen["zeros"]):
        model = _untrained()
    elif max_words is None and (seen["words"] > TASK_WORDS or seen["ones"] + seen["zeros"] > PART_DOCS):
        model = _fit_parts(steps, rows, seen)
    else:
        model = _fit_whole(rows, max_words)
        if not model.trained:
            raise ValueError(f"max_words={max_words} leaves no labelled documents of both kinds to learn from")
    steps.drop()
    return model


def _fit_whole(rows: DataFrame, max_words: int | None) -> Model:
    """Train in one task, on no more than ``max_words`` words if that is given.

    Which documents the bound lets pass is decided on their sizes alone.
    """
    # Both labels are taken alternately, so that the bound on words cuts them alike.
    turn = F.row_number().over(Window.partitionBy("y").orderBy("o", "size"))
    sizes = rows.select("y", "o", "size").distinct()
    if max_words is not None:
        sizes = sizes.filter(F.col("size") <= WIDEST * max_words)
    chosen = sizes.withColumn("turn", turn)
    if max_words is not None:
        running = Window.orderBy("turn", "y", "o").rowsBetween(Window.unboundedPreceding, 0)
        chosen = chosen.withColumn("taken", F.sum("size").over(running)).filter(F.col("taken") <= max_words)
    chosen = chosen.select("y", "o", "turn")
    found = rows.join(chosen, ["y", "o"]).repartition(1).sortWithinPartitions("turn", "y", "o")
    found = found.select("y", "codes", "language", "size").mapInArrow(_fit, "model binary")
    fitted = found.first()
    return pickle.loads(fitted["model"]) if fitted else _untrained()


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows, which are of bounded size, in their order."""
    let_go()
    parts, labels = [], []
    for batch in batches:
        parts.append(_decoded(batch))
        labels.append(batch.column("y").to_numpy())
    if parts:
        x = _joined(parts)
        del parts
        model = train(x, np.concatenate(labels))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Encoded, np.ndarray, bool]]:
    """Rows that follow each other in one part, about ``LOT_WORDS`` words at most at once:
    (part, texts, labels, whether the part ends)."""
    let_go()
    held: list[pa.RecordBatch] = []

    def lot(ends):
        out = _joined([_decoded(b) for b in held])
        y = np.concatenate([b.column("y").to_numpy() for b in held]).astype(np.float64)
        return held[0].column("part")[0].as_py(), out, y, ends

    words = 0
    for batch in batches:
        part, size = batch.column("part").to_numpy(), batch.column("size").to_numpy()
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(np.cumsum(size) // LOT_WORDS) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
            if a == b:
                continue
            new = bool(held) and held[0].column("part")[0].as_py() != part[a]
            if held and (new or words + size[a:b].sum() > LOT_WORDS):
                yield lot(new)
                held, words = [], 0
            held.append(batch.slice(a, b - a))
            words += int(size[a:b].sum())
    if held:
        yield lot(True)
        held = []
    let_go()


def _blocks(part: int, values: np.ndarray) -> pa.RecordBatch:
    cuts = range(0, len(values), BLOCK)
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part] * len(cuts), pa.int32()),
        "block": pa.array(range(len(cuts)), pa.int32()),
        "values": pa.array([values[a : a + BLOCK].tobytes() for a in cuts], pa.binary()),
    })


def _merged(steps: Steps, name: str, blocks: DataFrame, kind: str, mean: bool) -> np.ndarray:
    """The sum of all parts' vectors; with ``mean`` each element's over the parts where it is not 0."""

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table["part"])
        total, n = 0.0, 0
        for value in table["values"].take(order):
            own = np.frombuffer(value.as_buffer(), dtype=kind)
            total, n = total + own.astype(np.float64), n + (own != 0)
        out = (total / np.maximum(n, 1) if mean else total).astype(kind)
        return pa.table({"block": table["block"][:1], "values": pa.array([out.tobytes()], pa.binary())})

    rows = steps.save(blocks.groupBy("block").applyInArrow(run, "block int, values binary"), name).collect()
    return np.concatenate([np.frombuffer(r["values"], dtype=kind) for r in sorted(rows, key=lambda r: r["block"])])


def _fit_parts(steps: Steps, rows: DataFrame, seen: dict) -> Model:
    """Train on all rows, part by part; a part lies in one file of the table, its rows together."""
    context = rows.sparkSession.sparkContext
    fit, blocks = rows.filter(~F.col("held")).drop("held", "o"), "part int, block int, values binary"

    def count(batches):
        total = None
        for part, x, y, ends in _lots(batches):
            counts = _bucket_counts(x, np.arange(len(y)), y)
            total = counts if total is None else total + counts
            if ends:
                yield _blocks(part, total.ravel())
                total = None

    counts = _merged(steps, "counts", fit.mapInArrow(count, blocks), "<f8", mean=False).reshape(2, 2, BUCKETS)
    model = _fresh(counts, seen["fit_ones"] / seen["fit"])
    weights = _flat_weights(model)
    for number in range(ROUNDS):
        shared = context.broadcast(_with_weights(model, weights))

        def change(batches, shared=shared, number=number):
            learner = None
            for part, x, y, ends in _lots(batches):
                if learner is None:
                    learner = _Learner(_with_weights(shared.value, _flat_weights(shared.value)), [2, number, part])
                learner.learn(x, y, np.arange(len(y)), BATCH_WORDS)
                if ends:
                    moved, learner = learner.model, None
                    yield _blocks(part, _flat_weights(moved) - _flat_weights(shared.value))

        weights = weights + _merged(steps, f"changes-{number}", fit.mapInArrow(change, blocks), "<f4", mean=True)
        shared.destroy()
    model = _with_weights(model, weights)
    shared = context.broadcast(model)

    def outputs(batches):
        for _, x, y, _ in _lots(batches):
            lots = _batches(np.diff(x.first) + 2, BATCH_WORDS)
            z = np.concatenate([logits(shared.value, _some(x, texts)) for texts in lots])
            z = np.rint(np.clip(z, -60, 60) * OUTPUT_STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(z), pa.array(y.astype(np.int32)), pa.array(x.language.astype(np.int32))], names=["z", "y", "language"]
            )

    cut = rows.filter("held").drop("held", "o").mapInArrow(outputs, "z long, y int, language int")
    cut = cut.groupBy("z", "y", "language").agg(F.count(F.lit(1)).alias("n")).orderBy("language", "z", "y").toArrow()
    z, y = cut["z"].to_numpy() / OUTPUT_STEPS, cut["y"].to_numpy().astype(np.float64)
    if len(np.unique(y)) == 2:
        model.thresholds = _thresholds(z, y, cut["language"].to_numpy(), cut["n"].to_numpy())
    shared.destroy()
    return model


def score_toxicity(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, held_out, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(F.col(id_column), F.col(text_column))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        let_go()
        for batch in batches:
            score = scores(shared.value, batch.column(text_column))
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), pa.array(score), pa.array(score >= 0.5).cast(pa.int32())],
                names=[id_column, "score", "predicted"],
            )
        let_go()

    out = docs.mapInArrow(run, f"`{id_column}` {kind}, score double, predicted int")
    held_out = F.coalesce(id_share(id_column) == 0, F.lit(False))
    return out.select(id_column, held_out.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is not predicted to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        let_go()
        for batch in batches:
            yield batch.filter(pa.array(scores(shared.value, batch.column(text_column)) < 0.5))
        let_go()

    return docs.mapInArrow(run, docs.schema)
