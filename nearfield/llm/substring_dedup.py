"""Substring dedup: suffix automata of passages that recur, and matching statistics of documents.

A window is ``min_words`` consecutive words of one document. A word goes if a window that covers it
also starts in a document with a smaller id. The work runs in three steps.

1. **Reference shards.** The anchor of a window is the smallest hash of its word 8-grams, so equal
   windows have equal anchors, and a document has about one anchor in 22 words. Anchors that occur
   under two ids name the shards; all other text is left out from here on.
2. **Automata.** Each document sends its stretches of windows with a recurring anchor to that anchor's
   shard. There the documents are taken by ascending id: each is streamed through the suffix automaton
   of all before it, and where the longest match ending at a word has ``min_words`` words or more, the
   window ending there is removed; then its stretches extend the automaton. Equal stretches are
   streamed once.
3. **Removal.** Spans are gathered by document and joined to the texts.

The shards partition the reference, so an automaton goes to the stretches that can match it, never to
all of the corpus; the reference has no size bound, so it isn't broadcast whole. A shard holds at most
``HEAVY_ROWS`` stretches. A more frequent anchor is cut into single windows: each task keeps only the
smallest id per window (a larger one is decided on the spot), and what is left meets by window hash.

Null texts are empty. Texts shorter than a window keep all words. Rows with a null id keep all words
and are no source for others. Rows that share an id are one document: they do not remove each other's
words. Equal rows are treated alike. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.words import Slice, grams_of, slices

MIN_WORDS = 50
GRAM = 8
HEAVY_ROWS = 4096
COMBINED_WINDOWS = 200_000
OUT_ROWS = 20_000


class SuffixAutomaton:
    """All substrings of the sequences given to ``extend``, in a number of states linear in them."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def extend(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            last = self._step(last, word)

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of ``q`` for its strings up to one word longer than ``p``'s."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _step(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another sequence has brought this string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            same = self.length[q] == self.length[p] + 1
            self.link[new] = q if same else self._split(p, q, word)
        return new

    def matches(self, sequence: list[int]) -> list[int]:
        """For each word, the length of the longest substring of the automaton that ends there."""
        state, size, out = 0, 0, []
        nexts, links, lengths = self.next, self.link, self.length
        for word in sequence:
            to = nexts[state].get(word)
            while to is None and state:
                state = links[state]
                size = lengths[state]
                to = nexts[state].get(word)
            if to is not None:
                state, size = to, size + 1
            else:
                size = 0
            out.append(size)
        return out


# --- anchors --------------------------------------------------------------------------


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_anchors(
    part: Slice, words: np.ndarray, min_words: int
) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every window of a slice and, for each text, where its windows begin."""
    gram = min(GRAM, min_words)
    width = min_words - gram + 1
    grams, first = grams_of(words, part.first, gram)
    counts = np.maximum(np.diff(first) - (width - 1), 0)
    begin = np.zeros(len(first), dtype=np.int64)
    np.cumsum(counts, out=begin[1:])
    if not begin[-1]:
        return np.zeros(0, dtype=np.int64), begin
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    return sliding_min(grams, width)[at].view(np.int64), begin


def _anchor_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "mark"))
            for part in slices(batch.column("text")):
                anchors, begin = window_anchors(part, part.hashes(), min_words)
                if not len(anchors):
                    continue
                change = np.ones(len(anchors), dtype=bool)
                change[1:] = anchors[1:] != anchors[:-1]
                change[begin[:-1][np.diff(begin) > 0]] = True
                at = np.flatnonzero(change)
                row = part.row + np.searchsorted(begin, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors[at]), pa.array(ids[row]), pa.array(marks[row])],
                    names=["anchor", "doc", "mark"],
                )

    return run


# --- stretches ------------------------------------------------------------------------

_DECIDED, _STRETCH, _WINDOW = 0, 1, 2
_PART_FIELDS = [
    ("key", pa.int64()),
    ("kind", pa.int8()),
    ("doc", pa.int64()),
    ("mark", pa.int64()),
    ("start", pa.int64()),
    ("stop", pa.int64()),
    ("words", pa.binary()),
]
_PART_SCHEMA = "key long, kind byte, doc long, mark long, start long, stop long, words binary"


class _Rows:
    """Rows waiting to be sent as a batch."""

    def __init__(self, fields):
        self.schema = pa.schema(fields)
        self.rows: list[tuple] = []

    def __len__(self) -> int:
        return len(self.rows)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in self.schema]
        self.rows = []
        arrays = [pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


class _FirstWindows:
    """The smallest document of each window hash that this task has met."""

    def __init__(self, rows: _Rows, min_words: int):
        self.rows, self.min_words = rows, min_words
        self.first: dict[int, tuple[int, int, int]] = {}

    def add(self, key: int, doc: int, mark: int, start: int) -> None:
        known = self.first.get(key)
        if known is None:
            self.first[key] = (doc, mark, start)
        elif doc == known[0]:
            self._send(key, (doc, mark, start))
        else:
            later = known if doc < known[0] else (doc, mark, start)
            if doc < known[0]:
                self.first[key] = (doc, mark, start)
            self.rows.rows.append(
                (later[0], _DECIDED, *later, later[2] + self.min_words, None)
            )

    def _send(self, key: int, place: tuple[int, int, int]) -> None:
        self.rows.rows.append((key, _WINDOW, *place, place[2] + self.min_words, None))

    def flush(self) -> None:
        for key, place in self.first.items():
            self._send(key, place)
        self.first = {}


def _runs(values: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[int, int]]:
    """Maximal ranges of chosen positions with one value."""
    if not chosen.any():
        return
    edge = np.ones(len(values) + 1, dtype=bool)
    edge[1:-1] = (values[1:] != values[:-1]) | (chosen[1:] != chosen[:-1])
    at = np.flatnonzero(edge)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if chosen[a]:
            yield int(a), int(b)


def _stretches(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(_PART_FIELDS)
        combined = _FirstWindows(rows, min_words)
        for batch in batches:
            ids, marks = (batch.column(c).to_pylist() for c in ("doc", "mark"))
            light, heavy = batch.column("light"), batch.column("heavy")
            for part in slices(batch.column("text")):
                words = part.hashes()
                anchors, begin = window_anchors(part, words, min_words)
                short = (words >> np.uint64(32)).astype("<u4")
                for i in range(len(part)):
                    row, own = part.row + i, anchors[begin[i] : begin[i + 1]]
                    if not len(own):
                        continue
                    doc, mark, at = ids[row], marks[row], part.first[i]
                    wanted = np.asarray(light[row].as_py() or [], dtype=np.int64)
                    for a, b in _runs(own, np.isin(own, wanted)):
                        content = short[at + a : at + b - 1 + min_words].tobytes()
                        rows.rows.append(
                            (int(own[a]), _STRETCH, doc, mark, a, b - 1 + min_words, content)
                        )
                    wanted = np.asarray(heavy[row].as_py() or [], dtype=np.int64)
                    if len(wanted):
                        starts = np.flatnonzero(np.isin(own, wanted))
                        text = words[at : part.first[i + 1]]
                        keys, _ = grams_of(text, np.array([0, len(text)]), min_words)
                        for start, key in zip(
                            starts.tolist(), keys[starts].view(np.int64).tolist(), strict=True
                        ):
                            combined.add(key, doc, mark, start)
                        if len(combined.first) >= COMBINED_WINDOWS:
                            combined.flush()
                    if len(rows) >= OUT_ROWS:
                        yield rows.batch()
        combined.flush()
        yield rows.batch()

    return run


# --- matching -------------------------------------------------------------------------


def _covered(lengths: list[int], min_words: int) -> list[tuple[int, int]]:
    """Maximal spans of windows that end where a match is long enough."""
    spans: list[list[int]] = []
    for end, size in enumerate(lengths, 1):
        if size >= min_words:
            if spans and spans[-1][1] >= end - min_words:
                spans[-1][1] = end
            else:
                spans.append([end - min_words, end])
    return [(a, b) for a, b in spans]


def match_shard(
    stretches: list[tuple[int, int, int, bytes]], min_words: int
) -> Iterator[tuple[int, int, int, int]]:
    """Spans (doc, mark, start, stop) that occur under a smaller id.

    ``stretches``: (doc, mark, start, words as little-endian 32-bit hashes), by ascending doc.
    """
    automaton = SuffixAutomaton()
    holder: dict[bytes, int] = {}  # the smallest document with these very words
    found: dict[bytes, list[tuple[int, int]]] = {}  # spans of stretches of the document at hand
    at = 0
    while at < len(stretches):
        doc, own = stretches[at][0], []
        while at < len(stretches) and stretches[at][0] == doc:
            own.append(stretches[at])
            at += 1
        found.clear()
        for _, mark, start, content in own:
            if content in holder:
                yield doc, mark, start, start + len(content) // 4
                continue
            if content not in found:
                sequence = np.frombuffer(content, dtype="<u4").tolist()
                found[content] = _covered(automaton.matches(sequence), min_words)
            for a, b in found[content]:
                yield doc, mark, start + a, start + b
        for content in found:
            holder[content] = doc
            if at < len(stretches):
                automaton.extend(np.frombuffer(content, dtype="<u4").tolist())


def match_windows(places: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """The windows of one hash that are not in the smallest document."""
    first = places[0][0]
    return (p for p in places if p[0] > first)


_SPAN_FIELDS = [("doc", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]


def _match(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(_SPAN_FIELDS)
        key, group = None, []

        def decide():
            stretches = [(d, m, a, w) for kind, d, m, a, _, w in group if kind == _STRETCH]
            places = [(d, m, a, b) for kind, d, m, a, b, _ in group if kind == _WINDOW]
            out.rows += [(d, m, a, b) for kind, d, m, a, b, _ in group if kind == _DECIDED]
            if stretches and stretches[0][0] < stretches[-1][0]:
                out.rows += match_shard(stretches, min_words)
            if places:
                out.rows += match_windows(places)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    decide()
                    key, group = row[0], []
                    if len(out) >= OUT_ROWS:
                        yield out.batch()
                if row[1] == _DECIDED:
                    out.rows.append(row[2:6])
                else:
                    group.append(row[1:])
        decide()
        yield out.batch()

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Word spans (doc, mark, start, stop), overlaps allowed, that occur under a smaller id.

    ``docs`` has doc (long, not null), mark (tells texts of one id apart) and text.
    """
    anchors = docs.mapInArrow(_anchor_rows(min_words), "anchor long, doc long, mark long")
    anchors = anchors.repartition("anchor")
    recurring = (
        anchors.groupBy("anchor")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n"))
        .filter("low < high")
        .select("anchor", (F.col("n") > HEAVY_ROWS).alias("heavy"))
    )
    wanted = anchors.join(recurring, "anchor").groupBy("doc", "mark")
    wanted = wanted.agg(
        F.collect_set(F.when(~F.col("heavy"), F.col("anchor"))).alias("light"),
        F.collect_set(F.when(F.col("heavy"), F.col("anchor"))).alias("heavy"),
    )
    parts = docs.join(wanted, ["doc", "mark"]).mapInArrow(_stretches(min_words), _PART_SCHEMA)
    parts = parts.repartition("key").sortWithinPartitions("key", "doc", "mark", "start")
    return parts.mapInArrow(_match(min_words), "doc long, mark long, start long, stop long")


def _removed_mask(n: int, spans) -> np.ndarray:
    steps = np.zeros(n + 1, dtype=np.int64)
    for span in spans or ():
        steps[span["start"]] += 1
        steps[span["stop"]] -= 1
    return np.cumsum(steps[:n]) > 0


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, spans = batch.column("id"), batch.column("spans")
            for part in slices(batch.column("text")):
                raw = part.data.tobytes()
                for i in range(len(part)):
                    a, b = part.first[i], part.first[i + 1]
                    removed = _removed_mask(b - a, spans[part.row + i].as_py())
                    keep = np.flatnonzero(~removed) + a
                    starts, ends = part.starts[keep].tolist(), part.ends[keep].tolist()
                    text = b" ".join([raw[s:e] for s, e in zip(starts, ends, strict=True)])
                    gone = int(removed.sum())
                    if with_text and not gone:
                        text = raw[part.offsets[i] : part.offsets[i + 1]]
                    rows.append((int(b - a), gone, text))
            words, gone, texts = zip(*rows, strict=True) if rows else ([], [], [])
            if with_text:
                last = pa.array([t.decode() for t in texts], pa.string())
            else:
                last = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(words, pa.int64()), pa.array(gone, pa.int64()), last],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return run


def _with_spans(docs: DataFrame, id_column: str, text_column: str, min_words: int) -> DataFrame:
    """Rows (id, text, spans) of all documents."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("mark", F.xxhash64("text"))
    named, unnamed = docs.filter("doc is not null"), docs.filter("doc is null")
    spans = repeated_spans(named, min_words)
    spans = spans.groupBy("doc", "mark").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")
    )
    # The same shuffle of the texts serves this join and the one for the stretches.
    joined = named.join(spans, ["doc", "mark"], "left").select(F.col("doc").alias("id"), "text", "spans", "mark")
    return joined.unionByName(
        unnamed.select(
            F.col("doc").alias("id"),
            "text",
            F.lit(None).cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
            "mark",
        )
    )


def dedup_report(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 of the kept words."""
    rows = _with_spans(docs, id_column, text_column, min_words).drop("mark")
    out = rows.mapInArrow(_kept(False), "id long, n_words long, n_removed long, kept string")
    return out.withColumnsRenamed({"id": id_column, "kept": "kept_sha256"})


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """The same rows and columns; texts that lose words become their kept words, one space apart.

    A column ``n_chars`` follows its text. Texts that lose nothing stay as they are.
    """
    rows = _with_spans(docs, id_column, text_column, min_words)
    new = (
        rows.filter("spans is not null")
        .select(F.struct("id", "mark").alias("id"), "text", "spans")
        .dropDuplicates(["id"])
        .mapInArrow(
            _kept(True), "id struct<id:long,mark:long>, n_words long, n_removed long, kept string"
        )
        .select(F.col("id.id").alias("_nf_id"), F.col("id.mark").alias("_nf_mark"), F.col("kept").alias("_nf_kept"))
    )
    mark = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    key = F.col(id_column).cast("long")
    marked = docs.withColumns({"_nf_id": key, "_nf_mark": mark})
    out = marked.join(new, ["_nf_id", "_nf_mark"], "left")
    kept = F.coalesce("_nf_kept", text_column)
    columns = [kept.alias(c) if c == text_column else F.col(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col("_nf_kept").isNull(), F.col("n_chars")).otherwise(
            F.length("_nf_kept").cast(kind)
        )
        columns = [length.alias(c) if c == "n_chars" else x for c, x in zip(docs.columns, columns, strict=True)]
    return out.select(*columns)
