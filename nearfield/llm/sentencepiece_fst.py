"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into three transducers: the normaliser (space to U+2581, dummy prefix), the
pieces, whose arcs read a piece's characters and write its id, and byte fallback, which writes the
UTF-8 bytes of a character that is no piece. They are composed with the input, and the shortest path
in the tropical semiring (weights add along a path, the least path wins) is the encoding.

Unigram models weigh an arc by the negated score. The greedy merges of BPE models are no sum over
pieces; there a second transducer, whose states are the last piece read, weighs each step 0 or
infinity: a piece may follow another if the merges leave the two apart when given both alone. A
sequence all of whose neighbours may follow each other is the result of the merges, and there is one
for every text, so the paths of finite weight are the encoding.

Where two neighbouring characters occur in no piece, every path has a cut: the input is composed part
by part there, and a part that was met before keeps its path (two generations of ``CACHE_PARTS``).

A null or empty text has no ids. Texts of any length are read whole. Repeated rows are encoded alike;
other columns are ignored. Decoding skips control pieces, writes U+2047 for the unknown piece, and
replaces bytes that are no UTF-8 by U+FFFD. Models with a character map are rejected.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
CACHE_PARTS = 400_000
ROWS_AT_ONCE = 256

# Field numbers and values of the public model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_MODEL_TYPE, _UNIGRAM, _BPE = 3, 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, struct.unpack("<d" if kind == 1 else "<f", data[at : at + size])[0]
            at += size


class _Cache(dict):
    """Ids by stretch of text, in two generations of at most ``size`` entries."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Transducer:
    """A compiled model."""

    def __init__(self, data: bytes):
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.kinds: list[int] = []
        names: list[str] = []
        self.unknown, model_type = 0, _UNIGRAM
        normalizer: dict[int, object] = {3: 1, 4: 1, 5: 1}
        for field, value in _fields(data):
            if field == _PIECES:
                piece = dict(_fields(value))
                names.append(piece.get(1, b"").decode())
                self.kinds.append(piece.get(3, _NORMAL))
                if self.kinds[-1] in (_NORMAL, _USER):
                    self.ids[names[-1]] = len(names) - 1
                    self.scores[names[-1]] = piece.get(2, 0.0)
                elif self.kinds[-1] == _BYTE:
                    self.byte_ids[int(names[-1][3:5], 16)] = len(names) - 1
                elif self.kinds[-1] == _UNKNOWN:
                    self.unknown = len(names) - 1
                elif self.kinds[-1] == _UNUSED:
                    raise ValueError("unused pieces are not supported")
            elif field == _TRAINER:
                model_type = dict(_fields(value)).get(_MODEL_TYPE, _UNIGRAM)
            elif field == _NORMALIZER:
                normalizer |= dict(_fields(value))
        if model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models have pieces")
        if normalizer.get(2) or _USER in self.kinds:
            raise ValueError("character maps and user-defined pieces are not supported")
        self.prefix, self.squeeze, self.escape = (bool(normalizer[i]) for i in (3, 4, 5))
        self.bpe = model_type == _BPE
        self.bytes_known = _BYTE in self.kinds
        self.beginnings = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # No piece goes on beyond a word, so the words of a text are its chunks.
        self.by_word = all(pair[0] == SPACE or pair[1] != SPACE for pair in self.inner)
        self.plain = self.prefix and self.escape and self.bytes_known and self.by_word
        self.least = min(self.scores.values(), default=0.0)
        self.follows: dict[tuple[str, str], float] = {}
        self.parts = _Cache(self._part, CACHE_PARTS // 2)
        self.chunks = _Cache(self._chunk, CACHE_PARTS // 8)
        self.words = _Cache(lambda word: self._chunk(SPACE + word), CACHE_PARTS)
        self.bytes_of = [self._written(n, k) for n, k in zip(names, self.kinds, strict=True)]

    @staticmethod
    def _written(name: str, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(name[3:5], 16)])
        if kind == _UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == _CONTROL else name.replace(SPACE, " ").encode()

    # --- composition --------------------------------------------------------------

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def merged(self, text: str) -> list[str]:
        """The greedy merges: the best pair first, the leftmost of equal ones."""
        symbols = list(text)
        while True:
            best, at = -inf, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1], -inf)
                if score > best:
                    best, at = score, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def step(self, before: str, piece: str) -> float:
        """The weight of ``piece`` after ``before`` in a BPE model."""
        key = (before, piece)
        weight = self.follows.get(key)
        if weight is None:
            if len(self.follows) >= CACHE_PARTS:
                self.follows.clear()
            apart = before[-1] + piece[0] not in self.inner or self.merged(before + piece) == [before, piece]
            weight = self.follows[key] = 0.0 if apart else inf
        return weight

    def shortest_path(self, part: str) -> list[str]:
        """Pieces of the least path through the composed transducer."""
        last = self._least_bpe(part) if self.bpe else self._least_unigram(part)
        path, at = [], len(part)
        while at:
            path.append(last[at])
            at -= len(last[at])
        return path[::-1]

    def _least_bpe(self, part: str) -> list[str | None]:
        """For every position, the last piece of the path of finite weight that ends there.

        There is at most one: the merges of what stands before the position."""
        n, ids, beginnings, follows = len(part), self.ids, self.beginnings, self.follows
        last: list[str | None] = [None] * (n + 1)
        for start in range(n):
            before = last[start]
            if before is None and start:
                continue
            end, piece = start + 1, part[start]  # any one character is an arc
            while True:
                if last[end] is None and (end == start + 1 or piece in ids):
                    weight = follows.get((before, piece)) if start else 0.0
                    if (self.step(before, piece) if weight is None else weight) == 0.0:
                        last[end] = piece
                end += 1
                if end > n:
                    break
                piece = part[start:end]
                if piece not in beginnings:
                    break
        return last

    def _least_unigram(self, part: str) -> list[str | None]:
        """For every position, the last piece of the least path that ends there."""
        n = len(part)
        weights, last = [0.0] + [inf] * n, [None] * (n + 1)
        for start in range(n):
            for end in range(start + 1, n + 1):
                piece = part[start:end]
                if end > start + 1 and piece not in self.beginnings:
                    break
                if end == start + 1 or piece in self.ids:
                    total = weights[start] - self.scores.get(piece, self.least - 10)
                    if total < weights[end]:
                        weights[end], last[end] = total, piece
        return last

    def _part(self, part: str) -> bytes:
        out: list[int] = []
        for piece in self.shortest_path(part):
            number = self.ids.get(piece)
            if number is not None:
                out.append(number)
            elif self.bytes_known:
                out += [self.byte_ids[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, dtype="<i4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch, part by part between cuts."""
        if not self.bytes_known:  # neighbouring unknown characters are one unknown piece
            return self._part(chunk)
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.inner]
        if not cuts:
            return self.parts[chunk]
        bounds = zip([0, *cuts], [*cuts, len(chunk)], strict=True)
        return b"".join([self.parts[chunk[a:b]] for a, b in bounds])

    # --- whole texts --------------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.plain and SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        text = self.normalize(text)
        if not (self.bytes_known and self.by_word):
            return self._chunk(text)
        return b"".join(map(self.chunks.__getitem__, re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)))

    def decode(self, ids) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(data)
        return text[self._prefixes(ids) :] if self.prefix else text

    def _prefixes(self, ids) -> int:
        """Spaces to take back from the start: that of the first piece, and again after control pieces."""
        n, taken = 0, False
        for i in ids:
            if self.kinds[i] == _CONTROL:
                taken = False
                continue
            if taken or self.kinds[i] != _NORMAL or not self.bytes_of[i].startswith(b" "):
                break
            n, taken = n + 1, True
            if self.bytes_of[i] != b" ":
                break
        return n

    @staticmethod
    def _decode_broken(data: bytes) -> str:
        """Every byte that begins no character becomes U+FFFD."""
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_loaded: dict[str, Transducer] = {}


def transducer_at(path: str) -> Transducer:
    """One per Python worker, so that its cache outlives a task."""
    if path not in _loaded:
        with open(path, "rb") as file:
            _loaded[path] = Transducer(file.read())
    return _loaded[path]


def _id_lists(parts: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))


def encode_texts(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, ``ids`` and ``n_tokens``."""
    docs = docs.select(id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer_at(model_path)
        for whole in batches:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                parts = [model.encode(t.as_py() or "") for t in batch.column(text_column)]
                sizes = pa.array([len(p) // 4 for p in parts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_column), _id_lists(parts), sizes],
                    names=[id_column, "ids", "n_tokens"],
                )

    return docs.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, n_tokens long")


def decode_ids(
    rows: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """One row per id list: id and ``text``; null lists give empty texts."""
    rows = rows.select(id_column, ids_column)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer_at(model_path)
        for batch in batches:
            texts = [model.decode(x.as_py() or []) for x in batch.column(ids_column)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column), pa.array(texts, pa.string())], names=[id_column, "text"]
            )

    return rows.mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trips(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Encode every text and decode the ids again, in one pass: id, ``ids``, ``n_tokens``, the decoded
    text's SHA-256 and whether it equals the text."""
    docs = docs.select(id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer_at(model_path)
        for whole in batches:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts = [t.as_py() or "" for t in batch.column(text_column)]
                parts = [model.encode(t) for t in texts]
                decoded = [model.decode(np.frombuffer(p, dtype="<i4").tolist()) for p in parts]
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in decoded]
                same = [a == b for a, b in zip(texts, decoded, strict=True)]
                sizes = pa.array([len(p) // 4 for p in parts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_column), _id_lists(parts), sizes, pa.array(digests), pa.array(same)],
                    names=[id_column, "ids", "n_tokens", "decoded_sha256", "round_trip"],
                )

    return docs.mapInArrow(
        run,
        f"`{id_column}` {kind}, ids array<int>, n_tokens long, decoded_sha256 string, round_trip boolean",
    )
