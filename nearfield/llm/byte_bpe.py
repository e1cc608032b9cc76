"""Byte-level BPE: pre-tokenisation by scans over codepoint classes, cached merging of pairs.

The pieces of a text are those of the public pattern: contractions (``'s 't 're 've 'm 'll 'd``); runs of
letters, of numbers or of other characters, each with one space in front if there is one; white space,
whose last character stands apart in front of other text. They are found without a regular expression:

1. Every codepoint gets a class, and from its neighbours a symbol (``symbols``): what white space needs
   to know of the character behind it, and whether an apostrophe can begin a contraction.
2. A symbol is a function from states to states (``NEXT``), and whether a piece begins is a table of
   state and symbol (``BEGINS``). Functions of consecutive symbols compose associatively, so stretches are
   composed side by side, the stretches' functions are scanned, and then all states follow at once.

The pieces' bytes are merged by rank, each distinct piece once per task (``Merger``). Tokens keep their
byte offsets in the text. Decoding copies the tokens' bytes from one flat table by their offsets.

Null and empty texts have no tokens. Texts are taken whole; a slice is some texts, or one longer than
``ENCODED_BYTES``. Columns beyond those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from nearfield.llm.words import slices

LETTER, NUMBER, SPACE, OTHER = range(4)

# Symbols: plain classes, then what lookahead tells apart; the second half begins a text.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_WHITE, S_LAST_BLANK, S_LAST_WHITE = range(8)
FIRST = 8
# States: inside a run of a class; behind a blank that belongs to what follows; one or two letters of a
# contraction left; behind a finished piece.
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, BLANK, ONE_LEFT, TWO_LEFT, DONE = range(8)
STRETCH = 256
ENCODED_BYTES = 2 << 20
# Distinct pieces kept with their tokens; when there are more, the next slice starts over with none.
CACHED_PIECES = 500_000
# Longer pieces are merged by a heap and not kept.
CACHED_BYTES = 64
NO_RANK = 1 << 62


def class_table() -> np.ndarray:
    """The class of every codepoint, as the public library's version of Unicode has it."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        probe = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        members = bytes(probe.encode_ordinary(every)).decode("utf-8")
        table[np.frombuffer(members.encode("utf-32-le"), dtype="<u4")] = kind
    return table


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """The next state and whether a piece begins, by symbol and state."""
    after = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER, S_WHITE: IN_WHITE}
    follow, begins = np.zeros((16, 8), dtype=np.uint8), np.ones((16, 8), dtype=bool)
    for symbol in range(8):
        plain = S_OTHER if symbol in (S_SHORT, S_LONG) else symbol
        opened = {S_SHORT: ONE_LEFT, S_LONG: TWO_LEFT, S_LAST_BLANK: BLANK, S_LAST_WHITE: DONE}
        fresh = opened.get(symbol, after.get(plain))
        follow[symbol], follow[symbol + FIRST] = fresh, fresh
        if plain not in after:
            continue  # the last white space always stands apart
        run = after[plain]
        joined = [run] if plain == S_WHITE else [run, BLANK]
        for state in joined:
            follow[symbol, state], begins[symbol, state] = run, False
        if symbol == S_LETTER:
            for state, rest in ((ONE_LEFT, DONE), (TWO_LEFT, ONE_LEFT)):
                follow[symbol, state], begins[symbol, state] = rest, False
    return follow, begins


NEXT, BEGINS = _machine()


def symbols(codes: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbol of every codepoint; texts begin at ``first`` (the last entry is their end)."""
    n = len(codes)
    kind = classes[codes]
    out = np.array([S_LETTER, S_NUMBER, S_WHITE, S_OTHER], dtype=np.uint8)[kind]
    begin = np.zeros(n + 1, dtype=bool)
    begin[first] = True
    # Followed by a character of the same text that is not white space.
    before_text = np.zeros(n, dtype=bool)
    before_text[:-1] = (kind[1:] != SPACE) & ~begin[1:-1]
    last = (kind == SPACE) & before_text
    out[last] = np.where(codes[last] == 0x20, S_LAST_BLANK, S_LAST_WHITE)
    quotes = np.flatnonzero(codes == 0x27)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[~begin[quotes + 1]]
    one = codes[quotes + 1]
    out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
    pairs = quotes[quotes + 2 < n]
    pairs = pairs[~begin[pairs + 2]]
    one, two = codes[pairs + 1], codes[pairs + 2]
    for a, b in ("re", "ve", "ll"):
        out[pairs[(one == ord(a)) & (two == ord(b))]] = S_LONG
    out[np.flatnonzero(begin[:-1])] += FIRST
    return out


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The functions (n, states) that apply ``first``, then ``second``."""
    return np.take_along_axis(second, first, axis=1)


def scan(functions: np.ndarray) -> np.ndarray:
    """Composition of all functions up to each one, by doubling strides."""
    out, step = functions.copy(), 1
    while step < len(out):
        out[step:] = _then(out[:-step], out[step:])
        step *= 2
    return out


def piece_starts(symbol: np.ndarray) -> np.ndarray:
    """Where pieces begin, from symbols whose first one begins a text."""
    n = len(symbol)
    if not n:
        return np.zeros(0, dtype=np.int64)
    rows = -(-n // STRETCH)
    # A stretch per column; what is beyond the end does no harm.
    grid = np.zeros(rows * STRETCH, dtype=np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, STRETCH).T).astype(np.int64) * 8
    table, begins = NEXT.ravel(), BEGINS.ravel()
    function = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for symbol_row in grid:
        function = table[symbol_row[:, None] + function]
    state = np.zeros(rows, dtype=np.uint8)
    state[1:] = scan(function)[:-1, 0]
    found = np.empty(grid.shape, dtype=bool)
    for i, symbol_row in enumerate(grid):
        at = symbol_row + state
        found[i], state = begins[at], table[at]
    return np.flatnonzero(np.ascontiguousarray(found.T).ravel()[:n])


# --- merging --------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id: their bytes one after another in ``flat``, token i from ``starts[i]`` on.

    ``pairs`` are, in order, the numbers ``a * len + b`` of all ids whose bytes make up a token together,
    and ``merged`` is that token's id, which is also its rank.
    """

    ranks: dict[bytes, int]
    flat: np.ndarray
    starts: np.ndarray
    pairs: np.ndarray
    merged: np.ndarray
    classes: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1


def load_vocabulary(path: str) -> Vocabulary:
    """Read lines of a base64 token and its rank, which is its id. All single bytes must be tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary does not have all single bytes")
    n = max(ranks.values()) + 1
    by_id, pairs = [b""] * n, {}
    for token, rank in ranks.items():
        by_id[rank] = token
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                pairs[a * n + b] = rank
    keys = np.array(sorted(pairs), dtype=np.int64)
    merged = np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)
    return Vocabulary(ranks, *_flat(by_id), keys, merged, class_table())


def _flat(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), starts


class Merger:
    """Token ids by piece. Pieces not seen before are merged together, pairs of lowest rank first."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.bytes_as_ids = np.array([vocabulary.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.known: dict[bytes, tuple[int, ...]] = {}

    def tokens(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        if len(self.known) > CACHED_PIECES:
            self.known = {}
        known, ranks = self.known, self.vocabulary.ranks
        by_size: dict[int, list[bytes]] = {}
        long = {}
        for piece in set(pieces).difference(known):
            rank = ranks.get(piece)
            if rank is not None:
                known[piece] = (rank,)
            elif len(piece) > CACHED_BYTES:
                long[piece] = self._merged_by_heap(piece)
            else:
                by_size.setdefault(len(piece), []).append(piece)
        for size, group in by_size.items():
            known.update(zip(group, self._merged_alike(group, size), strict=True))
        if long:
            return [long[p] if p in long else known[p] for p in pieces]
        return [known[p] for p in pieces]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each two ids together."""
        pairs = self.vocabulary.pairs
        key = a * len(self.vocabulary) + b
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[at] == key, self.vocabulary.merged[at], NO_RANK)

    def _merged_alike(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Pieces of one size as rows of a matrix; a round merges the first lowest pair of every row."""
        ids = self.bytes_as_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(-1, size)]
        out: list = [None] * len(pieces)
        row, pair = np.arange(len(pieces)), self._ranks(ids[:, :-1], ids[:, 1:])
        while len(row):
            width = ids.shape[1]
            at = pair.argmin(axis=1) if width > 1 else np.zeros(len(row), dtype=np.int64)
            here = np.arange(len(row))
            least = pair[here, at] if width > 1 else np.full(len(row), NO_RANK)
            ended = least == NO_RANK
            if ended.any():
                for r, tokens in zip(row[ended].tolist(), ids[ended].tolist(), strict=True):
                    out[r] = tuple(tokens)
                go = ~ended
                row, ids, pair, at, least = row[go], ids[go], pair[go], at[go], least[go]
                here = np.arange(len(row))
                if not len(row):
                    break
            # Drop the second id of the merged pair, and its pair with the one behind it.
            columns = np.arange(width - 1)
            ids[here, at] = least
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            columns = np.arange(width - 2)
            pair = np.take_along_axis(pair, columns + (columns >= at[:, None]), axis=1)
            for left in (at - 1, at):
                some = np.flatnonzero((left >= 0) & (left < width - 2))
                l = left[some]
                pair[some, l] = self._ranks(ids[some, l], ids[some, l + 1])
        return out

    def _merged_by_heap(self, piece: bytes) -> tuple[int, ...]:
        """A heap of pairs over a linked list: n log n steps for a piece of n bytes."""
        ranks, n = self.vocabulary.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        firsts = (ranks.get(piece[a : a + 2]) for a in range(n - 1))
        heap = [(rank, a, a + 2) for a, rank in enumerate(firsts) if rank is not None]
        heapq.heapify(heap)
        while heap:
            _, a, stop = heapq.heappop(heap)
            # A pair is out of date once either part has grown or gone.
            if end[a] < 0 or end[a] >= stop or end[end[a]] != stop:
                continue
            b = end[a]
            end[a], end[b] = stop, -1
            if stop < n:
                before[stop] = a
            for left in (a, before[a]):
                if left >= 0 and end[left] < n:
                    last = end[end[left]]
                    rank = ranks.get(piece[left:last])
                    if rank is not None:
                        heapq.heappush(heap, (rank, left, last))
        ids, a = [], 0
        while a < n:
            ids.append(ranks[piece[a : end[a]]])
            a = end[a]
        return tuple(ids)


# --- columns --------------------------------------------------------------------------


@dataclass
class Tokens:
    """Token ids of some texts, those of text i from ``first[i]`` on, and each token's byte offset."""

    ids: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def encode(merger: Merger, texts: pa.Array) -> Iterator[Tokens]:
    """The tokens of a text column, by slices of whole texts."""
    vocabulary = merger.vocabulary
    for part in slices(texts, ENCODED_BYTES):
        raw = part.data.tobytes()
        lead = np.flatnonzero((part.data & 0xC0) != 0x80)
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype="<u4")
        texts_at = np.searchsorted(lead, part.offsets)
        begins = piece_starts(symbols(codes, texts_at, vocabulary.classes))
        begins = lead[begins]
        cuts = [*begins.tolist(), len(raw)]
        merged = merger.tokens([raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        count = np.fromiter(map(len, merged), np.int64, len(merged))
        ids = np.fromiter(chain.from_iterable(merged), np.int32, int(count.sum()))
        token_of_piece = np.concatenate([[0], np.cumsum(count)])
        first = token_of_piece[np.searchsorted(begins, part.offsets)]
        size = np.diff(vocabulary.starts)[ids]
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        of_text = np.repeat(part.offsets[:-1], np.diff(first))
        yield Tokens(ids, first, at - of_text)


def _gather(flat: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``ids`` of a flat table one after another, and where each begins."""
    size = starts[ids + 1] - starts[ids]
    begin = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(begin[-1]) + np.repeat(starts[ids] - begin[:-1], size)], begin


def decode(vocabulary: Vocabulary, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The bytes of each text's tokens. An id outside the vocabulary is an error."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocabulary)):
        raise ValueError("an id is not in the vocabulary")
    data, begin = _gather(vocabulary.flat, vocabulary.starts, np.asarray(ids, dtype=np.int64))
    raw, cuts = data.tobytes(), begin[first].tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


# --- on Spark -------------------------------------------------------------------------


def encode_documents(
    docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: its id, the token ``ids`` and their byte ``offsets`` in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    docs = docs.select(f"`{id_column}`", f"`{text_column}`")
    schema = (
        StructType([docs.schema[id_column]])
        .add("ids", ArrayType(IntegerType(), False))
        .add("offsets", ArrayType(LongType(), False))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(shared.value)
        for batch in batches:
            row = 0
            for t in encode(merger, batch.column(1)):
                n, first = len(t.first) - 1, pa.array(t.first, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n),
                        pa.ListArray.from_arrays(first, pa.array(t.ids)),
                        pa.ListArray.from_arrays(first, pa.array(t.offsets)),
                    ],
                    names=[id_column, "ids", "offsets"],
                )
                row += n

    return docs.mapInArrow(run, schema)


def decode_documents(
    encoded: DataFrame, vocabulary_path: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """One row per row: its id and the ``bytes`` of its tokens; null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    encoded = encoded.select(f"`{id_column}`", f"`{ids_column}`")
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(sizes)])
            ids = column.flatten().to_numpy(zero_copy_only=False)
            out = decode(shared.value, ids, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary())], names=[id_column, "bytes"]
            )

    return encoded.mapInArrow(run, f"`{id_column}` {kind}, bytes binary")


def round_trips(
    docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: n_tokens, ids_sha256 (of the decimal ids, a space between) and
    decoded_sha256 (of the bytes decoded from the ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    docs = docs.select(f"`{id_column}`", f"`{text_column}`")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        merger = Merger(vocabulary)
        decimals = _flat([f"{i} ".encode() for i in range(len(vocabulary))])
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            row = 0
            for t in encode(merger, batch.column(1)):
                n = len(t.first) - 1
                text, begin = _gather(*decimals, t.ids.astype(np.int64))
                cuts, text = begin[t.first].tolist(), text.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, n),
                        pa.array(np.diff(t.first), pa.int64()),
                        pa.array([digest(text[a : max(a, b - 1)]) for a, b in zip(cuts, cuts[1:], strict=False)]),
                        pa.array([digest(b) for b in decode(vocabulary, t.ids, t.first)]),
                    ],
                    names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                row += n

    schema = f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.mapInArrow(run, schema)
