"""Words, word hashes and word shingles of whole Arrow text columns, in numpy.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. All functions work on slices of
a column, so that temporary arrays stay near ``SLICE_BYTES`` unless one text alone is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5

_U = np.uint64
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1
_powers = np.ones(1, dtype=_U)
_inverses = np.ones(1, dtype=_U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def _geometric(ratio: int, size: int) -> np.ndarray:
    factors = np.full(size, ratio & _MASK, dtype=_U)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < size:
        size = max(size, SLICE_BYTES + 1)
        _powers = _geometric(_BASE, size)
        _inverses = _geometric(pow(_BASE, -1, 1 << 64), size)
    return _powers, _inverses


class Slice:
    """The words of some consecutive texts: byte ``starts`` and ``ends`` in ``data``.

    Words of text ``i`` are ``first[i]`` up to ``first[i + 1]``; text ``i`` is row ``row + i`` of the
    column and lies in ``data[offsets[i]:offsets[i + 1]]``.
    """

    def __init__(self, row: int, data: np.ndarray, offsets: np.ndarray, word_bytes=_IS_WORD):
        self.row, self.data, self.offsets = row, data, offsets
        inside = word_bytes[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[0] = True
        edge[-1] = True
        np.logical_not(inside[:-1], out=edge[1:-1])
        begins = edge[:-1].copy()
        within = offsets[:-1][offsets[:-1] < len(data)]
        begins[within] = True
        begins &= inside
        stops = np.empty(len(data), dtype=bool)
        if len(data):
            stops[:-1] = ~inside[1:]
            stops[-1] = True
            ends = offsets[1:]
            stops[ends[ends > 0] - 1] = True
        stops &= inside
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, longest: int | None = None, seen_as: np.ndarray = _BYTE_CODES) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of its first ``longest`` bytes.

        ``seen_as`` gives the code of each byte value, by which bytes can be made alike.
        """
        n = len(self.data)
        powers, inverses = _tables(n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(seen_as[self.data] * powers[:n], out=sums[1:])
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return mix((sums[ends] - sums[self.starts]) * inverses[self.starts])

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``size`` consecutive words and, for each text, where its hashes begin.

        A text of fewer words, but at least one, has one shingle of all its words.
        """
        words = self.hashes()
        grams, first = grams_of(words, self.first, size)
        short = np.flatnonzero((np.diff(self.first) > 0) & (np.diff(self.first) < size))
        if not len(short):
            return grams, first
        whole = np.array(
            [_whole(words[self.first[i] : self.first[i + 1]]) for i in short], dtype=_U
        )
        grams = np.insert(grams, first[short], whole)
        added = np.zeros(len(self) + 1, dtype=first.dtype)
        added[short + 1] = 1
        return grams, first + np.cumsum(added)


def _whole(words: np.ndarray) -> int:
    h = len(words)
    for w in words:
        h = (h * _BASE + int(w)) & _MASK
    return int(mix(np.array([h], dtype=_U))[0])


def grams_of(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words that lie in one text, and where each text's begin."""
    counts = np.maximum(np.diff(first) - (size - 1), 0)
    begin = np.zeros(len(first), dtype=np.int64)
    np.cumsum(counts, out=begin[1:])
    if len(words) < size:
        return np.zeros(0, dtype=_U), begin
    n = len(words) - size + 1
    h = np.zeros(n, dtype=_U)
    factor = 1
    for j in range(size):
        h += words[j : j + n] * _U(factor)
        factor = factor * _BASE & _MASK
    # The position of every gram that does not reach into the next text.
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    return mix(h[at]), begin


# Codes by which A-Z are hashed as a-z.
FOLDED_CODES = _BYTE_CODES.copy()
FOLDED_CODES[0x41:0x5B] = _BYTE_CODES[0x61:0x7B]


def slices(
    column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES, word_bytes: np.ndarray = _IS_WORD
) -> Iterator[Slice]:
    """Cut a text column into slices of whole texts, about ``limit`` bytes each; null is empty."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_string()).fill_null("")
        base, data = np.frombuffer(chunk.buffers()[1], dtype=np.int64), chunk.buffers()[2]
        base = base[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
        row = 0
        while row < len(chunk):
            end = int(np.searchsorted(base, base[row] + limit, side="right")) - 1
            end = min(max(end, row + 1), len(chunk))
            yield Slice(row, raw[base[row] : base[end]], base[row : end + 1] - base[row], word_bytes)
            row = end
