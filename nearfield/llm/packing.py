"""Packing of tokenized documents into fixed windows by minimum bin slack.

A document is cut only at multiples of the window: full windows are sequences of their own, and the
remainders, shorter than a window, are packed whole. For each sequence the longest remaining length
is placed first; a bitset subset-sum over the multiset of remaining lengths then finds the fill
closest to the capacity, and the counts of each length are backtracked from the recorded bitsets.

Remainders are dealt into groups of about ``GROUP_PIECES`` by row number, so a group's size does not
depend on the data, and only numbers (no tokens) are shuffled. A null or empty text is the end id
alone. Repeated rows and ids are packed each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.steps import kept
from nearfield.plans.staging import Stage

CAPACITY = 4096
GROUP_PIECES = 20_000
CACHE_WORDS = 300_000
TEXT_BLOCK = 1 << 20


# --- tokens ---------------------------------------------------------------------------

# Letters and numbers of Latin-1, in the classes of the tokenizer's own splitting pattern (fixed
# values of Unicode); its contractions are those of the pattern.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
# White space that str.split() knows but the tokenizer does not.
_OTHER_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class _Cache(dict):
    """Little-endian ids by chunk. Two generations of at most ``CACHE_WORDS`` entries each: when the
    young one is full it becomes the old one, from which chunks return when they are met again."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _is_latin(text: str) -> bool:
    return text.isascii() or max(text) < "\u0100"


class WordTokenizer:
    """Ids of whole texts, chunk by chunk between white space.

    The tokenizer drops white space and no token crosses it, so the ids of a text are those of its
    chunks in order. A chunk of Latin-1 (in NFC as it stands, and lower-cased letter by letter) goes
    to the library's BPE model part by part; any other chunk, and one that may hold a special token,
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {
            c: "".join(s for s, _ in level.pre_tokenize_str(chr(c))) for c in range(0x21, 0x100)
        }
        self.chunks = _Cache(self._chunk)

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() else part.translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if "<|" not in chunk and _is_latin(chunk) and chunk.isprintable():
            low = chunk.lower()
            if low.isalpha():
                return self._part(low)
            parts = _PARTS.findall(low)
            if len(parts) == 1:
                return self._part(low)
            return b"".join(map(self.chunks.__getitem__, parts))
        ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as unsigned 32-bit little-endian integers."""
        if len(text) <= TEXT_BLOCK:
            return self._block(text)
        out, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + TEXT_BLOCK)
            end = cut.end() if cut else len(text)
            out.append(self._block(text[at:end]))
            at = end
        return b"".join(out)

    def _block(self, text: str) -> bytes:
        if "<|" not in text and _is_latin(text):
            text = text.lower()  # fewer kinds of chunks
        chunks = _SPACE.split(text) if _OTHER_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))


def tokenizer_at(path: str) -> WordTokenizer:
    """One per Python worker, so that its cache outlives a task; toxicity's tasks, which need the room, let it go."""
    return kept(path, lambda: WordTokenizer(path))


def _cut(path: str, id_column: str, text_column: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = tokenizer_at(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for row, text in enumerate(batch.column(text_column)):
                ids = memoryview(tokenizer.encode(text.as_py() or "") + end)
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
            ids = batch.column(id_column).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return run


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 2,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Tokenize every text and cut it at multiples of ``capacity``."""
    docs = docs.select(id_column, text_column)
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.mapInArrow(
        _cut(tokenizer_path, id_column, text_column, end_id, capacity),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long",
    )


# --- packing --------------------------------------------------------------------------


class Multiset:
    """Counts by length, and the ascending lengths that have any."""

    def __init__(self, counts: dict[int, int]):
        self.counts = dict(counts)
        self.lengths = sorted(counts)

    def take(self, length: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.lengths[bisect_left(self.lengths, length)]


def fullest(items: Multiset, room: int) -> list[int]:
    """Lengths from ``items`` whose sum is as close to ``room`` as can be, not above."""
    full, reached = (1 << (room + 1)) - 1, 1
    steps = []  # (length, copies taken together, sums that were possible before)
    for i in range(bisect_right(items.lengths, room) - 1, -1, -1):
        length = items.lengths[i]
        left, copies = min(items.counts[length], room // length), 1
        while left > 0:
            taken = min(copies, left)
            steps.append((length, taken, reached))
            reached |= (reached << (length * taken)) & full
            left, copies = left - taken, 2 * copies
        if reached >> room & 1:
            break
    target, chosen = reached.bit_length() - 1, []
    for length, taken, before in reversed(steps):
        if not before >> target & 1:
            chosen += [length] * taken
            target -= length * taken
    return chosen


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece, counted from 0, and its offset there."""
    rows: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        rows[int(lengths[i])].append(i)
    counts = Multiset({length: len(r) for length, r in rows.items()})
    sequence = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    n = 0
    while counts.lengths:
        seed = counts.lengths[-1]
        counts.take(seed)
        chosen = fullest(counts, capacity - seed)
        for length in chosen:
            counts.take(length)
        at = 0
        for length in [seed, *chosen]:
            row = rows[length].pop()
            sequence[row], offset[row] = n, at
            at += length
        n += 1
    return sequence, offset


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 2,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: its document, place, CRC-32, and the sequence and offset it is packed at.

    The pieces (numbers only) are written to the staging folder, so texts are tokenized once.
    """
    stage = Stage(docs.sparkSession)
    pieces = token_pieces(docs, tokenizer_path, id_column, text_column, end_id, capacity)
    pieces, facts = stage.save_with(
        pieces, "pieces", F.count(F.when(F.col("length") < capacity, 1)).alias("rest")
    )
    groups = max(1, -(-(facts["rest"] or 0) // GROUP_PIECES))
    numbered = pieces.withColumn("n", F.monotonically_increasing_id())
    whole = numbered.filter(F.col("length") == capacity).select(
        *pieces.columns, (2 * F.col("n") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    names = [*pieces.columns, "sequence_id", "offset"]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n", kind="stable", ignore_index=True)
        sequence, offset = pack_lengths(group["length"].to_numpy(), capacity)
        group["sequence_id"] = 2 * ((group["grp"].to_numpy() << 32) + sequence)
        group["offset"] = offset
        return group[names]

    rest = numbered.filter(F.col("length") < capacity).withColumn(
        "grp", F.pmod(F.col("n"), F.lit(groups)).cast("long")
    )
    return whole.unionByName(rest.groupBy("grp").applyInPandas(pack, whole.schema))
