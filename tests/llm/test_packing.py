from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from nearfield.llm import packing
from nearfield.llm.registry import word_tokenizer

ODD = [
    "", "a\x1cb c", "É́ x̂", "̀a b", "<|endoftext|>x <|ENDOFTEXT|> y", "İstanbul ΣΑΣ ςσ", "don't I'LL x'S ½²³ªº µ ×÷ \xa0\x85 q",
    "日本 語　テ", "하 ᆫ", "'s's 's'T ''re", "ﬁ Å K", "a\x00b", "​ x‍y", "😀😀 a😀b", "naïve café ÀÉÎ Ÿÿ ẞß", "x­y soft",
]


def test_ids_are_the_tokenizers_own():
    whole, own = Tokenizer.from_file(word_tokenizer()), packing.WordTokenizer(word_tokenizer())
    rnd = random.Random(1)
    letters = "aBcé ÀßÞ'sStT're 12½²_-.,!<|>\t\n\x1c\xa0\x85́ÅΣ日　İ×ªµ\x00"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_long_texts_and_small_caches(monkeypatch):
    whole = Tokenizer.from_file(word_tokenizer())
    monkeypatch.setattr(packing, "TEXT_BLOCK", 10)
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    own = packing.WordTokenizer(word_tokenizer())
    text = " ".join(f"Word{i % 7}, näme\n" for i in range(200))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_fullest_is_the_best_subset():
    rnd = random.Random(2)
    for _ in range(300):
        lengths = [rnd.randint(1, 12) for _ in range(rnd.randint(0, 7))]
        room = rnd.randint(0, 25)
        counts = {x: lengths.count(x) for x in lengths}
        chosen = packing.fullest(packing.Multiset(counts), room)
        assert all(chosen.count(x) <= counts[x] for x in chosen)
        sums = {sum(c) for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n)}
        assert sum(chosen) == max(s for s in sums if s <= room)


@pytest.mark.parametrize("group", [20_000, 7])
def test_every_id_once(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_PIECES", group)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["one", "two", "Größe", "x1"]) for _ in range(rnd.choice([0, 3, 40, 400]))) for _ in range(60)]
    rows = [(i, t, 5, "o") for i, t in enumerate(texts)] + [(70, None, 5, "o"), (None, "one two", 5, "o"), (0, texts[0], 5, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, offset string")
    got = packing.pack_documents(docs, word_tokenizer(), capacity=128).collect()
    tokenizer = Tokenizer.from_file(word_tokenizer())
    want = []
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 128):
            part = np.array(ids[s : s + 128], dtype="<u4").tobytes()
            want.append((doc, s, len(part) // 4, zlib.crc32(part), len(ids)))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    if group > 100:  # in one group: no more sequences than first fit by falling length needs
        bins = []
        for length in sorted((w[2] for w in want), reverse=True):
            at = next((i for i, used in enumerate(bins) if used + length <= 128), None)
            if at is None:
                bins.append(length)
            else:
                bins[at] += length
        assert len(sequences) <= len(bins)


def test_little_padding():
    rnd = np.random.default_rng(5)
    lengths = np.minimum(rnd.lognormal(6.5, 1.2, 20_000).astype(int) + 1, 4095)
    sequence, _ = packing.pack_lengths(lengths)
    assert sequence.max() + 1 <= -(-lengths.sum() // 4096) + 1


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, word_tokenizer()).count() == 0
