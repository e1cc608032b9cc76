from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from nearfield.llm import byte_bpe, registry

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}
    )


LETTERS = [*"'strevlmdaS1-!", " ", " ", "\n", "\t", "\x0b", "\xa0", "　", "\x1c", "é", "²", "界", "\U0001f600", "́", "\x00", "Ᲊ"]


def texts_of(n, seed=1):
    rnd = random.Random(seed)
    some = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]
    return some + [None, "", " ", "  ", "a ", " a", "\n a", "'s's", "'re'", "' re", "a" * 3000, " " * 999 + "x", "ab" * 700]


def encoded(vocabulary, texts):
    out = []
    for t in byte_bpe.encode(byte_bpe.Merger(vocabulary), pa.array(texts, pa.string())):
        raw = byte_bpe.decode(vocabulary, t.ids, t.first)
        for i in range(len(t.first) - 1):
            part = slice(t.first[i], t.first[i + 1])
            out.append((t.ids[part].tolist(), t.offsets[part].tolist(), raw[i]))
    return out


@pytest.mark.parametrize("size", [1, 200, byte_bpe.ENCODED_BYTES])
def test_ids_equal_the_library(vocabulary, library, size, monkeypatch):
    monkeypatch.setattr(byte_bpe, "ENCODED_BYTES", size)
    monkeypatch.setattr(byte_bpe, "CACHED_PIECES", 50)
    texts = texts_of(2000)
    got = encoded(vocabulary, texts)
    assert len(got) == len(texts)
    for text, (ids, offsets, raw) in zip(texts, got, strict=True):
        text = text or ""
        assert ids == library.encode_ordinary(text)
        assert raw == text.encode()
        size = [len(library.decode_single_token_bytes(i)) for i in ids]
        assert offsets == [sum(size[:i]) for i in range(len(ids))]


def test_scan_composes_functions():
    rnd = np.random.default_rng(3)
    functions = rnd.integers(0, 8, (100, 8)).astype(np.uint8)
    got, so_far = byte_bpe.scan(functions), np.arange(8)
    for i, f in enumerate(functions):
        so_far = f[so_far]
        assert (got[i] == so_far).all()


def test_stretches_do_not_matter(monkeypatch, vocabulary):
    texts = pa.array([t or "" for t in texts_of(300)])
    codes = np.array([ord(c) for t in texts.to_pylist() for c in t], dtype=np.uint32)
    first = np.cumsum([0, *(len(t) for t in texts.to_pylist())])
    symbol = byte_bpe.symbols(codes, first, vocabulary.classes)
    whole = byte_bpe.piece_starts(symbol)
    for size in (1, 2, 7, 1000):
        monkeypatch.setattr(byte_bpe, "STRETCH", size)
        assert (byte_bpe.piece_starts(symbol) == whole).all()


def test_matrix_and_heap_merge_alike(vocabulary):
    rnd = random.Random(5)
    merger = byte_bpe.Merger(vocabulary)
    pieces = [bytes(rnd.choice(b"abcdethin ") for _ in range(rnd.randint(1, 40))) for _ in range(500)]
    for piece, ids in zip(pieces, merger.tokens(pieces), strict=True):
        assert ids == (merger._merged_by_heap(piece) if piece not in vocabulary.ranks else (vocabulary.ranks[piece],))


def test_decode_refuses_unknown_ids(vocabulary):
    with pytest.raises(ValueError):
        byte_bpe.decode(vocabulary, np.array([len(vocabulary)]), np.array([0, 1]))


def test_columns_round_trip(spark):
    texts = texts_of(50)
    docs = spark.createDataFrame(
        [(i if i % 9 else None, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, ids string, bytes string"
    )
    out = byte_bpe.encode_documents(docs, PATH)
    assert out.columns == ["doc_id", "ids", "offsets"]
    back = byte_bpe.decode_documents(out, PATH)
    assert sorted(bytes(r["bytes"]).decode() for r in back.collect()) == sorted(t or "" for t in texts)
    none = byte_bpe.decode_documents(spark.sql("select 1L doc_id, cast(null as array<int>) ids"), PATH)
    assert bytes(none.first()["bytes"]) == b""
    assert byte_bpe.round_trips(docs.limit(0), PATH).count() == 0


def test_registered_query(spark, library):
    sf = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha(r["text"].encode())))
    got = registry.op13_byte_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
