from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import merkle, registry
from nearfield.llm import sha_states as sha

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, n int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, more=0):
    n = r["n_chars"]
    return H(*map(field, (r["doc_id"], r["source"], r["lang"], None if n is None else n + more, r["text"])))


def tree_of(digests, fanout):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def climb(levels, i, digest, fanout):
    proof = []
    for level in levels[:-1]:
        first = i - i % fanout
        run = level[first : first + fanout]
        proof += run[: i % fanout] + run[i % fanout + 1 :]
        run[i % fanout] = digest
        digest, i = H(*run), i // fanout
    return digest, proof


def brute(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[g] = tree_of([leaf_of(r) for r in groups[g]], fanout)
    top = tree_of([trees[g][-1][0] for g in names], fanout)
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            broken = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf_of(r, 1 if broken else 0)
            sub, low = climb(trees[g], i, now, fanout)
            folded, high = climb(top, at, sub, fanout)
            root = top[-1][0]
            out.append((r["doc_id"], leaf_of(r), trees[g][-1][0], root, H(*low, *high), folded, folded == root))
    return out


def rows_of(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return [tuple(r[n] for n in names) for r in df.collect()]


def some_rows(n, seed=1):
    rnd = np.random.default_rng(seed)
    langs = ["en", "de", None, "", "é", "zh"]
    rows = []
    for i in range(n):
        rows.append(
            {
                "doc_id": None if i % 37 == 5 else int(i),
                "text": [None, "", "ä" * int(rnd.integers(0, 30)), f"text {i}"][int(rnd.integers(0, 4))],
                "lang": langs[min(int(rnd.geometric(0.5)) - 1, 5)],
                "source": None if i % 11 == 0 else f"s{i % 3}",
                "n_chars": None if i % 5 == 0 else i,
                "tree": "x",
                "n": i,
            }
        )
    return rows + rows[:9] + rows[:4]


@pytest.mark.parametrize("n,fanout,height", [(1, 2, 12), (3, 2, 12), (90, 2, 2), (90, 3, 1)])
def test_equals_brute_force(spark, n, fanout, height):
    rows = some_rows(n)
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = merkle.verify_manifest(
        docs, {"n_chars": F.col("n_chars") + 1}, registry.tampered(), fanout=fanout, block_height=height
    )
    assert sorted(rows_of(got), key=repr) == sorted(brute(rows, fanout), key=repr)


def test_empty_table(spark):
    assert rows_of(merkle.verify_manifest(spark.createDataFrame([], SCHEMA))) == []


def test_untouched_rows_all_fold_to_the_root(spark):
    docs = spark.createDataFrame([tuple(r.values()) for r in some_rows(40)], SCHEMA)
    assert all(r[-1] for r in rows_of(merkle.verify_manifest(docs, block_height=3)))


def test_hot_group_is_spread_over_ranges_and_blocks(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 50 > 0, "en").alias("lang"),
        F.lit("s").alias("source"), F.col("id").alias("n_chars"),
    )
    rows = [r.asDict() for r in docs.collect()]
    got = merkle.verify_manifest(docs, {"n_chars": F.col("n_chars") + 1}, registry.tampered(), block_height=5)
    assert sorted(rows_of(got)) == sorted(brute(rows))


def test_states_resume_like_the_whole_hash():
    raw = [hashlib.sha256(str(i).encode()).digest() for i in range(50)]
    d = sha.words_of(b"".join(raw))
    state = sha.append(sha.start(50), d)
    kept = sha.words_of(sha.bytes_of(state))
    got = sha.bytes_of(sha.finish(sha.append(kept, d[:, ::-1]), np.full(50, 2)))
    for i in range(50):
        assert got[i * 32 : i * 32 + 32].hex() == H(raw[i].hex(), raw[49 - i].hex())


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(rows_of(registry.op11_merkle_manifest(spark, sf))) == sorted(brute(rows))
