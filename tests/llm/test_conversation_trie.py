from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from nearfield.llm import conversation_trie, registry

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, n int"
COLUMNS = [part.split()[0] for part in conversation_trie.NODES.split(", ")]


def turn_id(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows, graft=True):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, turn_id(role, text), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        if graft:
            h = zlib.crc32(str(c).encode()) % 4
            # The remainder has the sign of the id, as in SQL.
            turns = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
        paths[c] = tuple(turns)
    members, ends = {}, {}
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(members[p]) - 1) * words
    return [
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, m in members.items()
    ]


def some_rows(n, longest, seed=1, kinds=3):
    rnd = random.Random(seed)
    texts = [None, "", "a", "b c", " d\te  f", "é"][: kinds + 1]
    rows = []
    for _ in range(n):
        conv = rnd.choice([0, 1, 5, 19, 20, 21, 39, 40, 47, 60, 61, *range(81, 81 + n // 2)])
        rows += [(conv, t if t != 2 else None, rnd.choice(["u", None]), rnd.choice(texts)) for t in range(rnd.randint(0, longest))]
    rows += [(None, 0, "u", "x"), (-7, 1, "u", "a"), (-7, 1, "u", "a"), (10**12, -3, "", "b c")]
    return rows


def nodes_of(spark, rows, taken=None, **options):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = conversation_trie.conversation_trie(table, taken, **options)
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=repr)


def graft():
    return F.crc32(F.col("conv").cast("string").cast("binary")) % 4


@pytest.mark.parametrize("longest,options", [(3, {}), (3, {"shard_rows": 6}), (9, {"window": 2, "shard_rows": 7}), (6, {"window": 3})])
def test_equals_brute_force(spark, longest, options):
    rows = some_rows(60, longest)
    assert nodes_of(spark, rows, graft(), **options) == sorted(brute(rows), key=repr)


def test_copies_over_many_shards(spark):
    rows = [(c, t, "u", f"w{t} x") for c in range(100, 160) for t in range(5 + (c % 9 == 0))]
    rows += [(c, 0, "u", "w0 x") for c in range(160, 170)]
    for options in ({"shard_rows": 7}, {"shard_rows": 7, "window": 2}):
        assert nodes_of(spark, rows, **options) == sorted(brute(rows, graft=False), key=repr)


def test_a_conversation_with_most_rows(spark):
    rows = [(1, t, "u", f"{t % 7}") for t in range(700)] + [(2, t, "u", f"{t % 7}") for t in range(300)]
    assert nodes_of(spark, rows) == sorted(brute(rows, graft=False), key=repr)


def test_empty_table(spark):
    assert nodes_of(spark, []) == []


def test_only_conversations_without_turns(spark):
    conv = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(conv, 0, "u", "a")]
    assert nodes_of(spark, rows, graft()) == brute(rows) and len(brute(rows)) == 1


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in registry.op12_conversation_trie(spark, sf).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
