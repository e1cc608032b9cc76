from __future__ import annotations

import hashlib
import random
import re

import pytest

from nearfield.llm import substring_dedup as dedup

SEPARATORS = r"[^\x20\x09-\x0D]+"


def brute(rows, size):
    """Removed words by comparing every window with every window under a smaller id."""
    words = [re.findall(SEPARATORS, text or "") for _, text in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - size + 1):
            if doc is not None:
                key = tuple(w[s : s + size])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - size + 1):
            if doc is not None and first[tuple(w[s : s + size])] < doc:
                gone.update(range(s, s + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, size):
    rnd = random.Random(seed)
    vocabulary = [f"wö{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [text(rnd.choice([size - 1, size, size + 1, 3 * size])) for _ in range(6)]
    rows = []
    for doc in rnd.sample(range(1000), 80):
        parts = [text(rnd.randint(0, 2 * size))]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(passages), text(rnd.randint(0, 30))]
        rows.append((doc, rnd.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    rows += [(rows[3][0] + 1000, rows[3][1]), (rows[4][0], rows[4][1]), (rows[5][0], rows[6][1])]
    rows += [(5000, None), (5001, ""), (None, rows[3][1]), (5002, " ".join(["again"] * 300)), (5003, " ".join(["again"] * 200))]
    return rows


def report(spark, rows, size):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, mark string")
    return [tuple(r) for r in dedup.dedup_report(docs, min_words=size).collect()]


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("size", "heavy"), [(50, 4096), (50, 2), (5, 4096), (12, 0)])
def test_same_as_all_windows(spark, monkeypatch, size, heavy):
    monkeypatch.setattr(dedup, "HEAVY_ROWS", heavy)
    rows = corpus(size + heavy, size)
    assert by_text(report(spark, rows, size)) == by_text(brute(rows, size))


def test_empty_table(spark):
    assert report(spark, [], 50) == []


def test_a_long_text(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(60))), (2, " ".join(f"a{i % 70000}" for i in range(300_000)))]
    got = {r[0]: r[1:3] for r in report(spark, rows, 50)}
    assert got == {1: (60, 0), 2: (300_000, 60 * 5)}


def test_rows_keep_their_columns(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, passage, 5, "a"), (2, f"x  {passage} y", 7, "b"), (3, "q  r", 9, "c"), (4, None, 1, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [
        (1, passage, 5, "a"), (2, "x y", 3, "b"), (3, "q  r", 9, "c"), (4, None, 1, "d"),
    ]


def test_automaton_matches():
    rnd = random.Random(3)
    for _ in range(50):
        automaton, seen = dedup.SuffixAutomaton(), []
        for _ in range(4):
            sequence = [rnd.randint(0, 2) for _ in range(rnd.randint(0, 12))]
            known = {tuple(s[i:j]) for s in seen for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
            want = [max([j - i for i in range(j) if tuple(sequence[i:j]) in known], default=0) for j in range(1, len(sequence) + 1)]
            assert automaton.matches(sequence) == want
            automaton.extend(sequence)
            seen.append(sequence)
