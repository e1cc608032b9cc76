from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import hmm

FIELDS = "doc_id long, text string, held_out string, block int"


def words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded)


def share(doc):
    return zlib.crc32(str(doc).encode()) % 5


def corpus(n=150):
    rnd = np.random.default_rng(3)
    tongues = [[f"{a}{i}{b}" for i in range(40)] for a, b in (("x", "ing"), ("y", "ung"), ("z", "ção"))]
    rows = []
    for i in range(n):
        tongue = tongues[int(rnd.integers(3))]
        chosen = [tongue[int(k)] for k in (rnd.random(int(rnd.integers(0, 150))) ** 3 * 40)]
        rows.append((i, " ".join(w.title() if rnd.random() < 0.1 else w for w in chosen)))
    return rows + [(900, None), (901, ""), (None, "x1ing new"), (rows[5][0], rows[5][1]), (902, " ".join(["rare"] * 3000))]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "h", 1) for r in rows], FIELDS)
    return [r.asDict() for r in hmm.score_language(docs, **options).collect()]


def base_of(rows):
    counts = Counter()
    for doc, text in rows:
        if doc is not None and share(doc) != 1:
            counts.update([*words(text), None])
    total, kinds = sum(counts.values()), len(counts)
    return counts, total, kinds


@pytest.mark.parametrize("block", [6_000_000, 500])
def test_counts_and_base_score(spark, monkeypatch, block):
    monkeypatch.setattr(hmm, "BLOCK_WORDS", block)
    monkeypatch.setattr(hmm, "TOP", hmm.TOP)
    rows = corpus()
    got = run(spark, rows, states=3, rounds=3)
    counts, total, kinds = base_of(rows)
    assert len(got) == len(rows)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, text)
    for r in got:
        tokens = [*words(texts[r["doc_id"]]), None]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        assert r["held_out"] == (r["doc_id"] is not None and share(r["doc_id"]) == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] <= 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_no_rows_and_no_training_rows(spark):
    assert run(spark, []) == []
    held = next(i for i in range(50) if share(i) == 1)
    (row,) = run(spark, [(held, "a b")], states=2, rounds=1)
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert math.isfinite(row["score"])


def small_model(rnd, states):
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    emit = np.full((hmm.BUCKETS, states), 1e-9)
    emit[:4] = rnd.random((4, states))
    return hmm.Hmm(norm(rnd.random(states), 0), norm(rnd.random((states, states)), 1), norm(emit, 0))


def all_paths(model, obs):
    states = range(len(model.start))
    for path in itertools.product(states, repeat=len(obs)):
        p = model.start[path[0]] * model.emit[obs[0], path[0]]
        for t in range(1, len(obs)):
            p *= model.step[path[t - 1], path[t]] * model.emit[obs[t], path[t]]
        yield path, p


def test_forward_sums_all_paths():
    rnd = np.random.default_rng(1)
    model = small_model(rnd, 3)
    texts = [rnd.integers(0, 4, n).astype(np.int32) for n in (1, 5, 3, 7, 1)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = hmm.forward_log10(model, np.concatenate(texts), first)
    want = [math.log10(sum(p for _, p in all_paths(model, t))) for t in texts]
    assert np.allclose(got, want)


def test_expected_counts_are_those_of_all_paths():
    rnd = np.random.default_rng(2)
    model = small_model(rnd, 2)
    lengths = np.array([6, 4, 4, 1])
    obs = rnd.integers(0, 4, (4, 6)).astype(np.int32)
    start, step, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((hmm.BUCKETS, 2))
    for row, n in zip(obs, lengths, strict=True):
        paths = list(all_paths(model, row[:n]))
        total = sum(p for _, p in paths)
        for path, p in paths:
            start[path[0]] += p / total
            for t in range(n):
                emit[row[t], path[t]] += p / total
                if t:
                    step[path[t - 1], path[t]] += p / total
    for got, want in zip(hmm.expected_counts(model, obs, lengths), (start, step, emit), strict=True):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-5)


def test_rounds_raise_the_likelihood():
    rnd = np.random.default_rng(7)
    obs = np.concatenate([rnd.integers(0, 2, (40, 8)), rnd.integers(2, 4, (40, 8))]).astype(np.int32)
    lengths, model, before = np.full(80, 8), small_model(rnd, 2), -np.inf
    first = np.arange(81) * 8
    for _ in range(8):
        now = hmm.forward_log10(model, obs.ravel(), first).sum()
        assert now >= before - 1e-3
        before = now
        start, step, emit = hmm.expected_counts(model, obs, lengths)
        model = hmm.Hmm(start / start.sum(), step / step.sum(axis=1, keepdims=True), (emit + 1e-12) / (emit + 1e-12).sum(axis=0))
