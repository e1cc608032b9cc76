from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.llm import components as graph
from nearfield.llm import minhash
from nearfield.llm.steps import Steps
from nearfield.plans.staging import Stage


def brute(rows):
    """Classes by comparing all pairs of texts."""
    texts = [t or "" for _, t in rows]
    bags = list(minhash._bags(pa.array(texts)))
    counts = np.zeros(minhash.DF_BUCKETS + 1, dtype=np.int64)
    for hashes, _ in bags:
        counts[np.unique(minhash._bucket(hashes))] += 1
        counts[-1] += 1
    idf = minhash.idf_table(counts)
    full = [np.repeat(*b) for b in bags]
    root = {doc: doc for doc, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is None or b is None or not len(full[i]):
                continue
            if texts[i] == texts[j] or minhash.weighted_jaccard(full[i], full[j], idf) >= minhash.THRESHOLD:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {doc: find(doc) for doc, _ in rows}


def corpus():
    rnd = random.Random(1)
    vocabulary = [f"w{i}é" for i in range(2000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows, doc = [], 0
    for _ in range(12):  # originals and copies with a few words changed
        original = text(rnd.choice([8, 60, 200]))
        for _ in range(rnd.randint(1, 12)):
            copy = list(original)
            for _ in range(rnd.choice([0, 1, 2, 3, 5])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((doc, " ".join(copy)))
            doc += 1
    shared = text(40)
    rows += [(doc + i, " ".join(shared + text(rnd.randint(5, 60)))) for i in range(20)]
    rnd.shuffle(rows)
    rows += [(1000, "one two"), (1001, "one  two"), (1002, "one two"), (1003, "one"), (1004, None), (1005, ""), (1006, " "), (None, rows[0][1])]
    return rows + [(1007, rows[0][1]), (1007, rows[1][1]), rows[2]]


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, u int")
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    return {r.doc_id: r.class_id for r in got}


@pytest.mark.parametrize("crowd", [4000, 3])
def test_same_as_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(minhash, "BUCKET_ROWS", crowd)
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def exact(rows):
    """Weights by document frequencies counted for every shingle, and similarities by them."""
    bags = [dict(zip(*(x.tolist() for x in b), strict=True)) for b in minhash._bags(pa.array([t for _, t in rows]))]
    df = Counter(h for b in bags for h in b)
    n = 1 + len(rows)
    weigh = {h: 1 + math.log(n / (1 + min(c, n - 1))) / math.log(n) for h, c in df.items()}

    def alike(i, j):
        low, high = (sum(f(bags[i].get(h, 0), bags[j].get(h, 0)) * weigh[h] for h in {**bags[i], **bags[j]}) for f in (min, max))
        return low / high

    return df, alike


@pytest.mark.parametrize("frequent", [1 << 18, 40, 1])
def test_frequencies_are_counted_for_every_shingle(spark, monkeypatch, frequent):
    monkeypatch.setattr(minhash, "FREQUENT", frequent)
    monkeypatch.setattr(minhash, "HELD", 500)
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(10**9)}"
    many = [word() for _ in range(94)]  # 90 shingles that 300 texts share
    rows = [(i, " ".join(many + [word() for _ in range(60)])) for i in range(298)]
    rows += [(1000 + i, " ".join(many + [word() for _ in range(n)])) for i, n in enumerate((10, 10, 5, 5))]
    # So many unique shingles that a table of hash buckets counts each of them several times.
    rows += [(2000 + i, " ".join(word() for _ in range(4000))) for i in range(250)]
    docs = spark.createDataFrame([(t,) for _, t in rows], "text string")
    df, alike = exact(rows)
    most, others = minhash.document_frequencies(docs, Steps(spark))
    got = dict(zip(most.hashes.tolist(), most.counts.tolist(), strict=True))
    assert len(got) <= frequent and most.texts == len(rows)
    got |= {r.h % 2**64: r.n for r in others.collect()}
    assert got == {h: c for h, c in df.items() if c > 1}
    a, b, c, d = range(298, 302)
    assert alike(a, b) < 0.8 <= alike(c, d)
    classes = run(spark, rows)
    assert classes[1001] != classes[1000] and classes[1002] == classes[1003]


@pytest.mark.parametrize("frequent", [40, 1])
def test_same_as_all_pairs_with_joined_frequencies(spark, monkeypatch, frequent):
    monkeypatch.setattr(minhash, "FREQUENT", frequent)
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(3, "a b c")]) == {3: 3}
    long = " ".join(f"v{i}" for i in range(150_000))
    assert run(spark, [(9, long), (4, long + " end"), (6, "a")]) == {9: 4, 4: 4, 6: 6}


def test_kept_rows(spark):
    rows = [(2, "a b c d e f", 11, "p"), (5, "a b c d e f", 11, "q"), (None, "a b c d e f", 11, "r"), (7, None, 0, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, class_id string")
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_samples_agree_as_often_as_texts_are_alike():
    rnd = np.random.default_rng(2)
    hashes = np.unique(rnd.integers(0, 2**64, 3000, dtype=np.uint64))
    rates = []
    for cut in (300, 900):
        a, b = hashes[:-cut], hashes[cut:]
        weight = dict(zip(hashes.tolist(), rnd.uniform(1, 4, len(hashes)), strict=True))
        wa, wb = (np.array([weight[x] for x in s.tolist()], dtype=np.float32) for s in (a, b))
        sample = minhash.samples(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a), len(a) + len(b)]))
        both = sum(weight[x] for x in np.intersect1d(a, b).tolist())
        rates.append((float((sample[0] == sample[1]).mean()), both / (wa.sum() + wb.sum() - both)))
    assert all(abs(got - want) < 0.17 for got, want in rates)  # about four standard deviations


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "u long, v long")
    got = graph.components(table, Stage(spark)).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in list(root)}
    assert len(got) == len(root)
    assert graph.components(table.filter(F.lit(False)), Stage(spark)).count() == 0


def test_samples_cost_shingles_of_the_usual_weight_by_a_table(monkeypatch):
    rnd = np.random.default_rng(8)
    hashes = rnd.integers(0, 2**64, 6000, dtype=np.uint64)
    first = np.array([0, 1, 500, 2500, 6000])
    weight = np.full(6000, 1.9, dtype=np.float32)
    weight[::50] = rnd.uniform(1, 4, 120)
    want = np.empty((4, len(minhash._SALTS)), dtype=np.uint32)
    for k, salt in enumerate(minhash._SALTS):
        at = (hashes * salt) >> np.uint64(48)
        r, beta = minhash._R[at], minhash._BETA[at]
        level = np.floor(np.log(weight) / r + beta)
        cost = minhash._LOG_C[at] - r * (level - beta + 1)
        value = minhash.mix(hashes + level.astype(np.int64).astype(np.uint64) * salt) >> np.uint64(32)
        parts = [slice(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
        want[:, k] = [value[p][cost[p] == cost[p].min()].min() for p in parts]
    worked_out, levels = [], minhash._levels
    monkeypatch.setattr(minhash, "_levels", lambda w, at: worked_out.append(len(w)) or levels(w, at))
    assert (minhash.samples(hashes, weight, first) == want).all()
    assert sum(worked_out) <= minhash.TRIPLES + 200 * len(minhash._SALTS)


def test_no_plan_reads_many_tables(spark, monkeypatch):
    """A plan's exchanges are prepared by as many threads of the driver."""
    sizes, save = {}, Steps.save_with

    def counted(self, df, name, *facts):
        sizes[name] = df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
        return save(self, df, name, *facts)

    monkeypatch.setattr(Steps, "save_with", counted)
    rows = corpus()
    assert run(spark, rows) == brute(rows)
    assert max(sizes.values()) <= 12, sizes
