from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from nearfield.llm import toxicity as tox


def corpus(n=900):
    rnd = random.Random(1)
    common = {
        "en": ["the", "and", "of", "house", "tree", "water"], "de": ["der", "und", "das", "haus", "baum"], "fr": ["le", "les", "et", "maison"],
    }
    bad = {"en": ["moron", "scum"], "de": ["lump"], "fr": ["nigaud"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(list(common))
        words = [rnd.choice(common[lang]) + rnd.choice(["", "", "s", "en"]) for _ in range(rnd.randint(5, 80))]
        toxic = rnd.random() < 0.3
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            words.insert(rnd.randint(0, len(words)), rnd.choice(bad[lang]) + rnd.choice(["", "e", "!!"]))
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, lang, "s") for d, t, lang, _ in rows], "doc_id long, text string, y string, score string")
    labels = spark.createDataFrame(
        [(d, 1, y) for d, _, _, y in rows] + [(1, 0, 0), (None, 0, 1), (5000, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"
    )
    return rows, docs, labels, tox.train_toxicity(docs, labels)


def test_held_out_accuracy(trained):
    rows, docs, _, model = trained
    truth = {d: y for d, _, _, y in rows}
    got = tox.score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_training_does_not_see_held_out_rows(spark, trained):
    rows, docs, labels, model = trained
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    again = tox.train_toxicity(docs, flipped)
    texts = pa.array([t for _, t, _, _ in rows[:50]])
    assert np.array_equal(tox.scores(model, texts), tox.scores(again, texts))


def test_odd_texts(spark, trained):
    _, _, _, model = trained
    texts = [None, "", "!!! ???", "moron", "x" * 300_000, "the house " * 60_000, "the house"]
    scores = tox.scores(model, pa.array(texts, pa.string()))
    assert scores[0] == scores[1] == scores[2] < 0.5
    assert np.isfinite(scores).all()
    alone = [tox.scores(model, pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(scores, alone, atol=1e-5)
    rows = [(1, "the moron and the scum and moron", 9, "a"), (2, "the house of the tree", 9, "b"), (2, "the house of the tree", 9, "b"), (None, None, 9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, predicted string")
    kept = tox.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
    assert tox.drop_toxic(docs.limit(0), model).count() == 0


def test_without_labels(spark, trained):
    _, docs, labels, _ = trained
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        model = tox.train_toxicity(docs, some)
        assert {(r.score, r.predicted) for r in tox.score_toxicity(docs, model).collect()} == {(0.0, 0)}


def test_pooling_is_the_largest_over_each_text(trained):
    model = trained[3]
    texts = ["moron the", "a", "", "le les et maison tree water of"]
    (x,) = tox.encoded(pa.array(texts))
    pooled = tox._pooled(model, x)[0]
    for i in range(len(texts)):
        a, b = x.first[i], x.first[i + 1]
        rows = [model.words[w] + model.stems[s] for w, s in zip(x.word[a:b], x.stem[a:b], strict=True)]
        rows += [np.zeros(tox.DIMS, np.float32)] * 2
        for k, width in enumerate(tox.WIDTHS):
            best = np.zeros(tox.FILTERS)
            for p in range(b - a):
                best = np.maximum(best, np.concatenate(rows[p : p + width]) @ model.filters[k] + model.biases[k])
            assert np.allclose(pooled[i, k * tox.FILTERS : (k + 1) * tox.FILTERS], best, atol=1e-5)


def test_languages_are_read_from_the_text():
    texts = ["the house and the tree", "der Baum und das Haus", "le ciel et les arbres", "el sol y los montes", "xyz"]
    (x,) = tox.encoded(pa.array(texts))
    assert [tox.LANGUAGES[i] for i in x.language] == ["en", "de", "fr", "es", "other"]


def test_a_long_document_does_not_empty_the_sample(spark, trained, monkeypatch):
    _, docs, labels, _ = trained
    monkeypatch.setattr(tox, "WIDEST", 0.1)
    long = spark.createDataFrame([(10**6 + i, "the tree " * 4000, "", "") for i in range(5)], docs.schema)
    more = labels.unionByName(spark.createDataFrame([(10**6 + i, 1, i % 2) for i in range(5)], labels.schema))
    model = tox.train_toxicity(docs.unionByName(long), more, max_words=20_000)
    assert model.trained and tox.scores(model, pa.array(["the moron scum moron"]))[0] > 0.5
    with pytest.raises(ValueError, match="max_words"):
        tox.train_toxicity(docs, labels, max_words=10)


def test_sample_is_about_as_large_as_asked_for(spark, trained):
    _, _, labels, _ = trained
    many = spark.range(40_000).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic")
    kept = {r["y"]: r["n"] for r in tox._sampled_ids(many, "doc_id", "toxic", 500).groupBy("y").count().withColumnRenamed("count", "n").collect()}
    assert all(400 < kept[y] < 600 for y in (0, 1))
    assert tox._sampled_ids(labels, "doc_id", "toxic", 4000).count() == tox._sampled_ids(labels, "doc_id", "toxic", 10**9).count()


def test_repeated_ids_are_learnt_once(spark, trained):
    rows, docs, labels, model = trained
    again = tox.train_toxicity(docs.unionByName(docs), labels)
    texts = pa.array([t for _, t, _, _ in rows[:50]])
    assert np.array_equal(tox.scores(model, texts), tox.scores(again, texts))


def test_training_takes_little_beyond_its_input(monkeypatch):
    monkeypatch.setattr(tox, "EPOCHS", 1)
    monkeypatch.setattr(tox, "LEAST_STEPS", 1)
    rnd = np.random.default_rng(1)
    n = 8000
    first = np.arange(n + 1) * 750
    words = [rnd.integers(0, 65536, first[-1]).astype(np.uint16) for _ in range(2)]
    x = tox.Encoded(*words, first, np.zeros(n, dtype=np.int64))
    monkeypatch.setattr(tox, "BATCHES", 1)
    monkeypatch.setattr(tox._Adam, "step", lambda self, gradients: None)
    tracemalloc.start()
    tox.train(x, np.arange(n) % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def test_gradients_equal_finite_differences():
    (x,) = tox.encoded(pa.array(["a b c d a", "e f", "g", ""]))
    y = np.array([1.0, 0.0, 1.0, 0.0])
    model = tox._start(x, np.arange(4), y)
    for w in (model.words, model.stems, *model.filters, *model.biases, model.out):
        w += np.random.default_rng(4).normal(0, 0.3, w.shape).astype(np.float32)
    model.words[-1] = model.stems[-1] = 0

    def loss():
        z = tox.logits(model, x)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    found = tox._gradients(model, x, y)
    weights = [model.words, model.stems, *model.filters, *model.biases, model.out]
    for w, g in zip(weights, found, strict=False):
        dense = np.zeros_like(w)
        if isinstance(g, tuple):
            dense[g[0]] = g[1]
        else:
            dense[...] = g.reshape(w.shape)
        spots = np.argsort(-np.abs(dense), axis=None)[:6]
        for spot in spots:
            at = np.unravel_index(spot, w.shape)
            old, step = w[at], 1e-2
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * step) - dense[at]) < 2e-3 + 0.05 * abs(dense[at])


def test_thresholds_equal_those_of_all_cuts():
    rnd = np.random.default_rng(6)
    for _ in range(30):
        z = rnd.integers(-5, 6, 40) / 2
        y = (z + rnd.normal(0, 2, 40) > 0).astype(float)
        if y.min() == y.max():
            continue
        cut = tox._thresholds(z, y, np.zeros(40, dtype=int))[0]

        def f1(t, z=z, y=y):
            hit = z >= t
            return 2 * (hit & (y == 1)).sum() / max(1, hit.sum() + y.sum())

        assert f1(cut) >= max(f1(t) for t in z) - 1e-12


def test_documents_beyond_any_sample_are_learnt_from(spark):
    ids = spark.range(12_000).selectExpr("id", "shiftrightunsigned(xxhash64(id), 32) as h").filter("crc32(cast(cast(id as string) as binary)) % 5 != 0")
    order = [r["id"] for r in ids.orderBy("h").collect()]
    rnd = random.Random(5)
    common = ["house", "tree", "water", "road", "stone", "bread", "river", "light"]
    toxic = {d: int(i % 5 > 0) for i, d in enumerate(order)}
    last = set([d for d in order if toxic[d]][-150:])
    rows = []
    for d in order:
        own = ["zorn", "zorn"] if d in last else ["moron"] if toxic[d] else []
        rows.append((d, " ".join([rnd.choice(common) for _ in range(6)] + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    scores = tox.scores(tox.train_toxicity(docs, labels), pa.array(["house tree zorn zorn", "house moron tree", "house tree road water"]))
    assert scores[0] > 0.5 and scores[1] > 0.5 > scores[2]


def test_many_documents_are_learnt_from_in_parts(spark, trained, monkeypatch):
    rows, docs, labels, _ = trained
    monkeypatch.setattr(tox, "PART_DOCS", 150)
    twice = docs.unionByName(docs.filter("doc_id % 3 = 0"))
    models = [tox.train_toxicity(d, labels) for d in (docs.repartition(3), twice)]
    truth = {d: y for d, _, _, y in rows}
    held = [r for r in tox.score_toxicity(docs, models[0]).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    texts = pa.array([t for _, t, _, _ in rows[:50]])
    assert np.array_equal(*(tox.scores(m, texts) for m in models))


def test_all_documents_are_in_the_parts(spark, trained, monkeypatch):
    rows, docs, labels, _ = trained
    monkeypatch.setattr(tox, "PART_DOCS", 150)
    seen = []
    monkeypatch.setattr(tox, "_fit_parts", lambda steps, rows, facts: seen.append((rows.collect(), facts)) or tox._untrained())
    monkeypatch.setattr(tox.Steps, "drop", lambda self: None)
    tox.train_toxicity(docs, labels)
    ((found, facts),) = seen
    kept = [(d, t) for d, t, _, _ in rows if zlib.crc32(str(d).encode()) % 5]
    assert len(found) == len(kept) == facts["ones"] + facts["zeros"] and len({r.part for r in found}) > 1
    sizes = sum(np.diff(x.first).sum() for x in tox.encoded(pa.array([t for _, t in kept])))
    assert facts["words"] == sizes


def test_long_texts_are_pooled_in_pieces(trained, monkeypatch):
    model = trained[3]
    (x,) = tox.encoded(pa.array(["moron the " * 9, "", "a", "le les et maison tree water of scum " * 5, "house"]))
    whole = tox._pooled(model, x, keep=True)
    for size in (1, 2, 7):
        monkeypatch.setattr(tox, "POOLED_WORDS", size)
        for a, b in zip(whole, tox._pooled(model, x, keep=True), strict=True):
            assert np.allclose(a, b, atol=1e-5)
