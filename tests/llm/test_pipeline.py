from __future__ import annotations

import random
import re
import weakref
import zlib

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from nearfield.llm import packing, registry, toxicity
from nearfield.llm.secrets import find_secrets, mask_spans
from tests.llm.test_minhash import brute as near_classes
from tests.llm.test_substring_dedup import SEPARATORS


def corpus():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage, rows, labels = text(70), [], []
    for doc in range(400):
        words = text(rnd.randint(20, 150))
        toxic = doc % 7 == 0
        if toxic:
            for _ in range(5):
                words.insert(rnd.randrange(len(words)), "moron")
        elif doc % 10 == 1:
            at = rnd.randrange(len(words))
            words[at:at] = passage
        elif doc % 10 == 2:
            words.insert(3, "password=abcdefgh12345678")
        elif doc % 10 == 3 and doc > 20:
            words = rows[doc - 20][1].split()
            words[rnd.randrange(len(words))] = "changed"
        rows.append((doc, " ".join(words), "en", "s", len(" ".join(words)), "extra"))
        labels.append((doc, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    fields = "doc_id long, text string, lang string, source string, n_chars long, start string"
    spark.createDataFrame(rows, fields).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def expected(spark, folder):
    """The stages by brute force, from what the classifier says of each text."""
    rows, labels = corpus()
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.scores(toxicity.train_toxicity(docs, marks), pa.array([r[1] for r in rows]))
    right = [(score >= 0.5) == bool(y) for score, (_, _, y) in zip(scores, labels, strict=True)]
    assert sum(right) >= 0.95 * len(right)
    clean = {r[0]: r[1] for r, score in zip(rows, scores, strict=True) if score < 0.5}
    classes = near_classes(list(clean.items()))
    kept = {d: t for d, t in clean.items() if classes[d] == d}
    words = {d: re.findall(SEPARATORS, t) for d, t in kept.items()}
    first = {}
    for d in sorted(words):
        for s in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][s : s + 50]), d)
    out = {}
    for d, w in words.items():
        gone = {i for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < d for i in range(s, s + 50)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else kept[d]
        out[d] = mask_spans(text, find_secrets(text))
    return out


def test_stages_and_run_agree_with_brute_force(spark, folder):
    want = expected(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "secret_scans", "packing"]
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, folder)
        assert docs.columns == columns, name
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    got = docs.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) and r.start == "extra" for r in got)
    tokenizer = Tokenizer.from_file(registry.word_tokenizer())
    pieces = corpus_pipeline.run(spark, folder).collect()
    sizes = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    assert {r.doc_id: r.doc_tokens for r in pieces} == sizes
    assert sum(r.length for r in pieces) == sum(sizes.values())
    for r in pieces:
        ids = [*tokenizer.encode(want[r.doc_id], add_special_tokens=False).ids, 2][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, folder).count() == 0


def test_toxicity_lets_go_of_the_words_that_packing_keeps():
    path = registry.word_tokenizer()
    tokenizer = packing.tokenizer_at(path)
    assert packing.tokenizer_at(path) is tokenizer
    tokenizer.encode("some words")
    alive = weakref.ref(tokenizer)
    del tokenizer
    batch = pa.RecordBatch.from_pydict({"text": ["some words"]})
    assert sum(b.num_rows for b in toxicity._encode_rows(iter([batch]))) == 1
    assert alive() is None
