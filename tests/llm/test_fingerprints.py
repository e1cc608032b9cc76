from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa

from nearfield.llm import fingerprints as fp
from nearfield.llm.words import slices


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((doc, text, text[: len(text) - half] + after[:half], after))
    return out


def text(rnd, n):
    return " ".join(rnd.choice(["ä", "be", "cé", "do", "😀", "ef", "gh"]) for _ in range(n))


def expected(rows):
    out = []
    for doc, own, new, after in edited(rows):
        a, b, c = fp.sketches(pa.array([own, new, after], pa.string()))
        out.append((doc, len(own), hashlib.sha256(new.encode()).hexdigest(), fp.encode(a), fp.encode(b), fp.resemblance(a, b), fp.resemblance(a, c)))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "g") for r in rows], "doc_id long, text string, bucket int, guard string")
    return sorted([tuple(r)[:7] for r in fp.fingerprint_edits(docs).collect()], key=str)


def test_edits_follow_the_order(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, rnd.randint(0, 60))) for i in rnd.sample(range(-500, 10_000), 150)]
    rows += [(rows[0][0], text(rnd, 9)), rows[1], (20_000, None), (20_001, ""), (None, "ä be cé do ef gh"), (None, "ä be")]
    assert run(spark, rows) == expected(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    one = [(7, "a b c d e f g h")]
    assert run(spark, one) == expected(one)
    assert run(spark, [(1, "x y"), (1, "x y")]) == expected([(1, "x y"), (1, "x y")])


def shingles(value):
    words = value.split()
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_estimates():
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(vocabulary) for _ in range(4000)]
    for cut in (0, 400, 2000, 4000):
        other = base[cut:] + [rnd.choice(vocabulary) for _ in range(cut)]
        a, b = " ".join(base), " ".join(other)
        x, y = fp.sketches(pa.array([a, b]))
        sa, sb = shingles(a), shingles(b)
        assert abs(fp.resemblance(x, y) - len(sa & sb) / len(sa | sb)) < 0.15
        assert abs(fp.containment(x, y) - len(sa & sb) / len(sa)) < 0.2
    many = [" ".join(str(rnd.random()) for _ in range(2004)) for _ in range(40)]
    errors = [fp.distinct_count(s) / 2000 - 1 for s in fp.sketches(pa.array(many))]
    assert abs(np.mean(errors)) < 0.05  # 9 % each
    assert np.std(errors) < 0.15
    (small,) = fp.sketches(pa.array(["a b c d e f a b c d e f"]))
    assert fp.distinct_count(small) == len(shingles("a b c d e f a b c d e f"))


def test_encoding_and_union(spark):
    rnd = random.Random(3)
    texts = [text(rnd, n) for n in (0, 1, 3, 5, 200, 5000)]
    found = fp.sketches(pa.array(texts))
    for s in found:
        assert (fp.decode(fp.encode(s)) == s).all()
    whole = np.unique(np.concatenate(found))[: fp.K]
    docs = spark.createDataFrame([(i, t, "g") for i, t in enumerate(texts)] + [(9, None, "g"), (10, None, "e")], "doc_id long, text string, k string")
    rows = fp.fingerprint_texts(docs).join(docs.select("doc_id", "k"), "doc_id")
    got = {r.k: r.fingerprint for r in fp.merge_fingerprints(rows, "k").collect()}
    assert got == {"g": fp.encode(whole), "e": ""}


def test_slices_do_not_matter():
    rnd = random.Random(4)
    column = pa.chunked_array([[text(rnd, rnd.randint(0, 30)) for _ in range(20)], ["", None, "a"], []], type=pa.string())
    collect = lambda limit: [s[0][s[1][i] : s[1][i + 1]].tolist() for p in slices(column, limit) for s in [p.shingles()] for i in range(len(p))]
    assert collect(1) == collect(100) == collect(1 << 20)
    assert [len(x) for x in collect(7)] == [max(1, len(t.split()) - 4) if t and t.split() else 0 for t in column.to_pylist()]
