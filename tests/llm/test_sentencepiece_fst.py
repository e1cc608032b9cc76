from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import sentencepiece

from nearfield.llm import sentencepiece_fst as fst
from nearfield.llm.registry import piece_model

ODD = [
    "", " ", "  ", "   a  b   ", "a ", "▁", "▁a ▁", "<s>", "<0x41>", "\x00", "a" * 50, " " * 100, "=" * 77 + "a" + "-" * 40, "\n\n\n  x", "�", "é",
    "日本 語　テ 하 ᆫ", "😀😀 a😀b", "naïve café ÀÉÎ", "x­y ​soft\t\ttabs\r\n",
]


def ids(model, text):
    return np.frombuffer(model.encode(text), "<i4").tolist()


def test_ids_are_the_librarys():
    library, model = sentencepiece.SentencePieceProcessor(model_file=piece_model()), fst.transducer_at(piece_model())
    rnd = random.Random(5)
    letters = "  ab the ing▁\n\t.,éß日本語한😀\x00<s>0x0A12 =-*/_  ÀeEr"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    for text in texts:
        got = ids(model, text)
        assert got == library.encode(text), text
        assert model.decode(got) == library.decode(got), text


def test_decoding_of_any_ids():
    library, model = sentencepiece.SentencePieceProcessor(model_file=piece_model()), fst.transducer_at(piece_model())
    rnd = random.Random(6)
    for _ in range(1500):
        some = [rnd.randrange(0, 400 if rnd.random() < 0.5 else 32_000) for _ in range(8)]
        assert model.decode(some) == library.decode(some)


def test_small_caches_change_nothing(monkeypatch):
    text = "some words and Some wörds, 123  and\nmore " * 5
    want = ids(fst.transducer_at(piece_model()), text)
    monkeypatch.setattr(fst, "CACHE_PARTS", 16)
    with open(piece_model(), "rb") as file:
        assert ids(fst.Transducer(file.read()), text) == want


def message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_unigram_path_is_the_best_of_all():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "▁a": -2.2, "ba": -2.9, "aba": -4.5, "▁ab": -6.0}
    pieces = [(1, message((1, b"<unk>"), (2, 0.0), (3, 2)))]
    pieces += [(1, message((1, p.encode()), (2, s))) for p, s in scores.items()]
    model = fst.Transducer(message(*pieces, (2, message((3, 1)))))
    names = ["<unk>", *scores]
    rnd = random.Random(7)
    for _ in range(200):
        text = "".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 8))).strip()
        whole = model.normalize(text)
        best = None
        for cuts in itertools.product((0, 1), repeat=max(0, len(whole) - 1)):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(whole)]
            path = [whole[a:b] for a, b in itertools.pairwise(edges)]
            if all(p in scores for p in path):
                best = max(best or -1e9, sum(scores[p] for p in path))
        got = [names[i] for i in ids(model, text)]
        assert "".join(got) == whole
        assert not whole or abs(sum(np.float32(scores[p]) for p in got) - best) < 1e-4
    assert [names[i] for i in ids(model, "axyb")] == ["▁a", "<unk>", "b"]


def test_whole_table(spark):
    rows = [(i, t, 1, "n") for i, t in enumerate(ODD)] + [(90, None, 1, "n"), (0, "again again", 1, "n"), (None, "x" * 200_000, 1, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = fst.round_trips(docs, piece_model()).collect()
    want = sorted(((d, library.encode(t or "")) for d, t, _, _ in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.ids).encode()).hexdigest()
    assert all(r.round_trip for r in got if r.doc_id not in (5, 6))  # these hold U+2581
    encoded = fst.encode_texts(docs.filter("doc_id > 6"), piece_model())
    back = {r.doc_id: r.text for r in fst.decode_ids(encoded, piece_model()).collect()}
    assert back == {d: t or "" for d, t, _, _ in rows if d is not None and d > 6}
    assert fst.round_trips(docs.limit(0), piece_model()).count() == 0
