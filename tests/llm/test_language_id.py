import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DOCS

from tidemark.llm import language_id as li
from tidemark.llm.queries import QUERIES


def plain_points(text):
    lower = pa.compute.utf8_lower(pa.array([text or ""])).to_pylist()[0]
    letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in lower)
    inner = " ".join(letters.split(" ")).split()
    return " " + " ".join(inner) + (" " if inner else "")


def plain_grams(text, sizes):
    padded = plain_points(text)
    return [padded[i : i + n] for n in sizes for i in range(len(padded) - n + 1)]


TEXTS = ["", None, "  ", "12 !!", "a", "Abc d", "  -x- y--", "été À l'eau", "x" * 50, "a\n\nb", "éa"]


def test_code_points():
    points, bounds = li.code_points(pa.array(TEXTS, pa.string()))
    for text, a, b in zip(TEXTS, bounds[:-1], bounds[1:], strict=True):
        got = "".join(map(chr, points[a : b + 1]))
        assert got.split() == plain_points(text).split() and got[0] == got[-1] == " "
        assert "  " not in got or not got.strip()


@pytest.mark.parametrize("size", [2, 3, 5])
def test_grams_of_each_text(size):
    points, bounds = li.code_points(pa.array(TEXTS, pa.string()))
    grams = li.ngrams(points, size)
    first, last = li.spans_of(bounds, size)
    of = {}
    for text, a, b in zip(TEXTS, first, last, strict=True):
        want = plain_grams(text, [size]) if plain_points(text).strip() else None
        if want is None:
            continue
        assert b - a == len(want), text
        for gram, h in zip(want, grams[a:b].tolist(), strict=True):
            assert of.setdefault(gram, h) == h
    assert len(set(of.values())) == len(of)


def plain_model(rows, sizes, share):
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            own = plain_grams(text, sizes) if plain_points(text).strip() else []
            counts.setdefault(lang, Counter()).update(own)
    return {k: {g for g, n in c.items() if n >= share * sum(c.values())} for k, c in counts.items()}


def test_against_plain(spark):
    """With an almost empty filter no hit is by chance, so counts are those of exact sets."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([
        ("the cat and the dog sat on the mat", "en"), ("the house of the rising sun", "en"), ("le chat et le chien", "fr"),
        ("la maison du soleil levant était là", "fr"), ("der Hund und die Katze", "de"), (None, "de"), ("no label", None), ("123", "xx"),
    ])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(df, sizes=(2, 3), share=0.02, slot_bits=20)
    assert model.languages == ("de", "en", "fr", "xx")
    sets = plain_model([r[1:] for r in rows], (2, 3), 0.02)
    tests = [(100 + i, t) for i, t in enumerate(["the sun and the mat", "le soleil et la maison", "die Katze", "", None, "?!", "zzz", "q", "été"])]
    got = {r.doc_id: r for r in li.predict(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    for doc_id, text in tests:
        if not plain_points(text).strip():
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0)
            continue
        grams = plain_grams(text, (2, 3))
        hits = [sum(g in sets.get(x, ()) for g in grams) for x in model.languages]
        assert got[doc_id].lang_pred == model.languages[int(np.argmax(hits))], text
        assert abs(got[doc_id].score - max(hits) / len(grams)) < 1e-3


def test_chance_is_corrected():
    """In a filter that is half full, hits by chance don't count."""
    rng = np.random.default_rng(1)
    masks = (rng.random((1, 1 << 12)) < 0.5).astype(np.uint64)
    model = li.Model(("a",), masks, np.array([masks.mean() ** 2]), (3,), 12, 2)
    text = "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 20000))
    hits, totals = model.counts(*li.code_points(pa.array([text])))
    assert abs(hits[0, 0] / totals[0]) < 0.03


def test_blocks_of_a_text(monkeypatch):
    """Counts don't depend on where blocks of n-grams end."""
    rng = np.random.default_rng(2)
    masks = rng.integers(0, 4, (1, 1 << 12), dtype=np.uint64)
    model = li.Model(("a", "b"), masks, np.zeros(2), (3, 5), 12, 2)
    texts = pa.array([*TEXTS, "some words and more " * 9, ""], pa.string())
    whole = model.counts(*li.code_points(texts))
    for block in (1, 7, 64):
        monkeypatch.setattr(li, "BLOCK", block)
        hits, totals = model.counts(*li.code_points(texts))
        assert (hits == whole[0]).all() and (totals == whole[1]).all()


def test_many_languages(spark):
    rows = [(i * 3 + j, " ".join(chr(0x4E00 + i * 40 + k) * 3 for k in range(20)), f"l{i:03}") for i in range(130) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(df, slot_bits=16)
    assert model.masks.shape == (3, 1 << 16)
    got = {r.doc_id: r.lang_pred for r in li.predict(df, model).collect()}
    assert got == {d: lang for d, _, lang in rows}


def test_edges(spark):
    assert li.identify(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "some text", "en", 0.5, "z"), (1, "some text", None, 0.5, "z"), (1, "some text", None, 0.5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    assert {(r.lang_pred, r.score) for r in li.identify(df).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_language_id"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    tests = [r for r in got if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in tests) / len(tests)
    assert len(tests) > 250
    assert right > 0.97, right
