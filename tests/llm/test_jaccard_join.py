import random

import numpy as np
import pytest
from helpers import DOCS, jaccard_components, shingles

from tidemark.llm import jaccard_join as jj


def check(spark, rows, size, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.jaccard_join(df, size, percent).collect()
    want = jaccard_components(rows, size, percent)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted(
        (d, len(shingles(t, size))) for d, t in rows if d is not None
    )
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    return got


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, i = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[i] = f"x{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(i, rng.choice(words))
        elif len(words) > 1:
            del words[i]
    return words


@pytest.fixture(scope="module")
def corpus():
    """Near copies at every distance, long chains, shared passages, exact copies, short texts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for _ in range(12):
        seed = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 120, 400]))]
        for _ in range(12):
            rows.append(" ".join(edited(rng, seed, rng.randrange(0, max(2, len(seed) // 12)))))
    for _ in range(25):
        rows.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(60))]))
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(15):
        chain = edited(rng, chain, 3)
        rows.append(" ".join(chain))
    rows += ["a b", "A  B", "a", "a b c d", "a b c d", None, "", " \t\n"]
    rng.shuffle(rows)
    return [(i * 7 + 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (3, 60), (1, 100)])
def test_against_all_pairs(spark, corpus, size, percent):
    check(spark, corpus, size, percent)


def test_lists_in_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(jj, "LIST_BLOCK", 3)
    check(spark, corpus, 3, 80)


def test_links_that_no_hub_has(spark, corpus, monkeypatch):
    monkeypatch.setattr(jj, "HUBS", 1)
    check(spark, corpus, 3, 85)


def test_long_text_in_blocks(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import words

    text = " ".join(f"word{i % 97}  \n" for i in range(5000)) + "tail"
    whole = next(words.shingle_sets(pa.array([text]), 3))
    monkeypatch.setattr(words, "BLOCK", 64)
    assert np.array_equal(whole, next(words.shingle_sets(pa.array([text]), 3)))
    assert len(whole) == len(shingles(text, 3))


def test_steps_keep_every_link():
    """Sets that link share as many prefix tokens as each step asks for."""
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 80)
        x = rng.sample(range(1000), n)
        y = list(set(x) - set(rng.sample(x, rng.randrange(0, n // 8 + 1))) | set(rng.sample(range(1000), rng.randrange(0, n // 8 + 1))))
        for percent in (80, 90):
            common = len(set(x) & set(y))
            if not y or 100 * common < percent * (len(x) + len(y) - common):
                continue
            need = lambda s: jj.needed(len(s), percent)
            for step in range(1, min(need(x), need(y)) + 1):
                px = set(sorted(x)[: len(x) - need(x) + step])
                py = set(sorted(y)[: len(y) - need(y) + step])
                assert len(px & py) >= step
            assert len(set(x) ^ set(y)) <= jj.most_apart(len(x), len(y), percent)


def test_bitmaps_fold():
    found = np.random.default_rng(1).integers(0, 2**63, 700, dtype=np.uint64)
    wide = np.frombuffer(jj.parity(found, 1024), np.uint64)
    assert (wide[:8] ^ wide[8:]).tobytes() == jj.parity(found, 512)


def test_dear_lists_lengthen_the_prefix():
    assert jj.prefix_step(np.zeros(50), 100, 80) == 1
    assert jj.prefix_step(np.r_[np.full(21, 1000), np.zeros(29)], 100, 80) == jj.LONGEST_PREFIX_STEP


def test_edge_rows(spark):
    text = "one two three four five six"
    rows = [(1, text), (1, "other words here that link with none"), (2, text), (None, text), (3, None), (3, None)]
    rows += [(9, "other words here that link with none"), (0, "")]
    got = check(spark, rows, 3, 90)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.doc_id: r.component_id for r in got}[9] == 1


def test_empty_and_other_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jj.jaccard_join(empty).collect() == []
    df = spark.createDataFrame([(1, "a b c", 5, b"k", 7)], "doc_id long, text string, n long, key binary, component long")
    assert [tuple(r) for r in jj.jaccard_join(df).collect()] == [(1, 1, 1)]
