import math

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn
from tidemark.llm.queries import ORACLE, QUERIES

ROW = "vec_id long, label long, embedding array<double>"


def plain(rows, asked, positives=5, negatives=3):
    """All rows of the answer, from all pairs of whole-number vectors."""
    clean = {(i, c, tuple(math.floor(256 * x) for x in v)) for i, c, v in rows if None not in (i, c) and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    product = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True))))
    out = []
    for i, c, v in clean:
        if not asked(i):
            continue
        others = sorted((-product(v, w), j, d) for j, d, w in clean if j != i and len(w) == len(v))
        for s, j, _ in [o for o in others if o[2] == c][:positives]:
            fit = [(n, t) for t, n, d in others if d != c and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, j, rank + 1, n, -s, -t) for rank, (n, t) in enumerate(fit)]
    return sorted(out)


def got(spark, rows, ddl=ROW):
    return sorted(tuple(r) for r in hn.mine(spark.createDataFrame(rows, ddl), F.col("vec_id") % 10 == 0).collect())


def test_against_plain(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 20))
    rows = [(i, int(rng.integers(0, 3)), (centres[i % 12] + rng.normal(size=20) * 0.3).tolist()) for i in range(600)]
    rows += [(600 + i, i % 2, rng.integers(-1, 2, 20).astype(float).tolist()) for i in range(200)]  # many ties
    want = plain(rows, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert got(spark, rows) == want


def test_hot_copies(spark):
    """A third of all rows are one vector, of two labels."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [0.5] * 8) for i in range(150)] + [(150 + i, i % 3, (0.45 + rng.normal(size=8) * 0.1).tolist()) for i in range(300)]
    assert got(spark, rows) == plain(rows, lambda i: i % 10 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, 1, [1.0, 0.0]), (11, 1, [1.0, 0.5]), (12, 2, [0.8, 0.1]), (12, 2, [0.8, 0.1]), (13, None, [0.8, 0.1]), (None, 2, [0.8, 0.1])]
    rows += [(14, 2, [nan, 1.0]), (15, 2, [inf, 1.0]), (16, 2, [None, 1.0]), (17, 2, None), (18, 2, [0.7]), (10, 2, [0.9, 0.0]), (10, 2, [0.9, 0.0])]
    rows += [(20, 1, []), (21, 1, []), (22, 2, []), (30, 5, [1.0, 1.0]), (40, 1, [0.0, 0.0]), (41, 2, [-0.3, 0.2])]
    want = plain(rows, lambda i: i is not None and i % 10 == 0)
    assert (20, 21, 1, 22, 0, 0) in want
    assert got(spark, [(*r, 3, "x") for r in rows], ROW + ", rank int, positives string") == want
    assert got(spark, [], ROW) == []
    assert got(spark, rows[:1]) == []


def test_numbers_beyond_64_bits(spark):
    rows = [(10, 1, [1e30, 1.0]), (11, 1, [1e30, 0.0]), (12, 2, [5e-14, 1.0]), (13, 1, [3e-14, 7.0]), (14, 2, [2e15, 7.0]), (20, 1, [1e300, 1e300]), (21, 1, [0.5, 1e290])]
    rows += [(15, 2, [1e9 + i, 2.0**40]) for i in range(8)] + [(16, 1, [2.0**45, 2.0**40 + 3]), (30, 1, [2.0**20 + 0.3, 7.0])]
    assert got(spark, rows) == plain(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("dim", [1, 3, 64, 100, 300])
def test_no_score_outside_its_interval(dim):
    rng = np.random.default_rng(dim)
    vectors = np.floor(rng.normal(size=(400, dim)) * 80)
    vectors[:20] = vectors[20:40] * 3  # along each other
    vectors[40:45] = 0
    shard = hn.Shard(np.arange(400), np.zeros(400, int), vectors, *hn.encode(vectors))
    estimate, half = shard.intervals(vectors[:60], slice(0, 400))
    exact = hn.products(vectors[:60], vectors)
    assert (np.abs(exact - estimate) <= half).all()
    if dim >= 64:
        assert np.median(half / (np.linalg.norm(vectors[:60], axis=1)[:, None] * np.linalg.norm(vectors, axis=1) + 1)) < 0.7


def test_filter_saves_scoring():
    """With clusters, most pairs are passed over by their intervals alone."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 64))
    vectors = np.floor((centres[np.arange(4000) % 20] + rng.normal(size=(4000, 64)) * 0.1) * 50)
    labels = rng.integers(0, 2, 4000)
    shard = hn.Shard(np.arange(4000), labels, vectors, *hn.encode(vectors))
    anchors = {"vec_id": np.arange(50), "label": labels[:50], "vectors": vectors[:50]}
    found = list(shard.positives(anchors, 5))
    assert sum(len(a) for a, _, _ in found) == 250
    assert shard.survivors < 0.3 * shard.pairs


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op11_hard_negatives"](spark, sf), connect(sf), ORACLE["op11_hard_negatives"]) > 100
