import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import vector_search as vs
from tidemark.llm.queries import QUERIES

ROW = "vec_id long, embedding array<float>"


def exact(vectors, queries, k):
    out = {}
    ids, matrix = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors], float)
    units = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    for q, x in queries:
        score = units @ (np.array(x, float) / np.linalg.norm(x))
        best = sorted((-round(s, 12), i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q)
        out[q] = [(i, -s) for s, i in best[:k]]
    return out


def recall(got, want):
    """Of the scores that the exact search has, how many were reached."""
    right = total = 0
    for q, rows in want.items():
        have = sorted((s for _, s in got.get(q, [])), reverse=True)
        total += len(rows)
        right += sum(a >= b - 1e-9 for a, (_, b) in zip(have, rows, strict=False))
    return right / total


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("least_shards", [1, 8])
def test_recall(spark, least_shards, monkeypatch):
    monkeypatch.setattr(vs, "shards", functools.partial(vs.shards, least_shards=least_shards))
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 24))
    rows = [(i, (centres[i % 30] + rng.normal(size=24) * 0.4).astype(np.float32).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, ROW)
    got = answers(vs.search(df, df.where("vec_id % 10 = 0"), 5))
    want = exact(rows, [r for r in rows if r[0] % 10 == 0], 5)
    assert recall(got, want) > 0.97
    assert all(len(r) == 5 for r in got.values())
    for q, rows_ in got.items():
        x = np.array(rows[q][1])
        for i, s in rows_:
            y = np.array(rows[i][1])
            assert abs(s - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-12


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = answers(QUERIES["op4_vector_search"](spark, sf))
    want = exact(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert got.keys() == want.keys()
    same = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert same > 0.95


def test_shards_by_size(spark):
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    index, count = vs.shards(df, 6, shard_bytes=1200, least_shards=2)
    assert count == 10 and index.count() <= 20
    assert sorted(i for r in index.collect() for ids in r.ids for i in ids) == sorted(r[0] for r in rows)


def test_work_grows_with_rows_and_answers(spark):
    """Five times the rows are not more shards, and a query gets k answers from each at most."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(3000)]
    for many in (600, 3000):
        df = spark.createDataFrame(rows[:many], ROW)
        found = vs.search(df, df.where("vec_id % 50 = 0"), 5)
        assert found.count() == 5 * many // 50
    assert vs.shards(df.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), 6)[1] == vs.LEAST_SHARDS


def test_copies_and_ties(spark):
    """Very many copies of a vector: the smallest ids, without the query's own."""
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(400, 0, -1)] + [(500 + i, [1.0, 2.0, 0.6 + i / 50]) for i in range(100)]
    got = answers(vs.search(spark.createDataFrame(rows, ROW), spark.createDataFrame([rows[399], rows[100], rows[450]], ROW), 5))
    assert [i for i, _ in got[1]] == [2, 3, 4, 5, 6]
    assert [i for i, _ in got[300]] == [1, 2, 3, 4, 5]
    assert len(got) == 3


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (None, [1.0, 0.0])]
    rows += [(6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (10, [1e30, 1e-30])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], ROW + ", score string, shard int")
    got = answers(vs.search(df, df, 5))
    assert [i for i, _ in got[0]] == [10, 5, 9]
    assert sorted(got) == [0, 5, 9, 10]
    assert abs(got[0][0][1] - 1) < 1e-12 and got[0][2][1] == -1
    assert vs.search(df.limit(0), df.limit(0)).collect() == []
    assert vs.search(df, df.where("vec_id = 2")).collect() == []


def test_pruning_keeps_diverse_edges():
    """A candidate goes if a nearer kept one is closer to it by the factor."""
    angles = np.array([0.0, 0.1, 0.12, -0.2, 0.5])
    units = np.stack([np.cos(angles), np.sin(angles)], axis=1).astype(np.float32)
    assert vs.prune(units, np.array([0]), np.array([[1, 2, 3, 4, -1, 1, 0]]), 1.0, 4).tolist() == [[1, 3, -1, -1]]
    assert vs.prune(units, np.array([0]), np.array([[1, 2, 3, 4]]), 100.0, 3).tolist() == [[1, 2, 3]]
