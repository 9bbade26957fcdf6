"""Approximate nearest neighbours by cosine: a robust-pruned directed graph per shard.

Equal vectors become one node first, with the few smallest ids that an answer can need.
Nodes are dealt into shards, as large as a task's memory allows and some dozen at least,
so that their number grows with the rows far more slowly than these. Each shard gets a graph: starting from
random edges, a greedy search from the entry points proposes neighbours of a node, and
pruning walks over them from the nearest on, dropping every one that a kept one is
closer to by a factor, so that the edges kept point into different directions. Edges are
added backwards too, and pruned again where a node has too many. Two rounds are made,
the second with the relaxed factor.

A task loads one shard and lets all queries stream past in blocks; a beam search, which
opens the best few unopened nodes of its list in every step, answers all queries of a
block together. Scores are then computed anew in double precision from the original vectors,
and the best of all shards stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SHARD_BYTES = 1 << 25
"""Of vectors as doubles in a shard: 65,536 of 64 numbers."""
LEAST_SHARDS = 16
BLOCK_ROWS = 512
DEGREE = 32
BEAM = 64
WIDTH = 4
RELAXED = 1.2
ENTRIES = 8


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    """Of length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of each query with its own row of vectors, in double precision."""
    scale = lambda x: x / np.abs(x).max(axis=-1, keepdims=True)
    a, b = scale(queries)[:, None, :], scale(vectors)
    dots = (a * b).sum(axis=2)
    return np.clip(dots / (np.sqrt((a * a).sum(axis=2)) * np.sqrt((b * b).sum(axis=2))), -1.0, 1.0)


class Graph:
    """The edges of one shard: up to ``degree`` per node, -1 where there are fewer."""

    def __init__(self, units: np.ndarray, edges: np.ndarray, entries: np.ndarray) -> None:
        self.units, self.edges, self.entries = units, edges, entries

    def search(self, queries: np.ndarray, beam: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes found for each query, nearest first, with their distances; -1 where there are fewer."""
        n = len(queries)
        nodes = np.full((n, beam), -1, np.int32)
        far = np.full((n, beam), np.inf, np.float32)
        entries = self.entries[:beam]
        nodes[:, : len(entries)] = entries
        far[:, : len(entries)] = 1 - queries @ self.units[entries].T
        opened = np.zeros((n, beam), bool)
        rows = np.arange(n)
        while len(rows):
            closed = np.where(opened[rows] | (nodes[rows] < 0), np.inf, far[rows])
            some = np.argpartition(closed, width, axis=1)[:, :width] if beam > width else np.tile(np.arange(beam), (len(rows), 1))
            real = np.take_along_axis(closed, some, 1) < np.inf
            going = real.any(axis=1)
            rows, some, real = rows[going], some[going], real[going]
            if not len(rows):
                break
            flags = opened[rows]
            np.put_along_axis(flags, some, True, 1)
            new = self.edges[np.take_along_axis(nodes[rows], some, 1)]
            new = np.where(real[:, :, None], new, -1).reshape(len(rows), -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[(new[:, :, None] == nodes[rows][:, None, :]).any(axis=2)] = -1
            away = 1 - np.matmul(self.units[new], queries[rows][:, :, None])[:, :, 0]
            away[new < 0] = np.inf
            all_nodes = np.concatenate([nodes[rows], new], axis=1)
            all_far = np.concatenate([far[rows], away], axis=1)
            all_opened = np.concatenate([flags, np.zeros(new.shape, bool)], axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[rows] = np.take_along_axis(all_far, best, 1)
            nodes[rows] = np.where(far[rows] < np.inf, np.take_along_axis(all_nodes, best, 1), -1)
            opened[rows] = np.take_along_axis(all_opened, best, 1)
        return nodes, far


def prune(units: np.ndarray, own: np.ndarray, others: np.ndarray, factor: float, degree: int) -> np.ndarray:
    """Of each node's candidates (-1: none), those to keep as edges, nearest first."""
    others = np.sort(np.where(others == own[:, None], -1, others), axis=1)
    others[:, 1:][others[:, 1:] == others[:, :-1]] = -1
    vectors = units[others]
    apart = lambda dots: np.sqrt(np.maximum(2 - 2 * dots, 0))
    far = apart(np.matmul(vectors, units[own][:, :, None])[:, :, 0])
    far[others < 0] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    others, far = np.take_along_axis(others, order, 1), np.take_along_axis(far, order, 1)
    vectors = units[others]
    between = apart(np.matmul(vectors, vectors.transpose(0, 2, 1)))
    alive = others >= 0
    kept = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for i in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        kept[some, i] = others[rows, first][some]
        alive &= ~(some[:, None] & (factor * between[rows, first] <= far))
        alive[rows, first] = False
    return kept


def build(units: np.ndarray, degree: int = DEGREE, beam: int = BEAM, factor: float = RELAXED, seed: int = 1) -> Graph:
    """The graph of one shard."""
    n = len(units)
    rng = np.random.default_rng(seed)
    middle = int(np.argmax(units @ units.mean(axis=0)))
    entries = np.unique(np.r_[middle, rng.integers(0, n, ENTRIES - 1)]).astype(np.int32)
    if n <= degree + 1:
        every = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        return Graph(units, np.concatenate([every, np.full((n, degree + 1 - n), -1, np.int32)], axis=1), entries)
    edges = np.full((n, degree), -1, np.int32)
    edges[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    graph = Graph(units, edges, entries)
    for relaxed in (1.0, factor):
        order = rng.permutation(n).astype(np.int32)
        for start in range(0, n, 256):
            own = order[start : start + 256]
            near, _ = graph.search(units[own], beam)
            edges[own] = prune(units, own, np.concatenate([near, edges[own]], axis=1), relaxed, degree)
            _add_back(graph, own, relaxed)
    return graph


def _add_back(graph: Graph, own: np.ndarray, factor: float) -> None:
    """Edges from the neighbours of nodes to these."""
    edges, degree = graph.edges, graph.edges.shape[1]
    to = edges[own].ravel()
    source = np.repeat(own, degree)[to >= 0]
    to = to[to >= 0]
    order = np.argsort(to, kind="stable")
    to, source = to[order], source[order]
    targets, first, many = np.unique(to, return_index=True, return_counts=True)
    for size in np.unique(many).tolist():
        some = targets[many == size]
        new = source[first[many == size][:, None] + np.arange(size)]
        have = edges[some]
        new = np.where((new[:, :, None] == have[:, None, :]).any(axis=2), -1, new)
        total = (have >= 0).sum(axis=1) + (new >= 0).sum(axis=1)
        fits = total <= degree
        if fits.any():
            both = np.concatenate([have[fits], new[fits]], axis=1)
            both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
            edges[some[fits]] = both[:, :degree]
        for i in range(0, int((~fits).sum()), 512):
            full = some[~fits][i : i + 512]
            both = np.concatenate([have[~fits][i : i + 512], new[~fits][i : i + 512]], axis=1)
            edges[full] = prune(graph.units, full, both, factor, degree)


def _matrix(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.float64)


SHARD = "dim int, shard int, vectors binary, ids array<array<long>>, edges binary, entries array<int>"


def _units_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with the same keys, as they come."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(values[first].tolist()), batch.slice(first, last - first)


def _build_pass(degree: int, beam: int, factor: float):
    """A row per shard and dimension from its vectors, which come one after the other."""

    def made(key: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        vectors = np.concatenate([_matrix(p.column("vector")) for p in parts])
        graph = build(_units(vectors), degree, beam, factor)
        ids = [own for p in parts for own in p.column("ids").to_pylist()]
        values = [[key[1]], [key[0]], [vectors.tobytes()], [ids], [graph.edges.astype(np.int32).tobytes()], [graph.entries.tolist()]]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.list_(pa.int32())]
        columns = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["dim", "shard", "vectors", "ids", "edges", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for key, rows in _units_of(batches, ["shard", "dim"]):
            if key != held and parts:
                yield made(held, parts)
                parts = []
            held = key
            parts.append(rows)
        if parts:
            yield made(held, parts)

    return run


def shards(vectors: DataFrame, spare: int, shard_bytes: int = SHARD_BYTES, degree: int = DEGREE, beam: int = BEAM, factor: float = RELAXED, least_shards: int = LEAST_SHARDS):
    """The index: a stored row per shard and dimension, and the number of shards.

    ``vectors`` has ``vec_id long`` and ``vector array<double>``, all usable. Of equal
    vectors the index has the ``spare`` smallest ids.
    """
    place = Window.partitionBy("vector").orderBy("vec_id")
    few = vectors.distinct().withColumn("place", F.row_number().over(place)).where(F.col("place") <= spare)
    nodes = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = stored(nodes.select("vector", "ids", F.col("ids")[0].alias("first"), F.size("vector").alias("dim")), "nodes")
    size = nodes.agg(F.sum(F.col("dim").cast("long") * 8)).first()[0] or 0
    count = max(least_shards, -(-size // shard_bytes))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("first", "dim"), F.lit(count)).cast("int"))
    dealt = dealt.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "dim", "first")
    return stored(dealt.mapInArrow(_build_pass(degree, beam, factor), SHARD), "shards"), count


def _search_pass(k: int, beam: int):
    """Keeps a shard, which comes first, and answers the queries that follow, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, graph = None, None
        for (shard, dim, is_query), rows in _units_of(batches, ["shard", "dim", "is_query"]):
            if not is_query:
                get = lambda name, rows=rows: rows.column(name)[0]
                vectors = np.frombuffer(get("vectors").as_buffer(), np.float64).reshape(-1, dim)
                edges = np.frombuffer(get("edges").as_buffer(), np.int32).reshape(len(vectors), -1)
                held, graph = (shard, dim), Graph(_units(vectors), edges, np.array(get("entries").as_py(), np.int32))
                ids = get("ids").as_py()
            elif held == (shard, dim):  # otherwise the shard has no vectors of this length
                for at in range(0, rows.num_rows, BLOCK_ROWS):
                    some = rows.slice(at, BLOCK_ROWS)
                    yield _answers(graph, vectors, ids, some.column("vec_id").to_numpy(), _matrix(some.column("vector")), k, beam)

    return run


def _answers(graph, vectors, ids, query_ids, queries, k, beam) -> pa.RecordBatch:
    nodes, _ = graph.search(_units(queries), beam)
    scores = np.where(nodes >= 0, cosines(queries, vectors[nodes]), -np.inf)
    found: list[tuple[int, int, float]] = []
    for query, own, score in zip(query_ids.tolist(), nodes.tolist(), scores.tolist(), strict=True):
        best = [(-s, i) for node, s in zip(own, score, strict=True) if node >= 0 for i in ids[node] if i != query]
        found += [(query, i, -s) for s, i in sorted(best)[:k]]
    columns = zip(*found, strict=True) if found else ([], [], [])
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score"])


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", shard_bytes: int = SHARD_BYTES, beam: int = BEAM, degree: int = DEGREE
) -> DataFrame:
    """The ``k`` nearest found of ``vectors`` for each of ``queries``, but for rows of the query's own id.

    Both have ``vec_id long`` and the array column named by ``vector``; other columns
    are ignored. Returns ``query_id, rank, vec_id, score``: rank from 1, nearest first,
    ties to the smaller vec_id, score the cosine of the original vectors. Rows without
    id or with a vector that is null, empty, zero or not finite throughout take no
    part, and vectors of another length than the query's are no candidates. A row that
    is there several times is one. A query id with several vectors takes the best
    score of each candidate. Empty tables give no rows.
    """
    clean = lambda df: (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        .where("vec_id is not null")
        .where(usable(F.col("vector")))
    )
    index, count = shards(clean(vectors), k + 1, shard_bytes, degree, beam)
    asked = stored(clean(queries).distinct().withColumn("dim", F.size("vector")), "queries")
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("is_query", F.lit(1))
    met = index.withColumn("is_query", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    met = met.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "dim", "is_query")
    found = met.mapInArrow(_search_pass(k, beam), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
