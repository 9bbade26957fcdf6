"""Hard negatives by rotated one-bit codes, with intervals that cannot miss a row.

Components become integers. A row's code has one bit per component of the rotated
vector, its sign; stored beside it are the alignment of the row with its code vector (the
signs divided by the root of the dimension) and the length of what the code vector leaves
over, the residual. An anchor's rotated vector is rounded to bytes, so that its product
with every code vector is a weighted sum of popcounts over the byte's bit planes. Product
times alignment is the estimate of the score. What is missing is the product of the
residual with the part of the anchor beside the code vector, which by Cauchy and Schwarz
is at most the product of their lengths. The interval holds for every row, not only with
high probability; it also takes in the rounding to bytes and that of the floating point.

Rows are dealt into shards by a hash. A shard goes to one task, which keeps it and lets
all anchors stream past, a tile of pairs at a time. The best estimates of an anchor are
scored first; rows whose interval ends below the worst of them, or wholly outside the
window that negatives must lie in, are passed over, and the rest are scored in integers.
The first pass finds the positives of each anchor, the second the negatives of each
anchor and positive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SCALE = 256
SHARD_BYTES = 1 << 26
LEAST_SHARDS = 32
TILE = 1 << 20
"""Pairs of an anchor and a row that are looked at together."""
ROTATED_TOGETHER = 256
PLANES = 8
SLACK = 1e-9
"""Room for the rounding of doubles, relative to the lengths of both vectors."""
SAFE_DOUBLE, SAFE_LONG = 1 << 53, 1 << 62


def usable(vector: Column) -> Column:
    """Not null, and every component there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


@lru_cache(maxsize=4)
def _rotation(dim: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of the components and orthogonal matrices for runs of them, the same on every machine."""
    rng = np.random.default_rng(dim)
    sizes = [min(ROTATED_TOGETHER, dim - i) for i in range(0, dim, ROTATED_TOGETHER)]
    return rng.permutation(dim), [np.linalg.qr(rng.normal(size=(n, n)))[0] for n in sizes]


def rotate(vectors: np.ndarray) -> np.ndarray:
    order, matrices = _rotation(vectors.shape[1])
    mixed = vectors[:, order]
    parts = [mixed[:, i * ROTATED_TOGETHER : i * ROTATED_TOGETHER + len(m)] @ m for i, m in enumerate(matrices)]
    return np.concatenate(parts, axis=1) if parts else mixed


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    wide = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, alignments and residuals of rows."""
    with np.errstate(over="ignore", invalid="ignore"):
        turned = rotate(vectors)
        align = np.abs(turned).sum(axis=1) / math.sqrt(max(vectors.shape[1], 1))
        length = _lengths(vectors)
        rest = np.sqrt(np.maximum(length - align, 0)) * np.sqrt(length + align)
    return _words(turned >= 0), align, rest


def _bound(anchors: np.ndarray, rows: np.ndarray) -> int:
    """What no product of theirs exceeds, nor any sum on the way."""
    most = lambda x: int(np.abs(x).max(initial=0))
    return most(anchors) * most(rows) * max(anchors.shape[1], 1)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All integer products of two matrices of whole numbers; beyond 64 bits, the nearest 64-bit number."""
    bound = _bound(anchors, rows)
    if bound < SAFE_DOUBLE:
        return (anchors @ rows.T).astype(np.int64)
    if bound < SAFE_LONG:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (anchors, rows)]
    return np.clip(whole[0] @ whole[1].T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Shard:
    """Rows of one length with their codes, sorted by label and id."""

    def __init__(self, ids, labels, vectors, codes, align, rest) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.codes, self.align, self.rest = codes[order], align[order], rest[order]
        self.lengths = _lengths(self.vectors)

    def intervals(self, anchors: np.ndarray, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """For anchors and some rows, the estimated score and how far the score can be from it."""
        dim = max(anchors.shape[1], 1)
        with np.errstate(all="ignore"):
            turned = rotate(anchors)
            low = turned.min(axis=1, keepdims=True, initial=0)
            step = np.maximum((turned.max(axis=1, keepdims=True, initial=0) - low) / (2**PLANES - 1), 1e-300)
            levels = np.rint((turned - low) / step)
            rounded = low + levels * step
            off = _lengths(turned - rounded)[:, None]
            levels = levels.astype(np.uint8)
            total = np.zeros((len(anchors), len(self.ids[some])), np.int64)
            codes = self.codes[some]
            for plane in range(PLANES):
                bits = _words((levels >> plane) & 1)
                for word in range(codes.shape[1]):
                    total += np.bitwise_count(bits[:, word][:, None] & codes[:, word][None, :]).astype(np.int64) << plane
            ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
            beside = 2 * (low * ones + step * total) - rounded.sum(axis=1, keepdims=True)
            along = beside / math.sqrt(dim)  # the product with the code vector, but for at most ``off``
            length = _lengths(anchors)[:, None]
            least = np.maximum(np.abs(along) - off, 0)
            left = np.sqrt(np.maximum(length * length - least * least, 0))
            slack = SLACK * dim * (length + 1) * (self.lengths[some] + 1)
            half = self.align[some] * off + self.rest[some] * left + slack
            estimate = self.align[some] * along
        odd = ~(np.isfinite(estimate) & np.isfinite(half))  # numbers too large for doubles: nothing is known
        estimate[odd], half[odd] = 0, np.inf
        return estimate, half

    def scored(self, anchors: np.ndarray, some: slice, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and integer score of the surviving pairs."""
        a, r = np.nonzero(alive)
        rows = self.vectors[some]
        if 8 * len(a) > alive.size:
            return a, r + some.start, products(anchors, rows)[a, r]
        found = np.empty(len(a), np.int64)
        for own in np.unique(a).tolist():
            i, j = np.searchsorted(a, [own, own + 1])
            found[i:j] = products(anchors[own : own + 1], rows[r[i:j]])[0]
        return a, r + some.start, found

    def pilot(self, anchors: np.ndarray, some: slice, estimate: np.ndarray, k: int) -> np.ndarray:
        """The scores, as doubles, of each anchor's ``k`` rows of largest estimate; minus infinity where that is the estimate."""
        best = np.argpartition(-estimate, k - 1, axis=1)[:, :k]
        rows = self.vectors[some][best]
        if _bound(anchors, rows) < SAFE_DOUBLE:
            found = np.matmul(rows, anchors[:, :, None])[:, :, 0]
        else:
            found = np.stack([products(anchors[i : i + 1], own)[0] for i, own in enumerate(rows)]).astype(float)
        return np.where(np.take_along_axis(estimate, best, 1) > -np.inf, found, -np.inf)

    def positives(self, anchors: dict[str, np.ndarray], k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """For each anchor, its best ``k`` rows of the same label: index of the anchor, id, score."""
        for label in np.unique(anchors["label"]):
            some = slice(*(int(np.searchsorted(self.labels, label, side)) for side in ("left", "right")))
            size = some.stop - some.start
            own = np.flatnonzero(anchors["label"] == label)
            step = max(1, TILE // max(size, 1))
            for at in range(0, len(own) if size else 0, step):
                part = own[at : at + step]
                vectors, ids = anchors["vectors"][part], anchors["vec_id"][part]
                estimate, half = self.intervals(vectors, some)
                self.pairs += estimate.size
                alive = self.ids[some][None, :] != ids[:, None]
                if size > k:
                    bottom = self.pilot(vectors, some, np.where(alive, estimate, -np.inf), k).min(axis=1)
                    alive &= estimate + half >= bottom[:, None]
                a, r, score = self.scored(vectors, some, alive)
                self.survivors += len(a)
                best = _first(a, score, self.ids[r], k)
                yield part[a[best]], self.ids[r[best]], score[best]

    pairs = survivors = 0

    def negatives(self, anchors: dict[str, np.ndarray], k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """For each anchor and window, the best ``k`` rows of other labels in it: anchor, window, id, score."""
        if not len(self.ids):
            return
        everything = slice(0, len(self.ids))
        step = max(1, TILE // len(self.ids))
        for at in range(0, len(anchors["vec_id"]), step):
            part = np.arange(at, min(at + step, len(anchors["vec_id"])))
            vectors, ids = anchors["vectors"][part], anchors["vec_id"][part]
            low, high = anchors["low"][part], anchors["high"][part]
            estimate, half = self.intervals(vectors, everything)
            self.pairs += estimate.size
            other = (self.labels[None, :] != anchors["label"][part][:, None]) & (self.ids[None, :] != ids[:, None])
            top, bottom = estimate + half, estimate - half
            alive = np.zeros(other.shape, bool)
            for j in range(low.shape[1]):
                least = low[:, j].astype(float)
                if len(self.ids) > 2 * k:
                    first = np.where(other & (estimate <= high[:, j : j + 1]), estimate, -np.inf)
                    found = self.pilot(vectors, everything, first, 2 * k)
                    inside = (found >= low[:, j : j + 1]) & (found <= high[:, j : j + 1])
                    least = np.maximum(least, np.sort(np.where(inside, found, -np.inf), axis=1)[:, -k])
                alive |= other & (top >= least[:, None]) & (bottom <= high[:, j : j + 1])
            a, r, score = self.scored(vectors, everything, alive)
            self.survivors += len(a)
            for j in range(low.shape[1]):
                inside = np.flatnonzero((score >= low[a, j]) & (score <= high[a, j]))
                best = inside[_first(a[inside], score[inside], self.ids[r[inside]], k)]
                yield part[a[best]], np.full(len(best), j), self.ids[r[best]], score[best]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where each group's ``k`` best are: larger scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    ordered = group[order]
    start = np.searchsorted(ordered, ordered)
    return order[np.arange(len(order)) - start < k]


def _matrix(values: pa.Array, dim: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), dim)


CODED = "vec_id long, label long, asked boolean, whole array<double>, dim int, code binary, align double, rest double"


def _encode_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole = batch.column("whole")
        dims = whole.value_lengths().to_numpy()
        for dim in np.unique(dims).tolist():
            some = batch.filter(pa.array(dims == dim))
            codes, align, rest = encode(_matrix(some.column("whole"), dim))
            columns = [*some.columns, pa.array(np.full(len(align), dim, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(align), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CODED.split(", ")])


def windows(scores: list[int], least_percent: int, most_percent: int) -> list[tuple[int, int]]:
    """The whole numbers between two percentages of each score."""
    return [(-(-least_percent * s // 100), most_percent * s // 100) for s in scores]


def _stream_pass(found: Callable[[Shard, dict[str, np.ndarray], pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """Keeps a shard's rows, which come first, and answers its anchors batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts, shard = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "dim", "is_anchor")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                if first == last:
                    continue
                number, dim, is_anchor = keys[first].tolist()
                some = batch.slice(first, last - first)
                if unit != (number, dim):
                    unit, parts, shard = (number, dim), [], None
                columns = {c: some.column(c).to_numpy() for c in ("vec_id", "label")}
                columns["vectors"] = _matrix(some.column("whole"), dim)
                if not is_anchor:
                    words = -(-dim // 64)
                    code = np.frombuffer(b"".join(some.column("code").to_pylist()), np.uint64).reshape(len(some), words)
                    parts.append((*columns.values(), code, some.column("align").to_numpy(), some.column("rest").to_numpy()))
                elif parts:  # without rows of this length in the shard there is nothing to find
                    shard = shard or Shard(*[np.concatenate(c) for c in zip(*parts, strict=True)])
                    yield from found(shard, columns, some)

    return run


def _find_positives(k: int):
    def found(shard: Shard, anchors: dict[str, np.ndarray], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        numbers = batch.column("anchor").to_numpy(zero_copy_only=False)
        for own, ids, scores in shard.positives(anchors, k):
            yield pa.RecordBatch.from_arrays([pa.array(numbers[own]), pa.array(ids), pa.array(scores)], ["anchor", "positive_id", "positive_score"])

    return found


def _find_negatives(k: int, least_percent: int, most_percent: int):
    def found(shard: Shard, anchors: dict[str, np.ndarray], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        numbers = batch.column("anchor").to_numpy(zero_copy_only=False)
        lists = batch.column("positives").to_pylist()
        width = max(map(len, lists))
        spans = [windows([p["score"] for p in own], least_percent, most_percent) for own in lists]
        spans = [own + [(1, 0)] * (width - len(own)) for own in spans]  # an empty window where there are fewer
        anchors |= {"low": np.array([[a for a, _ in own] for own in spans]), "high": np.array([[b for _, b in own] for own in spans])}
        for own, place, ids, scores in shard.negatives(anchors, k):
            columns = [pa.array(c) for c in (numbers[own], place.astype(np.int32), ids, scores)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "place", "negative_id", "negative_score"])

    return found


def _met(coded: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """Each shard's rows and then all anchors, a task per shard."""
    rows = coded.drop("asked").withColumn("is_anchor", F.lit(0))
    asked = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("is_anchor", F.lit(1))
    both = rows.unionByName(asked, allowMissingColumns=True).repartitionById(shards, F.col("shard"))
    return both.sortWithinPartitions("shard", "dim", "is_anchor")


def mine(
    rows: DataFrame,
    asked: Column,
    positives: int = 5,
    negatives: int = 3,
    least_percent: int = 50,
    most_percent: int = 95,
    vector: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """Rows of another label that score almost as high as an anchor's positives.

    ``rows`` has ``vec_id long``, ``label`` (a whole number) and the array column named by
    ``vector``; other columns are ignored. Anchors are the rows for which ``asked``, a
    condition on columns of ``rows``, holds. Components become ``floor(scale * x)``, x as
    double, and scores are their integer products. An anchor's positives are its best
    ``positives`` other rows of the same label, higher scores first, ties by smaller id.
    For each, the best ``negatives`` rows of other labels are returned whose score is
    between ``least_percent`` and ``most_percent`` percent of the positive's:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows take no part that have no id or label, or whose vector is null or has a null or
    not finite component (also after scaling). Vectors of different lengths are no
    candidates of each other. Rows that are the same in id, label and vector count once;
    rows that share an id only are rows of their own, but none is a candidate for an
    anchor of its own id. A score beyond 64 bits is taken as the nearest 64-bit number.
    Anchors without positives, and positives without negatives in their window, give no
    rows; nor does an empty table.
    """
    clean = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.coalesce(asked.cast("boolean"), F.lit(False)).alias("asked"),
        F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(scale))).alias("scaled"),
    )
    clean = clean.where("vec_id is not null and label is not null").where(usable(F.col("scaled")))
    # a double of this size is whole; the function's result ends at 64 bits
    floor = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    clean = clean.groupBy("vec_id", "label", F.transform("scaled", floor).alias("whole")).agg(F.bool_or("asked").alias("asked"))
    clean = clean.select("vec_id", "label", "asked", "whole")
    coded = stored(clean.mapInArrow(_encode_pass, CODED), "coded")
    size = coded.agg(F.sum(F.col("dim").cast("long") * 8)).first()[0] or 0
    shards = max(LEAST_SHARDS, math.ceil(size / SHARD_BYTES))
    coded = coded.withColumn("shard", F.pmod(F.xxhash64("vec_id", "label", "whole"), F.lit(shards)).cast("int"))
    anchors = coded.where("asked").select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "whole", "dim")
    anchors = stored(anchors, "anchors")

    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = _met(coded, anchors, shards).mapInArrow(_stream_pass(_find_positives(positives)), "anchor long, positive_id long, positive_score long")
    found = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives)
    each = F.struct("place", F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
    found = found.groupBy(F.col("anchor").alias("_anchor")).agg(F.sort_array(F.collect_list(each)).alias("positives"))
    anchors = stored(anchors.join(found, F.col("anchor") == F.col("_anchor")).drop("_anchor"), "positives")

    answer = _stream_pass(_find_negatives(negatives, least_percent, most_percent))
    found = _met(coded, anchors, shards).mapInArrow(answer, "anchor long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = anchors.select(F.col("anchor").alias("_anchor"), F.col("vec_id").alias("anchor_id"), F.inline("positives"))
    named = named.withColumnsRenamed({"place": "_place", "id": "positive_id", "score": "positive_score"})
    joined = found.join(named, (F.col("anchor") == F.col("_anchor")) & (F.col("place") == F.col("_place")))
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted(label: Column, vec_id: Column) -> Column:
    """The query's labels: every seventh row has the next one of ten."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


#: The same for the rows of ``embeddings`` whose id is divisible by 50.
SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
