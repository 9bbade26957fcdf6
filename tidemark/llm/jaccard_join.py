"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
word shingles. If they do, then with the tokens of every set in one global order,
rare ones first, the first ``n - ceil(percent * n / 100) + l`` tokens of both share
at least ``l`` tokens, for every l. A longer prefix costs longer lists to read but
demands more shared tokens before a pair is looked at. Each document picks its own l
by the estimated cost; a pair is held to the smaller l of the two, counting tokens
within that prefix only, so no link is lost.

Frequencies come from a table of hashed counters over all shingles. It has a fixed
size, gives order and cost only, and any order gives the same links.

Steps:

1. one pass makes each text's set, its fingerprint and the counters;
2. equal sets become one class, whose smallest doc_id stands for it;
3. a second pass makes the prefixes and a parity bitmap of each class; the Hamming
   distance of two bitmaps is at most the size of the sets' difference, so it
   rules pairs out before their sets are compared;
4. documents meet by prefix token, tokens of long lists in blocks. Some documents of
   each list, those with most copies first, are compared with all others: the links
   found gather large groups of near copies at a cost in proportion to the list;
5. then every other pair of different components that shares enough tokens and
   passes the bitmaps is compared, set by set, and components follow from the links.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_filter, mix64, release, slices, stored, tidy, utf8
from tidemark.llm.components import components
from tidemark.llm.words import shingle_sets

COUNTERS = 1 << 22
CHUNK = 1 << 16
LONGEST_PREFIX_STEP = 5
LIST_BLOCK = 4096
HUBS = 4
LEAST_BITS = 256
MOST_BITS = 8192


def needed(n: np.ndarray | int, percent: int):
    """How many tokens of a set of n its partner shares at least."""
    return (n * percent + 99) // 100


def most_apart(a, b, percent: int):
    """The largest difference of two sets of these sizes that link."""
    total = a + b
    return total - 2 * ((percent * total + 99 + percent) // (100 + percent))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(11)).astype(np.int64) & (COUNTERS - 1)


def _profile_pass(size: int):
    """Sets of all texts: size and fingerprint per row, and this task's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        waiting, held = [], 0

        def add() -> None:
            nonlocal waiting, held
            if waiting:
                counts[:] += np.bincount(_slots(np.concatenate(waiting)), minlength=COUNTERS).astype(np.uint32)
            waiting, held = [], 0

        for batch in batches:
            ns, keys = [], []
            for part in slices(batch, "text"):
                for found in shingle_sets(part.column("text"), size):
                    ns.append(len(found))
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                    waiting.append(found)
                    held += len(found)
                    if held > COUNTERS:
                        add()
            none = pa.nulls(len(ns))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(ns, pa.int64()),
                    pa.array(keys, pa.binary()),
                    none.cast(pa.int32()),
                    none.cast(pa.binary()),
                ],
                ["doc_id", "n", "key", "chunk", "counts"],
            )
        add()
        used = [i for i in range(COUNTERS // CHUNK) if counts[i * CHUNK : (i + 1) * CHUNK].any()]
        if used:
            none = pa.nulls(len(used))
            yield pa.RecordBatch.from_arrays(
                [
                    none.cast(pa.int64()),
                    none.cast(pa.int64()),
                    none.cast(pa.binary()),
                    pa.array(used, pa.int32()),
                    pa.array([zlib.compress(counts[i * CHUNK : (i + 1) * CHUNK].tobytes(), 1) for i in used], pa.binary()),
                ],
                ["doc_id", "n", "key", "chunk", "counts"],
            )

    return run


def _add_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
            counts = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32)
            if chunk in sums:
                sums[chunk] += counts
            else:
                sums[chunk] = counts.astype(np.uint64)
    for chunk, counts in sums.items():
        small = np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([small.tobytes()], pa.binary())}
        )


def _counters(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters: 16 MB, whatever the input."""
    chunks = COUNTERS // CHUNK
    merged = parts.repartition(chunks, "chunk").mapInArrow(_add_counters, "chunk int, counts binary")
    counts = np.zeros(COUNTERS, np.uint32)
    for row in merged.collect():
        start = row["chunk"] * CHUNK
        counts[start : start + CHUNK] = np.frombuffer(bytes(row["counts"]), np.uint32)
    return counts


def prefix_step(frequency: np.ndarray, n: int, percent: int) -> int:
    """How many shared tokens to ask for: the l of least estimated cost.

    ``frequency`` has the other documents expected in the list of each token of the
    set, in the global order. Reading lists costs one per entry. Of the entries,
    every l make one candidate at most, whose comparison costs more for a larger set.
    """
    base = n - needed(n, percent)
    top = min(LONGEST_PREFIX_STEP, needed(n, percent))
    entries = np.cumsum(frequency[: base + top])
    steps = np.arange(1, top + 1)
    read = entries[base : base + top]
    cost = read + read / steps * (4 + n / 64)
    return int(steps[np.argmin(cost)])


def bitmap_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (n - 1).bit_length()))


def parity(found: np.ndarray, bits: int) -> bytes:
    """Each token flips one bit; the bitmap of half as many bits is its two halves' sum."""
    flips = np.bincount((found >> np.uint64(43)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _prefix_pass(size: int, percent: int, counters, chosen):
    """Prefix lists and bitmap of each text that may stand for a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counters.value
        noise = int(counts.sum(dtype=np.uint64)) // COUNTERS
        for batch in batches:
            keep = chosen.value.passes(batch.column("slot").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(keep))
            rows = {name: [] for name in ("doc_id", "key", "n", "step", "lists", "levels", "sides", "bitmap")}
            for part in slices(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                for doc_id, found in zip(ids, shingle_sets(part.column("text"), size), strict=True):
                    n = len(found)
                    if not n:
                        continue
                    often = counts[_slots(found)].astype(np.int64)
                    order = np.lexsort((found, often))[: n - needed(n, percent) + LONGEST_PREFIX_STEP]
                    others = np.maximum(often[order] - noise - 1, 0)
                    step = prefix_step(others, n, percent)
                    base = n - needed(n, percent)
                    order = order[: base + step]
                    tokens, blocks = found[order], others[: base + step] // LIST_BLOCK + 1
                    level = np.maximum(np.arange(base + step) - base + 1, 1)
                    lists, levels, sides = _spread(tokens, level, blocks, doc_id)
                    rows["doc_id"].append(doc_id)
                    rows["key"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    rows["n"].append(n)
                    rows["step"].append(step)
                    rows["lists"].append(lists.view(np.int64))
                    rows["levels"].append(levels.astype(np.int8))
                    rows["sides"].append(sides.astype(np.int8))
                    rows["bitmap"].append(parity(found, bitmap_bits(n)))
            kinds = dict(
                doc_id=pa.int64(), key=pa.binary(), n=pa.int64(), step=pa.int8(),
                lists=pa.list_(pa.int64()), levels=pa.list_(pa.int8()), sides=pa.list_(pa.int8()), bitmap=pa.binary(),
            )
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return run


def _spread(tokens, levels, blocks, doc_id):
    """Lists to enter. A token of b blocks has a list for each pair of blocks.

    A document enters the b lists of its own block; side 2 means that all pairs of
    a list count, 0 and 1 that only pairs across do.
    """
    if (blocks == 1).all():
        return tokens, levels, np.full(len(tokens), 2)
    lists, new_levels, sides = [], [], []
    own = int(mix64(np.array([doc_id], np.int64).view(np.uint64))[0])
    for token, level, count in zip(tokens, levels.tolist(), blocks.tolist(), strict=True):
        mine = own % count
        for other in range(count):
            low, high = min(mine, other), max(mine, other)
            with np.errstate(over="ignore"):
                lists.append(token if count == 1 else mix64(np.array([token ^ np.uint64((low << 32) + high + 1)], np.uint64))[0])
            new_levels.append(level)
            sides.append(2 if low == high else int(mine == high))
    return np.array(lists, np.uint64), np.array(new_levels), np.array(sides)


def _drop_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only lists with two entries or more; the input is sorted by list."""
    tail, paired = None, False  # the last row so far, and whether the row before it is of the same list
    for batch in batches:
        if not batch.num_rows:
            continue
        if tail is not None:
            batch = _joined([tail, batch])
        values = batch.column("list").to_numpy(zero_copy_only=False)
        same = values[1:] == values[:-1]
        keep = np.zeros(len(values), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= paired
        tail, paired = batch.slice(len(values) - 1), bool(keep[-1])
        yield batch.slice(0, len(values) - 1).filter(pa.array(keep[:-1]))
    if paired:
        yield tail


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches that end where a list ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        values = batch.column("list").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            held[-1] = batch.slice(0, cut)
            yield _joined(held)
            held = [batch.slice(cut)]
    if held:
        yield _joined(held)


class _Lists:
    """The entries of many lists, sorted by list and set size, and which pairs to look at."""

    def __init__(self, batch: pa.RecordBatch, percent: int):
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.doc, self.n, self.side = column("doc_id"), column("n"), column("side")
        self.level, self.step, self.copies = column("level"), column("step"), column("copies")
        self.component = column("component") if "component" in batch.schema.names else None
        self.percent = percent
        values = column("list")
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        self.sizes = np.diff(np.r_[starts, len(values)])
        self.starts = np.repeat(starts, self.sizes)
        self.left = np.repeat(starts + self.sizes, self.sizes) - np.arange(len(values)) - 1  # entries behind each one
        data, bounds = utf8(batch.column("bitmap").cast(pa.binary()))
        self.bits = np.diff(bounds) * 8
        self.maps: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        for bits in np.unique(self.bits).tolist():
            rows = np.flatnonzero(self.bits == bits)
            whole = data[bounds[rows][:, None] + np.arange(bits // 8)].view(np.uint64)
            width = bits
            while width >= LEAST_BITS:
                self._add(width, rows, whole)
                if width // 2 < LEAST_BITS:
                    break
                whole = whole[:, : whole.shape[1] // 2] ^ whole[:, whole.shape[1] // 2 :]
                width //= 2

    def _add(self, width: int, rows: np.ndarray, maps: np.ndarray) -> None:
        old = self.maps.get(width)
        if old is None:
            self.place[width] = np.full(len(self.doc), -1)
            old = np.zeros((0, width // 64), np.uint64)
        self.place[width][rows] = len(old) + np.arange(len(rows))
        self.maps[width] = np.concatenate([old, maps])

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of entries that may link by size and bitmap."""
        swap = self.n[a] > self.n[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        keep = (self.doc[a] != self.doc[b]) & ((self.side[a] == 2) | (self.side[a] != self.side[b]))
        keep &= 100 * self.n[a] >= self.percent * self.n[b]
        if self.component is not None:
            keep &= self.component[a] != self.component[b]
            keep &= np.maximum(self.level[a], self.level[b]) <= np.minimum(self.step[a], self.step[b])
        a, b = a[keep], b[keep]
        keep = np.zeros(len(a), bool)
        for bits in np.unique(self.bits[a]).tolist():
            maps, place = self.maps[bits], self.place[bits]
            these = np.flatnonzero(self.bits[a] == bits)
            block = max(1, (1 << 23) // (bits // 8))
            for i in range(0, len(these), block):
                some = these[i : i + block]
                apart = np.bitwise_count(maps[place[a[some]]] ^ maps[place[b[some]]]).sum(axis=1, dtype=np.int64)
                keep[some] = apart <= most_apart(self.n[a[some]], self.n[b[some]], self.percent)
        return a[keep], b[keep]

    def all_near(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs that may link, by distance in the sorted lists; ends where sizes are too far apart."""
        rows, shift = np.flatnonzero(self.left >= 1), 1
        while len(rows):
            yield self.near(rows, rows + shift)
            shift += 1
            rows = rows[self.left[rows] >= shift]
            rows = rows[100 * self.n[rows] >= self.percent * self.n[rows + shift]]

    def hub_near(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs with the entries of most copies of each list."""
        order = np.lexsort((self.doc, -self.copies, self.starts))
        every = np.arange(len(order))
        found = []
        for h in range(HUBS):
            some = every[np.repeat(self.sizes, self.sizes) > h]
            hub = order[self.starts[some] + h]
            found.append(self.near(some, hub))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _pairs(doc_a: np.ndarray, doc_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(doc_a, doc_b), np.maximum(doc_a, doc_b)


def _hub_pass(percent: int):
    """Pairs with hubs, and as ``b`` null each document that is near any other of a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_lists(batches):
            lists = _Lists(batch, percent)
            a, b = _pairs(*(lists.doc[x] for x in lists.hub_near()))
            near = np.zeros(len(lists.doc), bool)
            for x, y in lists.all_near():
                near[x] = near[y] = True
            pairs = np.unique(np.stack([a, b]), axis=1)
            docs = np.unique(lists.doc[near])
            yield pa.RecordBatch.from_pydict(
                {
                    "a": pa.array(np.r_[pairs[0], docs], pa.int64()),
                    "b": pa.array(np.r_[pairs[1], docs], pa.int64(), mask=np.r_[np.zeros(len(pairs[0]), bool), np.ones(len(docs), bool)]),
                }
            )

    return run


def _rest_pass(percent: int):
    """Pairs across components, once for each token that they share within the smaller step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_lists(batches):
            lists = _Lists(batch, percent)
            for x, y in lists.all_near():
                if len(x):
                    a, b = _pairs(lists.doc[x], lists.doc[y])
                    step = np.minimum(lists.step[x], lists.step[y]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(step)], ["a", "b", "step"])

    return run


def _set_pass(size: int, chosen):
    """The whole sets of texts that are near another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = chosen.value.passes(batch.column("slot").to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(keep))
            for part in slices(batch, "text"):
                sets = [found.tobytes() for found in shingle_sets(part.column("text"), size)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "tokens"])

    return run


def _compare(percent: int):
    """Pairs whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("tokens_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(_compare(percent), "a long, b long")


def jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The component of each document under links of similar shingle sets.

    ``docs`` has ``doc_id long`` and ``text string``; other columns are ignored,
    whatever their names. Returns ``doc_id, n_shingles, component_id``, a row per
    input row. ``size`` words make a shingle, words are parted by blanks, A-Z count
    as a-z; a shorter text is one shingle as a whole. ``percent`` is over 50.

    Null and blank texts have an empty set, link with nothing and are their own
    component. Rows without doc_id link with nothing and have a null component.
    Rows that share a doc_id are one document: a link of one is a link of all. An
    empty table gives no rows.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, n long, key binary, chunk int, counts binary"
    first = stored(texts.mapInArrow(tidy(_profile_pass(size)), kinds), "shingle-sets")
    base = first.where("chunk is null").select("doc_id", "n", "key")
    counters = spark.sparkContext.broadcast(_counters(first.where("chunk is not null").select("chunk", "counts")))

    known = base.where("key is not null and doc_id is not null")
    classes = stored(
        known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("copies")), "set-classes"
    )
    chosen = spark.sparkContext.broadcast(id_filter(classes, "rep"))
    slotted = texts.where("doc_id is not null").withColumn("slot", F.xxhash64("doc_id"))
    kinds = (
        "doc_id long, key binary, n long, step byte, lists array<long>, levels array<byte>, sides array<byte>,"
        " bitmap binary"
    )
    profiles = slotted.mapInArrow(tidy(_prefix_pass(size, percent, counters, chosen)), kinds)
    profiles = stored(
        profiles.join(classes.select("key", F.col("rep").alias("doc_id"), "copies"), ["key", "doc_id"]).drop("key"),
        "prefixes",
    )

    entries = profiles.select("doc_id", F.explode(F.arrays_zip("lists", "levels", "sides")).alias("e")).select(
        F.col("e.lists").alias("list"), "doc_id", F.col("e.levels").alias("level"), F.col("e.sides").alias("side")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = stored(
        entries.repartition(parts, "list")
        .sortWithinPartitions("list")
        .mapInArrow(_drop_single, "list long, doc_id long, level byte, side byte"),
        "prefix-lists",
    )
    release(spark)
    traits = profiles.select("doc_id", "n", "step", "copies", "bitmap")
    by_list = entries.join(traits, "doc_id").repartition(parts, "list").sortWithinPartitions("list", "n", "doc_id")
    near = stored(by_list.mapInArrow(tidy(_hub_pass(percent)), "a long, b long").distinct(), "near")
    near_docs = near.where("b is null").select(F.col("a").alias("doc_id"))

    del by_list
    release(spark)
    chosen = spark.sparkContext.broadcast(id_filter(near_docs, "doc_id"))
    sets = slotted.mapInArrow(tidy(_set_pass(size, chosen)), "doc_id long, tokens binary")
    sets = stored(sets.join(near_docs, "doc_id", "left_semi"), "near-sets")

    release(spark)
    links = stored(_linked(near.where("b is not null"), sets, percent), "hub-links")
    same_id = known.groupBy("doc_id").agg(F.min(F.xxhash64("key")).alias("x"), F.max(F.xxhash64("key")).alias("y"))
    same_id = same_id.where("x <> y").select("doc_id")
    shared = known.join(same_id, "doc_id").join(classes, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stored(links.union(shared), "links-so-far")
    found = components(links)

    release(spark)
    near_now = near_docs.join(found, near_docs.doc_id == found.node, "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component")
    )
    rest = entries.join(traits, "doc_id").join(near_now, "doc_id")
    rest = rest.repartition(parts, "list").sortWithinPartitions("list", "n", "doc_id")
    rest = rest.mapInArrow(tidy(_rest_pass(percent)), "a long, b long, step int")
    rest = rest.groupBy("a", "b").agg(F.count("a").alias("shared"), F.min("step").alias("step")).where("shared >= step")
    more = stored(_linked(rest.select("a", "b"), sets, percent), "other-links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))

    classes = stored(
        classes.join(found, classes.rep == found.node, "left").select(
            F.col("key").alias("key_"), F.coalesce("component", "rep").alias("component")
        ),
        "set-components",
    )
    return base.join(classes, base.key == classes.key_, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
