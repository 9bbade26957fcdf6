"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a text is its bytes, blanks deleted, as the digits of a number to a
fixed base, modulo four primes. Fingerprints compose: that of two parts in a row is
``f(a) * base ** len(b) + f(b)``. So the parts of a huge document are hashed by
different tasks, and a part is hashed as one product of matrices.

Texts of equal fingerprint and length are then compared part by part. A filter of their
lengths and ends, sized by their number, passes them and few others, so only these are
read closely again. Rows are dealt
by fingerprint, part and a salt and stream past, each next to the one before, so that
no group is held. Texts that differ in spite of equal fingerprints are told apart by
their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import key_filter, slices, stored, utf8

BLANKS = b" \t\n\x0b\f\r"
PRIMES = (1073741789, 1073741783, 1073741741, 1073741723)
"""The four largest primes below 2**30. Fixed values."""
BASES = (536870923, 715827913, 805306457, 894784853)
BLOCK = 1 << 14
"""Bytes hashed as one product: 255 * 2**30 * 2**14 is exact in a double."""
PART = 1 << 16
HUGE = 1 << 22
SALTS = 64
ENDS = 256


@lru_cache(maxsize=4)
def _powers(primes: tuple[int, ...]) -> np.ndarray:
    """``base ** (BLOCK - 1 - i)`` for each base, as doubles."""
    bases, divisors = np.array(BASES, np.uint64), np.array(primes, np.uint64)
    powers = np.ones((BLOCK, len(primes)), np.uint64)
    for i in range(1, BLOCK):
        powers[i] = powers[i - 1] * bases % divisors
    return powers[::-1].astype(np.float64)


def fingerprint(data: bytes, primes: tuple[int, ...] = PRIMES) -> np.ndarray:
    """The four remainders, block by block."""
    powers, total = _powers(primes), np.zeros(len(primes), np.uint64)
    for start in range(0, len(data), BLOCK):
        block = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - start), start)
        one = (block.astype(np.float64) @ powers[BLOCK - len(block) :]).astype(np.uint64) % np.array(primes, np.uint64)
        total = combine(total, one, len(block), primes)
    return total


def combine(a: np.ndarray, b: np.ndarray, length_b: int, primes: tuple[int, ...] = PRIMES) -> np.ndarray:
    """The fingerprint of two parts in a row, the second of ``length_b`` bytes."""
    shift = np.array([pow(x, length_b, p) for x, p in zip(BASES, primes, strict=True)], np.uint64)
    return (a * shift + b) % np.array(primes, np.uint64)


def key_of(remainders: np.ndarray, length: int) -> bytes:
    return remainders.astype(np.uint32).tobytes() + length.to_bytes(8, "little")


def slot_of(text: bytes) -> int:
    """A 64-bit hash of a text's length and ends, alike for equal texts and quick for long ones."""
    ends = len(text).to_bytes(8, "little") + text[:ENDS] + text[-ENDS:]
    return int.from_bytes(hashlib.blake2b(ends, digest_size=8).digest(), "little", signed=True)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with their texts without blanks."""
    for batch in batches:
        for part in slices(batch, "text"):
            data, bounds = utf8(part.column("text"))
            raw = data.tobytes()
            yield part, [raw[a:b].translate(None, BLANKS) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


ROWS = "row long, doc_id long, n_points long, sha string, key binary, slot long, part int, bytes binary"


def _record(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = dict(row=pa.int64(), doc_id=pa.int64(), n_points=pa.int64(), sha=pa.string(), key=pa.binary(), slot=pa.int64(), part=pa.int32(), bytes=pa.binary())
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})


def _first_pass(huge: int, size: int, primes: tuple[int, ...]):
    """A row per text with its fingerprint; of a huge text, its parts instead of a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            rows = {name.split()[0]: [] for name in ROWS.split(", ")}

            def add(*values, rows=rows) -> None:
                for column, value in zip(rows.values(), values, strict=True):
                    column.append(value)

            whole = (batch.column(c).to_pylist() for c in ("row", "doc_id", "n_points"))
            for row, doc_id, points, text in zip(*whole, texts, strict=True):
                sha = hashlib.sha256(text).hexdigest()
                if len(text) <= huge:
                    key = key_of(fingerprint(text, primes), len(text))
                    add(row, doc_id, points, sha, key, slot_of(text), None, None)
                    continue
                add(row, doc_id, points, sha, None, slot_of(text), None, None)
                for i in range(0, len(text), size):
                    add(row, None, None, None, None, None, i // size, text[i : i + size])
            yield _record(rows)

    return run


def _hash_parts(primes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(b), fingerprint(b, primes)) for b in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("part"),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([f.tolist() for _, f in found], pa.list_(pa.int64())),
                ],
                ["row", "part", "length", "remainders"],
            )

    return run


def _combine_parts(primes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for parts in batch.column("parts").to_pylist():
                total, length = np.zeros(len(primes), np.uint64), 0
                for part in parts:
                    total = combine(total, np.array(part["remainders"], np.uint64), part["length"], primes)
                    length += part["length"]
                keys.append(key_of(total, length))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(keys, pa.binary())], ["row_", "key_"])

    return run


def _with_huge(first: DataFrame, parts: int, primes: tuple[int, ...]) -> DataFrame:
    """The rows of all texts, those of huge ones with the fingerprint that their parts make."""
    pieces = first.where("part is not null").select("row", "part", "bytes").repartition(parts, "row", "part")
    hashed = pieces.mapInArrow(_hash_parts(primes), "row long, part int, length long, remainders array<long>")
    whole = hashed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("part", "length", "remainders"))).alias("parts"))
    whole = whole.mapInArrow(_combine_parts(primes), "row_ long, key_ binary")
    rows = first.where("part is null").drop("part", "bytes")
    joined = rows.join(whole, rows.row == whole.row_, "left")
    return joined.select("row", "doc_id", "n_points", "sha", F.coalesce("key", "key_").alias("key"), "slot")


def _part_pass(chosen, size: int, primes: tuple[int, ...]):
    """The parts of texts whose fingerprint others have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            keys, parts, salts, data = [], [], [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(parts, pa.int32()), pa.array(salts, pa.int32()), pa.array(data, pa.binary())],
                    ["key", "part", "salt", "bytes"],
                )

            for row, text in zip(batch.column("row").to_pylist(), texts, strict=True):
                if not chosen.value.passes(np.array([slot_of(text)]))[0]:
                    continue
                key = key_of(fingerprint(text, primes), len(text))
                for i in range(0, len(text), size):
                    keys.append(key)
                    parts.append(i // size)
                    salts.append(row % SALTS)
                    data.append(text[i : i + size])
                    if len(keys) * size > 1 << 25:
                        yield out()
                        keys, parts, salts, data = [], [], [], []
            yield out()

    return run


def _compare(salted: bool):
    """Rows stream past, sorted by text and part; each is held against the one before.

    With salts, gives one row per run of equal bytes. Without, gives the key of every
    run whose bytes differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (["key", "part", "salt"] if salted else ["key", "part"])]
            keep = []
            for i, (place, data) in enumerate(zip(zip(*columns, strict=True), batch.column("bytes"), strict=True)):
                data = data.as_buffer()
                same = last is not None and last[0] == place
                differs = same and not last[1].equals(data)
                if differs or (salted and not same):
                    keep.append(i)
                last = (place, data)
            some = batch.take(pa.array(keep, pa.int64()))
            yield some.select(["key", "part", "bytes"] if salted else ["key"])

    return run


def exact_dedup(docs: DataFrame, huge: int = HUGE, part: int = PART, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """For each row, the document that stays of all with the same text but for blanks.

    ``docs`` has ``doc_id long`` and ``text string``; other columns are ignored.
    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, a row per input row.
    The row with most code points stays, then the one with the smallest doc_id, then
    any one. Null counts as an empty text. A row without doc_id counts in its group,
    and stays only if all rows of most code points have none; ``keep_id`` is null
    then. Of rows that repeat a doc_id and text, one is kept. Texts of over ``huge``
    bytes are hashed in parts of ``part`` bytes by several tasks; ``primes`` below
    2**30 are the moduli. An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    texts = texts.withColumn("n_points", F.length("text").cast("long"))
    first = stored(texts.mapInArrow(_first_pass(huge, part, primes), ROWS), "fingerprints")
    rows = first.where("part is null").drop("part", "bytes")
    if not first.where("part is not null").isEmpty():
        rows = stored(_with_huge(first, parts, primes), "all-fingerprints")

    several = rows.groupBy("key").agg(F.count("row").alias("n"), F.collect_set("slot").alias("slots")).where("n > 1")
    several = stored(several.select(F.explode("slots").alias("slot")), "several")  # one slot, but for equal keys of other texts
    chosen = spark.sparkContext.broadcast(key_filter(several, F.col("slot")))
    pieces = texts.select("row", "text").mapInArrow(_part_pass(chosen, part, primes), "key binary, part int, salt int, bytes binary")
    pieces = pieces.repartition(parts, "key", "part", "salt").sortWithinPartitions("key", "part", "salt")
    runs = pieces.mapInArrow(_compare(True), "key binary, part int, bytes binary")
    runs = runs.repartition(parts, "key", "part").sortWithinPartitions("key", "part")
    clash = stored(runs.mapInArrow(_compare(False), "key binary").distinct(), "unequal")
    if not clash.isEmpty():
        marked = rows.join(clash.select(F.col("key").alias("key_")), F.col("key") == F.col("key_"), "left")
        rows = marked.withColumn("key", F.when(F.col("key_").isNull(), F.col("key")).otherwise(F.unhex("sha"))).drop("key_")
        rows = stored(rows, "split-fingerprints")

    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("order"), F.bitwise_not("row").alias("row")))
    groups = stored(rows.groupBy(F.col("key").alias("key_")).agg(F.count("row").alias("group_size"), best.alias("best")), "text-groups")
    return rows.join(groups, rows.key == groups.key_).select(
        "doc_id",
        F.bitwise_not("best.order").alias("keep_id"),
        "group_size",
        (F.bitwise_not("best.row") == F.col("row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


#: The same rows by plain grouping.
SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body
  FROM documents
), r AS (
  SELECT doc_id, sha256(body) AS text_sha256,
         row_number() OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""
