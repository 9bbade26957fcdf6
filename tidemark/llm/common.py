"""What several operators share: stored results, text slices, bounded id filters."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

SLICE_BYTES = 1 << 20
FILTER_BITS, MOST_FILTER_BITS = 1 << 22, 1 << 30
"""The smallest and the largest filter, of half a megabyte and 128 MB."""
BITS_PER_KEY = 16
BITMAP_BITS = 1 << 15
"""Bits of one bitmap of ``bitmap_construct_agg``: a fixed value of Spark."""


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read from there.

    Cuts the lineage: a lost executor costs the tasks it ran, not the steps before.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of results that nobody holds any more.

    Its cleaner acts on objects that the driver's garbage collection finds, and a
    driver with little to do may not collect for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Pass) -> Pass:
    """A pass over batches that gives the memory it has freed back to the system at its end.

    A worker process serves many tasks of many steps, and the allocator would keep for
    it what the greediest of them took. Where the allocator has no such call, nothing happens.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows in them; null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("")
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many bytes of text, or a single longer row."""
    if not batch.num_rows:
        return
    _, bounds = utf8(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class KeyFilter(NamedTuple):
    """A bitmap with the slots of some keys set: a key of them always passes, another one may.

    That saves work; a join or a comparison afterwards decides.
    """

    packed: np.ndarray
    bits: int

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes.astype(np.int64) % self.bits
        return (self.packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def filter_bits(keys: int) -> int:
    """Bits for so many keys: a sixteenth of the others passes, whatever the number, up to the largest filter.

    Beyond that ever more pass, and more is moved for nothing; what comes out is the same.
    """
    return min(max(FILTER_BITS, -(-keys * BITS_PER_KEY // BITMAP_BITS) * BITMAP_BITS), MOST_FILTER_BITS)


def key_filter(df: DataFrame, key_hash: Column) -> KeyFilter:
    """The filter of the rows' keys, given as 64-bit hashes; ``df`` is counted first, so it should be stored."""
    bits = filter_bits(df.count())
    slot = F.pmod(key_hash, F.lit(bits))
    part, place = F.floor(F.col("slot") / BITMAP_BITS), F.pmod(F.col("slot"), F.lit(BITMAP_BITS))
    found = df.select(slot.cast("long").alias("slot")).where("slot is not null").groupBy(part.alias("part"))
    packed = np.zeros(math.ceil(bits / BITMAP_BITS) * BITMAP_BITS // 8, np.uint8)
    for row in found.agg(F.bitmap_construct_agg(place).alias("bitmap")).collect():  # bits / BITMAP_BITS rows at most
        start = row["part"] * BITMAP_BITS // 8
        packed[start : start + BITMAP_BITS // 8] = np.frombuffer(bytes(row["bitmap"]), np.uint8)
    return KeyFilter(packed, bits)


def id_filter(df: DataFrame, key: str) -> KeyFilter:
    """The filter of a column's values; the other side looks up ``xxhash64`` of its own."""
    return key_filter(df, F.xxhash64(key))
