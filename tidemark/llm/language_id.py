"""Language identification by n-gram filters with a bit per language.

A language's n-grams are those that make up at least a given share of its training
text, so there are at most 1 / share of them whatever the corpus. All languages share
one bit-sliced Bloom filter: a slot holds a mask with a bit per language, and the AND of
an n-gram's slots is the mask of all languages that have it. Of a document, the n-grams
per language are counted. Some are hits by chance: as large a part of the misses as the
language's filled slots, to the power of the number of hashes, predict. The counts are
corrected for that, and the language of the largest one is the document's.

N-grams are runs of code points in lower case; what is no letter counts as one blank, and
each text begins and ends with one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import mix64, slices, stored, tidy

SIZES = (3, 5)
SHARE = 2e-5
SLOT_BITS = 20
HASHES = 3
UNKNOWN = "und"
BLANK = 32
BLOCK = 1 << 17


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts in lower case, parted by single blanks, and each text's bounds."""
    lower = pc.utf8_lower(texts.cast(pa.string()).fill_null("")).to_pylist()
    points = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lower), np.int64, len(lower))
    letter = _letters()[points]
    points = np.where(letter, points, BLANK)
    edges = np.concatenate([[0], np.cumsum(lengths + 1)])  # the blanks around each text
    keep = letter.copy()
    runs = np.flatnonzero(~letter & np.concatenate([[True], letter[:-1]]))  # where runs of blanks begin
    at_edge = np.zeros(len(runs), bool)
    at_edge[np.searchsorted(runs, edges, side="right") - 1] = True
    keep[runs[~at_edge]] = True
    keep[edges] = True
    return points[keep], np.cumsum(keep)[edges] - keep[edges]


def ngrams(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of the n-gram that begins at each code point."""
    count = len(points) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    wide = points.astype(np.uint64)
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + wide[i : i + count] + np.uint64(1)
        return mix64(total + np.uint64(size))


def gram_blocks(points: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The n-grams of a text of any length, some at a time: the first one's place and their hashes."""
    for start in range(0, len(points) - size + 1, BLOCK):
        yield start, ngrams(points[start : start + BLOCK + size - 1], size)


def gram_slots(grams: np.ndarray, slot_bits: int, hashes: int) -> Iterator[np.ndarray]:
    """The slots of each n-gram: bits of its hash, then of the hash of that."""
    for i in range(hashes):
        used = mix64(grams + np.uint64(i)) if i else grams
        yield (used >> np.uint64(64 - slot_bits)).astype(np.int64)


def spans_of(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the first n-gram and the one after the last; both its edge blanks count."""
    first = bounds[:-1]
    return first, np.maximum(bounds[1:] + 1 - size + 1, first)


@dataclass(frozen=True)
class Model:
    """``masks[w][slot]`` has the bits of languages 64 * w and on; ``chance`` is each one's rate of false hits."""

    languages: tuple[str, ...]
    masks: np.ndarray
    chance: np.ndarray
    sizes: tuple[int, ...]
    slot_bits: int
    hashes: int

    def counts(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits per text and language, and n-grams per text."""
        texts = len(bounds) - 1
        hits, totals = np.zeros((texts, len(self.languages))), np.zeros(texts)
        for size in self.sizes:
            first, last = spans_of(bounds, size)
            last = np.minimum(last, max(len(points) - size + 1, 0))
            first = np.minimum(first, last)
            totals += last - first
            for start, grams in gram_blocks(points, size):
                here = slice(np.searchsorted(last, start, side="right"), np.searchsorted(first, start + len(grams)))
                low, high = np.maximum(first[here] - start, 0), np.minimum(last[here] - start, len(grams))
                slots = list(gram_slots(grams, self.slot_bits, self.hashes))
                for w, masks in enumerate(self.masks):
                    found = masks[slots[0]]
                    for slot in slots[1:]:
                        found = found & masks[slot]
                    for b in range(min(64, len(self.languages) - 64 * w)):
                        sums = np.concatenate([[0], np.cumsum((found >> np.uint64(b)) & np.uint64(1), dtype=np.int64)])
                        hits[here, 64 * w + b] += sums[high] - sums[low]
        return (hits - totals[:, None] * self.chance) / (1 - self.chance), totals


def _count_pass(languages: Sequence[str], sizes: Sequence[int]):
    """Per task, how often each language has each n-gram."""
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for code, parts in waiting.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                for i in range(0, len(grams), 1 << 18):
                    some = grams[i : i + (1 << 18)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some.view(np.int64)), pa.array([code] * len(some), pa.int32()), pa.array(n[i : i + (1 << 18)].astype(np.int64))],
                        ["gram", "code", "n"],
                    )

        for batch in batches:
            for part in slices(batch, "text"):
                names = np.array([number[x] for x in part.column("lang").to_pylist()])
                for code in np.unique(names).tolist():
                    points, bounds = code_points(part.column("text").filter(pa.array(names == code)))
                    for size in sizes:
                        first, last = spans_of(bounds, size)
                        count = max(len(points) - size + 1, 0)
                        steps = np.zeros(count + 1, np.int8)
                        last = np.minimum(last, count)
                        np.add.at(steps, np.minimum(first, last), 1)
                        np.add.at(steps, last, -1)
                        inside = np.cumsum(steps, dtype=np.int8) > 0
                        for start, grams in gram_blocks(points, size):
                            own = grams[inside[start : start + len(grams)]]
                            waiting.setdefault(code, []).append(own)
                            held += len(own)
                if held > 1 << 22:
                    yield from out()
                    waiting, held = {}, 0
        yield from out()

    return run


def _slot_pass(slot_bits: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64)
            for slots in gram_slots(grams, slot_bits, hashes):
                yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(slots)], ["code", "slot"])

    return run


def train(
    docs: DataFrame,
    sizes: Sequence[int] = SIZES,
    share: float = SHARE,
    slot_bits: int = SLOT_BITS,
    hashes: int = HASHES,
) -> Model:
    """The filters of all languages of ``docs`` (``text``, ``lang``); rows without either are left out.

    An n-gram belongs to each language of which it makes up at least ``share`` of the
    n-grams, so a language has at most ``len(sizes) / share`` of them. The filter has
    ``2 ** slot_bits`` slots per 64 languages, which is what the driver gets.
    """
    labelled = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where("text is not null and lang is not null")
    languages = tuple(sorted(r["lang"] for r in labelled.select("lang").distinct().collect()))
    words = max(1, -(-len(languages) // 64))
    masks = np.zeros((words, 1 << slot_bits), np.uint64)
    if languages:
        counted = labelled.mapInArrow(tidy(_count_pass(languages, sizes)), "gram long, code int, n long")
        counted = stored(counted.groupBy("gram", "code").agg(F.sum("n").alias("n")), "language-grams")
        totals = counted.groupBy("code").agg(F.sum("n").alias("total"))
        kept = counted.join(F.broadcast(totals), "code").where(F.col("n") >= F.lit(share) * F.col("total"))  # one row per language
        slots = kept.mapInArrow(_slot_pass(slot_bits, hashes), "code int, slot long").distinct()
        part = F.floor(F.col("slot") / 32768)
        chunks = slots.groupBy("code", part.alias("part")).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(32768))).alias("bits"))
        for row in chunks.collect():  # 2 ** slot_bits / 32768 rows per language
            bits = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")[: 1 << slot_bits]
            start = row["part"] * 32768
            own = masks[row["code"] // 64, start : start + len(bits)]
            own |= bits.astype(np.uint64)[: len(own)] << np.uint64(row["code"] % 64)
    filled = [np.mean((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))]
    return Model(languages, masks, np.array(filled) ** hashes, tuple(sizes), slot_bits, hashes)


def _predict_pass(model, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            margins: list[float] = []
            for part in slices(batch, "text"):
                texts = part.column("text")
                points, bounds = code_points(texts)
                hits, totals = own.counts(points, bounds)
                worded = np.diff(np.concatenate([[0], np.cumsum(points != BLANK)])[bounds]) > 0
                if not own.languages:
                    worded[:] = False
                    hits = np.zeros((len(texts), 1))
                rates = np.clip(hits / np.maximum(totals, 1)[:, None], 0, 1)
                best = rates.argmax(axis=1)
                ordered = np.sort(rates, axis=1)
                second = ordered[:, -2] if ordered.shape[1] > 1 else np.zeros(len(texts))
                names += [own.languages[b] if w else UNKNOWN for b, w in zip(best.tolist(), worded.tolist(), strict=True)]
                scores += np.where(worded, rates[np.arange(len(texts)), best], 0.0).tolist()
                margins += np.where(worded, ordered[:, -1] - second, 0.0).tolist()
            yield (
                (batch if with_text else batch.drop_columns(["text"])).append_column("lang_pred", pa.array(names, pa.string()))
                .append_column("score", pa.array(scores, pa.float64()))
                .append_column("margin", pa.array(margins, pa.float64()))
            )

    return run


def predict(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The language of each text: columns ``keep``, then ``lang_pred``, ``score`` and ``margin``.

    ``score`` is the corrected share of the text's n-grams that the language has,
    ``margin`` what it has more than the next language, both from 0 to 1. Ties go to
    the first language by name. ``und``, with 0 for both, is for null texts, texts
    without a letter, and a model without languages. Only ``text`` is looked at.
    """
    rest = [c for c in keep if c != "text"]
    texts = docs.select(*rest, F.col("text").cast("string").alias("text"))
    kept = texts if "text" in keep else texts.drop("text")
    kinds = StructType(kept.schema.fields[:]).add("lang_pred", "string").add("score", "double").add("margin", "double")
    model = docs.sparkSession.sparkContext.broadcast(model)
    return texts.mapInArrow(tidy(_predict_pass(model, "text" in keep)), kinds)


def held_out(doc_id: Column) -> Column:
    """A fixed third of the documents by their id; not those without one."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from two thirds of the labelled documents and predict the language of all.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; other columns are ignored. Returns
    ``doc_id, held_out, lang_pred, score, margin``, a row per input row. Rows without
    doc_id are predicted but not learned from, and are not held out. Null texts and those
    without letters are ``und`` with score 0, and so are all if no document has a label.
    Every row is one of its own, repeated ones too; an empty table gives no rows.
    """
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(marked.where("not held_out and doc_id is not null"))
    return predict(marked, model, ["doc_id", "held_out"])
