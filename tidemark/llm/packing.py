"""Best-fit packing of tokenised documents with matching of large items.

Documents become token ids, an end id, and pieces of at most one sequence's length.
Which piece goes where depends on the pieces' lengths only, so the plan is made from
the number of pieces of each length: a table of at most ``capacity`` rows, whatever
the corpus. Pieces over a third of the capacity are matched greedily, the largest with
the largest that fits beside it, two per sequence at most; shorter ones go, longest
first, into the smallest gap that takes them. Equal pieces and equal gaps are handled
together, so the plan is a short list of runs: pieces number r to r + n of a length go
to the sequences from s on. Each piece then finds its place from its length and its
number among the pieces of that length, which tasks count for themselves and a window
over the tasks' counts makes global. The plan has as many runs as the lengths and gaps
need, not as there are documents, and is what tasks receive.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored, tidy, utf8
from tidemark.llm.words import BLOCK, blocks, placed_words

CAPACITY = 4096
END_ID = 1
KNOWN_BYTES = 24 << 20
"""How much memory the words that a worker process remembers may take, about."""
NEW_WORDS = 1 << 16
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
"""Words that the tokenizer's normaliser only turns into lower case."""
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")
"""How the tokenizer cuts plain words in lower case: fixed endings, letters, single digits, other signs."""

_tokenizers: dict[tuple[str, bool], "WordTokenizer"] = {}


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each pair, ``count`` of them, in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class WordTable:
    """Ids by the 64-bit hash of a word, in sorted arrays: some twenty bytes a word."""

    def __init__(self, kind: type = np.uint32) -> None:
        self.keys, self.starts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.ids, self.kind = np.zeros(0, kind), kind

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are there, and at which place."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Put in sorted keys that are not there yet."""
        at = np.searchsorted(self.keys, keys)
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.keys, self.starts, self.counts = (
            np.insert(old, at, new) for old, new in ((self.keys, keys), (self.starts, starts), (self.counts, counts))
        )
        self.ids = np.concatenate([self.ids, ids.astype(self.kind)])

    @property
    def size(self) -> int:
        return self.keys.nbytes + self.starts.nbytes + self.counts.nbytes + self.ids.nbytes


class WordTokenizer:
    """A tokenizer that never joins what white space parts, with the ids of words it has met.

    Words are looked up by hash, many at a time. The memory of words only saves time: new
    words gather in a small table, go on into a larger one, and when that is full the one
    filled before it is dropped. With ``plain`` the names of special tokens in a text are
    ordinary text, otherwise those tokens.
    """

    def __init__(self, path: str, plain: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = () if plain else tuple(token.content.lower().encode() for token in added)
        self.model = self.tokenizer.model
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.older, self.table, self.new = (WordTable(self.kind) for _ in range(3))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each one's begin and end."""
        data, bounds = utf8(texts)
        if len(bounds) == 2 and len(data) > BLOCK:
            parts = [data] if self._named(data) else blocks(data)
            found = [self._ids(part, np.array([0, len(part)]))[0] for part in parts]
            ids = np.concatenate(found)
            return ids, np.array([0, len(ids)])
        return self._ids(data, bounds)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        found, bounds = self.texts(pa.array(texts, pa.string()))
        return [found[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _named(self, data: np.ndarray) -> bool:
        """Whether a text has the name of a special token, in any spelling."""
        lower = data.tobytes().lower()
        return any(name in lower for name in self.special)

    def _ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, first, last = placed_words(data, bounds)
        edges = np.searchsorted(first, bounds)
        words, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        counts, ids = self._known(words, index, data, first, last)
        each = counts[inverse]
        flat = ids[ragged((np.cumsum(counts) - counts)[inverse], each)]
        starts = np.concatenate([[0], np.cumsum(each)])[edges]
        if self.special and self._named(data):  # their upper-case spellings are other tokens
            parts = [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                if self._named(data[a:b]):
                    parts[i] = np.array(self.tokenizer.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            flat, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return flat, starts

    def _known(self, words: np.ndarray, index: np.ndarray, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids in a row; new words are learned."""
        counts, missing, found = np.zeros(len(words), np.int64), np.ones(len(words), bool), []
        for table in (self.table, self.older, self.new):
            hit, at = table.find(words)
            hit &= missing
            counts[hit] = table.counts[at[hit]]
            found.append((hit, table.ids[ragged(table.starts[at[hit]].astype(np.int64), table.counts[at[hit]].astype(np.int64))]))
            missing &= ~hit
        if missing.any():
            places = index[missing]
            raw = data.tobytes()
            learned = self._learn([raw[a:b].decode() for a, b in zip(first[places].tolist(), last[places].tolist(), strict=True)])
            counts[missing] = [len(x) // 4 for x in learned]
            ids = np.frombuffer(b"".join(learned), np.uint32)
            self._remember(words[missing], counts[missing], ids)
            found.append((missing, ids))
        total = np.empty(int(counts.sum()), np.uint32)
        starts = np.cumsum(counts) - counts
        for some, ids in found:
            total[ragged(starts[some], counts[some])] = ids
        return counts, total

    def _remember(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        if self.table.size > KNOWN_BYTES // 2:
            self.older, self.table = self.table, WordTable(self.kind)
        self.new.add(keys, counts, ids)
        if len(self.new.keys) > NEW_WORDS:
            new, self.new = self.new, WordTable(self.kind)
            there, _ = self.table.find(new.keys)
            order = np.flatnonzero(~there)
            counts = new.counts[order].astype(np.int64)
            self.table.add(new.keys[order], counts, new.ids[ragged(new.starts[order].astype(np.int64), counts)])

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of words: plain ones piece by piece through the merges alone, others through the whole tokenizer.

        What the tokenizer does before its merges has no effect on plain words but for the
        lower case and the cut into pieces.
        """
        found, rest = [b""] * len(words), []
        pieces: dict[str, bytes] = {}
        for i, word in enumerate(words):
            if not PLAIN.fullmatch(word):
                rest.append(i)
                continue
            own = PIECE.findall(word.lower())
            for piece in own:
                if piece not in pieces:
                    pieces[piece] = self._piece(piece)
            found[i] = pieces[own[0]] if len(own) == 1 else b"".join([pieces[x] for x in own])
        for at in range(0, len(rest), 1000):
            some = rest[at : at + 1000]
            for i, own in zip(some, self.tokenizer.encode_batch([words[i] for i in some], add_special_tokens=False), strict=True):
                found[i] = np.array(own.ids, np.uint32).tobytes()
        return found

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join(map(byte_letters().__getitem__, piece.encode()))
        ids = [token.id for token in self.model.tokenize(spelled)]
        return struct.pack(f"={len(ids)}I", *ids)


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def word_tokenizer(path: str, plain: bool) -> WordTokenizer:
    """One per worker process, which serves many tasks."""
    if (path, plain) not in _tokenizers:
        _tokenizers[path, plain] = WordTokenizer(path, plain)
    return _tokenizers[path, plain]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


def _piece_pass(path: str, capacity: int, end_id: int, plain: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = word_tokenizer(path, plain), TaskContext.get().partitionId()
        end, met = np.array([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "number")}
            for some in slices(batch, "text"):
                flat, bounds = tokenizer.texts(some.column("text"))
                raw, bounds = flat.astype("<u4").tobytes(), (4 * bounds).tolist()
                for doc_id, a, b in zip(some.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                    ids = raw[a:b] + end
                    for i, at in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * at : 4 * (at + capacity)]
                        length = len(own) // 4
                        values = (doc_id, i, at, length, zlib.crc32(own), int(met[length]))
                        for column, value in zip(rows.values(), values, strict=True):
                            column.append(value)
                        met[length] += 1
            columns = [pa.array(v, pa.int32() if k == "piece" else pa.int64()) for k, v in rows.items()]
            columns.insert(5, pa.array([part] * len(columns[0]), pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, plain: bool = True) -> DataFrame:
    """The pieces of all documents, stored, with ``number`` among the pieces of a length in ``part``."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return stored(texts.mapInArrow(tidy(_piece_pass(path, capacity, end_id, plain)), PIECES), "pieces")


class Plan:
    """Runs of pieces: numbers ``first`` on of ``length`` go to sequences ``sequence`` on,
    ``each`` per sequence, from ``offset`` on. Sorted by length and first."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.left = {n: c for n, c in counts.items() if c}
        self.next = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (sequences, the first of them)
        self.sizes: list[int] = []  # gaps in use, sorted
        self._match_large()
        self._fit_small()
        self.runs.sort()

    def _put(self, length: int, first: int, many: int, each: int, offset: int) -> None:
        self.runs.append((length, self.next[length], first, each, offset))
        self.next[length] += many * each
        self.left[length] -= many * each
        if not self.left[length]:
            del self.left[length]

    def _open(self, many: int) -> int:
        self.sequences += many
        return self.sequences - many

    def _gap(self, size: int, many: int, first: int) -> None:
        if many and size:
            if not self.gaps[size]:
                bisect.insort(self.sizes, size)
            self.gaps[size].append((many, first))

    def _match_large(self) -> None:
        large = sorted(n for n in self.left if 3 * n > self.capacity)
        while large:
            length = large[-1]
            room = self.capacity - length
            partner = large[i - 1] if (i := bisect.bisect_right(large, room)) else None
            if partner == length:
                many = self.left[length] // 2
                if many:
                    first = self._open(many)
                    self._put(length, first, many, 2, 0)
                    self._gap(self.capacity - 2 * length, many, first)
                elif (i := bisect.bisect_left(large, length)) and large[i - 1] <= room:
                    partner = large[i - 1]
                else:
                    partner = None
            if partner is None:
                many = self.left[length]
                first = self._open(many)
                self._put(length, first, many, 1, 0)
                self._gap(room, many, first)
            elif partner != length:
                many = min(self.left[length], self.left[partner])
                first = self._open(many)
                self._put(length, first, many, 1, 0)
                self._put(partner, first, many, 1, length)
                self._gap(room - partner, many, first)
            large = [n for n in large if n in self.left] if any(n not in self.left for n in (length, partner)) else large

    def _fit_small(self) -> None:
        for length in sorted(self.left, reverse=True):
            while length in self.left:
                i = bisect.bisect_left(self.sizes, length)
                if i == len(self.sizes):
                    each = min(self.capacity // length, self.left[length])
                    many = self.left[length] // each
                    first = self._open(many)
                    self._put(length, first, many, each, 0)
                    self._gap(self.capacity - each * length, many, first)
                    continue
                size = self.sizes[i]
                many, first = self.gaps[size].pop()
                if not self.gaps[size]:
                    del self.sizes[i]
                each = min(size // length, self.left[length])
                used = min(many, self.left[length] // each)
                self._put(length, first, used, each, self.capacity - size)
                self._gap(size - each * length, used, first)
                self._gap(size, many - used, first + used)


def _place_pass(runs):
    """The sequence and offset of each piece, from its length and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, each, offset = runs.value
        order = (length << 44) + first
        for batch in batches:
            own = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(order, (own << 44) + number, side="right") - 1
            since = number - first[at]
            placed = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            placed = placed.append_column("sequence_id", pa.array(sequence[at] + since // each[at]))
            yield placed.append_column("offset", pa.array(offset[at] + since % each[at] * own))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The place of each piece: ``sequence_id`` and ``offset`` beside the columns of a piece.

    ``pieces`` has ``doc_id, piece, start, length, ids_crc32``, and ``part`` and
    ``number`` that count the pieces of a length within a part from 0.
    """
    spark = pieces.sparkSession
    counts = stored(pieces.groupBy("part", "length").agg(F.count("number").alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = Plan(totals, capacity)
    runs = np.array(plan.runs, np.int64).reshape(-1, 5).T
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("part").alias("part_"), F.col("length").alias("length_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    starts = starts.hint("shuffle_hash")  # as many rows as tasks times lengths, which grows with the corpus
    ranked = pieces.join(starts, (F.col("part") == F.col("part_")) & (F.col("length") == F.col("length_")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(_place_pass(spark.sparkContext.broadcast(runs)), kinds)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, plain: bool = True) -> DataFrame:
    """All documents as pieces of at most ``capacity`` tokens in as few sequences as best fit finds.

    ``docs`` has ``doc_id long`` and ``text string``; other columns are ignored.
    ``path`` names a tokenizer file whose tokens never reach over white space and end
    words with ``</w>``. Returns ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``, a row per piece: ``start`` ids of the document come before
    it, ``offset`` ids of its sequence. Only documents over the capacity are cut. Null
    and empty texts are the end id alone. Each row is a document of its own, also if
    it repeats a doc_id or has none. An empty table gives no rows. With ``plain`` the
    names of special tokens in a text are ordinary text; without it they become those
    tokens, as the tokenizer file says.
    """
    return pack(token_pieces(docs, path, capacity, end_id, plain), capacity)
