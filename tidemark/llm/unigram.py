"""Unigram encoding and decoding with the pieces and scores of a SentencePiece model.

The pieces lie in a double-array trie over their UTF-8 bytes: from state s, byte b leads
to ``t = base[s] + b`` if ``check[t] == s``. The Viterbi search takes, for each place of
a text, the piece that ends there on the path of the highest sum of scores; a character
that no piece covers alone may also be spelled out in byte pieces, at a price below any
piece. Blanks become whitespace markers, one more marker stands before the text, and
decoding turns them back.

Where no piece has a marker after another character, the best path of a text is that of
its words one after the other, a word reaching from its markers to the next one. So
words are segmented, many at a time: one step of the search is taken for all words of a
length class together, and what a worker has met it remembers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tidemark.llm.common import slices

MARK = "▁"
LONG = 64
TOGETHER = 1 << 15
DECODED_TOGETHER = 256
CACHED_WORDS = 250_000
UNKNOWN_PENALTY = 10.0
"""How much less than the least piece an unknown character counts. A fixed value of the format."""
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class DoubleArray:
    """A trie of byte strings in two arrays, and in a third the number of the string that ends in a state."""

    def __init__(self, keys: Sequence[bytes], values: Sequence[int]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = {}
        for key, value in zip(keys, values, strict=True):
            node = 0
            for byte in key:
                node = children[node].setdefault(byte, len(children))
                if node == len(children):
                    children.append({})
            ends.setdefault(node, value)
        size = 2 * len(children) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        state, first, queue = {0: 0}, 1, [0]
        for node in queue:
            labels = sorted(children[node])
            if not labels:
                continue
            while taken[first]:
                first += 1
            base = max(first - labels[0], 1)
            while any(taken[base + b] for b in labels):
                base = taken.index(0, base + labels[0] + 1) - labels[0]
            own = state[node]
            self.base[own] = base
            for b in labels:
                taken[base + b] = 1
                self.check[base + b] = own
                state[children[node][b]] = base + b
            queue += [children[node][b] for b in labels]
            if base + 1024 > size // 2 + len(children):
                taken += bytes(1024)
                self.base, self.value = (np.r_[x, np.full(1024, fill, np.int32)] for x, fill in ((self.base, 0), (self.value, -1)))
                self.check = np.r_[self.check, np.full(1024, -1, np.int32)]
        for node, value in ends.items():
            self.value[state[node]] = value

    def prefixes(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """``end, value`` of each string that begins at a place, short ones first."""
        state = 0
        for at in range(start, len(data)):
            following = int(self.base[state]) + data[at]
            if data[at] == 0 or self.check[following] != state:
                return
            state = following
            if self.value[state] >= 0:
                yield at + 1, int(self.value[state])


@dataclass(frozen=True)
class Piece:
    text: str
    score: float
    kind: str = "normal"  # or byte, unknown, control, unused


class Model:
    """Pieces by id. ``prefix`` puts a marker before each text that is not empty."""

    def __init__(self, pieces: Sequence[Piece], prefix: bool = True) -> None:
        self.pieces, self.prefix = list(pieces), prefix
        normal = [(i, p) for i, p in enumerate(pieces) if p.kind == "normal" and p.text]
        if any("\0" in p.text for _, p in normal):
            raise ValueError("a piece has a NUL")
        self.trie = DoubleArray([p.text.encode() for _, p in normal], [i for i, _ in normal])
        self.scores = np.array([p.score for p in pieces], np.float64)
        self.unknown_score = min((p.score for _, p in normal), default=0.0) - UNKNOWN_PENALTY
        unknown = [i for i, p in enumerate(pieces) if p.kind == "unknown"]
        self.unknown = unknown[0] if unknown else 0
        bytes_ = {int(p.text[3:5], 16): i for i, p in enumerate(pieces) if p.kind == "byte"}
        self.bytes = np.array([bytes_[b] for b in range(256)], np.int32) if len(bytes_) == 256 else None
        self.by_word = not any(MARK in p.text.lstrip(MARK) for _, p in normal)
        self.surfaces = [self._surface(p) for p in pieces]
        self.sizes = np.array([len(s) for s in self.surfaces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.surfaces), np.uint8)
        self.known: dict[str, bytes] = {}

    def _surface(self, piece: Piece) -> bytes:
        if piece.kind == "byte":
            return bytes([int(piece.text[3:5], 16)])
        if piece.kind == "control":
            return b""
        return " ⁇ ".encode() if piece.kind == "unknown" else piece.text.replace(MARK, " ").encode()

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        split = []
        for text in texts:
            marked = (MARK if self.prefix and text else "") + text.replace(" ", MARK)
            split.append(WORDS.findall(marked) if self.by_word else [marked] if marked else [])
        new = set().union(*split) - self.known.keys()
        if new:
            if len(self.known) + len(new) > CACHED_WORDS:
                self.known.clear()
                new = set().union(*split)
            words = list(new)
            self.known.update(zip(words, self.segment([w.encode() for w in words]), strict=True))
        find = self.known.__getitem__
        return [b"".join(map(find, words)) for words in split]

    def text(self, ids: Sequence[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        surfaces = self.surfaces
        found = b"".join([surfaces[i] for i in ids])
        return (found[1:] if self.prefix and found[:1] == b" " else found).decode("utf-8", "replace")

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of many runs of ids, of which the bounds are given."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        data = self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[bounds]
        if self.prefix:  # without the marker in front
            full = edges[:-1][edges[1:] > edges[:-1]]
            drop = np.zeros(len(data) + 1, np.int64)
            drop[full[data[full] == ord(" ")]] = 1
            data, edges = data[drop[:-1] == 0], edges - np.concatenate([[0], np.cumsum(drop[:-1])])[edges]
        raw = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data.tobytes())])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:  # byte pieces that are no UTF-8
            return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())

    def segment(self, words: list[bytes]) -> list[bytes]:
        """The best path of each word."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self._segment_long(words[i])
        order = np.argsort(lengths, kind="stable")
        order = order[(lengths[order] > 0) & (lengths[order] <= LONG)]
        for start in range(0, len(order), TOGETHER):
            some = order[start : start + TOGETHER]
            for i, ids in zip(some.tolist(), self._segment_many([words[i] for i in some.tolist()], lengths[some]), strict=True):
                out[i] = ids
        return out

    def _segment_many(self, words: list[bytes], lengths: np.ndarray) -> list[bytes]:
        n, width = len(words), int(lengths.max())
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).astype(np.int32)
        starts = (text & 0xC0) != 0x80
        size = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            here = np.flatnonzero((lengths > i) & starts[:, i])
            alone = np.zeros(n, bool)
            rows, state = here, np.zeros(len(here), np.int32)
            for j in range(i, width):
                byte = text[rows, j]
                following = base[state] + byte
                goes = (check[following] == state) & (byte > 0) & (lengths[rows] > j)
                rows, state = rows[goes], following[goes]
                if not len(rows):
                    break
                found = value[state]
                hit = found >= 0
                ending, ids = rows[hit], found[hit]
                score = best[ending, i] + self.scores[ids]
                better = score > best[ending, j + 1]
                ending_better = ending[better]
                best[ending_better, j + 1] = score[better]
                back[ending_better, j + 1] = i
                piece[ending_better, j + 1] = ids[better]
                alone[ending[size[ending, i] == j + 1 - i]] = True
            rows = here[~alone[here]]
            if len(rows):
                end = i + size[rows, i]
                score = best[rows, i] + self.unknown_score
                better = score > best[rows, end]
                rows, end = rows[better], end[better]
                best[rows, end] = score[better]
                if self.bytes is None:
                    back[rows, end], piece[rows, end] = i, self.unknown
                else:  # a step per byte; no piece ends within a character
                    for k in range(4):
                        inside = end - i > k
                        back[rows[inside], end[inside] - k] = end[inside] - k - 1
                        piece[rows[inside], end[inside] - k] = self.bytes[text[rows[inside], end[inside] - k - 1]]
        ids, at, filled, rows = np.zeros((n, width), "<u4"), lengths.copy(), np.full(n, width), np.arange(n)
        while len(rows):
            filled[rows] -= 1
            ids[rows, filled[rows]] = piece[rows, at[rows]]
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        raw, line = ids.tobytes(), 4 * width
        return [raw[line * i + 4 * a : line * (i + 1)] for i, a in enumerate(filled.tolist())]

    def _segment_long(self, word: bytes) -> bytes:
        best, back = [-np.inf] * (len(word) + 1), [(0, -1)] * (len(word) + 1)
        best[0] = 0.0
        at = 0
        while at < len(word):
            lead = word[at]
            size, alone = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4, False
            for end, value in self.trie.prefixes(word, at):
                score = best[at] + float(self.scores[value])
                alone |= end == at + size
                if score > best[end]:
                    best[end], back[end] = score, (at, value)
            if not alone and best[at] + self.unknown_score > best[at + size]:
                best[at + size], back[at + size] = best[at] + self.unknown_score, (at, -1)
            at += size
        path, at = [], len(word)
        while at:
            before, value = back[at]
            if value >= 0:
                path.append(value)
            else:
                path += [self.unknown] if self.bytes is None else [int(self.bytes[b]) for b in reversed(word[before:at])]
            at = before
        return np.array(path[::-1], "<u4").tobytes()


def log_scores(ranks: Sequence[float]) -> list[float]:
    """The logarithms of shares that fall as one by the rank, as words' shares do (Zipf's law)."""
    total = math.log(sum(1 / r for r in range(1, len(ranks) + 1)))
    return [-math.log(min(r, len(ranks))) - total for r in ranks]


def load(path: str, ranks: bool = False, prefix: bool = True) -> Model:
    """The model of a SentencePiece file.

    Its scores are taken as they are, as a unigram model's are logarithms. In a file of
    merges they are the ranks of the merges, from 0 downwards: sums of these say
    nothing, so with ``ranks`` a piece gets the log score that its rank lets expect.
    """
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)

    def kind(i: int) -> str:
        for name, is_one in (("byte", file.is_byte), ("unknown", file.is_unknown), ("control", file.is_control), ("unused", file.is_unused)):
            if is_one(i):
                return name
        return "normal"

    pieces = [Piece(file.id_to_piece(i), file.get_score(i), kind(i)) for i in range(file.vocab_size())]
    if ranks:
        scores = iter(log_scores([1 - p.score for p in pieces if p.kind == "normal"]))
        pieces = [replace(p, score=next(scores)) if p.kind == "normal" else p for p in pieces]
    return Model(pieces, prefix)


def _encode_pass(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                found = model.value.ids([t or "" for t in texts])
                offsets = np.cumsum([0, *(len(b) // 4 for b in found)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32))
                absent = pa.array([t is None for t in texts])
                yield part.append_column("ids", pa.ListArray.from_arrays(pa.array(offsets), flat, mask=absent))

    return run


def _decode_pass(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            for first in range(0, batch.num_rows, DECODED_TOGETHER):
                own = bounds[first : first + DECODED_TOGETHER + 1]
                part = batch.slice(first, DECODED_TOGETHER)
                ids = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                found = model.value.texts(ids, own - own[0])
                yield part.append_column("decoded", pc.if_else(part.column("ids").is_valid(), found, pa.scalar(None, pa.string())))

    return run


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``ids array<int>``, the pieces of ``text string``.

    Other columns pass through, one named ``ids`` is replaced. Null has no ids, an
    empty text an empty array.
    """
    docs = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(_encode_pass(_sent(docs, model)), StructType(docs.schema.fields[:]).add("ids", ArrayType(IntegerType())))


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """The rows with ``decoded string``, the text of ``ids array<int>``; null ids have none.

    Other columns pass through, one named ``decoded`` is replaced. The text is that which
    was encoded, but for whitespace markers in it, which become blanks.
    """
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(_decode_pass(_sent(encoded, model)), StructType(encoded.schema.fields[:]).add("decoded", "string"))


def _sent(df: DataFrame, model: Model):
    return df.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary


def round_trip(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: pieces, byte pieces among them, a hash of the ids, and whether decoding gives the text.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Null and empty texts
    have no pieces, and decoding gives them back as they were. Every row is one of its
    own, repeated ones too; an empty table gives no rows.
    """
    found = decode(encode(docs.select("doc_id", "text"), model), model)
    spelled = F.lit(0) if model.bytes is None else F.size(
        F.filter("ids", lambda i: (i >= F.lit(int(model.bytes.min()))) & (i <= F.lit(int(model.bytes.max()))))
    )
    return found.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.coalesce(F.when(F.col("ids").isNotNull(), spelled), F.lit(0)).cast("long").alias("n_bytes"),
        F.xxhash64("ids").alias("ids_hash"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("same"),
    )
