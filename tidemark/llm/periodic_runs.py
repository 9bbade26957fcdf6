"""Runs: stretches of words that repeat with a period, found as maximal pairs.

A maximal pair is two equal stretches whose left neighbours differ and whose right
neighbours differ. Its second stretch begins at a distance d behind the first; if the
stretches have at least d words, both together repeat with period d, and as the pair is
maximal no neighbour goes on with it: the pair is a run as it stands, without any
extension. The smallest distance of the pairs that cover a stretch is its period.

Texts become numbers of words, a megabyte at a time, with a separator after each text.
Suffixes are sorted by doubling: ties among the first k words are sorted by the rank of
what follows them, until none is left, and only the tied ones are touched. The ranks of
every doubling give the longest common prefixes of neighbours in that order. Runs of at
least m words need a common prefix of m / 2, so what remains are the groups of suffixes
that share so much; in most texts there is none. A group has no maximal pair close enough
if all its left neighbours are the same, or if its smallest gap exceeds its longest
prefix. Over each other group the tree of LCP intervals is built bottom-up with a stack;
each interval holds its positions in order and in lists by left word, and when a child
joins an interval of prefix l, the smaller side looks in the other one for positions of
other left words at distances up to l.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, utf8

LEAST = 12


class _Numbers(dict):
    """Words in the order they were met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def suffix_order(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of the suffixes of ``keys``, and their ranks by the first 1, 2, 4, ... keys.

    Positions with the same keys up to there have the same rank. The last ranks given
    are the last with ties. The end of ``keys`` must be a key that occurs once.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, step = [], 1
    tied = order[_tied(new)]
    while len(tied):
        levels.append(rank.copy())
        own = rank[tied]  # sorted, as ``tied`` is in suffix order
        both = own * n + rank[tied + step]
        place = np.argsort(both, kind="stable")
        tied, both, own = tied[place], both[place], own[place]
        at = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(_changes(own), at, 0))  # of the group that was tied before
        slot = own + at - start
        order[slot] = tied
        new = _changes(both)
        rank[tied] = slot[np.maximum.accumulate(np.where(new, at, 0))]
        tied = tied[_tied(new)]
        step *= 2
    return order, levels


def _changes(values: np.ndarray) -> np.ndarray:
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def _tied(new: np.ndarray) -> np.ndarray:
    """Members of groups of several, from where groups begin."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return ~alone


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many keys pairs of positions have in common from there on."""
    shared = np.zeros(len(a), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        shared += (levels[i][a + shared] == levels[i][b + shared]) * np.int64(1 << i)
    return shared


class _Interval:
    """Positions below a node of the tree: all in order, and in order for each left word."""

    __slots__ = ("positions", "classes")

    def __init__(self, position: int, left: int) -> None:
        self.positions = [position]
        self.classes = {left: [position]}


def _join(a: _Interval, b: _Interval, shared: int, least: int, found: dict[tuple[int, int], int]) -> _Interval:
    """The interval of two children that have ``shared`` words in common, and their maximal pairs close enough."""
    if len(a.positions) < len(b.positions):
        a, b = b, a
    for left, own in b.classes.items():
        others = len(a.classes) - (left in a.classes)
        if not others:
            continue
        same = a.classes.get(left, ())
        for x in own:
            lo, hi = bisect_left(a.positions, x - shared), bisect_right(a.positions, x + shared)
            if lo == hi:
                continue
            if hi - lo <= 2 * others:
                own_class = set(same[bisect_left(same, x - shared) : bisect_right(same, x + shared)])
                near = [y for y in a.positions[lo:hi] if y not in own_class]
            else:
                lists = (other for word, other in a.classes.items() if word != left)
                near = [y for other in lists for y in other[bisect_left(other, x - shared) : bisect_right(other, x + shared)]]
            for y in near:
                distance = abs(x - y)
                if distance + shared >= least:
                    key = (min(x, y), distance + shared)
                    if distance < found.get(key, distance + 1):
                        found[key] = distance
    for left, own in b.classes.items():
        target = a.classes.setdefault(left, [])
        for x in own:
            insort(target, x)
            insort(a.positions, x)
    return a


def maximal_pairs(positions: list[int], shared: list[int], left: list[int], least: int, found: dict[tuple[int, int], int]) -> None:
    """Walk over the tree of a group: ``shared[i]`` words are common to suffixes ``i - 1`` and ``i`` of it.

    Adds to ``found`` the smallest distance for each start and length.
    """
    stack: list[list] = []
    for i in range(1, len(positions)):
        carried, depth = _Interval(positions[i - 1], left[i - 1]), shared[i]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            carried = _join(top[1], carried, top[0], least, found)
        if stack and stack[-1][0] == depth:
            stack[-1][1] = _join(stack[-1][1], carried, depth, least, found)
        else:
            stack.append([depth, carried])
    carried = _Interval(positions[-1], left[-1])
    while stack:
        depth, interval = stack.pop()
        carried = _join(interval, carried, depth, least, found)


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, as (start, length, period) in order."""
    answer: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    which = [i for i, words in enumerate(texts) if len(words) >= least]
    if not which:
        return answer
    numbers = _Numbers()
    ids = np.fromiter(itertools.chain.from_iterable(map(numbers.__getitem__, texts[i]) for i in which), np.int64)
    sizes = np.array([len(texts[i]) for i in which], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a separator after each text
    text = np.repeat(np.arange(len(which)), sizes)
    keys = np.empty(starts[-1], np.int64)
    keys[np.arange(len(ids)) + text] = text * len(numbers) + ids
    keys[starts[1:] - 1] = -1 - np.arange(len(which))
    order, levels = suffix_order(keys)

    deep = max(1, -(-least // 2))  # fewer common words give no run that is long enough
    gate = deep.bit_length() - 1
    if gate >= len(levels):
        return answer
    ranks = levels[gate][order]
    at = np.flatnonzero(ranks[1:] == ranks[:-1]) + 1
    shared = common_prefixes(levels, order[at - 1], order[at])
    at, shared = at[shared >= deep], shared[shared >= deep]
    if not len(at):
        return answer

    begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
    ends = np.r_[begins[1:], len(at)]
    member = np.sort(np.concatenate([at, at[begins] - 1]))
    group = np.repeat(np.arange(len(begins)), ends - begins + 1)
    position = order[member]
    left = np.where(position > 0, levels[0][position - 1], -1)
    edges = np.flatnonzero(_changes(group))
    differ = np.minimum.reduceat(left, edges) < np.maximum.reduceat(left, edges)
    by_place = np.sort(group * len(keys) + position)
    gaps = np.diff(by_place, append=by_place[-1] + len(keys))
    gaps[np.r_[edges[1:], len(group)] - 1] = len(keys)
    close = np.minimum.reduceat(gaps, edges) <= np.maximum.reduceat(shared, begins)
    found: dict[tuple[int, int], int] = {}
    for g in np.flatnonzero(differ & close).tolist():
        some = slice(edges[g], edges[g] + ends[g] - begins[g] + 1)
        own = [0, *shared[begins[g] : ends[g]].tolist()]
        maximal_pairs(position[some].tolist(), own, left[some].tolist(), least, found)

    for (start, length), period in sorted(found.items()):
        i = int(np.searchsorted(starts, start, side="right")) - 1
        answer[which[i]].append((start - int(starts[i]), length, period))
    for runs in answer:
        runs.sort(key=lambda run: (run[0], run[2]))
    return answer


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those that a run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(itertools.compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _runs_pass(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                data, bounds = utf8(some.column("text"))
                raw = data.tobytes()
                texts = [raw[a:b].split() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                runs = runs_of(texts, least)
                flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
                struct = pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], ["start", "length", "period"])
                offsets = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
                left = pa.array([collapsed(w, own) for w, own in zip(texts, runs, strict=True)], pa.binary()).view(pa.string())
                columns = [some.column("doc_id"), pa.array([len(w) for w in texts], pa.int64()), pa.ListArray.from_arrays(offsets, struct), left]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RUNS.split(", ", 3)])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The runs of each text and what is left of it when each is cut to its first period.

    ``docs`` has ``doc_id long`` and ``text string``; other columns are ignored. Words are
    what white space of ASCII parts, numbered from 0. A run is a stretch of at least
    ``least`` words and two periods in which words one period apart are the same, and
    which no neighbouring word continues; its period is the smallest. Returns ``doc_id,
    n_words, runs, collapsed``, a row per row: runs are sorted by start, then period, and
    ``collapsed`` has the words that no run contains after its first period, joined by one
    space. Null, empty and blank texts have no words, no runs and an empty ``collapsed``.
    Each row is a text of its own, also if it repeats a doc_id or has none. A text is
    handled by one task, in memory in proportion to its length.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_runs_pass(least), RUNS)


def made_periodic(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, every tenth text (by a checksum of its doc_id) made periodic from some word on.

    With g a tenth of the checksum, words from a = g % n on repeat the first p of them,
    p = 1 + (n - a) // (3 + g % 8). Texts without words or doc_id stay.
    """
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(checksum / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " "))

    periodic = F.transform(F.array(words), lambda w: F.coalesce(repeated(w), F.col("text")))[0]
    return docs.select("doc_id", F.when(checksum % 10 == 0, periodic).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and checksums of all runs and of what is left."""
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = found.withColumn("best", F.array_max(order))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(spelled, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
