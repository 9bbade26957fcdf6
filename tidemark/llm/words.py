"""Words and word shingles of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidemark.llm.common import mix64, utf8

PLACES = 64
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are blank, each byte in lower case (A-Z only), and a hash per place and byte."""
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    placed = mix64(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return blank, lower, placed


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash per word of every text, and where each text's words begin."""
    hashes, first, _ = placed_words(data, bounds)
    return hashes, np.searchsorted(first, bounds).astype(np.int64)


def placed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One hash per word of every text, and the bytes where it begins and ends.

    A word's hash is the sum of a random number for each pair of place and byte,
    mixed with its length, so that equal words and only they agree (but for chance).
    """
    blank, lower, placed = _bytes()
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    spaces = blank[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = True
    before[1:] = spaces
    before[bounds] = True  # a text's edge parts words too
    first = np.flatnonzero(before[:-1] & ~spaces)
    after = np.empty(len(data) + 1, bool)
    after[:-1] = spaces
    after[bounds] = True
    last = np.flatnonzero(after[1:] & ~spaces) + 1
    lengths = last - first
    letters = np.flatnonzero(~spaces)
    place = letters - np.repeat(first, lengths)
    code = lower[data[letters]].astype(np.int64)
    with np.errstate(over="ignore"):
        values = placed[(place % PLACES) * 256 + code]
        far = np.flatnonzero(place >= PLACES)
        if len(far):
            values[far] = mix64(values[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        starts = np.cumsum(lengths) - lengths
        sums = np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)
        hashes = mix64(sums + lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return hashes, first, last


def blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """A very long text in blocks that end at blanks."""
    blank, start = _bytes()[0], 0
    while start < len(data):
        stop = min(start + BLOCK, len(data))
        while stop < len(data) and not blank[data[stop]]:
            gap = np.flatnonzero(blank[data[stop : stop + BLOCK]])
            stop = stop + int(gap[0]) if len(gap) else min(stop + BLOCK, len(data))
        yield data[start:stop]
        start = stop


def _long_text(data: np.ndarray) -> np.ndarray:
    """The hashes of the words of one very long text."""
    found = [word_hashes(part, np.array([0, len(part)]))[0] for part in blocks(data)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of ``size`` words of each text.

    A text of fewer words has its whole sequence as one; without words, none.
    """
    data, bounds = utf8(texts)
    if len(bounds) == 2 and len(data) > BLOCK:
        words = _long_text(data)
        edges = np.array([0, len(words)])
    else:
        words, edges = word_hashes(data, bounds)
    factors = mix64(np.arange(1, size + 1, dtype=np.uint64) + np.uint64(size << 32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        count = max(len(words) - size + 1, 0)
        joined = np.zeros(count, np.uint64)
        for i in range(size):
            joined += words[i : i + count] * factors[i]
        joined = mix64(joined)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= size:
                found = np.sort(joined[a : b - size + 1])
                new = np.ones(len(found), bool)
                new[1:] = found[1:] != found[:-1]
                yield found[new]
            elif b > a:
                short = (words[a:b] * factors[: b - a]).sum(dtype=np.uint64)
                yield mix64(np.array([short + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
