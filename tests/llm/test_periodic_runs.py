import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import periodic_runs as pr
from tidemark.llm.queries import QUERIES

DOCS = "doc_id long, text string"


def plain_runs(words, least=12):
    """By trying every period: stretches in which words one period apart agree."""
    n, found = len(words), {}
    for period in range(1, n // 2 + 1):
        i = 0
        while i + period < n:
            if words[i] != words[i + period]:
                i += 1
                continue
            start = i
            while i + period < n and words[i] == words[i + period]:
                i += 1
            length = i + period - start
            if length >= max(least, 2 * period):
                found.setdefault((start, length), period)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rewritten(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = rewritten(doc_id, split(text))
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *longest, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(kept), len(words))


def texts():
    rng = random.Random(3)
    out = [[], ["a"] * 11, ["a"] * 12, ["a"] * 200, ["a", "b"] * 6, ["a", "b"] * 5 + ["a"], (["a"] * 6 + ["b"] * 6) * 3]
    out += [["x", *["a", "b", "c"] * 9, "a", "y"], list("abcdef") * 2, list("abcdef") * 2 + list("abc"), list("abcdefg") * 2]
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    out.append(list(fib[-1]))
    for letters in ("ab", "aab", "abc", "abcdefgh"):
        out += [[rng.choice(letters) for _ in range(rng.randrange(5, 160))] for _ in range(60)]
    for _ in range(80):  # repeats in a random text
        base = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 30))]
        parts = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 20))] + base * rng.randrange(1, 5) + base[: rng.randrange(len(base))] for _ in range(4)]
        out.append([w for p in parts for w in p])
    return out


@pytest.mark.parametrize("least", [12, 2, 5, 30])
def test_runs_against_plain(least):
    some = [[w.encode() for w in t] for t in texts()]
    together = pr.runs_of(some, least)
    for words, got in zip(some, together, strict=True):
        assert got == plain_runs(words, least), words
    assert sum(map(len, together)) > 20
    assert [pr.runs_of([w], least)[0] for w in some[:40]] == together[:40]


def test_suffix_order_and_prefixes():
    import numpy as np

    rng = random.Random(1)
    for _ in range(30):
        keys = [rng.choice([1, 2, 3]) for _ in range(rng.randrange(1, 60))] + [0]
        order, levels = pr.suffix_order(np.array(keys))
        assert order.tolist() == sorted(range(len(keys)), key=lambda i: keys[i:])
        a, b = order[:-1], order[1:]
        shared = pr.common_prefixes(levels, a, b).tolist()
        for x, y, n in zip(a.tolist(), b.tolist(), shared, strict=True):
            assert keys[x : x + n] == keys[y : y + n] and keys[x + n] != keys[y + n]


def test_long_texts_in_bounded_time():
    one = [[b"a"] * 200_000, [b"%d" % (i % 700) for i in range(200_000)]]
    # a phrase very often, each time behind another word, beside a long stretch of its own
    one.append([w for i in range(15_000) for w in (b"%d" % i, *[b"p"] * 7)] + [b"p"] * 50_000)
    got = pr.runs_of(one)
    assert got[0] == [(0, 200_000, 1)] and got[1] == [(0, 200_000, 700)]
    assert got[2] == [(119_993, 50_007, 1)]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 12), (4, "é\x0bé\x0cé   " * 9), (4, "é\x0bé\x0cé   " * 9), (5, "A a " * 6)]
    got = pr.periodic_runs(spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS + ", runs int, collapsed string")).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, (_, text) in zip(got, rows, strict=True):
        assert [tuple(x) for x in r.runs] == plain_runs(split(text)) and r.n_words == len(split(text))
    assert [r.collapsed for r in got] == ["", "", "", "a", "é é é  ", "é é é  ", "A a"]
    assert pr.periodic_runs(spark.createDataFrame([], DOCS)).collect() == []


def test_made_periodic(spark):
    docs = spark.createDataFrame([(i, " ".join(str(j) for j in range(i % 37))) for i in range(300)] + [(None, "a b")], DOCS)
    got = pr.made_periodic(docs).collect()
    assert [split(r.text) for r in got] == [rewritten(r.doc_id, split(d.text)) for r, d in zip(got, docs.collect(), strict=True)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300)) > 10


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert len(got) == len(docs)
    small = [r for r in got if len(docs[r.doc_id] or "") < 40_000]
    assert len(small) >= len(got) - 3
    for r in small:
        assert tuple(r) == expected(r.doc_id, docs[r.doc_id])
    assert sum(r.n_runs for r in got) > 10
