import random
import re
from collections import Counter

import pytest
from conftest import plan
from oracle_check import compare, connect

from tidemark.llm import license_scan as ls
from tidemark.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def at(w, i):
    return w[i] if 0 <= i < len(w) else None


def plain(doc_id, text):
    """Every phrase and every template tried at every word."""
    w = words(text)
    base = [(i, label) for phrase, label in ls.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    df = Counter(x for _, t, _ in ls.TEMPLATES for x in set(t.split()))
    notices = []
    for label, t, phrases in ls.TEMPLATES:
        own = t.split()
        rare = [j for j, x in enumerate(own) if df[x] <= ls.INDEXED_BY]
        for start in range(-len(own), len(w)):
            there = [at(w, start + j) == x for j, x in enumerate(own)]
            key = all(any(own[j : j + len(p.split())] == p.split() and all(there[j : j + len(p.split())]) for j in range(len(own))) for p in phrases)
            if key and 2 * sum(there[j] for j in rare) >= len(rare) and 10 * sum(there) >= 7 * len(own):
                notices.append((label, start, sum(there) / len(own)))
    starts = [i for i, _ in base]
    labels = {x for _, x in base}
    score = 1.0 if base else max([s for _, _, s in notices], default=0.0)
    ends = (min(starts), max(starts)) if starts else (None, None)
    return (doc_id, len(w), len(base), *ends, ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, _, _ in notices})), score)


def texts():
    rng = random.Random(2)
    out = [None, "", " .,- ", "MIT License", "the MIT\nlicense; mit license", "GNU General\tPublic License apache-license CC-BY", "cc by cc by", "mitlicense", "é mit license ü"]
    out += ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "K mit license", "MİT license"]
    out += ["This work is licensed under the GNU General Public License, version 3.", "gnu general public licence", "apache licenses", "mit  --  LICENSE"]
    notices = [t for _, t, _ in ls.TEMPLATES]
    out += notices + [" * " + t.upper().replace(" ", " \n * ") for t in notices]
    out += [" ".join(t.split()[3:]) for t in notices] + [" ".join(t.split()[:-4]) for t in notices] + [" ".join(t.split()[:8]) for t in notices]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            own = rng.choice(notices).split()
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(["x", "license", "the", "mit"])
            parts += own + ["w%d" % rng.randrange(9)] * rng.randrange(0, 4)
        out.append(" ".join(parts))
    vocabulary = sorted({x for t in notices for x in t.split()})
    out += [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(20)]
    out.append("mit license " * 3000 + "w " * 20000 + notices[3])
    return out


def test_against_plain(spark):
    rows = list(enumerate(texts()))
    got = ls.digest(ls.scan(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r) == plain(*rows[r.doc_id]), rows[r.doc_id][1][:300]
    assert len({label for r in got for label in r.labels.split(",")}) > 18


def test_index_has_the_rare_words():
    df, index = ls.frequencies(), ls.postings()
    rarest = min(ls.idf(w) for w in index)
    assert all(ls.idf(w) < rarest for w in df if w not in index)
    for t, (_, text, phrases) in enumerate(ls.TEMPLATES):
        assert any(u == t for own in index.values() for u, _ in own)
        assert all(text.split()[i] == w for w, own in index.items() for u, i in own if u == t)
        assert ls.keys(text, phrases)


def test_edges(spark):
    rows = [(1, "mit license"), (1, "mit license"), (None, None), (2, "x" * 200_000)]
    df = ls.scan(spark.createDataFrame([(*r, 7, "x", "y") for r in rows], DOCS + ", n_words int, notices string, _found string"))
    assert df.columns == ["doc_id", "text", "n_words", "notices", "_found", "phrases"]
    got = df.collect()
    assert [(r.n_words, len(r.phrases), r.notices) for r in got[:3]] == [(2, 1, [])] * 2 + [(0, 0, [])]
    assert [r._found for r in got] == ["y"] * 4 and got[3].n_words == 1
    assert ls.scan(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    df = QUERIES["op13_license_scan"](spark, sf)
    assert not any(x in plan(df) for x in ("Python", "Arrow", "Pandas"))
    assert compare(df, connect(sf), ORACLE["op13_license_scan"]) == 1000
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = df.collect()
    for r in got[::7]:
        assert tuple(r) == plain(r.doc_id, docs[r.doc_id])
    assert sum(r.n_base for r in got) > 0
