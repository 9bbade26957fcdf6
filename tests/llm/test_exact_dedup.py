import hashlib
import random
import re
from collections import defaultdict

import pytest
from conftest import SF_DIR
from helpers import DOCS
from oracle_check import compare, connect

from tidemark.llm import exact_dedup as ed
from tidemark.llm.queries import ORACLE, QUERIES


def body(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def check(spark, rows, **options):
    got = ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[body(text)].append((-len(text or ""), doc_id is None, doc_id))
    want = []
    for text, members in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        want += [(m[2], keep[2], len(members), sha) for m in members]
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


ROWS = [(5, "a b\tc"), (3, "ab\x0bc"), (4, "abc  "), (9, "abd"), (1, None), (2, ""), (7, " \n"), (None, "a b\tc"), (5, "a b\tc")]
ROWS += [(10, "é x"), (11, "é  x"), (12, "éx"), (None, "alone"), (20, "z" * 40000), (21, "z" * 20000 + " " + "z" * 20000)]
ROWS += [(22, "z" * 39999 + "y")]


def test_small(spark):
    check(spark, ROWS)


def test_huge_texts_by_parts(spark):
    check(spark, ROWS, huge=2, part=3)


def test_equal_fingerprints_of_different_texts(spark):
    """Moduli so small that most texts of a length clash."""
    rows = [(i, f"{i % 7:07b}{' ' * (i % 3)}") for i in range(60)]
    check(spark, rows, primes=(2, 2, 2, 2))
    check(spark, rows, huge=2, part=3, primes=(2, 2, 2, 2))


@pytest.mark.parametrize("cut", [0, 1, 7, 16384, 16385, 40000])
def test_fingerprints_compose(cut):
    data = random.Random(1).randbytes(40000)
    a, b = data[:cut], data[cut:]
    assert (ed.combine(ed.fingerprint(a), ed.fingerprint(b), len(b)) == ed.fingerprint(data)).all()
    for i, (p, x) in enumerate(zip(ed.PRIMES, ed.BASES, strict=True)):
        total = 0
        for byte in data[:cut]:
            total = (total * x + byte) % p
        assert total == ed.fingerprint(a)[i]


def test_empty_and_other_columns(spark):
    assert ed.exact_dedup(spark.createDataFrame([], DOCS)).collect() == []
    df = spark.createDataFrame([(1, "a", 5, "k", True)], "doc_id long, text string, row int, key string, kept boolean")
    assert [tuple(r)[:4] for r in ed.exact_dedup(df).collect()] == [(1, 1, 1, True)]


def test_query(spark):
    assert compare(QUERIES["op5_exact_dedup"](spark, SF_DIR), connect(SF_DIR), ORACLE["op5_exact_dedup"]) > 0
