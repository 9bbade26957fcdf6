import gzip
import io
import random

import pytest
from conftest import SF_DIR
from oracle_check import compare, connect

from tidemark.llm import warc
from tidemark.llm.queries import ORACLE, QUERIES

PAGES = "page_id long, url string, html string"
LONG = "<p>é" + "x" * 1200
ROWS = [(1, "http://a/", LONG), (9, "http://b/", LONG), (4, None, LONG), (2, "u", "short"), (3, "u", "short"), (5, "u", None), (6, "u", "")]
ROWS += [(7, "line\r\nbreak: x", "a\r\n\r\nWARC/1.1\r\n"), (8, "ü", "y" * 999), (10, "u", "y" * 999), (11, "u", "z" * 1000), (12, "u", "z" * 1000)]
ROWS += [(None, "u", LONG), (13, "u", "only one " * 200), (20, "big", "ab" * 400_000), (9, "http://b/", LONG)]


def want(rows):
    largest = {}
    for page, _, html in rows:
        if page is not None:
            largest[html or ""] = max(page, largest.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        target = largest[html or ""] if len(data) >= 1000 else page
        out.append((page, len(data), warc.sha1(data), "response" if target == page else "revisit", None if target == page else target))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, PAGES).repartition(3)
    archives = warc.write_archives(df, str(tmp_path / "a"), archive_bytes=700)
    assert sum(r.records for r in archives.collect()) == len(ROWS)
    assert len({r.path for r in archives.collect()}) > 3
    got = warc.read_archives(archives)
    short = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in short.collect()), key=repr) == want(ROWS)
    payloads = {(r.page_id, r.payload) for r in got.where("record_type = 'response'").collect()}
    assert payloads == {(p, h or "") for p, _, h in ROWS if (p, "response") in {(w[0], w[3]) for w in want(ROWS)}}
    for r in archives.collect():  # any other reader of gzip sees whole records
        text = gzip.open(r.path).read()
        assert text.count(b"WARC/1.1\r\nWARC-Type: ") == r.records


def members(*rows):
    return [warc.record(*r) for r in rows]


def read(data):
    return list(warc.read_records(io.BytesIO(data)))


def test_members_over_block_ends(monkeypatch):
    rng = random.Random(1)
    rows = [(i, "u", rng.randbytes(rng.choice([0, 1, 50, 70000])), None) for i in range(20)]
    for size in (1, 7, 64, 1 << 16):
        monkeypatch.setattr(warc, "READ_BYTES", size if size > 1 else 13)
        assert [r.payload for r in read(b"".join(members(*rows)))] == [r[2] for r in rows]


def test_faults():
    good = b"".join(members((1, "u", b"payload", None), (2, "u", b"more", 1)))
    assert [r.kind for r in read(good)] == ["response", "revisit"]
    with pytest.raises(warc.WarcError, match="ends within"):
        read(good[:-5])
    with pytest.raises(warc.WarcError):
        read(good + b"junk")
    plain = gzip.decompress(members((1, "u", b"payload", None))[0])
    for old, new in ((b"payload\r\n\r\n", b"pAyload\r\n\r\n"), (b"\r\n\r\n", b"\r\n"), (b"WARC/1.1", b"WRAC/1.1"), (b"Content-Length: ", b"Content-Size: ")):
        with pytest.raises(warc.WarcError):
            read(gzip.compress(plain.replace(old, new)))
    with pytest.raises(warc.WarcError):
        read(gzip.compress(plain + b"x"))
    without = b"\r\n".join(x for x in plain.split(b"\r\n") if not x.startswith(b"WARC-Block"))
    with pytest.raises(warc.WarcError, match="payload digest"):
        read(gzip.compress(without.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")))


def test_empty_and_other_columns(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
    df = spark.createDataFrame([(1, "u", "x", 5, "d", 3)], PAGES + ", refers_to int, digest string, target long")
    assert [tuple(r) for r in warc.round_trip(df).collect()] == want([(1, "u", "x")])


def test_query(spark):
    for sf in (SF_DIR, "/root/testdata/sf0.01"):
        assert compare(QUERIES["op9_warc"](spark, sf), connect(sf), ORACLE["op9_warc"]) > 0
