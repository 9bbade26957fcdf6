from collections import defaultdict

from conftest import SF_DIR, plan
from helpers import DOCS
from oracle_check import compare, connect

from tidemark.llm import line_dedup as ld
from tidemark.llm.queries import ORACLE, QUERIES


def plain(rows, ratio, least):
    pages = defaultdict(list)
    for _, text, host in rows:
        if host is not None:
            pages[host].append(text)
    common = {}
    for host, texts in pages.items():
        have = defaultdict(list)
        for t in texts:
            for x in {y.strip(" ") for y in t.split("\n")} - {""} if t is not None else ():
                have[x].append(t)
        common[host] = {x for x, own in have.items() if len(set(own)) >= least and len(own) > ratio * len(texts)}
    out = []
    for doc, text, host in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if not x.strip(" ") or x.strip(" ") not in common.get(host, ())]
        out.append((doc, "\n".join(kept) if len(kept) < len(lines) else text, len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


ROWS = [
    *[(i, f"menu\nown {i}\n menu  \n\nfoot", "a") for i in range(6)],
    *[(10 + i, "menu\ncopied page", "b") for i in range(8)],
    (20, "menu\nother", "b"),
    (21, "menu", None),
    (22, None, "a"),
    (23, "", "a"),
    (24, "foot\nfoot", "a"),
    (25, "menu", "a"),
    (25, "menu", "a"),
    (26, "x" * 50000 + "\nmenu", "a"),
]


def test_small(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for ratio, least in ((0.3, 2), (0.5, 1), (0.0, 1), (0.9, 1)):
        got = ld.line_dedup(df, "source", ratio, least).select("doc_id", "text", "n_lines", "n_dropped").collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain(ROWS, ratio, least)


def test_copies_count_as_pages(spark):
    """Of 1,000 pages, 900 are copies: a line of 11 others stays, one of 101 pages goes, the copied text stays."""
    rows = [(i, "copied\nseldom two" if i < 2 else "copied", "a") for i in range(900)]
    rows += [(1000 + i, f"own {i}" + "\nseldom" * (i < 11) + "\noften" * (i < 100), "a") for i in range(100)] + [(2000, "copied\noften", "a")]
    rows += [(3000 + i, "one\ntext", "b") for i in range(50)] + [(4000 + i, f"menu\n{i}", "c") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in ld.line_dedup(df).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert got == plain(rows, ld.RATIO, ld.LEAST_TEXTS)
    dropped = {r[0]: r[3] for r in got}
    assert dropped[1000] == 1 and dropped[1099] == 1 and dropped[5] == 1 and dropped[3000] == 0 and dropped[4000] == 1
    texts = {r[0]: r[1] for r in got}
    assert texts[1000] == "own 0\nseldom" and texts[3000] == "one\ntext" and texts[4003] == "3"


def test_empty_and_other_columns(spark):
    assert ld.line_dedup(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(i, f"m\n{i}", "h", "page", 3, ["x"]) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host string, n_lines int, lines array<string>")
    got = ld.line_dedup(df).collect()
    assert {(r.text, r.host, r.n_lines, r.n_dropped, tuple(r.lines)) for r in got} == {(str(i), "page", 2, 1, ("x",)) for i in range(9)}


def test_no_python(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert not any(x in plan(ld.line_dedup(df)) for x in ("Python", "Arrow", "Pandas"))


def test_query(spark):
    for sf in (SF_DIR, "/root/testdata/sf0.01"):
        compare(QUERIES["op8_line_dedup"](spark, sf), connect(sf), ORACLE["op8_line_dedup"])
