import pytest
from helpers import DOCS, jaccard_components
from test_language_id import plain_points
from test_line_dedup import plain as plain_lines
from test_packing import check as check_packing
from test_secret_scan import plain_added, plain_base

import __spark_entry__ as driver
import corpus_pipeline
from tidemark.llm import language_id, line_dedup, secret_scan, stages
from tidemark.llm.packing import WordTokenizer
from tidemark.llm.queries import QUERIES, WORD_BPE, tokenizer_path


def masked(text):
    spans = sorted((base := plain_base(text)) + plain_added(text, base))
    out, at = "", 0
    while spans:
        a, _, b = spans.pop(0)
        while spans and spans[0][0] <= b:
            b = max(b, spans.pop(0)[2])
        out, at = out + text[at:a] + secret_scan.MASK, b
    return out + text[at:]


def brute_force(spark, rows):
    """Every stage by its plain version, but for the language model, which is the operator's."""
    df = spark.createDataFrame(rows, DOCS)
    found = language_id.predict(df, language_id.train(df)).collect()
    kept = {r.doc_id for r in found if r.lang_pred != "und" and r.score >= stages.LEAST_SCORE}
    rows = [r for r in rows if r[0] in kept]
    assert all(plain_points(r[1]).strip() for r in rows)
    lines = plain_lines([(r[0], r[1], r[3]) for r in rows], line_dedup.RATIO, line_dedup.LEAST_TEXTS)
    texts = {d: t for d, t, _, dropped in lines if not dropped or t.strip()}
    component = jaccard_components(texts.items(), 5, 80)
    return [(d, masked(t)) for d, t in texts.items() if component[d] == d]


@pytest.fixture(scope="module")
def tokenizer():
    return WordTokenizer(tokenizer_path(WORD_BPE)).tokenizer


def test_pipeline_against_brute_force(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*[c.split()[0] for c in DOCS.split(", ")]).collect()]
    got = driver.queries()["pipeline"](spark, sf).collect()
    docs = brute_force(spark, rows)
    assert 0 < len(docs) < len(rows)
    check_packing(got, docs, tokenizer, 4096)


LONG = "The weather was fine that day and many people walked along the river in the old town until late at night. "
ROWS = [
    *[(i, f"Home | News\nThis is an article about number {i} and the many things that the number {i} does. " + LONG[: i * 4], "en", "a", 5) for i in range(12)],
    (20, LONG * 3, "en", "b", 5),
    (21, LONG * 3 + "And then.", "en", "b", 5),
    (22, LONG * 3, "en", "c", 5),
    (30, "Please set password = hunter22 in the file and then go on with the work of the day", "en", "b", None),
    (31, None, "en", "b", 5),
    (32, "12345 !!! 999", "en", "b", 5),
    (33, "ქართული ენა არის ძალიან ლამაზი", None, "b", 5),
    (34, "Home | News", "en", "a", 5),
    (35, "", "en", None, 5),
    (40, "a short text of the town", None, None, 5),
    (40, "a short text of the town", None, None, 5),
    (None, "a text that has no number at all and that nobody has labelled", None, "b", 5),
]


def test_each_stage(spark):
    df = spark.createDataFrame([(*r, "more") for r in ROWS], DOCS + ", score string")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, "").cache()
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in spark.createDataFrame([], DOCS + ", score string").schema]
        seen[name] = {r.doc_id: r for r in df.collect()}
    assert set(seen["language_id"]) == {*range(12), 20, 21, 22, 30, 34, 40, None}
    assert set(seen["line_dedup"]) == set(seen["language_id"]) - {34}
    assert not any("Home" in r.text for r in seen["line_dedup"].values())
    assert seen["line_dedup"][3].n_chars == len(seen["line_dedup"][3].text)
    assert {20, 30, 40, None} <= set(seen["near_duplicates"]) and not {21, 22} & set(seen["near_duplicates"])
    assert df.where("doc_id = 40").count() == 1
    final = seen["secret_scan"]
    assert final[30].text == "Please set [SECRET] in the file and then go on with the work of the day"
    assert final[30].n_chars == len(final[30].text) and final[20].n_chars == 5
    assert set(final) == set(seen["near_duplicates"])


def test_rows_that_share_a_doc_id(spark):
    other = "Quite another story about a ship on the sea that came home after seven long years with nobody on board but a cat. "
    third = "In the garden behind the house grew apples and pears and plums that nobody picked before the first snow had come. "
    rows = [
        (2, LONG * 3, "en", "b", 5), (2, other * 3, "en", "b", 5), (2, other * 3 + "And then.", "en", "b", 5),
        (3, LONG * 3, "en", "b", 5), (3, third * 3, "en", "c", 5), (3, third * 3, "de", "b", 5),
        (1, other * 3 + "The end.", "en", "b", 5), (4, third * 3 + "The end.", "en", "b", 5), (5, None, "en", "b", 5), (5, "", "en", "b", 5),
        (None, third * 3, "en", "b", 5), (None, third * 3, "en", "b", 5),
    ]
    want = [(1, other * 3 + "The end.", "en", "b", 5), (2, LONG * 3, "en", "b", 5), (3, third * 3, "de", "b", 5), *rows[8:]]
    for parts, some in ((1, rows), (5, rows[::-1])):
        got = stages.near_duplicates(spark, spark.createDataFrame(some, DOCS).repartition(parts), "").collect()
        assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
        assert df.collect() == []
        if "doc_id" in df.columns and "text" in df.columns:
            df = spark.createDataFrame([], DOCS)


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "secret_scan", "packing"]
