"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup as exact
from tidemark.llm import hard_negatives as hard
from tidemark.llm import language_id as language
from tidemark.llm import license_scan as licences
from tidemark.llm import line_dedup as lines
from tidemark.llm import secret_scan as secrets
from tidemark.llm import packing
from tidemark.llm import periodic_runs as runs
from tidemark.llm import pseudonyms as pii
from tidemark.llm import unigram
from tidemark.llm import vector_search as vectors
from tidemark.llm import warc
from tidemark.llm.common import table
from tidemark.llm.jaccard_join import jaccard_join

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


@query("op2_ngram_jaccard_join")
def _op2(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"), size=3, percent=90)


@query("op5_exact_dedup")
def _op5(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op5_exact_dedup"] = exact.SQL


@query("op8_line_dedup")
def _op8(spark, sf_dir):
    """Documents as the pages of their source."""
    return lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


ORACLE["op8_line_dedup"] = lines.SQL


@query("op3_secret_scan")
def _op3(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; it is installed with its library on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_best_fit_packing")
def _op7(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), capacity=4096, end_id=1, plain=False)


@query("op1_language_id")
def _op1(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op9_warc")
def _op9(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLE["op9_warc"] = warc.SQL


@query("op4_vector_search")
def _op4(spark, sf_dir):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.search(rows, rows.where("vec_id % 50 = 0"), k=5)


PII_KEY = b"a key for the test tables; give your own to pseudonymise"


@query("op6_pii_pseudonyms")
def _op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY)


PIECE_MODEL = "piece_bpe_32k.model"


@query("op10_sentencepiece_unigram")
def _op10(spark, sf_dir):
    return unigram.round_trip(table(spark, sf_dir, "documents"), unigram.load(tokenizer_path(PIECE_MODEL), ranks=True))


@query("op11_hard_negatives")
def _op11(spark, sf_dir):
    """Anchors are the rows whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", hard.shifted(F.col("label"), F.col("vec_id")))
    return hard.mine(rows, F.col("vec_id") % 50 == 0)


ORACLE["op11_hard_negatives"] = hard.SQL


@query("op12_periodic_runs")
def _op12(spark, sf_dir):
    """Every tenth text is made periodic first, as the given ones have few runs."""
    return runs.digest(runs.periodic_runs(runs.made_periodic(table(spark, sf_dir, "documents"))))


@query("op13_license_scan")
def _op13(spark, sf_dir):
    return licences.digest(licences.scan(table(spark, sf_dir, "documents")))


ORACLE["op13_license_scan"] = licences.SQL
