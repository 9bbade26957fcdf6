"""From raw documents to packed training sequences, as stages that Parquet tables part.

Each stage is a function of ``(spark, docs, sf_dir)``; its result is written and
read again as the ``docs`` of the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", stages.identified),
    ("line_dedup", stages.without_boilerplate),
    ("near_duplicates", stages.near_duplicates),
    ("secret_scan", stages.without_secrets),
    ("packing", stages.packed),
]

#: SQL has neither the language model nor the tokenizer of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``: a row per piece, with its place in a sequence.

    Each stage says what it does with null and empty texts, rows that share a doc_id or have
    none, and further columns; columns of the table beyond those it knows pass through all
    stages but the last. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
