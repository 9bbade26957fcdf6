"""The stages of the corpus pipeline. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, line_dedup, packing, secret_scan
from tidemark.llm.common import stored
from tidemark.llm.jaccard_join import jaccard_join
from tidemark.llm.queries import WORD_BPE, tokenizer_path

LEAST_SCORE = 0.15


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach.

    Those go whose text is null or has no letter, and those of which less than
    ``LEAST_SCORE`` of the n-grams belong to the language found: noise, or a language
    that nobody has labelled. What the label says does not matter for a document. With
    no labelled document at all there is nothing to judge by, and all with a letter stay.
    """
    model = language_id.train(docs.where("doc_id is not null"))
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    found = language_id.predict(docs.select(rest.alias("_rest"), "text"), model, ["_rest", "text"])
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*["text" if c == "text" else F.col(f"_rest.{c}").alias(c) for c in docs.columns])


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that over a tenth of their source's documents have.

    A document of which nothing but blanks is left goes. ``n_chars`` follows the text.
    """
    found = line_dedup.line_dedup(docs.withColumn("_columns", F.struct(*docs.columns)), host="source")
    changed = F.col("n_dropped") > 0
    kept = found.where(~changed | (F.trim(F.regexp_replace("text", "\\s+", " ")) != ""))
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("_columns.n_chars"))}
    return kept.select(*[new.get(c, F.col(f"_columns.{c}")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect: that with the smallest doc_id.

    Links are those of five-word shingles and a similarity of 0.8 or more. Rows that share
    a doc_id but not the text are linked each for itself, so only copies and near copies of
    what stays go; of equal doc_ids in a group one stays by a hash of its text, and of rows
    that differ in other columns only the first in the order of these as JSON. Rows without
    doc_id and texts without words link with nothing and stay, but for exact copies with
    the same doc_id.
    """
    rows = docs.where("doc_id is not null")
    text = F.xxhash64("text")
    several = rows.groupBy("doc_id").agg(F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y")
    several = stored(several.select(F.col("doc_id").alias("_several")), "repeated-ids")
    own = F.xxhash64("doc_id", "text")
    rows = rows.join(several, F.col("doc_id") == F.col("_several"), "left")
    rows = rows.withColumn("_node", F.when(F.col("_several").isNull(), F.col("doc_id").cast("long")).otherwise(own))
    nodes = stored(rows.where("_several is not null").select(F.col("_node").alias("_own"), F.col("_several").alias("_id")).distinct(), "row-nodes")

    found = jaccard_join(rows.select(F.col("_node").alias("doc_id"), "text"), size=5, percent=80)
    found = found.join(nodes, F.col("doc_id") == F.col("_own"), "left")
    first = F.min(F.struct(F.coalesce("_id", "doc_id").alias("id"), F.col("doc_id").alias("node")))
    chosen = found.groupBy("component_id").agg(first.alias("first")).select(F.col("first.node").alias("_chosen"))

    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    kept = rows.join(chosen, F.col("_node") == F.col("_chosen"))
    kept = kept.groupBy("_node").agg(F.min_by(F.struct(*docs.columns), order).alias("_row"))
    kept = kept.select(*[F.col(f"_row.{c}").alias(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret. ``n_chars`` follows the text."""
    found = secret_scan.scan(docs.withColumn("_columns", F.struct(*docs.columns)))
    spans = F.array_sort(F.concat("base_spans", "added_spans"))
    changed = F.size(spans) > 0
    text = F.when(changed, secret_scan.masked(F.col("text"), spans)).otherwise(F.col("text"))
    found = found.withColumn("_text", text)
    new = {"text": F.col("_text"), "n_chars": F.when(changed, F.length("_text").cast("long")).otherwise(F.col("_columns.n_chars"))}
    return found.select(*[new.get(c, F.col(f"_columns.{c}")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens.

    Null and empty texts are the end id alone; rows that share a doc_id, or have none, are
    documents of their own. No documents give no rows.
    """
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE), capacity=4096, end_id=1, plain=False)
