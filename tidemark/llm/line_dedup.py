"""Line deduplication by frequency within a site, with DataFrame functions only.

A line is boilerplate of its host if it is on more than a share of the host's pages,
copies of a page counted each. A line that only copies of one text have says nothing
about the host's layout; at least two different texts must have it.

Copies are counted before lines are taken apart: a page that was crawled a thousand
times is one row with its number. Lines are counted as 128-bit hashes, one per text, so
hot hosts are summed before the shuffle. Few lines of a host can be boilerplate: with L lines per page, at most
L / ratio. They come to the pages as one array per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

RATIO = 0.1
LEAST_TEXTS = 2


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """A line without the spaces around it, as two hashes."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """The boilerplate lines of each host, as ``host, lines`` with an array of line keys."""
    filled = F.filter(lines_of(F.col("text")), lambda line: F.trim(line) != "")
    pages = docs.where(F.col(host).isNotNull()).select(
        F.col(host).alias("host"),
        F.md5("text").alias("page"),
        F.array_distinct(F.transform(filled, line_key)).alias("lines"),
    )
    pages = pages.groupBy("host", "page").agg(F.first("lines").alias("lines"), F.count(F.lit(1)).alias("copies"))
    pages = stored(pages.select("host", "lines", "copies"), "page-lines")
    totals = pages.groupBy("host").agg(F.sum("copies").alias("total"))
    counts = pages.select("host", "copies", F.explode("lines").alias("line")).groupBy("host", "line.a", "line.b")
    counts = counts.agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= least_texts)
    often = counts.join(totals, "host").where(F.col("n") > F.lit(ratio) * F.col("total"))
    return stored(often.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("lines")), "boilerplate")


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """The documents without the boilerplate lines of their host.

    Needs ``text string`` and the column named by ``host``; other columns pass
    through. Adds ``n_lines`` (lines before) and ``n_dropped``, in place of columns
    of these names. A line goes if over ``ratio`` of the host's pages have it, every row a
    page, and at least ``least_texts`` different texts; lines that differ in the spaces
    around them are the same. A host of one text keeps all lines, however often it is there.
    Blank lines stay and never count. Null text stays null with no lines; documents
    without host keep all lines, as there is no site to compare with. Repeated lines
    of one page count once. A document may end without any line, with empty text.
    """
    common = boilerplate(docs, host, ratio, least_texts).select(F.col("host").alias("_host"), F.col("lines").alias("_common"))
    lines = lines_of(F.col("text"))
    kept = F.filter(lines, lambda line: (F.trim(line) == "") | ~F.array_contains("_common", line_key(line)))
    kept = F.when(F.col("_common").isNull(), lines).otherwise(kept)
    joined = docs.join(common, F.col(host) == F.col("_host"), "left")
    n_lines, n_kept = (F.coalesce(F.size(x), F.lit(0)) for x in (lines, F.col("_kept")))
    whole = joined.withColumn("_kept", kept).withColumns({"n_lines": n_lines, "n_dropped": n_lines - n_kept})
    text = F.when(F.col("n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col("text"))
    return whole.withColumn("text", text).drop("_host", "_common", "_kept")


#: The same for documents, with the source as host.
SQL = f"""
WITH l AS (
  SELECT source, md5(text) AS page, count(*) AS copies, list_distinct(list_filter(
    list_transform(string_split(first(text), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS lines
  FROM documents WHERE source IS NOT NULL GROUP BY source, page
), t AS (
  SELECT source, count(*) AS total FROM documents GROUP BY source
), n AS (
  SELECT source, line, sum(copies) AS n, count(*) AS texts
  FROM (SELECT source, copies, unnest(lines) AS line FROM l) GROUP BY source, line
), b AS (
  SELECT source, list(line) AS common FROM n JOIN t USING (source)
  WHERE texts >= {LEAST_TEXTS} AND n > {RATIO} * total GROUP BY source
), d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines, coalesce(common, []) AS common
  FROM documents LEFT JOIN b USING (source)
), k AS (
  SELECT doc_id, text, lines,
         list_filter(lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(common, trim(x, ' '))) AS kept
  FROM d
)
SELECT doc_id,
       CASE WHEN len(kept) < len(lines) THEN array_to_string(kept, chr(10)) ELSE text END AS text,
       coalesce(len(lines), 0)::INTEGER AS n_lines,
       coalesce(len(lines) - len(kept), 0)::INTEGER AS n_dropped
FROM k
"""
