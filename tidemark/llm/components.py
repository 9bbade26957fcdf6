"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """The smallest node that each linked node reaches, as ``node, component``.

    ``links`` has long columns ``a`` and ``b``. Alternates two rewritings until
    nothing changes: each node hands its larger neighbours to its smallest one, then
    its smaller neighbours likewise, so that a component ends as a star around its
    smallest node after a logarithmic number of rounds. The smallest neighbour of a
    node is an aggregate and comes back by a join, so a node with very many links
    is never gathered. Null ends and links of a node to itself are left out; no
    links give no rows.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "links")
        state = edges.agg(
            F.count("u").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(edges.select("v", "v").distinct())
