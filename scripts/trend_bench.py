"""Time two forms of the trend of a day's top names on many events, a third of them of one name.

Usage: python scripts/trend_bench.py [events] [runs]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import absolute_hour
from tidemark.operators import first_per_day, trend_long
from tidemark.session import local_session

DAYS, NAMES, K = 30, 500_000, 3


def made_events(spark: SparkSession, many: int) -> DataFrame:
    """Events over thirty days; every third is of one repository, the others are spread evenly."""
    n = F.col("id")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return spark.range(many).select(
        F.timestamp_add("SECOND", (F.pmod(F.xxhash64(n), F.lit(DAYS * 86400))).cast("int"), start).alias("created_at"),
        F.when(n % 3 == 0, "busy").otherwise(F.concat(F.lit("repo"), F.pmod(F.xxhash64(n, F.lit(1)), F.lit(NAMES)))).alias("repo_name"),
    )


def hours_in_a_row(events: DataFrame) -> DataFrame:
    """The other form: a row per name and day with a count for each hour, unfolded for the best names."""
    events = events.withColumn("event_date", F.to_date("created_at"))
    hour = F.hour("created_at")
    counts = events.groupBy("event_date", "repo_name").agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(hour == h).alias(f"_{h}") for h in range(24)]
    )
    best = first_per_day(counts, K, "_total", "repo_name")
    hours = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_{h}").alias("n")) for h in range(24)])
    each = best.select("event_date", "repo_name", F.explode(F.filter(hours, lambda x: x["n"] > 0)).alias("x"))
    return each.select("event_date", absolute_hour("event_date", F.col("x.h")).alias("hour"), "repo_name", F.col("x.n").alias("no_of_events"))


def main() -> None:
    given = [int(x) for x in sys.argv[1:3]]
    many, runs = given + [20_000_000, 3][len(given) :]
    spark = local_session("trend-bench", 8, partitions=32)
    spark.sparkContext.setLogLevel("ERROR")
    events = made_events(spark, many)
    forms = {"counts per hour first (in use)": lambda: trend_long(events, "repo_name", K), "hours in a row": lambda: hours_in_a_row(events)}
    answers = {name: sorted(map(tuple, form().collect())) for name, form in forms.items()}
    assert len(set(map(str, answers.values()))) == 1, "the forms disagree"
    for name, form in forms.items():
        seconds = []
        for _ in range(runs):
            start = time.perf_counter()
            form().write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        print(f"{name}: best {min(seconds):.1f} s of {runs}, {many} events")


if __name__ == "__main__":
    main()
