"""Hourly trends of a day's top names, tidy and wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import hour_start
from tidemark.operators.cleaning import scoped
from tidemark.operators.ranking import SLICES
from tidemark.params import DateLike

# Parts into which the events of one name are dealt where events meet names.
SALTS = 32


def keep_top(df: DataFrame, top: DataFrame, on: Sequence[str], spread: str = "event_id") -> DataFrame:
    """Rows whose key is among the top ones.

    The top keys are the busiest there are, so the rows of a key are dealt into
    parts by a hash of ``spread`` and the few keys are repeated for each part.
    How they meet is left to adaptive execution, which goes by measured sizes.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    names = top.select(*on).distinct().withColumn("_part", parts)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(names, [*on, "_part"], "left_semi").select(*df.columns)


def hourly_counts(df: DataFrame, key: str) -> DataFrame:
    """Events per name and hour of each day; events without a name are left out."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy("event_date", key, hour_start().alias("hour"))
        .agg(F.count(F.lit(1)).alias("no_of_events"))
    )


def trend_of(df: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Events per hour of given names, one row per hour and name.

    ``top`` holds (event_date, name); a pair may come several times. The events
    are counted first, so the join moves counts, of which a name has 24 per day
    at most, rather than events. (A semi-join would be moved below the counting,
    to the events.)
    """
    return trend_from(hourly_counts(scoped(df, None), key).withColumnRenamed("no_of_events", "n"), top, key)


def trend_from(hourly: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """The same from counts ``n`` per hour and name, of which each pair has one row."""
    on = ["event_date", key]
    kept = hourly.join(top.select(*on).distinct(), on)
    return kept.select("event_date", "hour", key, F.col("n").alias("no_of_events"))


def trend_long(df: DataFrame, key: str, k: int, date: DateLike | None = None) -> DataFrame:
    """Events per hour of each day's k most active names, one row per hour and name.

    One pass: events are counted per name and hour, the hours of a name (24 at
    most) add up to its total, and the rank by total keeps the k best, first of
    each slice of a day's names and then of the day. Equal totals are told apart
    by name, so the rank numbers names. (One row per name with 24 counts saves an
    exchange but not time, as most names are busy in few hours: 11.5 s against 9.5
    on 20 million events, see ``scripts/trend_bench.py``.)

    A missing name takes a place in the ranking of repositories, as it does
    in ``top_repos``, but has no trend.
    """
    events = scoped(df, date)
    if key == "org_name":
        events = events.where(F.col(key).isNotNull())
    hourly = events.groupBy("event_date", key, hour_start().alias("hour")).agg(
        F.count(F.lit(1)).alias("no_of_events")
    )
    of_name = Window.partitionBy("event_date", key)
    ranked = hourly.withColumn("_total", F.sum("no_of_events").over(of_name))
    order = [F.col("_total").desc(), F.col(key).asc_nulls_last()]
    for parts in (["event_date", F.pmod(F.xxhash64(key), F.lit(SLICES))], ["event_date"]):
        rank = F.dense_rank().over(Window.partitionBy(*parts).orderBy(*order))
        ranked = ranked.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return ranked.where(F.col(key).isNotNull()).select("event_date", "hour", key, "no_of_events")


def labels_of_day(tidy: DataFrame, label: str) -> list[str]:
    """The labels of one day's tidy result, sorted: the columns of its wide view.

    One day has as many as its summary keeps, a handful. For many days name the
    columns that are wanted: their labels grow with the days.
    """
    found = tidy.where(F.col(label).isNotNull()).select(label).distinct()
    return sorted(row[0] for row in found.collect())


def widen(tidy: DataFrame, label: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per hour and one column per name; a pair without events is null."""
    return tidy.groupBy("event_date", "hour").pivot(label, list(names)).agg(F.sum(value))


def trend_wide(long: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """A tidy trend with one column per name."""
    return widen(long, key, "no_of_events", names)


def fill_zero(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace the nulls of a wide trend by 0, in time order.

    Columns are taken by position: names may hold dots, differ in case only,
    or even read "hour".
    """
    places = [f"_{i}" for i in range(len(names))]
    in_order = wide.toDF("_day", "_hour", *places).orderBy("_hour")
    filled = [F.coalesce(F.col(p), F.lit(0)).alias(name) for p, name in zip(places, names, strict=True)]
    return in_order.select(F.col("_day").alias("event_date"), F.col("_hour").alias("hour"), *filled)
