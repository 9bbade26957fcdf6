"""Rankings per day and per hour.

Ties at a cut are broken by name, so every run gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.activity import PUSH, STAR, is_human, is_type, repo_part
from tidemark.functions.time import hour_start
from tidemark.operators.cleaning import scoped
from tidemark.params import DateLike

# Parts into which the names of a day are dealt before the best of all parts meet.
SLICES = 32


def first_per_day(counts: DataFrame, k: int, n_col: str, name: str, place: str | None = None) -> DataFrame:
    """The k rows of each day with the highest count; ``place`` names a column for their number.

    The names of a day are dealt into slices by their hash. Each slice keeps its
    best k, so the task that brings a day together sees k rows per slice
    whatever the number of names. For a small k Spark keeps the best k of a
    slice already within each task before the shuffle.
    """
    if k < 1:
        raise ValueError(f"k must be positive: {k}")
    order = [F.col(n_col).desc(), F.col(name).asc_nulls_last()]
    by_slice = Window.partitionBy("event_date", F.pmod(F.xxhash64(name), F.lit(SLICES))).orderBy(*order)
    by_day = Window.partitionBy("event_date").orderBy(*order)
    for window in (by_slice, by_day):
        counts = counts.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= k)
    return counts.drop("_place") if place is None else counts.withColumnRenamed("_place", place)


def top_k(
    df: DataFrame,
    key: str,
    k: int,
    n_col: str = "no_of_events",
    where: Column | None = None,
    date: DateLike | None = None,
    weight: str | None = None,
) -> DataFrame:
    """The k values of a column with most events per day.

    ``df`` holds events, or counts of events with the count in ``weight``.
    """
    rows = scoped(df, date)
    if where is not None:
        rows = rows.where(where)
    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return first_per_day(rows.groupBy("event_date", key).agg(number.alias(n_col)), k, n_col, key)


def rank_by_count(df: DataFrame, n_col: str, out: str = "rank_on_that_day") -> DataFrame:
    """Dense rank by count within the day; equal counts share a rank.

    Meant for a result that is already cut to its top rows.
    """
    by_day = Window.partitionBy("event_date").orderBy(F.col(n_col).desc())
    return df.withColumn(out, F.dense_rank().over(by_day))


def top_real_users(
    df: DataFrame, k: int = 10, date: DateLike | None = None, weight: str | None = None
) -> DataFrame:
    """The most active accounts that are not automated, with their rank."""
    n_col = "no_of_Events_per_user"
    return rank_by_count(top_k(df, "username", k, n_col, is_human(), date, weight), n_col)


def top_repos(
    df: DataFrame, k: int = 3, date: DateLike | None = None, key: str = "repo_name", weight: str | None = None
) -> DataFrame:
    """The most active repositories.

    By default repositories of one name count together whoever owns them;
    ``key="repo"`` keeps owners apart.
    """
    return top_k(df, key, k, date=date, weight=weight)


def top_orgs(df: DataFrame, k: int = 5, date: DateLike | None = None, weight: str | None = None) -> DataFrame:
    """The most active organisations."""
    return top_k(df, "org_name", k, where=F.col("org_name").isNotNull(), date=date, weight=weight)


def most_starred(df: DataFrame, k: int = 5, date: DateLike | None = None, weight: str | None = None) -> DataFrame:
    """The repositories starred most often, owner and name apart."""
    starred = is_type(STAR) if weight is None else F.col(weight) > 0
    top = top_k(df, "repo", k, "no_of_watchers", starred, date, weight)
    return top.select(
        "event_date",
        "repo",
        repo_part("repo", 0).alias("repo_owner"),
        repo_part("repo", 1).alias("repo_name"),
        "no_of_watchers",
    )


def most_pushed(
    df: DataFrame, k: int = 3, date: DateLike | None = None, key: str = "repo_name", weight: str | None = None
) -> DataFrame:
    """The repositories pushed to most often."""
    pushed = is_type(PUSH) if weight is None else F.col(weight) > 0
    return top_k(df, key, k, "no_of_pushes", pushed, date, weight)


def leaders_per_hour(df: DataFrame, key: str = "repo_name", date: DateLike | None = None) -> DataFrame:
    """The most active repositories of each hour; all of them where several tie.

    Ties may be many, so no hour is brought into one task: each hour's highest
    count is found on its own and sent to every task, where the counts that
    reach it are kept. That is a row per hour of the calendar, 24 per day: ten
    years are 88,000 small rows, however many events they have.
    """
    counts = (
        scoped(df, date)
        .groupBy(hour_start().alias("hour"), key)
        .agg(F.count(F.lit(1)).alias("no_of_events"))
    )
    highest = counts.groupBy("hour").agg(F.max("no_of_events").alias("no_of_events"))
    return counts.join(F.broadcast(highest), ["hour", "no_of_events"]).select("hour", key, "no_of_events")
