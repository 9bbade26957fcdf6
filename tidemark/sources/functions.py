"""The vocabulary of the package as SQL functions, for ad-hoc questions; all of it is inlined into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.functions.activity import BOT_MARK, BOT_NAME, BOT_SUFFIX, HIGH_RATE, MEDIUM_RATE
from tidemark.operators.ranking import SLICES
from tidemark.schemas import SILVER_TABLE

#: Name and arguments, type, body.
SCALAR = (
    (
        "is_human(login STRING)",
        "BOOLEAN",
        f"NOT contains(login, '{BOT_MARK}') AND NOT endswith(login, '{BOT_SUFFIX}') AND login <> '{BOT_NAME}'",
    ),
    ("owner_of(repository STRING)", "STRING", "get(split(repository, '/'), 0)"),
    ("name_of(repository STRING)", "STRING", "get(split(repository, '/'), 1)"),
    ("pct(part BIGINT, whole BIGINT)", "DOUBLE", "round(CASE WHEN whole <> 0 THEN part / whole * 100 ELSE 0.0D END, 2)"),
    (
        "band_of(rate DOUBLE)",
        "STRING",
        f"CASE WHEN rate >= {HIGH_RATE}D THEN 'high' WHEN rate >= {MEDIUM_RATE}D THEN 'medium' WHEN rate IS NOT NULL THEN 'low' END",
    ),
    ("hour_start_of(at TIMESTAMP_NTZ)", "TIMESTAMP_NTZ", "CAST(to_date(at) AS TIMESTAMP_NTZ) + make_dt_interval(0, hour(at), 0, 0)"),
)

#: Columns of the event table that can be asked for by name.
LABELS = ("type", "username", "repo", "repo_name", "org_name")

TABLES = (
    (
        "events_of_day(asked DATE)",
        "event_id STRING, type STRING, created_at TIMESTAMP_NTZ, username STRING, repo STRING, repo_name STRING, org_name STRING, action STRING",
        f"""SELECT event_id, type, created_at, username, repo, repo_name, org_name, action FROM {SILVER_TABLE}
            WHERE year = year(asked) AND month = month(asked) AND day = day(asked)""",
    ),
    (
        # The best k of each slice of the names first, then of the day, as the ranking operators do.
        "top_of_day(label STRING, asked DATE, k INT)",
        "name STRING, no_of_events BIGINT",
        f"""SELECT name, n FROM (
              SELECT name, n, row_number() OVER (ORDER BY n DESC, name) AS place FROM (
                SELECT name, n, row_number() OVER (PARTITION BY pmod(xxhash64(name), {SLICES}) ORDER BY n DESC, name) AS in_slice FROM (
                  SELECT name, count(*) AS n FROM (
                    SELECT CASE label {" ".join(f"WHEN '{c}' THEN {c}" for c in LABELS)} ELSE raise_error('no such label') END AS name
                    FROM {SILVER_TABLE} WHERE year = year(asked) AND month = month(asked) AND day = day(asked))
                  WHERE name IS NOT NULL GROUP BY name))
              WHERE in_slice <= k)
            WHERE place <= k""",
    ),
)


def register_functions(spark: SparkSession, tables: bool = True) -> list[str]:
    """Temporary SQL functions: scalar ones, and table-valued ones over the view of the event table.

    ``is_human(login)``, ``owner_of(repository)``, ``name_of(repository)``, ``pct(part, whole)``,
    ``band_of(rate)``, ``hour_start_of(at)``, ``events_of_day(day)`` and
    ``top_of_day('repo_name', day, k)`` of events with a value, ties by name. The
    table-valued ones need the view, see ``register_views``, and read the one day's folder.
    """
    made = [(head, f"RETURNS {kind}", body) for head, kind, body in SCALAR]
    made += [(head, f"RETURNS TABLE({columns})", body) for head, columns, body in (TABLES if tables else ())]
    for head, returns, body in made:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} {returns} RETURN {body}")
    return [head.partition("(")[0] for head, _, _ in made]
