"""Raw events with their payload as a variant: every member is there, listed in a schema or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import event_day, utc_wall_clock
from tidemark.operators.cleaning import dedupe


def variant_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Raw lines as ``event_id, type, created_at, payload`` with the payload as a variant.

    Lines that are not JSON objects have no event and are left out; members of another
    type than expected are null.
    """
    event = F.try_parse_json(line).alias("event")
    member = lambda name, kind: F.try_variant_get("event", f"$.{name}", kind).alias(name)
    found = lines.select(event).select(member("id", "string"), member("type", "string"), member("created_at", "timestamp"), member("payload", "variant"))
    found = found.where("coalesce(id, type) IS NOT NULL OR created_at IS NOT NULL OR payload IS NOT NULL")
    return found.select(F.col("id").alias("event_id"), "type", utc_wall_clock("created_at").alias("created_at"), "payload")


def payload_members(events: DataFrame) -> DataFrame:
    """The members of payloads that occur, as one schema per event type, in one pass over the events.

    Types are merged as they are met in parts of the data, so a hot event type is a row
    per task before the shuffle.
    """
    found = events.groupBy("type").agg(F.schema_of_variant_agg("payload").alias("members"), F.count(F.lit(1)).alias("n"))
    return found.select("type", "members", "n")


#: Members by their names in the event table, as paths and types within a payload.
PATHS = {"action": ("$.action", "string"), "issue_id": ("$.issue.id", "bigint"), "pr_id": ("$.pull_request.id", "bigint")}


def variant_members(events: DataFrame, paths: dict[str, tuple[str, str]] = PATHS) -> DataFrame:
    """One row per event id with members taken out of the payload by path; null where one is absent or of another type."""
    members = [F.try_variant_get("payload", path, kind).alias(name) for name, (path, kind) in paths.items()]
    flat = events.where("event_id IS NOT NULL").select("event_id", "type", "created_at", *members)
    return dedupe(flat, ["event_id"], order=["created_at"]).withColumn("event_date", event_day())
