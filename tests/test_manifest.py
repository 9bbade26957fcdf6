"""Files that come late, change, or hold lines that are no events."""

import datetime as dt
import gzip

import pytest
from conftest import details, rows
from pyspark.sql import functions as F

from test_bronze_to_silver import DAY, event, put

from tidemark.fixtures import deliver
from tidemark.plans import daily
from tidemark.schemas import GOLD_TABLES
from tidemark.sources import built_hours, raw_files, read_records, read_silver, read_table

NEXT = dt.date(2024, 3, 11)


def total(spark, root, day):
    found = read_table(spark, root, "overview_table", day).first()
    return found.total_events if found else None


def three(hour, n=3, day=DAY):
    return [event(f"{day.day}.{hour}.{i}", at=f"{day}T{hour:02}:00:00Z") for i in range(n)]


def test_a_late_hour_is_taken_up_after_the_whole_day_was_run(spark, tmp_path):
    root = str(tmp_path)
    for hour in (0, 1):
        put(tmp_path, hour, three(hour))
    assert daily.run_day(spark, root, DAY)["rows"] == 6
    assert built_hours(spark, root, DAY) == {0, 1}
    put(tmp_path, 5, three(5))
    assert daily.run_day(spark, root, DAY)["rows"] == 9
    assert total(spark, root, DAY) == 9
    assert daily.run_day(spark, root, DAY) == {"date": DAY, "built": False}


def test_a_late_hour_is_taken_up_after_all_days_were_run(spark, tmp_path):
    root = str(tmp_path)
    for day in (DAY, NEXT):
        put(tmp_path, 0, three(0, day=day), day)
    assert daily.run_all(spark, root)["rows"] == 6
    assert daily.run_all(spark, root, force=False) == {}
    put(tmp_path, 7, three(7))
    got = daily.run_days(spark, root, [DAY, NEXT])
    assert got == [{"date": DAY, "built": True, **got[0]}, {"date": NEXT, "built": False}] and got[0]["rows"] == 6
    assert [total(spark, root, d) for d in (DAY, NEXT)] == [6, 3]
    put(tmp_path, 8, three(8, day=NEXT), NEXT)
    assert daily.run_all(spark, root, force=False)["rows"] == 6
    assert [total(spark, root, d) for d in (DAY, NEXT)] == [6, 6]


def test_a_replaced_file_is_built_again(spark, tmp_path):
    """With it goes what the old one gave, also to another day."""
    root = str(tmp_path)
    put(tmp_path, 23, [*three(23), event("late", at="2024-03-11T00:00:00Z"), "junk"])
    daily.run_day(spark, root, DAY)
    assert [total(spark, root, d) for d in (DAY, NEXT)] == [3, 1]
    assert daily.read_rejected(spark, root, [DAY]).count() == 1
    before = raw_files(spark, root, [DAY])[DAY]
    put(tmp_path, 23, three(23, 5))
    assert raw_files(spark, root, [DAY])[DAY] != before
    assert daily.run_day(spark, root, DAY)["rows"] == 5
    assert total(spark, root, DAY) == 5
    assert read_silver(spark, root, NEXT).isEmpty() and daily.read_rejected(spark, root).isEmpty()
    for name in GOLD_TABLES:
        assert read_table(spark, root, name, NEXT).isEmpty(), name
    assert read_records(spark, root)[DAY].days == {DAY}


def test_a_run_that_broke_off_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    """The event table was written, then the file was replaced."""
    root = str(tmp_path)
    put(tmp_path, 0, [event("1")])
    daily.run_day(spark, root, DAY)
    put(tmp_path, 23, [event("2"), event("late", at="2024-03-11T00:00:00Z")])
    with monkeypatch.context() as broken:
        broken.setattr(daily, "build_gold", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            daily.run_day(spark, root, DAY)
    record = read_records(spark, root)[DAY]
    assert record.pending and not record.files and built_hours(spark, root, DAY) == set()
    put(tmp_path, 23, [event("2"), event("3")])
    assert daily.run_day(spark, root, DAY)["rows"] == 3
    assert total(spark, root, DAY) == 3 and read_silver(spark, root, NEXT).isEmpty()
    assert not read_records(spark, root)[DAY].pending


def test_a_late_event_reads_no_event_of_other_files(spark, tmp_path):
    """Of the day's own events the ids are read, and their counts stay as stored."""
    root = str(tmp_path)
    put(tmp_path, 0, three(0, 4, NEXT), NEXT)
    daily.run_day(spark, root, NEXT)
    own = f"{tmp_path}/counts/parts/year=2024/month=3/day=11/delivered=own"
    stamp = {p: p.stat().st_mtime_ns for p in tmp_path.glob("counts/parts/year=2024/month=3/day=11/delivered=own/*.parquet")}
    assert stamp, own
    put(tmp_path, 23, [*three(23), event("late", at="2024-03-11T00:00:00Z"), event("11.0.1", at="2024-03-11T00:00:00Z")])
    daily.run_day(spark, root, DAY)
    assert [total(spark, root, d) for d in (DAY, NEXT)] == [3, 5]
    assert {p: p.stat().st_mtime_ns for p in stamp} == stamp
    events, late = daily.changed_events(spark, root, [DAY, NEXT], [DAY])
    assert all("year=2024/month=3/day=10/ingest_date=2024-03-10" in path for path in events.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert rows(late, "event_id") == [("late",)]
    schemas = [line for line in details(late).splitlines() if "ReadSchema" in line]
    assert len(schemas) == 2 and any("struct<event_id:string>" in line for line in schemas)


def test_counts_of_parts_add_up(spark, tmp_path):
    """One at a time or all at once, the same counts are stored and the same summaries."""
    root, other = str(tmp_path), f"{tmp_path}/other"
    for hour in (0, 9, 20):
        put(tmp_path, hour, [*three(hour), event(f"l{hour}", at="2024-03-11T02:00:00Z", org={"id": 1, "login": "o"})])
        daily.run_day(spark, root, DAY)
        put(tmp_path, hour, [*three(hour, day=NEXT), event("l9", at="2024-03-11T02:00:00Z")], NEXT)
        daily.run_day(spark, root, NEXT)
    daily.run_all(spark, root, lake=other)
    columns = ["event_date", "kind", "key", "hour", "n"]
    kept = lambda r: rows(daily.read_counts(spark, r).where("n > 0"), "delivered", *columns)
    assert kept(root) == kept(other) and {r[0] for r in kept(root)} == {"own", "late"}
    for name in GOLD_TABLES:
        assert rows(read_table(spark, root, name)) == rows(read_table(spark, other, name)), name


def test_rejected_lines(spark, tmp_path):
    root = str(tmp_path)
    lines = ["junk", "{}", "", event("1"), event("2", at="no time"), event("3", type=None), event(None), event("4", payload=None), '{"id": "5", "type": "Pu']
    put(tmp_path, 0, lines)
    put(tmp_path, 1, three(1))
    put(tmp_path, 2, [event("1", at=None)])
    report = daily.run_day(spark, root, DAY)
    got = rows(daily.read_rejected(spark, root, [DAY]), "file", "reason", F.substring("line", 1, 12))
    assert [r[:2] for r in got if r[0].endswith("-2.json.gz")] == [("2024-03-10-2.json.gz", "undated")]
    reasons = sorted(r[1] for r in got if r[0].endswith("-0.json.gz"))
    assert reasons == ["incomplete"] * 3 + ["malformed"] * 3 + ["undated"]
    assert report["malformed"] == 3 and ("2024-03-10-0.json.gz", "malformed", "junk") in got
    assert daily.read_rejected(spark, root).select("ingest_date").distinct().collect() == [(DAY,)]


def test_check_range_holds_for_several_days(spark, tmp_path):
    put(tmp_path, 0, three(0))
    with pytest.raises(ValueError, match="must lie between"):
        daily.run_days(spark, str(tmp_path), ["2001-01-01"], check_range=True)
    put(tmp_path, 0, three(0, day=dt.date(2001, 1, 1)), dt.date(2001, 1, 1))
    with pytest.raises(ValueError, match="must lie between"):
        daily.run_all(spark, str(tmp_path), check_range=True)


def test_ids_of_own_events_are_read_only_for_late_ones(spark, tmp_path, monkeypatch):
    """The folders say whether any event came with another day's files."""
    root, kept = str(tmp_path), []
    frame = type(spark.range(0))
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *level: kept.append(self) or persist(self, *level))
    put(tmp_path, 0, three(0))
    daily.run_all(spark, root)
    assert total(spark, root, DAY) == 3 and not kept
    put(tmp_path, 0, [*three(0, day=NEXT), event("late", at="2024-03-10T05:00:00Z"), three(0)[0]], NEXT)
    daily.run_all(spark, root, force=False)
    assert [total(spark, root, d) for d in (DAY, NEXT)] == [4, 3] and kept
    put(tmp_path, 0, three(0, day=NEXT), NEXT)
    daily.run_all(spark, root, force=False)
    assert [total(spark, root, d) for d in (DAY, NEXT)] == [3, 3]


def test_lines_that_cannot_be_set_aside_end_the_run(spark, tmp_path, monkeypatch):
    """The record stays pending, so that the next run does it again."""
    root = str(tmp_path)
    put(tmp_path, 0, [*three(0), "junk"])
    with monkeypatch.context() as broken:
        broken.setattr(daily, "rejected_lines", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            daily.run_all(spark, root)
    assert read_records(spark, root)[DAY].pending
    daily.run_all(spark, root, force=False)
    assert total(spark, root, DAY) == 3 and daily.read_rejected(spark, root, [DAY]).count() == 1


def test_delivered_files_hold_every_line_and_are_packed_lightly(spark, tmp_path):
    lines = spark.range(3000).select(
        F.when(F.col("id") % 7 != 0, F.lit(str(DAY))).alias("day"),
        F.when(F.col("id") % 5 != 0, (F.col("id") % 3).cast("int")).alias("hour"),
        F.concat(F.lit("é line "), "id").alias("line"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # an hour in several batches
    try:
        deliver(lines, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, got = {}, {}
    for day, hour, line in lines.collect():
        want.setdefault(f"{day}/{day}-{hour}.json.gz", []).append(line)
    for path in (tmp_path / "bronze").glob("*/*"):
        packed = path.read_bytes()
        text = gzip.decompress(packed).decode()
        assert text.endswith("\n") and packed[8] == 4  # the header's mark of the fastest packing
        got[f"{path.parent.name}/{path.name}"] = sorted(text.splitlines())
    assert got == {name: sorted(some) for name, some in want.items()} and len(got) == 8
