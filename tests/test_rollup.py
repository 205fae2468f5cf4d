from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators.generate import late_rows
from tidegauge.plans import late
from tidegauge.plans import rollup as r
from tidegauge.sinks.snapshots import SnapshotConflict, SnapshotTable


def view(path, granularity="1 hour", **more):
    return r.Rollup(str(path), "ts", ("event_type",), ("value",), granularity, **more)


def shown(spark, v):
    rows = r.query_rollup(spark, v)
    return sorted((*x[:2], round(x[2], 9), *x[3:]) for x in rows.collect())


@pytest.mark.parametrize(
    ("granularity", "origin"),
    [
        ("15 minutes", datetime(1970, 1, 1)), ("1 hour", datetime(1970, 1, 5, 2, 30)), ("7 hours", datetime(1970, 1, 1)),
        ("12 hours", datetime(1970, 1, 5, 2, 30)), ("1 day", datetime(1970, 1, 5, 2, 30)), ("2 days", datetime(1970, 1, 1)),
        ("7 days", datetime(1970, 1, 5, 2, 30)),
    ],
)
def test_refresh_equals_rebuild(spark, events, tmp_path, granularity, origin):
    """An unaligned window, at every width, with buckets off midnight."""
    start, end = datetime(2024, 1, 9, 22, 41), datetime(2024, 1, 11, 1, 7)
    missing = F.col("ts").between(start, end - timedelta(microseconds=1)) & (F.col("event_type") != "view")
    part, whole = view(tmp_path / "part", granularity, origin=origin), view(tmp_path / "whole", granularity, origin=origin)
    r.create_rollup(events.where(~missing), part)
    r.create_rollup(events, whole)
    before = shown(spark, part)
    r.refresh_rollup(events, part, start, end)
    assert shown(spark, part) == shown(spark, whole) != before
    assert r.rollup_vs_raw(events, part, "value", start, end).count() == 0


def test_refresh_reads_and_replaces_only_what_it_must(spark, events, tmp_path):
    v = view(tmp_path / "v")
    r.create_rollup(events, v)
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "v").glob("data/*/bucket_date=*/*.parquet")}
    span = r.refresh_rollup(events, v, datetime(2024, 1, 10, 5, 5), datetime(2024, 1, 10, 6, 5))
    assert span == (datetime(2024, 1, 10), datetime(2024, 1, 11))
    kept = {p for p in stamps if "2024-01-10" not in str(p)}
    assert kept and all(p.exists() and p.stat().st_mtime_ns == stamps[p] for p in kept)


def test_partitions_grow_with_the_bucket():
    assert [view("", g).unit for g in ("1 minute", "12 hours", "1 day", "2 days", "7 days")] == [
        "DAY", "DAY", "MONTH", "MONTH", "YEAR",
    ]
    assert r.partition_after(datetime(2024, 2, 29), "MONTH") == datetime(2024, 3, 1)
    assert r.partition_after(datetime(2023, 12, 31), "YEAR") == datetime(2024, 1, 1)
    assert r.partition_after(datetime(2024, 1, 1), "YEAR") == datetime(2025, 1, 1)


def test_query_prunes_partitions(spark, events, tmp_path):
    v = view(tmp_path / "v")
    r.create_rollup(events, v)
    plan = r.query_rollup(spark, v, datetime(2024, 1, 5), datetime(2024, 1, 6))._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket_date" in filters and "PushedFilters: [IsNotNull(ts_bucket)" in plan


def test_null_tags_and_null_values(spark, tmp_path):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, None, 1.0), (t, None, None), (t, "a", None)], "ts timestamp_ntz, event_type string, value double")
    v = view(tmp_path / "v")
    r.create_rollup(df, v)
    assert {x[1]: x[2] for x in r.query_rollup(spark, v).collect()} == {None: 1.0, "a": None}
    assert r.rollup_vs_raw(df, v, "value", t, t + timedelta(hours=1)).count() == 0


def test_zoned_times(spark, events, tmp_path):
    """A series with zoned times gives the same roll-up."""
    zoned = events.withColumn("ts", F.col("ts").cast("timestamp"))
    v = view(tmp_path / "v")
    r.create_rollup(zoned, v)
    start, end = datetime(2024, 1, 5, 0, 30), datetime(2024, 1, 7)
    r.refresh_rollup(zoned, v, start, end)
    assert r.rollup_vs_raw(zoned, v, "value", start, end).count() == 0
    assert r.query_rollup(spark, v, start, end).count() > 0


def test_late_cycle_equals_rebuild(spark, events, tmp_path):
    raw = str(tmp_path / "raw")
    events.write.parquet(raw)
    v, whole = view(tmp_path / "v"), view(tmp_path / "whole")
    r.create_rollup(spark.read.parquet(raw), v)
    windows = late.late_arrival_cycle(spark, raw, v, "event_id", rows_per_round=40, rounds=3)
    grown = spark.read.parquet(raw)
    assert grown.count() == events.count() + 120 and len(windows) == 3
    r.create_rollup(grown, whole)
    assert shown(spark, v) == shown(spark, whole)
    assert late.query_late(spark, v, windows, "value").select("round").distinct().count() == 3


def test_stale_rollup_is_noticed(spark, events, tmp_path):
    raw, v = str(tmp_path / "raw"), view(tmp_path / "v")
    events.write.parquet(raw)
    r.create_rollup(events, v)
    start = datetime(2024, 1, 12)
    end = start + timedelta(hours=1)
    late_rows(events, "ts", "event_id", start, end, 30).write.mode("append").parquet(raw)
    assert r.rollup_vs_raw(spark.read.parquet(raw), v, "value", start, end).count() > 0


def test_speedup_of_an_instant_rollup(spark):
    log = spark.createDataFrame(
        [("a", "raw", 9_000_000), ("a", "mv", 3_000_000), ("b", "raw", 1), ("b", "mv", 0), ("c", "raw", 5)],
        "database_name string, operation string, elapsed_ns bigint",
    )
    got = {x["database_name"]: x["speedup"] for x in r.speedup(log, "raw", "mv").collect()}
    assert got == {"a": 3.0, "b": 0.0}


def test_refresh_from_a_partitioned_table(spark, events, tmp_path):
    from tidegauge.sinks.tables import with_partition

    with_partition(events, "ts", "DAY").write.partitionBy("p").parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    v, whole = view(tmp_path / "v"), view(tmp_path / "whole")
    start, end = datetime(2024, 1, 9, 22, 41), datetime(2024, 1, 11, 1, 7)
    r.create_rollup(events, whole)
    r.create_rollup(events.where(~F.col("ts").between(start, end)), v)
    r.refresh_rollup(raw, v, start, end, partition=("p", "DAY"))
    assert shown(spark, v) == shown(spark, whole)


def test_a_reader_keeps_its_snapshot(spark, events, tmp_path):
    """A frame made before a switch sees the old state, one made after it the new one, whole."""
    v = view(tmp_path / "v")
    r.create_rollup(events.where("event_type <> 'view'"), v)
    before = r.query_rollup(spark, v)
    n = before.count()
    r.create_rollup(events, v)
    assert before.count() == n < r.query_rollup(spark, v).count()
    assert v.table.numbers(spark) == [1, 2]
    assert r.read_rollup(spark, v, number=1).count() == n
    assert v.table.expire(spark) == 1 and v.table.numbers(spark) == [2]
    assert r.query_rollup(spark, v).count() > n
    with pytest.raises(ValueError):
        r.read_rollup(spark, v, number=1)


def test_emptied_partitions_go_with_the_switch(spark, events, tmp_path):
    v = view(tmp_path / "v")
    start, end = datetime(2024, 1, 9, 12), datetime(2024, 1, 10, 7)
    gone = F.to_date("ts").between("2024-01-09", "2024-01-10")
    r.create_rollup(events, v)
    r.refresh_rollup(events.where(~gone), v, start, end)
    assert {"2024-01-09", "2024-01-10"}.isdisjoint(v.table.snapshot(spark).parts)
    whole = view(tmp_path / "whole")
    r.create_rollup(events.where(~gone), whole)
    assert shown(spark, v) == shown(spark, whole)
    r.refresh_rollup(events.limit(0), v, datetime(2023, 1, 1), datetime(2025, 1, 1))
    assert r.query_rollup(spark, v).count() == 0
    assert r.query_rollup(spark, v).columns == r.query_rollup(spark, whole).columns


def test_two_writers(spark, events, tmp_path):
    """Writers of different partitions both get through, of the same one the first."""
    v = view(tmp_path / "v")
    r.create_rollup(events, v)
    rows = v.rows(events)
    first, second, third = (v.table.stage(rows.where(F.col(r.DATE) == d)) for d in ("2024-01-05", "2024-01-06", "2024-01-05"))
    first.commit(spark, lambda n: n == "2024-01-05")
    second.commit(spark, lambda n: n == "2024-01-06")
    with pytest.raises(SnapshotConflict):
        third.commit(spark, lambda n: n == "2024-01-05")
    whole = view(tmp_path / "whole")
    r.create_rollup(events, whole)
    assert shown(spark, v) == shown(spark, whole)
    assert v.table.snapshot(spark).number == 3
    parts = v.table.snapshot(spark).parts
    assert (parts["2024-01-05"], parts["2024-01-06"]) == (first.version, second.version)
    with pytest.raises(ValueError):
        SnapshotTable(str(tmp_path / "n"), r.DATE).read(spark)


def test_comparison_takes_one_exchange(spark, events, tmp_path):
    v = view(tmp_path / "v")
    r.create_rollup(events.where("event_type <> 'view'"), v)
    found = r.rollup_vs_raw(events, v, "value", datetime(2024, 1, 5), datetime(2024, 1, 7))
    assert {x["side"] for x in found.collect()} == {"raw"}
    text = found._jdf.queryExecution().sparkPlan().toString()
    assert text.count("HashAggregate") == 2 and "Join" not in text
