"""Inputs that the test tables lack: null times, dates, offsets, large numbers, emptied days."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.buckets import bucket
from tidegauge.functions.timeparse import parse_text
from tidegauge.operators import generate, queries
from tidegauge.operators.prepare import time_filter
from tidegauge.plans import rollup as R
from tidegauge.schema import infer_schema
from tidegauge.session import new_path
from tidegauge.sinks import tables
from tidegauge.sources.files import scan_files


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(datetime(2024, 1, 1, 0, 30), 1), (None, 2), (datetime(2024, 1, 1, 1, 30), 3)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, value bigint")


@pytest.fixture(scope="module")
def days(spark):
    rows = [(date(2024, 1, 1) + timedelta(days=i), i) for i in range(30)]
    return spark.createDataFrame(rows, "day date, value bigint")


def test_bucket_keeps_null_times(holes):
    got = holes.select("value", bucket("ts", "1 hour").alias("b"), bucket("ts", "1 day").alias("d")).collect()
    assert {(r["value"], r["b"]) for r in got} == {
        (1, datetime(2024, 1, 1)), (2, None), (3, datetime(2024, 1, 1, 1))
    }
    zoned = holes.select(bucket(F.col("ts").cast("timestamp"), "1 hour").alias("b"))
    assert dict(zoned.dtypes)["b"] == "timestamp"


def test_limits_keep_null_times(holes):
    assert [r["value"] for r in queries.time_range(holes, "ts", key=["value"], limit=10).orderBy("value").collect()] == [1, 2, 3]
    assert [r["value"] for r in queries.slice_by_time(holes, "ts", ["value"], 0, 1).collect()] == [2]
    assert [r["value"] for r in queries.slice_by_time(holes, "ts", ["value"], 1, 5).collect()] == [1, 3]


def test_date_columns(days):
    whole = queries.time_range(days, "day", "2024-01-01", "2024-01-31", key=["value"], limit=100)
    assert whole.count() == 30
    assert [r["value"] for r in queries.slice_by_time(days, "day", ["value"], 10, 5).orderBy("day").collect()] == [*range(10, 15)]
    assert time_filter(days, "day", "2024-01-01", "2024-01-05 07:12").count() == 5


def test_offsets_in_text_bounds(holes):
    assert time_filter(holes, "ts", "2024-01-01T02:00:00+02:00", "2024-01-01T03:00:00+02:00").count() == 1


def test_large_sums(spark):
    rows = [(datetime(2024, 1, 1, i % 3), 10**18) for i in range(20)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, value bigint")
    got = queries.downsample_multi(frame, "ts", "value", ["1 day"]).first()
    assert got["avg_value"] == pytest.approx(1e18)


def test_emptied_partitions_go(spark):
    rows = [(datetime(2024, 1, 1 + i // 24, i % 24), "a", float(i)) for i in range(72)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, tag string, value double")
    own = R.Rollup(new_path(spark, "emptied"), "ts", ("tag",), ("value",), "1 hour")
    R.create_rollup(frame, own)
    left = frame.where("day(ts) <> 2")
    zone = timezone(timedelta(hours=2))
    R.refresh_rollup(left, own, datetime(2024, 1, 2, 2, tzinfo=zone), datetime(2024, 1, 3, 2, tzinfo=zone))
    assert R.rollup_vs_raw(left, own, "value", datetime(2024, 1, 1), datetime(2024, 1, 4)).count() == 0
    assert R.query_rollup(spark, own, datetime(2024, 1, 1, 2, tzinfo=zone), datetime(2024, 1, 2, 2, tzinfo=zone)).count() == 24


def test_no_windows(simple):
    assert generate.random_windows(simple, "ts", 0, timedelta(minutes=5)).count() == 0
    assert generate.late_windows(simple, "ts", 0).count() == 0


def test_reset_from_its_own_rows(spark, simple, simple_schema):
    tables.ingest_reset(simple, "reset_self", simple_schema)
    own = spark.table("reset_self").where("device = 'd01'").select(*simple_schema.columns)
    assert tables.ingest_reset(own, "reset_self", simple_schema) == 20
    assert spark.table("reset_self").count() == 20
    spark.sql("DROP TABLE reset_self")


def test_bare_times_are_not_dates(spark):
    texts = spark.createDataFrame([("12:30",), ("2024",), ("2024-01-05 01:02:03",)], "t string")
    got = [r[0] for r in texts.select(parse_text(F.col("t"), strict=False)).collect()]
    assert got[:2] == [None, None] and got[2] is not None


def test_sources_keep_all_columns(spark, tmp_path):
    spark.range(3).withColumn("a", F.lit(1)).write.parquet(f"{tmp_path}/x")
    spark.range(3).withColumn("b", F.lit(1)).write.parquet(f"{tmp_path}/y")
    files = [str(p) for d in ("x", "y") for p in sorted((tmp_path / d).glob("*.parquet"))]
    assert set(scan_files(spark, files).columns) == {"id", "a", "b"}
    spark.range(4).withColumn("k", F.col("id") % 2).write.partitionBy("k").parquet(f"{tmp_path}/z")
    parts = [str(p) for p in sorted((tmp_path / "z").rglob("*.parquet"))]
    assert set(scan_files(spark, parts).columns) == {"id", "k"}


def test_unsigned_metrics(spark):
    frame = spark.sql("SELECT timestamp_ntz'2024-01-01' AS ts, cast(5 AS decimal(20,0)) AS n")
    assert infer_schema(frame).role("n") == "metric"
