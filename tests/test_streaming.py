from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.operators.generate import shuffle_timestamps
from tidegauge.operators.sweep import windows_frame
from tidegauge.plans import rollup as r
from tidegauge.streaming import live
from tidegauge.streaming import rollup_stream as rs
from tidegauge.streaming.load import resumable_load
from tidegauge.streaming.sources import file_stream

VIEW = r.Rollup("", "ts", ("event_type",), ("value",), "1 hour")


def batch(events, view=VIEW):
    return rounded(rs.averages(view.rows(events), view))


def rounded(df):
    ts = F.col("ts_bucket").cast("timestamp_ntz").alias("ts_bucket")
    return sorted(tuple(x) for x in df.select(ts, "event_type", F.round("avg_value", 9), "min_value", "max_value").collect())


def deliver(events, path, *conditions):
    for c in conditions:
        events.where(c).coalesce(1).write.mode("append").parquet(str(path))


def run_delta(spark, source, schema, base):
    stream = file_stream(spark, str(source), schema, max_files=1)
    rs.delta_rollup(stream, VIEW, f"{base}/d", f"{base}/c").awaitTermination()
    return rounded(rs.averages(rs.read_deltas(spark, f"{base}/d", VIEW), VIEW))


def test_stateful_equals_batch_when_rows_are_not_too_late(spark, events, tmp_path):
    deliver(events, tmp_path / "in", "event_id % 2 = 0 AND ts < '2024-01-02'", "event_id % 2 = 1 AND ts < '2024-01-02'", "ts >= '2024-01-02'")
    stream = file_stream(spark, str(tmp_path / "in"), events.schema, max_files=1)
    rs.write_changes(rs.stateful_rollup(stream, VIEW), f"{tmp_path}/ch", f"{tmp_path}/c").awaitTermination()
    assert rounded(rs.averages(rs.latest_rollup(spark, f"{tmp_path}/ch", VIEW), VIEW)) == batch(events)


def test_stateful_drops_what_delta_keeps(spark, events, tmp_path):
    order = ("ts >= '2024-01-20'", "ts < '2024-01-10'", "ts >= '2024-01-10' AND ts < '2024-01-20'")
    deliver(events, tmp_path / "in", *order)
    stream = file_stream(spark, str(tmp_path / "in"), events.schema, max_files=1)
    rs.write_changes(rs.stateful_rollup(stream, VIEW), f"{tmp_path}/ch", f"{tmp_path}/c").awaitTermination()
    kept = rounded(rs.averages(rs.latest_rollup(spark, f"{tmp_path}/ch", VIEW), VIEW))
    assert set(kept) < set(batch(events))
    assert run_delta(spark, tmp_path / "in", events.schema, tmp_path / "delta") == batch(events)
    counts = rs.late_counts(spark, f"{tmp_path}/delta/d").first()
    assert counts["n_rows"] == events.count()
    assert counts["late_rows"] == events.where("ts < '2024-01-20'").count()


def test_rows_behind_the_watermark_are_repaired(spark, events, tmp_path):
    """Late rows in buckets with and without rows in time, over several batches and two runs."""
    view = r.Rollup(str(tmp_path / "stored"), "ts", ("event_type",), ("value", "event_id"), "1 hour")
    parts = (
        "ts < '2024-01-12' AND event_id % 2 = 0", "ts >= '2024-01-20'", "ts < '2024-01-12' AND event_id % 4 = 1",
        "ts < '2024-01-12' AND event_id % 4 = 3", "ts >= '2024-01-12' AND ts < '2024-01-20'",
    )
    states = []
    for upto in (range(0, 3), range(3, 5)):
        for i in upto:
            deliver(events, tmp_path / "in", parts[i])
        stream = file_stream(spark, str(tmp_path / "in"), events.schema, max_files=1)
        rs.repaired_rollup(stream, view, f"{tmp_path}/stream")
        there = events.where(" OR ".join(f"({p})" for p in parts[: upto[-1] + 1]))
        stored = rs.averages(r.read_rollup(spark, view), VIEW)
        assert rounded(stored) == batch(there)
        columns = ["ts_bucket", "event_type", "sum_event_id", "cnt_event_id"]
        assert sorted(r.read_rollup(spark, view).select(*columns).collect()) == sorted(view.rows(there).select(*columns).collect())
        states.append(view.table.snapshot(spark))
        # What is folded is in the roll-up alone.
        assert not list((tmp_path / "stream" / "changes").glob("batch_id=*"))
    # The second run rewrote the dates it touched, and no others.
    kept = {d for d in states[0].parts if d >= "2024-01-23"}
    assert kept and all(states[0].parts[d] == states[1].parts[d] for d in kept)
    assert states[0].parts["2024-01-05"] != states[1].parts["2024-01-05"]
    assert states[1].marks["late"] > states[0].marks["late"]
    late = spark.read.parquet(f"{tmp_path}/stream/rows").where("is_late = 'true'")
    assert late.count() == events.where("ts < '2024-01-20' AND NOT (ts < '2024-01-12' AND event_id % 2 = 0)").count()


def test_replayed_batches_do_not_count_twice(spark, events, tmp_path):
    deliver(events, tmp_path / "in", "ts < '2024-01-15'", "ts >= '2024-01-15'")
    first = run_delta(spark, tmp_path / "in", events.schema, tmp_path / "x")
    again = file_stream(spark, str(tmp_path / "in"), events.schema, max_files=1)
    rs.delta_rollup(again, VIEW, f"{tmp_path}/x/d", f"{tmp_path}/fresh-checkpoint").awaitTermination()
    assert rounded(rs.averages(rs.read_deltas(spark, f"{tmp_path}/x/d", VIEW), VIEW)) == first == batch(events)


def test_order_does_not_matter(spark, events, tmp_path):
    batches = events.withColumn("b", F.expr("event_id div 100"))
    mixed = shuffle_timestamps(batches, "ts", "b", "event_id").drop("b")
    deliver(mixed, tmp_path / "in", "event_id % 3 = 2", "event_id % 3 = 0", "event_id % 3 = 1")
    deliver(mixed.orderBy("ts"), tmp_path / "sorted", "true")
    assert run_delta(spark, tmp_path / "in", mixed.schema, tmp_path / "a") == run_delta(
        spark, tmp_path / "sorted", mixed.schema, tmp_path / "b"
    )


def test_compacted_deltas_are_a_rollup(spark, events, tmp_path):
    deliver(events, tmp_path / "in", "event_id % 2 = 0", "event_id % 2 = 1")
    run_delta(spark, tmp_path / "in", events.schema, tmp_path / "x")
    stored = r.Rollup(str(tmp_path / "compact"), "ts", ("event_type",), ("value",), "1 hour")
    rs.compact_deltas(spark, f"{tmp_path}/x/d", VIEW, stored.path)
    assert rounded(r.query_rollup(spark, stored)) == batch(events)
    start, end = datetime(2024, 1, 3), datetime(2024, 1, 4)
    assert r.rollup_vs_raw(events, stored, "value", start, end).count() == 0


def test_load_resumes(spark, events, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    deliver(events, source, "event_id % 2 = 0")
    for expected in (events.where("event_id % 2 = 0").count(),) * 2:
        resumable_load(file_stream(spark, source, events.schema), target, checkpoint).awaitTermination()
        assert spark.read.parquet(target).count() == expected
    deliver(events, source, "event_id % 2 = 1")
    resumable_load(file_stream(spark, source, events.schema, max_bytes=1000), target, checkpoint).awaitTermination()
    assert spark.read.parquet(target).exceptAll(events).count() == 0 and spark.read.parquet(target).count() == events.count()


@pytest.mark.parametrize("file_format", ["json"])
def test_other_formats_stream_too(spark, events, tmp_path, file_format):
    events.drop("ts").write.format(file_format).save(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), events.drop("ts").schema, file_format)
    resumable_load(stream, str(tmp_path / "out"), str(tmp_path / "c"), ["event_type"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_compacted_log_is_the_log(spark, events, tmp_path):
    """Batches folded after each file, one of them replayed later: the same roll-up, and a short log."""
    parts = ["ts < '2024-01-12' AND event_id % 2 = 0", "ts < '2024-01-12' AND event_id % 2 = 1", "ts >= '2024-01-12'"]
    path = f"{tmp_path}/ch"
    for n, part in enumerate(parts):
        deliver(events, tmp_path / "in", part)
        stream = file_stream(spark, str(tmp_path / "in"), events.schema, max_files=1)
        rs.write_changes(rs.stateful_rollup(stream, VIEW), path, f"{tmp_path}/c").awaitTermination()
        before = rounded(rs.averages(rs.latest_rollup(spark, path, VIEW), VIEW))
        if n < 2:
            newest = max((tmp_path / "ch").glob("batch_id=*"), key=lambda p: int(p.name[9:]))
            last = spark.read.parquet(str(newest)).collect()
            assert rs.compact_changes(spark, path, VIEW) >= 1
            assert not list((tmp_path / "ch").glob("batch_id=*"))
            if last:
                spark.createDataFrame(last).write.parquet(str(newest))
        assert rounded(rs.averages(rs.latest_rollup(spark, path, VIEW), VIEW)) == before
    assert before == batch(events)


def test_every_batch_is_answered_from_what_is_committed(spark, simple, tmp_path):
    """Two files; each batch counts rows, buckets and tags of the batches so far, one window empty."""
    rows = simple.withColumn("id", F.expr("CAST(minute(ts) + 60 * hour(ts) AS BIGINT)"))
    deliver(rows, tmp_path / "in", "id >= 50")
    deliver(rows, tmp_path / "in", "id < 50")
    hours = [(datetime(2024, 1, 1, h), datetime(2024, 1, 1, h + 1)) for h in range(3)]
    stream = file_stream(spark, str(tmp_path / "in"), rows.schema, max_files=1)
    live.load_and_query(
        stream, f"{tmp_path}/table", f"{tmp_path}/answers", f"{tmp_path}/c", "ts", windows_frame(spark, hours), "device", "value", ["id"]
    ).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/answers").select("batch_id", "query", "window_id", "n_rows")
    assert sorted(map(tuple, found.collect())) == sorted(
        (batch, query, window, n)
        for batch, sizes in enumerate(((10, 40), (60, 40)))
        for window, size in enumerate(sizes)
        for query, n in (("time_range", size), ("aggregation", 1), ("last_point", 5))
    )
