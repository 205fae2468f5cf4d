"""What the physical plans must look like for the queries to hold at scale."""

from __future__ import annotations

import re
from datetime import datetime

from tidegauge.operators import queries as q
from tidegauge.operators import sweep as s
from tidegauge.operators.prepare import time_filter
from tidegauge.sinks.tables import with_partition
from workload.base import tidy
from workload.series import daily_windows

START, END = datetime(2024, 1, 5), datetime(2024, 1, 6)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_reaches_the_scan_with_few_columns(events):
    text = plan(q.bucket_agg(events, "ts", "value", "1 hour", START, END))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in text and "LessThan(ts,2024-01-06T00:00)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text


def test_aggregates_combine_before_the_exchange(events):
    for df in (
        q.bucket_agg(events, "ts", "value"),
        q.tag_agg(events, "user_id", "value", "ts"),
        q.downsample_multi(events, "ts", "value"),
    ):
        text = plan(df)
        assert "SortAggregate" not in text and "partial_" in text


def test_last_point_sends_one_row_per_tag_and_task(events):
    text = plan(q.last_point(events, "user_id", "value", "ts", ["event_id"]))
    limit, exchange = text.rindex("WindowGroupLimit"), text.index("hashpartitioning(user_id")
    assert limit > exchange and "Partial" in text[limit : limit + 250]


def test_sweep_is_an_equi_join(spark, events):
    text = plan(s.sweep_tag(events, "ts", daily_windows(events), "user_id", "value"))
    assert re.search(r"(BroadcastHashJoin|SortMergeJoin) \[.*_cell", text)


def test_sweep_without_broadcast_is_still_an_equi_join(spark, events):
    windows = daily_windows(events)
    rows = lambda df: sorted(map(tuple, tidy(df).collect()), key=str)
    want = rows(s.sweep_tag(events, "ts", windows, "user_id", "value"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        df = s.sweep_tag(events, "ts", windows, "user_id", "value")
        assert "SortMergeJoin" in plan(df)
        assert rows(df) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_row_count_reads_no_column(events):
    from tidegauge.sources.extent import row_count

    assert "ReadSchema: struct<>" in plan(row_count(events))


def test_filter_on_a_partitioned_table_prunes(spark, events, tmp_path):
    with_partition(events, "ts", "DAY").write.partitionBy("p").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    kept = time_filter(stored, "ts", START, END, partition=("p", "DAY"))
    text = plan(kept)
    assert "p#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert kept.drop("p").exceptAll(time_filter(events, "ts", START, END)).count() == 0
    assert kept.count() == time_filter(events, "ts", START, END).count()
    assert kept.select("_metadata.file_path").distinct().count() == 1


def test_no_local_checkpoint_and_no_forced_broadcast():
    import pathlib
    import re

    import tidegauge

    for path in pathlib.Path(tidegauge.__file__).parent.rglob("*.py"):
        # A shared variable of a bounded model is no join hint; every other broadcast is.
        text = path.read_text().replace("sparkContext.broadcast(", "")
        assert not re.search(r"""hint\(\s*["']broadcast""", text, re.IGNORECASE), path
        for word in ("localCheckpoint", "broadcast(", "crossJoin", ".rdd", ".cache()", ".persist("):
            assert word not in text, f"{word} in {path}"


def test_tasks_of_a_bucket_sweep_follow_the_windows(spark, simple, monkeypatch):
    """Twice the windows, about twice the tasks, at each shuffle of parts; the same answers."""
    hours = [(datetime(2024, 1, 1, 0, i), datetime(2024, 1, 1, 1, i + 5)) for i in range(30)]
    answers = lambda n: s.sweep_bucket(simple, "ts", s.windows_frame(spark, hours[:n]), "value", "1 hour")
    plain = sorted(map(tuple, answers(30).collect()))
    monkeypatch.setattr(s, "TASK_ROWS", 20)
    tasks = []
    for n in (15, 30):
        found = answers(n)
        own = {int(x) for x in re.findall(r"hashpartitioning\((?:window_id|_level|_grain)[^()]*, (\d+)\), REPARTITION_BY_NUM", plan(found))}
        assert len(own) == 1
        tasks += own
    assert sorted(map(tuple, found.collect())) == plain and tasks[1] > 1.7 * tasks[0] > 4
