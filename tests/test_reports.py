from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidegauge.errors import SchemaError
from tidegauge.operators import compare as c
from tidegauge.operators import resources as res
from tidegauge.operators import runs as ro
from tidegauge.operators import verdicts as v

SUMMARY = (
    "id int, run_id string, benchmark_name string, database_name string, operation string, batch_size int, workers int,"
    " total_rows bigint, rows_per_second_mean double, latency_p50_ms double, latency_p99_ms double"
)


def summaries(spark, *rows):
    return spark.createDataFrame(list(rows), SUMMARY)


def row(i, bench, db, op, rate=0.0, p99=0.0, workers=1, p50=1.0):
    return (i, f"r{i}", bench, db, op, 0, workers, 10, rate, p50, p99)


def verdicts(df):
    return {r["id"]: r["verdict"] for r in df.collect()}


@pytest.mark.parametrize(
    ("operation", "expected"),
    [
        ("aggregation_1h", (35, 150, 1500)),
        ("aggregation_1week_limit_5", (150, 1300, 13000)),
        ("high_cardinality_1min_x", (20, 75, 650)),
        ("last_point_1day", (150, 1300, 13000)),
        ("mixed_write", (20, 150, 1500)),
        ("aggregation", (75, 650, 6500)),
        ("anything", (75, 650, 6500)),
    ],
)
def test_thresholds(spark, operation, expected):
    got = spark.range(1).select(v.thresholds(F.lit(operation))).first()[0]
    assert tuple(got) == expected


def test_levels_include_their_limit(spark):
    df = summaries(
        spark,
        row(1, "time_range", "a", "time_range_1h", p99=75.0), row(2, "time_range", "a", "time_range_1h", p99=75.1),
        row(3, "time_range", "a", "time_range_1h", p99=4000.0), row(4, "time_range", "a", "time_range_1h", p99=4000.1),
        row(5, "ingestion", "a", "ingestion", rate=500_000.0), row(6, "mixed", "a", "mixed_read", rate=99_999.0),
        row(7, "ingestion", "a", "ingestion", rate=None), row(8, "time_range", "a", "time_range_1h", p99=None),
    )
    assert verdicts(v.verdict_absolute(df)) == {
        1: "Great", 2: "Solid", 3: "Fair", 4: "Slow", 5: "Great", 6: "Fair", 7: "Slow", 8: "Great",
    }
    assert set(verdicts(v.verdict_report(df)).values()) == {"OK", "Fair", "Slow"}


def test_relative_verdicts(spark):
    df = summaries(
        spark,
        row(1, "last_point", "a", "last_point", p99=5.0), row(2, "last_point", "b", "last_point", p99=3.0),
        row(3, "last_point", "c", "last_point", p99=0.0), row(4, "last_point", "d", "last_point", p99=None),
        row(5, "ingestion", "a", "ingestion", rate=5.0), row(6, "ingestion", "b", "ingestion", rate=5.0),
        row(7, "ingestion", "a", "ingestion", rate=5.0, workers=2),
    )
    assert verdicts(v.verdict_relative(df)) == {
        1: "Middle", 2: "Fastest", 3: "Middle", 4: "Slowest", 5: "Fastest", 6: "Slowest",
    }
    assert verdicts(v.assign_verdicts(df))[7] == "Slow"


def test_leader_and_trailer(spark):
    df = summaries(
        spark,
        row(1, "ingestion", "a", "ingestion", rate=100.0), row(2, "ingestion", "b", "ingestion", rate=25.0),
        row(3, "last_point", "a", "last_point", p99=8.0), row(4, "last_point", "b", "last_point", p99=2.0),
        row(5, "mixed", "a", "mixed_read", rate=1.0), row(6, "ingestion", "c", "ingestion", rate=500.0, p50=None),
        row(7, "downsampling", "a", "downsampling", p99=0.0), row(8, "downsampling", "b", "downsampling", p99=0.0),
    )
    got = {r["operation"]: r for r in v.leader_trailer(df).collect()}
    assert set(got) == {"ingestion", "last_point", "downsampling"}
    assert (got["ingestion"]["best_database"], got["ingestion"]["worst_database"], got["ingestion"]["ratio"]) == ("a", "b", 4.0)
    assert (got["last_point"]["best_database"], got["last_point"]["ratio"]) == ("b", 4.0)
    assert got["downsampling"]["ratio"] is None


def test_report_numbers(spark):
    df = summaries(
        spark,
        row(1, "ingestion", "a", "ingestion", rate=200_000.0), row(2, "ingestion", "a", "ingestion", rate=150_000.0),
        row(3, "last_point", "a", "last_point", p99=100.0), row(4, "last_point", "a", "last_point", p99=90.0),
        row(5, "downsampling", "a", "downsampling", p99=50_000.0), row(6, "aggregation", "a", "aggregation_1h", p99=None),
    )
    runs = spark.createDataFrame([("r1", "x"), ("r2", None)], "run_id string, completed_at string")
    got = v.report_rollup(df, runs).first().asDict()
    assert got == {
        "max_total_rows": 10, "peak_rows_per_second": 200_000.0, "mean_query_p99_ms": 25_045.0,
        "passed": 2, "total": 4, "unfinished_runs": 1,
    }


def test_deltas(spark):
    a = summaries(spark, row(1, "b", "x", "p", p99=10.0), row(2, "b", "x", "q", p99=0.0), row(3, "b", "x", "r", p99=4.0))
    b = summaries(spark, row(4, "b", "x", "p", p99=15.0), row(5, "b", "x", "q", p99=1.0), row(6, "b", "x", "s", p99=4.0))
    got = {r["operation"]: (r["value_a"], r["value_b"], r["delta_pct"]) for r in c.compare_runs(a, b, "latency_p99_ms").collect()}
    assert got == {"p": (10.0, 15.0, 50.0), "q": (0.0, 1.0, None), "r": (4.0, None, None), "s": (None, 4.0, None)}


def test_pivot_takes_the_last_write(spark):
    df = summaries(spark, row(1, "b", "x", "p", p99=1.0), row(2, "b", "x", "p", p99=2.0), row(3, "b", "y", "q", p99=3.0))
    got = [tuple(r) for r in c.compare_pivot(df, "latency_p99_ms").collect()]
    assert got == [("p", 0, 1, 2.0, None), ("q", 0, 1, None, 3.0)]
    with pytest.raises(SchemaError):
        c.distinct_values(df, "id", limit=2)


def test_scaling_and_rank(spark):
    df = summaries(
        spark,
        row(1, "b", "x", "p", rate=5.0, p99=2.0), row(2, "b", "x", "p", rate=5.0, p99=9.0, workers=16),
        row(3, "b", "y", "p", rate=7.0, p99=0.0), row(4, "b", "z", "p", rate=7.0, p99=1.0),
    )
    got = {r["database_name"]: r["degradation"] for r in c.scaling_table(df, "latency_p99_ms").collect()}
    assert got == {"x": 4.5, "y": None, "z": None}
    assert {r["database_name"]: r["rank"] for r in c.throughput_rank(df).collect()} == {"y": 1, "z": 1, "x": 3}


def test_run_table(spark):
    changes = spark.createDataFrame(
        [("a", "t1", None, 1), ("a", "t1", "t9", 2), ("b", "t2", None, 1)],
        "run_id string, started_at string, completed_at string, version int",
    )
    runs = ro.upsert_runs(changes)
    assert sorted(tuple(r) for r in runs.collect()) == [("a", "t1", "t9"), ("b", "t2", None)]
    closing = spark.createDataFrame([("b", "t5")], "run_id string, finished_at string")
    assert [r["completed_at"] for r in ro.list_runs(ro.complete_run(runs, closing)).collect()] == ["t5", "t9"]


def test_id_lists_and_frames(spark):
    df = summaries(spark, *[row(i, "b", "x", "p") for i in range(5)])
    wanted = ["r3", "r1", "absent"]
    for ids in (wanted, spark.createDataFrame([(r,) for r in wanted * 2], "run_id string")):
        assert [r["id"] for r in ro.load_summaries(df, ids).collect()] == [1, 3]
    assert ro.load_summaries(df, []).count() == 0
    assert ro.load_summaries(df, operation="q").count() == 0


def test_latest_runs(spark):
    runs = spark.createDataFrame(
        [("a", "m", "x", 1, 2), ("b", "m", "x", 3, 4), ("c", "m", "x", 5, None), ("d", "n", "x", 1, 2)],
        "run_id string, benchmark_name string, database_name string, started_at int, completed_at int",
    )
    assert {r["run_id"] for r in ro.latest_runs(runs).collect()} == {"b", "d"}
    assert {r["run_id"] for r in ro.latest_runs(runs, "m").collect()} == {"b"}


def test_benchmark_order(spark):
    names = ["zebra", "late_arrival", "aggregation", "apple", "ingestion"]
    runs = spark.createDataFrame([(n,) for n in names], "benchmark_name string")
    assert [r[0] for r in ro.benchmark_order(runs).collect()] == ["ingestion", "aggregation", "late_arrival", "apple", "zebra"]


SAMPLE = (
    "run_id string, sample_id int, timestamp_ns bigint, cpu_percent double, rss_mb double, vm_used_mb double,"
    " disk_read_mb double, disk_write_mb double, net_sent_mb double, net_recv_mb double"
)


def test_first_cpu_sample_is_ignored(spark):
    df = spark.createDataFrame(
        [
            ("a", 1, 0, 99.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
            ("a", 2, 10**9, 10.0, 3.0, 1.0, 1.0, 1.0, 1.0, 1.0),
            ("a", 3, 2 * 10**9, 20.0, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0),
            ("b", 4, 7, 50.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
        ],
        SAMPLE,
    )
    got = {r["run_id"]: r for r in res.resource_summary(df).collect()}
    assert (got["a"]["cpu_percent_mean"], got["a"]["cpu_percent_max"], got["a"]["rss_mb_mean"]) == (15.0, 20.0, 3.0)
    assert (got["a"]["disk_read_mb_total"], got["a"]["sample_count"], got["a"]["duration_s"]) == (3.0, 3, 2.0)
    assert (got["b"]["cpu_percent_mean"], got["b"]["duration_s"]) == (0.0, 0.0)
    assert res.resource_timeline(df).agg(F.max("time_s")).first()[0] == 2.0


def test_counters_that_reset(spark):
    mib = 1_048_576
    df = spark.createDataFrame([("a", i, x * mib) for i, x in enumerate([5, 8, 2, 2])], "run_id string, t int, c bigint")
    got = res.counter_deltas(df, ["run_id"], ["t"], ["c"]).orderBy("t").collect()
    assert [r["c_mb"] for r in got] == [0.0, 3.0, 0.0, 0.0]
