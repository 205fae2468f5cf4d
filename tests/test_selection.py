from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.operators import latency as m
from tidegauge.operators import selection
from tidegauge.operators.ordering import number_rows, previous, running_sum
from tidegauge.operators.selection import linear_percentiles

MS = 1_000_000


@pytest.fixture(params=["sorted arrays", "cells", "both"])
def path(request, monkeypatch):
    """Run with every group small, with every group large, and with some of each."""
    limit = {"sorted arrays": 100_000, "cells": 0, "both": 25}[request.param]
    monkeypatch.setattr(selection, "GROUP_ROWS_MAX", limit)


def frame(spark, groups: dict, kind: str = "double"):
    rows = [(k, v) for k, values in groups.items() for v in values]
    return spark.createDataFrame(rows, f"k string, x {kind}")


SAMPLES = st.dictionaries(
    st.sampled_from(["a", "b", None]),
    st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e12, 1e12, allow_subnormal=False)), min_size=1, max_size=40),
    min_size=1,
)


@given(SAMPLES)
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_percentiles_are_numpys(spark, path, groups):
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in linear_percentiles(frame(spark, groups), ["k"], {"x": points}).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        for name, p in points.items():
            assert got[k][name] == pytest.approx(np.percentile(values, p * 100), rel=1e-9, abs=1e-9)


def test_several_columns_at_once(spark, path):
    df = spark.range(1, 101).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"), (F.col("id") * -1.5).alias("b"))
    got = linear_percentiles(df, ["k"], {"a": {"a50": 0.5}, "b": {"b10": 0.1, "b90": 0.9}}).orderBy("k").collect()
    odd = np.arange(1, 101, 2)
    assert got[1].asDict() == {
        "k": 1,
        "a50": np.percentile(odd, 50),
        "b10": pytest.approx(np.percentile(-1.5 * odd, 10)),
        "b90": pytest.approx(np.percentile(-1.5 * odd, 90)),
    }


def test_nulls_and_infinities(spark, path):
    df = frame(spark, {"a": [None, 1.0, float("inf"), float("-inf"), 0.0], "b": [None]})
    got = linear_percentiles(df, ["k"], {"x": {"lo": 0.0, "third": 1 / 3, "hi": 1.0}}).collect()
    assert [tuple(r) for r in got] == [("a", float("-inf"), 0.0, float("inf"))]


def test_hot_value(spark, path):
    """One value holds most of a group."""
    df = spark.range(20000).select(F.lit("a").alias("k"), F.when(F.col("id") < 15000, 7.0).otherwise(F.col("id") * 1.0).alias("x"))
    got = linear_percentiles(df, ["k"], {"x": {"p50": 0.5, "p80": 0.8}}).first()
    assert got["p50"] == 7.0 and got["p80"] == pytest.approx(np.percentile([7.0] * 15000 + list(range(15000, 20000)), 80))


def latencies(spark, groups):
    return spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k string, elapsed_ns bigint")


# name: samples, p50, p99, outliers
LATENCY_CASES = {
    "one": ([5 * MS], 5, 5, 0),
    "equal": ([7 * MS] * 100, 7, 7, 0),
    "ramp": ([i * MS for i in range(1, 101)], 50, 99, 0),
    "slow one": ([MS] * 99 + [10_000 * MS], 1, 1, 1),
    "fast one": ([100 * MS] * 99 + [1000], 100, 100, 1),
    "ramp and a giant": ([i * MS for i in range(1, 101)] + [1_000_000 * MS], 50, 99, 1),
}


def test_latency_cases(spark, path):
    log = latencies(spark, {k: case[0] for k, case in LATENCY_CASES.items()})
    percentiles = {r["k"]: r for r in m.latency_percentiles(log, ["k"]).collect()}
    counts = {r["k"]: r for r in m.outlier_counts(log, ["k"]).collect()}
    moments = {r["k"]: r for r in m.latency_moments(log, ["k"]).collect()}
    for k, (values, p50, p99, outliers) in LATENCY_CASES.items():
        got = percentiles[k]
        assert got["p50_ms"] == p50 and got["p99_ms"] == p99
        assert got["p50_ms"] <= got["p95_ms"] <= got["p99_ms"] <= got["p999_ms"] < 10_000
        assert counts[k]["outlier_count"] == outliers and counts[k]["sample_count"] == len(values)
        assert moments[k]["mean_ms"] == pytest.approx(np.mean(values) / 1e6)
        assert moments[k]["stddev_ms"] == pytest.approx(np.std(values) / 1e6)
        assert (moments[k]["min_ms"], moments[k]["max_ms"]) == (min(values) / 1e6, max(values) / 1e6)


def test_percentiles_are_clamped(spark, path):
    log = latencies(spark, {"zero": [0, 0, 0], "long": [90_000 * MS] * 3})
    got = {r["k"]: r for r in m.latency_percentiles(log, ["k"]).collect()}
    assert got["zero"]["p50_ms"] == 1 / 1e6 and got["long"]["p99_ms"] == 60_000


def test_rates(spark):
    log = spark.createDataFrame(
        [(10**9, 100, 2**20), (0, 100, 10), (10**9, 0, 0), (-5, 1, 1)],
        "elapsed_ns bigint, rows_processed bigint, bytes_processed bigint",
    )
    assert [(r["rows_per_second"], r["mb_per_second"]) for r in m.derive_rates(log).collect()] == [
        (100.0, 1.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0),
    ]


def full_log(spark, rows):
    df = spark.createDataFrame(
        rows,
        "run_id string, database_name string, operation string, phase string, batch_size int, workers int,"
        " elapsed_ns bigint, rows_processed bigint, bytes_processed bigint",
    )
    return m.derive_rates(df)


def test_summary_of_warm_up_only_is_zero(spark, path):
    log = full_log(
        spark,
        [
            ("r", "d", "a", "warmup", 1, 1, MS, 5, 5),
            ("r", "d", "b", "measurement", 1, 1, 2 * MS, 10, 70),
            ("r", "d", "b", "warmup", 1, 1, 900 * MS, 10, 70),
        ],
    )
    got = {r["operation"]: r for r in m.summarize(log).collect()}
    assert all(got["a"][c] == 0 for c in got["a"].asDict() if c not in m.SUMMARY_KEYS)
    b = got["b"]
    assert (b["sample_count"], b["total_rows"], b["latency_p50_ms"], b["latency_max_ms"]) == (1, 10, 2.0, 2.0)
    assert b["rows_per_second_mean"] == b["rows_per_second_p99"] == 5000.0


def test_empty_log(spark, path):
    log = full_log(spark, [])
    assert m.summarize(log).count() == 0
    assert m.latency_percentiles(log, ["operation"]).count() == 0
    assert m.throughput_stats(log, ["operation"]).count() == 0


def test_numbering_and_sums_across_chunks(spark):
    """Small partitions, and one key with most of the rows."""
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        ((F.col("id") * 7919) % 3001).alias("t"), (F.col("id") % 10).alias("v"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = number_rows(df, ["t", "id"]).toPandas().sort_values("row_number")
        summed = running_sum(df, ["k"], ["t", "id"], {"v": "total"}).toPandas()
        before = previous(df, ["k"], ["t", "id"], {"v": "last"}).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert list(numbered["row_number"]) == list(range(1, 3001))
    assert list(numbered["t"]) == sorted(numbered["t"])
    want = df.toPandas().sort_values(["t", "id"])
    want["total"] = want.groupby("k")["v"].cumsum()
    want["last"] = want.groupby("k")["v"].shift()
    want = want.set_index("id").sort_index()
    assert (summed.set_index("id").sort_index()["total"] == want["total"]).all()
    got = before.set_index("id").sort_index()["last"]
    assert ((got == want["last"]) | (got.isna() & want["last"].isna())).all()
    assert want["last"].isna().sum() == 8


def test_previous_keeps_null_values(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "t int, v int").withColumn("k", F.lit("a"))
    got = previous(df, ["k"], ["t"], {"v": "last"}).orderBy("t").collect()
    assert [r["last"] for r in got] == [None, 5, None]


def test_load_rates(spark):
    df = spark.createDataFrame(
        [("a", 0, 1, 10), ("a", 2_000_000, 2, 30), ("a", 4_000_000, 3, 60), ("b", 0, 4, 5)],
        "load_id string, at_us bigint, id int, n int",
    )
    got = {r["load_id"]: r for r in m.load_rates(df, "load_id", "at_us", "id", "n").collect()}
    assert (got["a"]["min_rate"], got["a"]["avg_rate"], got["a"]["max_rate"], got["a"]["overall_rate"]) == (20, 22.5, 25, 25)
    assert (got["b"]["avg_rate"], got["b"]["overall_rate"], got["b"]["total_rows"]) == (0, 0, 5)


def test_full_cells_are_split(spark, monkeypatch):
    """The third scan gives the same answer as two."""
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(1000, 1, 3000).tolist(), "b": rng.normal(-5, 3, 500).tolist(), "c": [4.0] * 700 + [4.0001]}
    points = {"x": {"p10": 0.1, "p50": 0.5, "p999": 0.999}}
    monkeypatch.setattr(selection, "GROUP_ROWS_MAX", 0)
    monkeypatch.setattr(selection, "CELL_ROWS_MAX", 10)
    got = {r["k"]: r for r in linear_percentiles(frame(spark, groups), ["k"], points).collect()}
    for k, values in groups.items():
        for name, p in points["x"].items():
            assert got[k][name] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)
