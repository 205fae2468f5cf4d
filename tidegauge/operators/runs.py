"""The run table and the summaries that belong to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.keys import keyed_join

# The order benchmarks are reported in; others follow by name.
BENCHMARK_ORDER = (
    "ingestion",
    "ingestion_out_of_order",
    "time_range",
    "aggregation",
    "last_point",
    "high_cardinality",
    "downsampling",
    "mixed",
    "materialized_view",
    "late_arrival",
)

# Benchmarks judged by rows per second instead of latency.
THROUGHPUT_BENCHMARKS = ("ingestion", "ingestion_out_of_order", "mixed")


def latest_versions(changes: DataFrame, key: str, version: str) -> DataFrame:
    """The last write of every key in an append-only change log."""
    return (
        changes.groupBy(key)
        .agg(F.max_by(F.struct(*changes.columns), version).alias("_row"))
        .select("_row.*")
    )


def upsert_runs(changes: DataFrame, version: str = "version") -> DataFrame:
    """The run table as its change log leaves it."""
    return latest_versions(changes, "run_id", version).drop(version)


def complete_run(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """Set ``completed_at`` from ``finished(run_id, finished_at)``; other runs keep theirs."""
    joined = keyed_join(runs, finished, ["run_id"], "left")
    return joined.withColumn("completed_at", F.coalesce("finished_at", "completed_at")).drop("finished_at")


def list_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id")


def load_summaries(
    summaries: DataFrame,
    run_ids: Sequence[str] | DataFrame | None = None,
    database_name: str | None = None,
    operation: str | None = None,
) -> DataFrame:
    """Summaries passing the given filters, by run, database and operation.

    ``run_ids`` is a list, which reaches the scan, or a frame with a ``run_id`` of any size.
    """
    if isinstance(run_ids, DataFrame):
        summaries = summaries.join(run_ids.select("run_id"), "run_id", "left_semi")
    elif run_ids is not None:
        summaries = summaries.where(F.col("run_id").isin(list(run_ids)))
    if database_name is not None:
        summaries = summaries.where(F.col("database_name") == database_name)
    if operation is not None:
        summaries = summaries.where(F.col("operation") == operation)
    return summaries.orderBy("run_id", "database_name", "operation")


def latest_runs(runs: DataFrame, benchmark: str | None = None) -> DataFrame:
    """The newest completed run of each benchmark and database."""
    done = runs.where(F.col("completed_at").isNotNull())
    if benchmark is not None:
        done = done.where(F.col("benchmark_name") == benchmark)
    return done.groupBy("benchmark_name", "database_name").agg(
        F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"),
        F.max("started_at").alias("started_at"),
    )


def label_benchmark(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """Summaries with the benchmark of their run, ``unknown`` when the run is."""
    names = runs.select("run_id", "benchmark_name")
    labelled = keyed_join(summaries, names, ["run_id"], "left")
    return labelled.withColumn("benchmark_name", F.coalesce("benchmark_name", F.lit("unknown")))


def benchmark_position(name: Column) -> Column:
    """Where a benchmark stands in the fixed order; unknown ones share the last place."""
    position = F.array_position(F.array(*[F.lit(b) for b in BENCHMARK_ORDER]), name)
    return F.when(position > 0, position).otherwise(F.lit(len(BENCHMARK_ORDER) + 1)).cast("int")


def benchmark_order(runs: DataFrame) -> DataFrame:
    """The benchmarks that were run, in reporting order."""
    return (
        runs.select("benchmark_name")
        .distinct()
        .withColumn("position", benchmark_position(F.col("benchmark_name")))
        .orderBy("position", "benchmark_name")
    )


def is_throughput(benchmark: Column) -> Column:
    return benchmark.isin(*THROUGHPUT_BENCHMARKS)
