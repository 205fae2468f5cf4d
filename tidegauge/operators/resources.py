"""Statistics over resource samples (CPU, memory, disk, network)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import BYTES_PER_MIB
from tidegauge.operators.keys import keyed_join
from tidegauge.operators.ordering import previous
from tidegauge.session import materialize

_TOTALS = ("disk_read_mb", "disk_write_mb", "net_sent_mb", "net_recv_mb")


def resource_summary(samples: DataFrame, run: str = "run_id", key: str = "sample_id") -> DataFrame:
    """Per run: CPU without its first sample, memory, totals, samples and duration.

    The first sample is found by aggregation and joined back, so a run of any length is
    never sorted in one task.
    """
    place = F.struct("timestamp_ns", key)
    first = materialize(samples.groupBy(run).agg(F.min(place).alias("_first")), "first")
    cpu = F.when(place != F.col("_first"), F.col("cpu_percent"))
    return (
        keyed_join(samples, first, [run])
        .groupBy(run)
        .agg(
            F.coalesce(F.avg(cpu), F.lit(0.0)).alias("cpu_percent_mean"),
            F.coalesce(F.max(cpu), F.lit(0.0)).alias("cpu_percent_max"),
            F.avg("rss_mb").alias("rss_mb_mean"),
            F.max("rss_mb").alias("rss_mb_max"),
            F.avg("vm_used_mb").alias("vm_used_mb_mean"),
            F.max("vm_used_mb").alias("vm_used_mb_max"),
            *[F.sum(c).alias(f"{c}_total") for c in _TOTALS],
            F.count(F.lit(1)).alias("sample_count"),
            ((F.max("timestamp_ns") - F.min("timestamp_ns")) / 1e9).alias("duration_s"),
        )
    )


def counter_deltas(
    samples: DataFrame, keys: Sequence[str], order: Sequence[str], counters: Sequence[str]
) -> DataFrame:
    """MiB added to each byte counter since the sample before; 0 first and after a reset."""
    before = {c: f"_before_{c}" for c in counters}
    seen = previous(samples, list(keys), list(order), before)
    delta = {
        f"{c}_mb": F.coalesce(F.greatest(F.lit(0), F.col(c) - F.col(b)), F.lit(0)) / BYTES_PER_MIB
        for c, b in before.items()
    }
    return seen.withColumns(delta).drop(*before.values())


def attach_resources(summaries: DataFrame, resources: DataFrame, run: str = "run_id") -> DataFrame:
    """Every summary with its run's resource columns, prefixed; null when not monitored."""
    prefixed = resources.select(
        run, *[F.col(c).alias(f"resource_{c}") for c in resources.columns if c != run]
    )
    return keyed_join(summaries, prefixed, [run], "left")


def resource_rows(summaries: DataFrame, value: str = "resource_cpu_percent_mean") -> DataFrame:
    """The monitored summaries' value per database and operation."""
    return summaries.where(
        F.col("resource_cpu_percent_mean").isNotNull() & F.col(value).isNotNull()
    ).select("database_name", "operation", value)


def resource_timeline(samples: DataFrame, run: str = "run_id") -> DataFrame:
    """CPU and memory over seconds since each run's first sample."""
    began = materialize(samples.groupBy(run).agg(F.min("timestamp_ns").alias("_began")), "began")
    return (
        keyed_join(samples, began, [run])
        .withColumn("time_s", (F.col("timestamp_ns") - F.col("_began")) / 1e9)
        .select(run, "time_s", "cpu_percent", "rss_mb")
    )
