"""Statistics over an operation log, per group of any size.

The log has one row per measured operation: run_id, database_name, operation, phase,
iteration, batch_size, workers, elapsed_ns, rows_processed, bytes_processed,
rows_per_second, mb_per_second.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import BYTES_PER_MIB, ratio
from tidegauge.operators.keys import keyed_join
from tidegauge.operators.ordering import running_sum
from tidegauge.operators.selection import (
    Cells,
    by_group_size,
    linear_at,
    linear_percentiles,
    nearest_rank,
    sorted_values,
)
from tidegauge.session import materialize

SUMMARY_KEYS = ("run_id", "database_name", "operation", "batch_size", "workers")

# Percentiles of a latency summary, and the range they are reported in (ns).
LATENCY_POINTS = {"p50": 0.50, "p95": 0.95, "p99": 0.99, "p999": 0.999}
LATENCY_MIN_NS, LATENCY_MAX_NS = 1, 60_000_000_000

MEASURES = ("elapsed_ns", "rows_processed", "rows_per_second", "mb_per_second")
QUARTILES = {"q1": 0.25, "q3": 0.75}
RATE_POINTS = {"p95": 0.95, "p99": 0.99}
MOMENTS = ("mean_ms", "min_ms", "max_ms", "stddev_ms")

# A sample this many interquartile ranges outside the quartiles is an outlier.
FENCE = 1.5

NANOS_PER_MS = 1e6


def derive_rates(log: DataFrame) -> DataFrame:
    """Add rows/s and MiB/s; 0 where the time or the count is not positive."""
    seconds = F.col("elapsed_ns") / 1e9
    timed = F.col("elapsed_ns") > 0
    return log.withColumns(
        {
            "rows_per_second": F.when(
                timed & (F.col("rows_processed") > 0), F.col("rows_processed") / seconds
            ).otherwise(0.0),
            "mb_per_second": F.when(
                timed & (F.col("bytes_processed") > 0),
                F.col("bytes_processed") / BYTES_PER_MIB / seconds,
            ).otherwise(0.0),
        }
    )


def measurement_only(log: DataFrame) -> DataFrame:
    return log.where(F.col("phase") == "measurement")


def pass_totals(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Time, rows and bytes of each pass over the data."""
    return log.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("elapsed_ns", "rows_processed", "bytes_processed")]
    )


def quartiles(log: DataFrame, keys: Sequence[str], value: str = "elapsed_ns") -> DataFrame:
    """q1, q3 and their distance, linearly interpolated."""
    return linear_percentiles(log, keys, {value: QUARTILES}).withColumn("iqr", F.col("q3") - F.col("q1"))


def with_fences(found: DataFrame) -> DataFrame:
    """Quartiles and the bounds, themselves included, of what is not an outlier."""
    return found.withColumns(
        {
            "fence_lo": F.col("q1") - FENCE * F.col("iqr"),
            "fence_hi": F.col("q3") + FENCE * F.col("iqr"),
        }
    )


def flag_outliers(log: DataFrame, keys: Sequence[str], value: str = "elapsed_ns") -> DataFrame:
    """Every row with ``is_outlier`` against the fences of its group."""
    bounds = materialize(with_fences(quartiles(log, keys, value)), "fences")
    fenced = keyed_join(log, bounds, list(keys))
    outside = (F.col(value) < F.col("fence_lo")) | (F.col(value) > F.col("fence_hi"))
    return fenced.withColumn("is_outlier", outside).drop("q1", "q3", "iqr", "fence_lo", "fence_hi")


def outlier_counts(log: DataFrame, keys: Sequence[str], value: str = "elapsed_ns") -> DataFrame:
    return flag_outliers(log, keys, value).groupBy(*keys).agg(
        F.count(F.when(F.col("is_outlier"), 1)).alias("outlier_count"),
        F.count(value).alias("sample_count"),
    )


def _population(value: str) -> list:
    """Aggregates beside the fences: ``iqr``, inliers ``n``, and ``skip``, the samples
    below the lower fence."""
    x = F.col(value)
    inside = (x >= F.col("fence_lo")) & (x <= F.col("fence_hi"))
    return [
        F.first("iqr").alias("iqr"),
        F.count(F.when(x < F.col("fence_lo"), 1)).alias("skip"),
        F.count(F.when(inside, 1)).alias("n"),
    ]


def _trimmed(grouped: DataFrame, values: str) -> DataFrame:
    """Fences, population and latency percentiles from the sorted array ``values``."""
    array = F.col(values)
    fenced = with_fences(
        grouped.withColumns({name: linear_at(array, p) for name, p in QUARTILES.items()}).withColumn(
            "iqr", F.col("q3") - F.col("q1")
        )
    )
    lower = F.size(F.filter(array, lambda x: x < F.col("fence_lo")))
    upper = F.size(F.filter(array, lambda x: x > F.col("fence_hi")))
    counted = fenced.withColumn("skip", lower).withColumn("n", F.size(array) - F.col("skip") - upper)
    at = {name: F.get(array, (F.col("skip") + nearest_rank(F.col("n"), p) - 1).cast("int")) for name, p in LATENCY_POINTS.items()}
    return counted.withColumns(at)


def latency_percentiles(log: DataFrame, keys: Sequence[str], value: str = "elapsed_ns") -> DataFrame:
    """p50, p95, p99 and p99.9 in ms over the samples that are not outliers."""
    keys = list(keys)

    def small(rows: DataFrame) -> DataFrame:
        grouped = rows.groupBy(*keys).agg(sorted_values(F.col(value)).alias("_sorted"))
        return _trimmed(grouped.where(F.size("_sorted") > 0), "_sorted").select(*keys, *_all_reported())

    def large(rows: DataFrame) -> DataFrame:
        cells = Cells.of(rows, keys, [value])
        found = cells.linear({value: QUARTILES}).withColumn("iqr", F.col("q3") - F.col("q1"))
        bounds = materialize(with_fences(found).select(*keys, "iqr", "fence_lo", "fence_hi"), "fences")
        fenced = keyed_join(rows.select(*keys, value), bounds, keys)
        population = materialize(fenced.groupBy(*keys).agg(*_population(value)), "population")
        return cells.nearest(value, LATENCY_POINTS, population).select(*keys, *_all_reported())

    return by_group_size(log, keys, [value], small, large)


def _all_reported(prefix: str = "") -> list:
    return [_reported(name).alias(f"{prefix}{name}_ms") for name in LATENCY_POINTS]


def _reported(name: str):
    clamped = F.greatest(F.lit(LATENCY_MIN_NS), F.least(F.lit(LATENCY_MAX_NS), F.col(name)))
    return clamped / NANOS_PER_MS


def latency_moments(log: DataFrame, keys: Sequence[str], value: str = "elapsed_ns") -> DataFrame:
    """mean, min, max and population standard deviation in ms, over all samples."""
    return log.groupBy(*keys).agg(*_moments(value))


def _moments(value: str) -> list:
    x = F.col(value)
    return [
        (F.avg(x) / NANOS_PER_MS).alias("mean_ms"),
        (F.min(x) / NANOS_PER_MS).alias("min_ms"),
        (F.max(x) / NANOS_PER_MS).alias("max_ms"),
        (F.stddev_pop(x) / NANOS_PER_MS).alias("stddev_ms"),
    ]


def throughput_stats(
    log: DataFrame, keys: Sequence[str], values: Sequence[str] = ("rows_per_second", "mb_per_second")
) -> DataFrame:
    """mean, p95 and p99 (linear) of each rate."""
    keys = list(keys)
    means = log.groupBy(*keys).agg(*[F.avg(v).alias(f"{v}_mean") for v in values])
    points = {v: {f"{v}_{name}": p for name, p in RATE_POINTS.items()} for v in values}
    return keyed_join(means, linear_percentiles(log, keys, points), keys, "left")


def summarize(log: DataFrame, keys: Sequence[str] = SUMMARY_KEYS) -> DataFrame:
    """One summary row per group, over its measurement rows; zeros where it has none.

    Two scans while every group is small; groups too large to sort in a task take five,
    whatever their number, and pass one row per group or cell between them.
    """
    keys = list(keys)
    # Warm-up rows only keep their group alive.
    measured = F.col("phase") == "measurement"
    only = log.select(*keys, *[F.when(measured, F.col(c)).alias(c) for c in MEASURES])
    rates = {f"rows_per_second_{name}": p for name, p in RATE_POINTS.items()}
    plain = [
        F.sum("rows_processed").alias("total_rows"),
        F.count("elapsed_ns").alias("sample_count"),
        F.avg("rows_per_second").alias("rows_per_second_mean"),
        F.avg("mb_per_second").alias("mb_per_second_mean"),
        *[c.alias(f"latency_{n}") for c, n in zip(_moments("elapsed_ns"), MOMENTS)],
    ]

    def small(rows: DataFrame) -> DataFrame:
        arrays = [sorted_values(F.col(c)).alias(f"_{c}") for c in ("elapsed_ns", "rows_per_second")]
        grouped = rows.groupBy(*keys).agg(*plain, *arrays)
        return _trimmed(grouped, "_elapsed_ns").withColumns(
            {name: linear_at(F.col("_rows_per_second"), p) for name, p in rates.items()}
        )

    def large(rows: DataFrame) -> DataFrame:
        cells = Cells.of(rows, keys, ["elapsed_ns", "rows_per_second"])
        linear = cells.linear({"elapsed_ns": QUARTILES, "rows_per_second": rates})
        bounds = with_fences(linear.withColumn("iqr", F.col("q3") - F.col("q1")))
        bounds = materialize(bounds.select(*keys, "iqr", "fence_lo", "fence_hi", *rates), "fences")
        grouped = keyed_join(rows, bounds, keys, "left").groupBy(*keys).agg(
            *plain, *_population("elapsed_ns"), *[F.first(name).alias(name) for name in rates]
        )
        grouped = materialize(grouped, "summary")
        points = cells.nearest("elapsed_ns", LATENCY_POINTS, grouped)
        return keyed_join(grouped, points, keys, "left")

    columns = [
        "total_rows", "sample_count", "rows_per_second_mean", *rates, "mb_per_second_mean",
        *[f"latency_{p}_ms" for p in LATENCY_POINTS], *[f"latency_{n}" for n in MOMENTS],
        "latency_iqr_ms", "latency_outlier_count",
    ]

    def finished(rows: DataFrame) -> DataFrame:
        named = rows.withColumns({f"latency_{p}_ms": _reported(p) for p in LATENCY_POINTS}).withColumns(
            {
                "latency_iqr_ms": F.col("iqr") / NANOS_PER_MS,
                "latency_outlier_count": (F.col("sample_count") - F.col("n")).cast("bigint"),
            }
        )
        empty = F.col("sample_count") == 0
        return named.select(*keys, *[F.when(empty, F.lit(0)).otherwise(F.col(c)).alias(c) for c in columns])

    return by_group_size(
        only, keys, ["elapsed_ns"], lambda rows: finished(small(rows)), lambda rows: finished(large(rows))
    )


# The parts of a nested summary and the columns each is stored under.
LATENCY_FIELDS = (
    "p50_ms", "p95_ms", "p99_ms", "p999_ms", "mean_ms", "min_ms", "max_ms", "iqr_ms", "stddev_ms", "outlier_count",
)
RESOURCE_FIELDS = (
    "cpu_percent_mean", "cpu_percent_max", "rss_mb_mean", "rss_mb_max", "vm_used_mb_mean", "vm_used_mb_max",
    "disk_read_mb_total", "disk_write_mb_total", "net_sent_mb_total", "net_recv_mb_total", "sample_count", "duration_s",
)


def nest_summary(summary: DataFrame) -> DataFrame:
    """Gather the ``latency_*`` columns into one struct column."""
    flat = [c for c in summary.columns if not c.startswith("latency_")]
    parts = [F.col(f"latency_{f}").alias(f) for f in LATENCY_FIELDS]
    return summary.select(*flat, F.struct(*parts).alias("latency"))


def flatten_summary(summary: DataFrame) -> DataFrame:
    """Structs ``latency`` and ``resource`` as prefixed columns; resources null if absent."""
    flat = [c for c in summary.columns if c not in ("latency", "resource")]
    latency = [
        F.col(f"latency.{f.name}").alias(f"latency_{f.name}") for f in summary.schema["latency"].dataType
    ]
    if "resource" in summary.columns:
        resource = [F.col(f"resource.{f}").alias(f"resource_{f}") for f in RESOURCE_FIELDS]
    else:
        resource = [F.lit(None).cast("double").alias(f"resource_{f}") for f in RESOURCE_FIELDS]
    return summary.select(*flat, *latency, *resource)


def running_load(progress: DataFrame, load: str, time_us: str, key: str, rows: str) -> DataFrame:
    """Every progress report with the rows so far and the rate since the load began."""
    began = materialize(progress.groupBy(load).agg(F.min(time_us).alias("_began")), "began")
    summed = running_sum(progress, [load], [time_us, key], {rows: "rows_so_far"})
    elapsed = (F.col(time_us) - F.col("_began")) / 1e6
    return (
        keyed_join(summed, began, [load])
        .withColumn("elapsed_s", elapsed)
        .withColumn("rate", ratio(F.col("rows_so_far"), F.col("elapsed_s"), 0.0))
        .drop("_began")
    )


def load_rates(progress: DataFrame, load: str, time_us: str, key: str, rows: str) -> DataFrame:
    """Lowest, mean, highest and overall rows per second of each load."""
    running = running_load(progress, load, time_us, key, rows)
    rate = F.when(F.col("rate") > 0, F.col("rate"))
    return (
        running.groupBy(load)
        .agg(
            F.coalesce(F.min(rate), F.lit(0.0)).alias("min_rate"),
            F.coalesce(F.avg(rate), F.lit(0.0)).alias("avg_rate"),
            F.coalesce(F.max(rate), F.lit(0.0)).alias("max_rate"),
            F.max("rows_so_far").alias("total_rows"),
            F.max("elapsed_s").alias("duration_s"),
        )
        .withColumn("overall_rate", ratio(F.col("total_rows"), F.col("duration_s"), 0.0))
    )
