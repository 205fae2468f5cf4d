"""Side-by-side views of summaries: pivots, deltas, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.errors import SchemaError
from tidegauge.functions.scalar import ratio
from tidegauge.operators.keys import same_keys

ROW_KEYS = ("operation", "batch_size", "workers")

# A pivot with more columns than this is a mistake, not a table.
PIVOT_MAX = 1000


def distinct_values(df: DataFrame, column: str, limit: int = PIVOT_MAX) -> list:
    """The values a pivot needs as columns; refused when there are too many."""
    values = [r[0] for r in df.select(column).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise SchemaError(f"{column!r} has more than {limit} values; give the ones to show")
    return sorted(v for v in values if v is not None)


def compare_pivot(
    summaries: DataFrame, metric: str, databases: Sequence[str] | None = None, version: str = "id"
) -> DataFrame:
    """One column per database with the metric of the last summary of each cell."""
    databases = distinct_values(summaries, "database_name") if databases is None else list(databases)
    return (
        summaries.groupBy(*ROW_KEYS)
        .pivot("database_name", databases)
        .agg(F.max_by(metric, version))
        .orderBy(*ROW_KEYS)
    )


def run_id_pivot(
    summaries: DataFrame, databases: Sequence[str] | None = None, version: str = "id"
) -> DataFrame:
    """Which run each cell of ``compare_pivot`` comes from."""
    return compare_pivot(summaries, "run_id", databases, version)


def compare_runs(a: DataFrame, b: DataFrame, metric: str, version: str = "id") -> DataFrame:
    """Both runs' metric per operation, batch size, workers and database, and the change
    from a to b in percent (null when a is missing or zero, or b is missing)."""
    keys = [*ROW_KEYS, "database_name"]
    last = lambda df, name: df.groupBy(*keys).agg(F.max_by(metric, version).alias(name))
    right = last(b, "value_b").select(*[F.col(k).alias(f"__{k}") for k in keys], "value_b")
    joined = last(a, "value_a").join(right, same_keys(keys), "full_outer")
    delta = ratio((F.col("value_b") - F.col("value_a")) * 100.0, F.col("value_a"))
    return joined.select(
        *[F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in keys],
        "value_a",
        "value_b",
        delta.alias("delta_pct"),
    ).orderBy(*keys)


def mean_by_op_db(
    summaries: DataFrame, metric: str, row: str = "operation", column: str = "database_name"
) -> DataFrame:
    return summaries.groupBy(row, column).agg(_three_digits(metric).alias(metric))


def _three_digits(metric: str) -> Column:
    """The mean to three digits. Nine digits first, so that a tie does not hang on the last
    bit of a sum, which depends on the order the rows were added in."""
    return F.round(F.round(F.avg(metric), 9), 3)


# How percentile columns are labelled.
PERCENTILE_LABELS = {
    "latency_p50_ms": "P50",
    "latency_p95_ms": "P95",
    "latency_p99_ms": "P99",
    "latency_p999_ms": "P99.9",
}


def percentile_melt(summaries: DataFrame, by_operation: bool = True) -> DataFrame:
    """Percentile columns as rows, averaged per operation, percentile and database."""
    columns = [c for c in PERCENTILE_LABELS if c in summaries.columns]
    label = F.coalesce(
        *[F.when(F.col("percentile") == c, F.lit(PERCENTILE_LABELS[c])) for c in columns]
    )
    keys = ["operation", "percentile", "database_name"] if by_operation else ["percentile", "database_name"]
    return (
        summaries.unpivot(["operation", "database_name"], columns, "percentile", "latency_ms")
        .where(F.col("latency_ms").isNotNull())
        .withColumn("percentile", label)
        .groupBy(*keys)
        .agg(_three_digits("latency_ms").alias("latency_ms"))
    )


def throughput_series(summaries: DataFrame, metric: str = "rows_per_second_mean") -> DataFrame:
    """The metric along growing batch sizes."""
    return summaries.select("operation", "database_name", "batch_size", metric).orderBy("batch_size")


def overview(summaries: DataFrame) -> DataFrame:
    """Runs, operations, databases and rows in a selection of summaries."""
    return summaries.agg(
        F.count_distinct("run_id").alias("runs"),
        F.count_distinct("operation").alias("operations"),
        F.count_distinct("database_name").alias("databases"),
        F.coalesce(F.sum("total_rows"), F.lit(0)).cast("bigint").alias("total_rows"),
    )


def cv_percent(summaries: DataFrame) -> DataFrame:
    """Spread relative to the mean, in percent; null when the mean is not positive."""
    mean = F.col("latency_mean_ms")
    return summaries.withColumn(
        "cv_percent", F.when(mean > 0, F.col("latency_stddev_ms") / mean * 100.0)
    )


def scaling_table(
    summaries: DataFrame,
    metric: str,
    workers: Sequence[int] | None = None,
    keys: Sequence[str] = ("database_name",),
) -> DataFrame:
    """The metric by number of workers, and how much the widest costs over the narrowest."""
    workers = distinct_values(summaries, "workers") if workers is None else sorted(workers)
    wide = summaries.groupBy(*keys).pivot("workers", list(workers)).agg(F.avg(metric))
    named = wide.select(*keys, *[F.col(str(w)).alias(f"workers_{w}") for w in workers])
    return named.withColumn(
        "degradation", ratio(F.col(f"workers_{workers[-1]}"), F.col(f"workers_{workers[0]}"))
    )


def throughput_rank(summaries: DataFrame, metric: str = "rows_per_second_mean") -> DataFrame:
    """Databases ranked by their mean rate within each operation.

    The rank sees one row per database, after the aggregate.
    """
    means = summaries.groupBy("operation", "database_name").agg(F.avg(metric).alias(metric))
    best_first = W.partitionBy("operation").orderBy(F.desc(F.round(metric, 6)))
    return means.withColumn("rank", F.rank().over(best_first))
