"""Judging summaries against thresholds and against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import ratio
from tidegauge.operators.compare import ROW_KEYS
from tidegauge.operators.keys import keyed_join
from tidegauge.operators.runs import is_throughput

# p99 in ms up to which an operation is great, solid, fair. An operation
# takes the row it is named after, else the longest row its name starts with.
LATENCY_THRESHOLDS = {
    "aggregation_1min": (15, 50, 400),
    "aggregation_1h": (35, 150, 1500),
    "aggregation_1day": (75, 650, 6500),
    "aggregation_1week": (150, 1300, 13000),
    "high_cardinality_1min": (20, 75, 650),
    "high_cardinality_1h": (75, 400, 4000),
    "high_cardinality_1day": (250, 2000, 18000),
    "high_cardinality_1week": (650, 6500, 38000),
    "time_range_1min": (20, 75, 650),
    "time_range_1h": (75, 400, 4000),
    "time_range_1day": (250, 2000, 18000),
    "time_range_1week": (650, 6500, 38000),
    "last_point": (150, 1300, 13000),
    "downsampling": (650, 6500, 38000),
    "mixed_read": (150, 1300, 6500),
    "mixed_write": (20, 150, 1500),
}
DEFAULT_THRESHOLD = (75, 650, 6500)

# Rows per second from which a throughput is great, solid, fair.
THROUGHPUT_THRESHOLDS = (500_000, 100_000, 20_000)

LEVELS = ("Great", "Solid", "Fair", "Slow")


def thresholds(operation: Column) -> Column:
    """``array(great, solid, fair)`` of an operation.

    The table is a constant, so the lookup is an expression and costs no join.
    """
    as_array = lambda row: F.array(*[F.lit(float(v)) for v in row])
    exact = F.coalesce(*[F.when(operation == n, as_array(t)) for n, t in LATENCY_THRESHOLDS.items()])
    longest_first = sorted(LATENCY_THRESHOLDS.items(), key=lambda item: -len(item[0]))
    prefix = F.coalesce(*[F.when(operation.startswith(n), as_array(t)) for n, t in longest_first])
    return F.coalesce(exact, prefix, as_array(DEFAULT_THRESHOLD))


def latency_level(p99_ms: Column, operation: Column) -> Column:
    limits = thresholds(operation)
    return (
        F.when(p99_ms <= limits[0], LEVELS[0])
        .when(p99_ms <= limits[1], LEVELS[1])
        .when(p99_ms <= limits[2], LEVELS[2])
        .otherwise(LEVELS[3])
    )


def throughput_level(rate: Column) -> Column:
    great, solid, fair = THROUGHPUT_THRESHOLDS
    return (
        F.when(rate >= great, LEVELS[0]).when(rate >= solid, LEVELS[1]).when(rate >= fair, LEVELS[2]).otherwise(LEVELS[3])
    )


def absolute_level(benchmark: Column) -> Column:
    rate = F.coalesce(F.col("rows_per_second_mean"), F.lit(0.0))
    p99 = F.coalesce(F.col("latency_p99_ms"), F.lit(0.0))
    return F.when(is_throughput(benchmark), throughput_level(rate)).otherwise(
        latency_level(p99, F.col("operation"))
    )


def verdict_absolute(summaries: DataFrame, benchmark: str = "benchmark_name") -> DataFrame:
    """Great, Solid, Fair or Slow for every summary."""
    return summaries.withColumn("verdict", absolute_level(F.col(benchmark)))


def three_levels(level: Column) -> Column:
    return F.when(level.isin("Great", "Solid"), "OK").otherwise(level)


def verdict_report(summaries: DataFrame, benchmark: str = "benchmark_name") -> DataFrame:
    """OK, Fair or Slow for every summary."""
    return summaries.withColumn("verdict", three_levels(absolute_level(F.col(benchmark))))


def _score(benchmark: Column) -> Column:
    """Smaller is better: the negative rate, or p99 with unknown and zero last."""
    p99 = F.col("latency_p99_ms")
    slow = F.when(p99.isNull() | (p99 == 0), F.lit(float("inf"))).otherwise(p99)
    return F.when(is_throughput(benchmark), -F.coalesce(F.col("rows_per_second_mean"), F.lit(0.0))).otherwise(slow)


def verdict_relative(
    summaries: DataFrame,
    benchmark: str = "benchmark_name",
    key: str = "id",
    group: Sequence[str] = ROW_KEYS,
) -> DataFrame:
    """Fastest, Slowest or Middle among the summaries of a group; groups of one are left out.

    Only the two ends of a group matter, so they are aggregated and joined back rather
    than ranked: no group is sorted.
    """
    keys = [benchmark, *group]
    scored = summaries.withColumn("_place", F.struct(_score(F.col(benchmark)).alias("score"), F.col(key)))
    ends = scored.groupBy(*keys).agg(
        F.min("_place").alias("_best"), F.max("_place").alias("_worst"), F.count(F.lit(1)).alias("_n")
    )
    place = F.col("_place")
    verdict = F.when(place == F.col("_best"), "Fastest").when(place == F.col("_worst"), "Slowest").otherwise("Middle")
    return (
        keyed_join(scored, ends.where(F.col("_n") > 1), keys)
        .withColumn("verdict", verdict)
        .drop("_place", "_best", "_worst", "_n")
    )


def assign_verdicts(summaries: DataFrame, benchmark: str = "benchmark_name", key: str = "id") -> DataFrame:
    """Relative verdicts where there is something to compare with, absolute ones elsewhere."""
    relative = verdict_relative(summaries, benchmark, key).select(key, F.col("verdict").alias("_relative"))
    joined = keyed_join(verdict_absolute(summaries, benchmark), relative, [key], "left")
    return joined.withColumn("verdict", F.coalesce("_relative", "verdict")).drop("_relative")


def best_per_benchmark(summaries: DataFrame, benchmark: str = "benchmark_name", key: str = "id") -> DataFrame:
    """The summary with the highest rate, or the lowest p99, of each benchmark."""
    rate = F.coalesce(F.col("rows_per_second_mean"), F.lit(0.0))
    score = F.when(is_throughput(F.col(benchmark)), -rate).otherwise(F.col("latency_p99_ms"))
    columns = F.struct("operation", "database_name", "rows_per_second_mean", "latency_p99_ms")
    return (
        summaries.withColumn("_score", score)
        .where(F.col("_score").isNotNull())
        .groupBy(benchmark)
        .agg(F.min_by(columns, F.struct("_score", key)).alias("_row"))
        .select(benchmark, "_row.*")
    )


def leader_trailer(
    summaries: DataFrame, benchmark: str = "benchmark_name", key: str = "id"
) -> DataFrame:
    """Best and worst database per operation with their ratio, where there are two or more.

    A rate's ratio is best over worst, a latency's worst over best.
    """
    fast = is_throughput(F.col(benchmark))
    rate = F.coalesce(F.col("rows_per_second_mean"), F.lit(0.0))
    p99 = F.coalesce(F.col("latency_p99_ms"), F.lit(0.0))
    value = F.when(fast, rate).otherwise(p99)
    lead = F.when(fast, -rate).otherwise(F.when(p99 == 0, F.lit(float("inf"))).otherwise(p99))
    trail = F.when(fast, rate).otherwise(-p99)
    who = F.struct("database_name", "_value")
    ends = (
        summaries.where(F.col("latency_p50_ms").isNotNull())
        .withColumns({"_value": value, "_lead": lead, "_trail": trail})
        .groupBy(benchmark, "operation")
        .agg(
            F.min_by(who, F.struct("_lead", key)).alias("_best"),
            F.min_by(who, F.struct("_trail", key)).alias("_worst"),
            F.count(F.lit(1)).alias("_n"),
        )
        .where(F.col("_n") > 1)
    )
    best, worst = F.col("_best._value"), F.col("_worst._value")
    return ends.select(
        benchmark,
        "operation",
        F.col("_best.database_name").alias("best_database"),
        best.alias("best_value"),
        F.col("_worst.database_name").alias("worst_database"),
        worst.alias("worst_value"),
        F.when(fast, ratio(best, worst)).otherwise(ratio(worst, best)).alias("ratio"),
    )


def report_rollup(summaries: DataFrame, runs: DataFrame, benchmark: str = "benchmark_name") -> DataFrame:
    """One row: rows in the largest summary, peak rate, mean of the best query p99s,
    benchmarks that passed of all, and runs that never finished."""
    best = verdict_report(best_per_benchmark(summaries, benchmark), benchmark)
    fast = is_throughput(F.col(benchmark))
    headline = best.agg(
        F.coalesce(F.max(F.when(fast, F.col("rows_per_second_mean"))), F.lit(0.0)).alias("peak_rows_per_second"),
        F.avg(F.when(~fast, F.col("latency_p99_ms"))).alias("mean_query_p99_ms"),
        F.count(F.when(F.col("verdict") == "OK", 1)).alias("passed"),
    )
    largest = summaries.agg(F.max("total_rows").alias("v")).scalar()
    tested = summaries.agg(F.count_distinct(benchmark).alias("v")).scalar()
    unfinished = runs.agg(F.count(F.when(F.col("completed_at").isNull(), 1)).alias("v")).scalar()
    return headline.select(
        largest.alias("max_total_rows"),
        "peak_rows_per_second",
        "mean_query_p99_ms",
        "passed",
        tested.alias("total"),
        unfinished.alias("unfinished_runs"),
    )
