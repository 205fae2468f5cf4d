"""The five query families over one series."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.errors import SchemaError
from tidegauge.functions.buckets import EPOCH, bucket, interval_text, width_of
from tidegauge.functions.scalar import floor_div, micros
from tidegauge.operators.ordering import number_rows
from tidegauge.operators.prepare import literal_time, naive_utc, time_filter

Moment = datetime | str | None

# A bounded result is sorted in one task when it is no larger than this; beyond it the
# rows are numbered across the cluster.
SORT_IN_ONE_TASK = 2_000_000

# Slices the time range is cut into when looking for the ends of a limited scan.
TIME_SLICES = 4096
NULL_SLICE = -(1 << 62)

# Up to here a limit is taken as a top-k per task.
TOP_K_MAX = 10_000


def within(df: DataFrame, time: str, start: Moment, end: Moment, partition=None) -> DataFrame:
    """``time_filter`` when a window is given, the whole series otherwise."""
    if start is None and end is None:
        return df
    if start is None or end is None:
        raise SchemaError("give both ends of the window or neither")
    return time_filter(df, time, start, end, partition)


def time_range(
    df: DataFrame,
    time: str,
    start: Moment = None,
    end: Moment = None,
    key: Sequence[str] = (),
    limit: int = 0,
    partition=None,
) -> DataFrame:
    """All columns of the rows in the window; with ``limit`` the first ones by (time, key)."""
    rows = within(df, time, start, end, partition)
    if limit <= 0:
        return rows
    return slice_by_time(rows, time, list(key), 0, limit, None if start is None else (start, end))


def slice_by_time(
    df: DataFrame,
    time: str,
    key: list[str],
    offset: int,
    length: int,
    bounds: tuple[datetime | str, datetime | str] | None = None,
) -> DataFrame:
    """Rows ``offset`` .. ``offset + length - 1`` by (time, key).

    A count per slice of time tells which slices the wanted rows lie in; only these are
    read, and only their rows are sorted. ``bounds`` saves finding the first and last time.
    """
    if length <= 0:
        return df.limit(0)
    low, high = _micros_between(bounds) if bounds is not None else _micros_covered(df, time)
    if low is None or high < low:
        low = high = 0
    width = max(1, -(-(high - low + 1) // TIME_SLICES))
    # Null times come first, as in an ascending order.
    number = F.coalesce(floor_div(micros(F.col(time)) - F.lit(low), width), F.lit(NULL_SLICE))
    counts = df.groupBy(number.alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy("slice"))  # over at most TIME_SLICES rows
    held = (
        counts.withColumn("upto", upto)
        .where((F.col("upto") > offset) & (F.col("upto") - F.col("n") < offset + length))
        .agg(
            F.min("slice").alias("first"),
            F.max("slice").alias("last"),
            F.min(F.col("upto") - F.col("n")).alias("skipped"),
            F.sum("n").alias("size"),
        )
        .first()
    )
    if held["first"] is None:
        return df.limit(0)
    near = df.where(number.between(held["first"], held["last"]))
    if held["first"] >= 0 and dict(df.dtypes)[time] != "date":
        # The same bounds on the time itself reach the scan.
        at = lambda i: literal_time(df, time, EPOCH + timedelta(microseconds=low + i * width))
        near = near.where((F.col(time) >= at(held["first"])) & (F.col(time) < at(held["last"] + 1)))
    skip = offset - held["skipped"]
    if held["size"] <= SORT_IN_ONE_TASK:
        return near.orderBy(time, *key).offset(skip).limit(length)
    row = F.col("_row")
    return number_rows(near, [time, *key], "_row").where((row > skip) & (row <= skip + length)).drop("_row")


def _micros_covered(df: DataFrame, time: str) -> tuple[int | None, int | None]:
    at = micros(F.col(time))
    found = df.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    return found["low"], found["high"]


def _micros_between(bounds: tuple[datetime | str, datetime | str]) -> tuple[int, int]:
    low, high = (
        (naive_utc(datetime.fromisoformat(b) if isinstance(b, str) else b) - EPOCH) // timedelta(microseconds=1)
        for b in bounds
    )
    return low, high - 1


def limited(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``df`` in order, cut to ``n`` rows when ``n`` is positive.

    A small limit is a top-k per task and a merge; a large one would merge too much in
    one task, so the rows are numbered across the cluster instead.
    """
    if n <= 0:
        return df.orderBy(*order)
    if n <= TOP_K_MAX:
        return df.orderBy(*order).limit(n)
    return number_rows(df, list(order), "_row").where(F.col("_row") <= n).drop("_row").orderBy(*order)


def summaries(metrics: Sequence[str]) -> list[Column]:
    """avg, min and max of each metric, named ``avg_<metric>`` and so on."""
    return [
        function(F.col(m)).alias(f"{prefix}_{m}")
        for m in metrics
        for prefix, function in (("avg", F.avg), ("min", F.min), ("max", F.max))
    ]


def bucket_agg(
    df: DataFrame,
    time: str,
    metrics: str | Sequence[str],
    granularity: str | timedelta = "1 hour",
    start: Moment = None,
    end: Moment = None,
    origin: datetime = EPOCH,
    limit: int = 0,
) -> DataFrame:
    """avg, min and max per time bucket, in bucket order."""
    metrics = [metrics] if isinstance(metrics, str) else list(metrics)
    out = (
        within(df, time, start, end)
        .groupBy(bucket(time, granularity, origin).alias("bucket"))
        .agg(*summaries(metrics))
    )
    return limited(out, ["bucket"], limit)


def downsample(
    df: DataFrame,
    time: str,
    metric: str,
    granularity: str | timedelta,
    start: Moment = None,
    end: Moment = None,
    origin: datetime = EPOCH,
    limit: int = 0,
) -> DataFrame:
    """One resolution of a series: avg, min and max per bucket."""
    return bucket_agg(df, time, metric, granularity, start, end, origin, limit)


def last_point(
    df: DataFrame,
    tag: str,
    metric: str,
    time: str,
    key: Sequence[str] = (),
    start: Moment = None,
    end: Moment = None,
    limit: int = 0,
) -> DataFrame:
    """The newest row of each tag value; equal times are settled by ``key``, descending.

    The planner turns ``row_number = 1`` into a group limit before the exchange, so each
    task sends at most one row per tag value however many rows a tag has.
    """
    newest = W.partitionBy(tag).orderBy(*[F.desc(c) for c in (time, *key)])
    out = (
        within(df, time, start, end)
        .select(tag, metric, time, *key)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .select(tag, metric, time)
    )
    return limited(out, [tag], limit)


def last_point_agg(
    df: DataFrame,
    tag: str,
    metric: str,
    time: str,
    key: Sequence[str] = (),
    start: Moment = None,
    end: Moment = None,
) -> DataFrame:
    """``last_point`` as an aggregate: the better form when a task sees few rows per tag."""
    newest = F.max_by(F.struct(metric, time), F.struct(time, *key)).alias("_newest")
    return (
        within(df, time, start, end)
        .groupBy(tag)
        .agg(newest)
        .select(tag, f"_newest.{metric}", f"_newest.{time}")
        .orderBy(tag)
    )


def tag_agg(
    df: DataFrame,
    tag: str,
    metric: str,
    time: str,
    start: Moment = None,
    end: Moment = None,
    limit: int = 0,
) -> DataFrame:
    """Row count and average per tag value, in tag order."""
    out = (
        within(df, time, start, end)
        .groupBy(tag)
        .agg(F.count(F.lit(1)).alias("cnt"), F.avg(metric).alias(f"avg_{metric}"))
    )
    return limited(out, [tag], limit)


def partials(metrics: Sequence[str], df: DataFrame | None = None) -> list[Column]:
    """sum, count, min and max of each metric: the mergeable form of avg, min and max.

    With ``df``, whole numbers are summed as decimals, which don't overflow.
    """
    whole = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")} if df is not None else ()
    return [
        function(F.col(m).cast("decimal(20,0)") if prefix == "sum" and m in whole else F.col(m)).alias(f"{prefix}_{m}")
        for m in metrics
        for prefix, function in (("sum", F.sum), ("cnt", F.count), ("min", F.min), ("max", F.max))
    ]


def merged(metrics: Sequence[str]) -> list[Column]:
    """``partials`` of ``partials``."""
    return [
        function(F.col(f"{prefix}_{m}")).alias(f"{prefix}_{m}")
        for m in metrics
        for prefix, function in (("sum", F.sum), ("cnt", F.sum), ("min", F.min), ("max", F.max))
    ]


def average(metric: str) -> Column:
    """The average kept in ``partials``; null when every value was null."""
    count = F.col(f"cnt_{metric}")
    return F.when(count > 0, F.col(f"sum_{metric}").cast("double") / count)


def downsample_multi(
    df: DataFrame,
    time: str,
    metric: str,
    granularities: Sequence[str | timedelta] = ("1 minute", "1 hour", "1 day"),
    start: Moment = None,
    end: Moment = None,
    origin: datetime = EPOCH,
) -> DataFrame:
    """Several resolutions from one scan: ``granularity``, ``bucket``, avg, min, max.

    The series is aggregated once, to the widest buckets that nest in all the wanted
    ones; every resolution is merged from those partial results.
    """
    widths = [width_of(g) for g in granularities]
    step = timedelta(microseconds=math.gcd(*[w // timedelta(microseconds=1) for w in widths]))
    base = (
        within(df, time, start, end)
        .where(F.col(time).isNotNull())
        .groupBy(bucket(time, step, origin).alias("_base"))
        .agg(*partials([metric], df))
    )
    starts = [f"_start{i}" for i in range(len(widths))]
    for name, width in zip(starts, widths):
        base = base.withColumn(name, bucket("_base", width, origin))
    levels = F.array(
        *[
            F.struct(F.lit(_label(g)).alias("granularity"), F.col(name).alias("bucket"))
            for name, g in zip(starts, granularities)
        ]
    )
    return (
        base.select(F.explode(levels).alias("_level"), *[f"{p}_{metric}" for p in ("sum", "cnt", "min", "max")])
        .groupBy(F.col("_level.granularity").alias("granularity"), F.col("_level.bucket").alias("bucket"))
        .agg(*merged([metric]))
        .select("granularity", "bucket", average(metric).alias(f"avg_{metric}"), f"min_{metric}", f"max_{metric}")
        .orderBy("granularity", "bucket")
    )


def _label(granularity: str | timedelta) -> str:
    return granularity if isinstance(granularity, str) else interval_text(granularity)
