"""Roll-up tables: build, read, and refresh only what late rows touched.

A roll-up keeps sum, count, min and max per metric, because averages cannot be merged. It
is partitioned by the date of the bucket (by its month or year when buckets are a day or
longer), so a refresh replaces whole partitions and leaves the others alone. Every write is a
snapshot (``sinks/snapshots.py``): readers see it whole or not at all, and partitions that
have no rows any more go with the same switch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.buckets import EPOCH, align_out, bucket, ceil_to, width_of
from tidegauge.functions.scalar import ratio
from tidegauge.operators.prepare import literal_time, naive_utc, partition_value, time_filter
from tidegauge.operators.queries import average, partials, within
from tidegauge.schema import SeriesSchema
from tidegauge.sinks.snapshots import Snapshot, SnapshotTable

BUCKET, DATE = "ts_bucket", "bucket_date"


def bucket_tag_agg(
    df: DataFrame,
    time: str,
    tags: Sequence[str],
    metric: str,
    granularity: str | timedelta = "1 hour",
    start=None,
    end=None,
    origin: datetime = EPOCH,
) -> DataFrame:
    """The average per bucket and tags, straight from the raw rows."""
    return (
        within(df, time, start, end)
        .groupBy(bucket(time, granularity, origin).alias(BUCKET), *tags)
        .agg(F.avg(metric).alias(f"avg_{metric}"))
        .orderBy(BUCKET, *tags)
    )


@dataclass(frozen=True)
class Rollup:
    """Where a roll-up lives and what it holds."""

    path: str
    time: str
    tags: tuple[str, ...]
    metrics: tuple[str, ...]
    granularity: str | timedelta = "1 hour"
    origin: datetime = EPOCH

    @classmethod
    def of(cls, schema: SeriesSchema, path: str, granularity: str | timedelta = "1 hour") -> Rollup:
        return cls(path, schema.time, schema.tags, schema.metrics, granularity)

    @property
    def table(self) -> SnapshotTable:
        return SnapshotTable(self.path, DATE)

    @property
    def unit(self) -> str:
        """What a partition covers: enough buckets that its files are worth opening."""
        width = width_of(self.granularity)
        if width < timedelta(days=1):
            return "DAY"
        return "MONTH" if width < timedelta(days=7) else "YEAR"

    def rows(self, df: DataFrame) -> DataFrame:
        """The roll-up of the raw rows; one exchange on (bucket, tags) after a partial
        aggregate, so a hot bucket or tag arrives as one row per task."""
        return (
            df.where(F.col(self.time).isNotNull()).groupBy(bucket(self.time, self.granularity, self.origin).alias(BUCKET), *self.tags)
            .agg(*partials(self.metrics, df))
            .withColumn(DATE, partition_value(F.col(BUCKET), self.unit))
        )


def create_rollup(df: DataFrame, rollup: Rollup) -> None:
    """Build the roll-up from the whole series, replacing what is there."""
    store_partitions(rollup.rows(df), rollup)


def store_partitions(rows: DataFrame, rollup: Rollup, replaced: Callable[[str], bool] | None = None) -> Snapshot:
    """Store rows of the roll-up's shape as its partitions named ``replaced`` (all, by default)."""
    return rollup.table.stage(rows, [BUCKET]).commit(rows.sparkSession, replaced)


def refresh_rollup(
    df: DataFrame,
    rollup: Rollup,
    start: datetime | None = None,
    end: datetime | None = None,
    partition: tuple[str, str] | None = None,
) -> tuple[datetime, datetime] | None:
    """Recompute the buckets a window touches; without a window, all of them.

    The window grows to whole buckets and then to whole partitions, the unit that is
    replaced. Returns the raw time range that was read. ``partition=(column, unit)`` names
    the raw table's time partition, so that only the partitions in range are opened.
    """
    if start is None or end is None:
        create_rollup(df, rollup)
        return None
    span = affected(rollup, naive_utc(start), naive_utc(end))
    # The dates of the partitions that the first and the last bucket of the span start in.
    ends = span[0], span[1] - width_of(rollup.granularity)
    first, last = (partition_start(m, rollup.unit).date() for m in ends)
    rows = rollup.rows(time_filter(df, rollup.time, *span, partition))
    store_partitions(rows, rollup, lambda name: first <= date.fromisoformat(name) <= last)
    return span


def affected(rollup: Rollup, start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The raw rows behind every bucket that starts in a partition the window touches."""
    low, high = align_out(start, end, rollup.granularity, rollup.origin)
    last = high - width_of(rollup.granularity)
    return (
        ceil_to(partition_start(low, rollup.unit), rollup.granularity, rollup.origin),
        ceil_to(partition_after(last, rollup.unit), rollup.granularity, rollup.origin),
    )


def partition_start(moment: datetime, unit: str) -> datetime:
    day = datetime(moment.year, moment.month, moment.day)
    if unit == "DAY":
        return day
    return day.replace(day=1) if unit == "MONTH" else day.replace(month=1, day=1)


def partition_after(moment: datetime, unit: str) -> datetime:
    """The start of the partition that follows the one of ``moment``."""
    longest = {"DAY": 1, "MONTH": 31, "YEAR": 366}[unit]
    return partition_start(partition_start(moment, unit) + timedelta(days=longest), unit)


def read_rollup(
    spark: SparkSession, rollup: Rollup, number: int | None = None, wanted: Callable[[str], bool] | None = None
) -> DataFrame:
    """The newest state, or that of snapshot ``number``; of the partitions ``wanted``, if given."""
    return rollup.table.read(spark, number, wanted)


def query_rollup(
    spark: SparkSession,
    rollup: Rollup,
    start: datetime | None = None,
    end: datetime | None = None,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """avg, min and max of the buckets that start in the window, in bucket order.

    The bounds go on the partition as well, so other partitions' files are never opened.
    """
    if start is None or end is None:
        stored = read_rollup(spark, rollup)
    else:
        start, end = naive_utc(start), naive_utc(end)
        first, last = partition_start(start, rollup.unit).date(), end.date()
        stored = read_rollup(spark, rollup, wanted=lambda name: first <= date.fromisoformat(name) <= last)
        low, high = literal_time(stored, BUCKET, start), literal_time(stored, BUCKET, end)
        stored = stored.where(
            (F.col(BUCKET) >= low)
            & (F.col(BUCKET) < high)
            & (F.col(DATE) >= F.lit(first))
            & (F.col(DATE) <= F.lit(last))
        )
    return averages(stored, rollup, metrics).orderBy(BUCKET, *rollup.tags)


def averages(rows: DataFrame, rollup: Rollup, metrics: Sequence[str] | None = None) -> DataFrame:
    """avg, min and max from stored partial results."""
    wanted = rollup.metrics if metrics is None else metrics
    values = [
        c for m in wanted for c in (average(m).alias(f"avg_{m}"), F.col(f"min_{m}"), F.col(f"max_{m}"))
    ]
    return rows.select(BUCKET, *rollup.tags, *values)


def rollup_vs_raw(
    df: DataFrame, rollup: Rollup, metric: str, start: datetime, end: datetime, digits: int = 6
) -> DataFrame:
    """Buckets on which the roll-up and the raw rows disagree, over whole buckets.

    ``side`` says where the row was found; an up-to-date roll-up gives no rows.
    """
    low, high = align_out(start, end, rollup.granularity, rollup.origin)
    name = f"avg_{metric}"
    keys = [BUCKET, *rollup.tags]
    stored = query_rollup(df.sparkSession, rollup, low, high, [metric]).select(*keys, F.col(name).alias("_stored"))
    raw = within(df, rollup.time, low, high).select(
        bucket(rollup.time, rollup.granularity, rollup.origin).alias(BUCKET), *rollup.tags, F.col(metric).alias("_raw")
    )
    # Raw rows and the roll-up's meet in one aggregate, which combines before its exchange.
    both = (
        raw.withColumn("_is_raw", F.lit(True))
        .unionByName(stored.withColumn("_is_raw", F.lit(False)), allowMissingColumns=True)
        .groupBy(*keys)
        .agg(
            F.avg("_raw").alias("_raw"), F.max("_stored").alias("_stored"),
            F.max("_is_raw").alias("_in_raw"), F.max(~F.col("_is_raw")).alias("_in_stored"),
        )
    )
    types = {f.name: f.dataType for f in both.schema}
    value = lambda c: F.round(F.col(c) if types["_raw"] == types["_stored"] else F.col(c).cast("double"), digits)
    side = lambda label, c, here: F.when(here, F.struct(F.lit(label).alias("side"), value(c).alias(name)))
    sides = F.array(side("raw", "_raw", F.col("_in_raw")), side("rollup", "_stored", F.col("_in_stored")))
    same = F.col("_in_raw") & F.col("_in_stored") & value("_raw").eqNullSafe(value("_stored"))
    apart = both.where(~same).select(*keys, F.explode(F.array_compact(sides)).alias("_one"))
    return apart.select("_one.side", *keys, F.col("_one")[name].alias(name))


def speedup(log: DataFrame, raw: str, rollup: str, keys: Sequence[str] = ("database_name",)) -> DataFrame:
    """Mean raw time over mean roll-up time per group; 0 when the roll-up's is 0."""
    mean = lambda op: F.avg(F.when(F.col("operation") == op, F.col("elapsed_ns") / 1e6))
    return (
        log.where(F.col("operation").isin(raw, rollup))
        .groupBy(*keys)
        .agg(mean(raw).alias("raw_mean_ms"), mean(rollup).alias("rollup_mean_ms"))
        .where(F.col("raw_mean_ms").isNotNull() & F.col("rollup_mean_ms").isNotNull())
        .withColumn("speedup", ratio(F.col("raw_mean_ms"), F.col("rollup_mean_ms"), 0.0))
    )
