"""Reproducible synthetic sensors, query windows and disorder.

Every random number is a hash of the row it belongs to, so the output does not depend on
how the rows are partitioned or how often a task runs.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions.buckets import EPOCH, interval_text
from tidegauge.functions.scalar import hashed_bits, hashed_unit, micros
from tidegauge.operators.keys import keyed_join
from tidegauge.operators.prepare import time_filter
from tidegauge.operators.queries import slice_by_time
from tidegauge.schema import SeriesSchema
from tidegauge.sources.extent import time_bounds

# Start of the grid, its span in seconds, and the sensors' distributions.
GRID_START = datetime(2024, 1, 1)
GRID_SECONDS = 86400.0
TEMPERATURE = {"mean": 20.0, "stddev": 5.0, "low": -40.0, "high": 125.0}
HUMIDITY = {"alpha": 2, "beta": 5, "scale": 100.0}
VOLTAGE = {"mean": 3.3, "stddev": 0.1}
PRESSURE = {"mean": 101325.0, "stddev": 200.0}

# Rows one expanded block holds.
READINGS_PER_BLOCK = 10_000

# How late a late window starts, in minutes before the end of the data.
LATE_FROM, LATE_TO = 30, 48 * 60
LATE_LENGTH = timedelta(hours=1)


def _uniform(seed: int, draw: int, *row: str) -> Column:
    """A uniform number in (0, 1): 53 bits of a hash of the row, the seed and the draw."""
    bits = F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in row], F.lit(seed), F.lit(draw)), 11)
    return (bits.cast("double") + 0.5) * F.lit(2.0**-53)


def _normal(seed: int, draw: int, mean: float, stddev: float, *row: str) -> Column:
    radius = F.sqrt(F.lit(-2.0) * F.log(_uniform(seed, draw, *row)))
    return F.lit(mean) + F.lit(stddev) * radius * F.cos(F.lit(2.0 * math.pi) * _uniform(seed, draw + 1, *row))


def _beta(seed: int, draw: int, alpha: int, beta: int, *row: str) -> Column:
    """Beta with whole parameters: an order statistic of alpha + beta - 1 uniforms."""
    draws = [_uniform(seed, draw + i, *row) for i in range(alpha + beta - 1)]
    return F.element_at(F.array_sort(F.array(*draws)), alpha)


def with_sensors(grid: DataFrame, seed: int = 42) -> DataFrame:
    """Add the four sensor values to rows of ``device`` and ``reading`` numbers."""
    row = ("device", "reading")
    t, h = TEMPERATURE, HUMIDITY
    return grid.withColumns(
        {
            "temperature": F.greatest(
                F.lit(t["low"]),
                F.least(F.lit(t["high"]), _normal(seed, 0, t["mean"], t["stddev"], *row)),
            ),
            "humidity": _beta(seed, 10, h["alpha"], h["beta"], *row) * F.lit(h["scale"]),
            "voltage": _normal(seed, 20, VOLTAGE["mean"], VOLTAGE["stddev"], *row),
            "pressure": _normal(seed, 30, PRESSURE["mean"], PRESSURE["stddev"], *row),
        }
    )


def _readings(grid: DataFrame, start: datetime, step_nanos: int, seed: int) -> DataFrame:
    origin = (start - EPOCH) // timedelta(microseconds=1)
    offset = F.call_function("div", F.col("reading") * F.lit(step_nanos).cast("bigint"), F.lit(1000))
    return with_sensors(grid, seed).select(
        F.timestamp_micros(offset + F.lit(origin)).alias("timestamp"),
        F.format_string("device_%06d", "device").alias("device_id"),
        "temperature",
        "humidity",
        "voltage",
        "pressure",
    )


def _step_nanos(readings: int, interval_seconds: float | None) -> int:
    if interval_seconds is None:
        interval_seconds = GRID_SECONDS / max(readings - 1, 1)
    return int(interval_seconds * 1e9)


def generate_series(
    devices: DataFrame,
    readings: int,
    start: datetime = GRID_START,
    interval_seconds: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """A regular grid of readings for the device numbers in ``devices(device bigint)``.

    By default the readings span exactly 24 hours. Series are cut into blocks, and these
    are spread over the tasks before they are expanded.
    """
    readings = max(readings, 1)
    blocks = F.sequence(F.lit(0).cast("bigint"), F.lit((readings - 1) // READINGS_PER_BLOCK).cast("bigint"))
    spread = devices.select(F.col("device").cast("bigint").alias("device"), F.explode(blocks).alias("_block"))
    # A fixed number of tasks: the blocks are small until they are expanded, so their size
    # would be a wrong guide.
    tasks = int(devices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.repartition(tasks, "device", "_block")
    first = F.col("_block") * READINGS_PER_BLOCK
    last = F.least(first + READINGS_PER_BLOCK, F.lit(readings).cast("bigint")) - 1
    grid = spread.select("device", F.explode(F.sequence(first, last)).alias("reading"))
    return _readings(grid, start, _step_nanos(readings, interval_seconds), seed)


def generate_iot(
    spark: SparkSession,
    n_devices: int = 100,
    n_readings: int = 100,
    start: datetime = GRID_START,
    interval_seconds: float | None = None,
    seed: int = 42,
    first_device: int = 0,
) -> DataFrame:
    """``n_devices`` numbered sensors with ``n_readings`` each, split evenly over the tasks."""
    readings = max(n_readings, 1)
    rows = spark.range(first_device * readings, (first_device + n_devices) * readings)
    grid = rows.select(
        F.expr(f"id div {readings}").alias("device"), F.pmod("id", F.lit(readings)).alias("reading")
    )
    return _readings(grid, start, _step_nanos(readings, interval_seconds), seed)


def iot_schema(df: DataFrame, name: str = "iot") -> SeriesSchema:
    return SeriesSchema(
        name, "timestamp", ("device_id",), ("temperature", "humidity", "voltage", "pressure"), df.schema
    )


def random_windows(
    df: DataFrame, time: str, n: int, length: timedelta, seed: int = 42, repeat_full: bool = False
) -> DataFrame:
    """``n`` windows placed at random inside the series; they may overlap.

    A series no longer than a window gives its full span once, or ``n`` times when
    ``repeat_full``; an empty one gives none.
    """
    if n <= 0:
        return random_windows(df, time, 1, length, seed).limit(0)
    bounds = time_bounds(df, time).select(
        F.col("min_ts").cast("timestamp_ntz"), F.col("max_ts").cast("timestamp_ntz")
    )
    span = micros(F.col("max_ts")) - micros(F.col("min_ts"))
    micros_long = F.lit(length // timedelta(microseconds=1)).cast("bigint")
    ids = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    once = F.array(F.lit(0).cast("bigint"))
    short = span <= micros_long
    # From the single row of bounds: window i lies at a hashed offset from its start.
    offset = F.floor(hashed_unit([F.lit("window"), F.lit(seed), F.col("window_id")]) * (span - micros_long))
    start = F.when(short, F.col("min_ts")).otherwise(
        F.timestamp_micros(micros(F.col("min_ts")) + offset.cast("bigint")).cast("timestamp_ntz")
    )
    end = F.when(short, F.col("max_ts")).otherwise(F.col("start") + F.expr(f"interval {interval_text(length)}"))
    return (
        bounds.where(F.col("min_ts").isNotNull())
        .withColumn("window_id", F.explode(F.when(short & F.lit(not repeat_full), once).otherwise(ids)))
        .withColumn("start", start)
        .withColumn("end", end)
        .select("window_id", "start", "end")
    )


def shuffle_timestamps(df: DataFrame, time: str, batch: str, key: str) -> DataFrame:
    """Permute ``time`` among the rows of each batch, seeded by the batch's row count.

    A batch is what one write carries (see ``chunk_rows``), so its size is bounded.
    """
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_size"))
    sized = keyed_join(df, sizes, [batch])
    natural = W.partitionBy(batch).orderBy(key)
    mixed = W.partitionBy(batch).orderBy(hashed_bits([F.col("_size"), F.col(key)]), key)
    placed = sized.withColumn("_slot", F.row_number().over(natural))
    donors = sized.select(batch, F.col(time).alias("_ts"), F.row_number().over(mixed).alias("_slot"))
    moved = keyed_join(placed, donors, [batch, "_slot"])
    return moved.withColumn(time, F.col("_ts")).select(*df.columns)


def late_windows(df: DataFrame, time: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` one-hour windows starting 30 minutes to 48 hours before the last row."""
    if n <= 0:
        return late_windows(df, time, 1, seed).limit(0)
    last = df.agg(F.max(time).cast("timestamp_ntz").alias("max_ts")).where(F.col("max_ts").isNotNull())
    unit = hashed_unit([F.lit("late"), F.lit(seed), F.col("window_id")])
    minutes = F.lit(LATE_FROM) + F.floor(unit * F.lit(LATE_TO - LATE_FROM)).cast("int")
    ids = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    return (
        last.withColumn("window_id", F.explode(ids))
        .withColumn("start", F.col("max_ts") - F.make_dt_interval(mins=minutes))
        .withColumn("end", F.col("start") + F.expr(f"interval {interval_text(LATE_LENGTH)}"))
        .select("window_id", "start", "end")
    )


def late_rows(
    df: DataFrame, time: str, key: str, start: datetime, end: datetime, n: int, seed: int = 42
) -> DataFrame:
    """``n`` rows for the window: a sample of its own rows when it has that many, else a
    sample of the whole series with times drawn inside the window."""
    if end <= start:
        return df.limit(0)
    own = time_filter(df, time, start, end)
    if own.limit(n).count() == n:
        return _hash_sample(own, key, n, seed)
    low = (start - EPOCH) // timedelta(microseconds=1)
    length = (end - start) // timedelta(microseconds=1)
    drawn = F.timestamp_micros(
        F.lit(low) + F.pmod(hashed_bits([F.lit("stamp"), F.lit(seed), F.col(key)]), F.lit(length).cast("bigint"))
    )
    return _hash_sample(df, key, n, seed).withColumn(time, drawn.cast(df.schema[time].dataType))


def _hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest hash, which is a sample without replacement.

    Hashes are uniform, so a slice of them is about ``n`` rows and no more are sorted.
    """
    hashed = hashed_bits([F.lit("sample"), F.lit(seed), F.col(key)])
    ranked = df.withColumn("_hash", F.timestamp_micros(F.shiftright(hashed, 8)))
    span = (EPOCH, EPOCH + timedelta(microseconds=1 << 52))
    return slice_by_time(ranked, "_hash", [key], 0, n, span).drop("_hash")
