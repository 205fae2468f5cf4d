"""Turning native, date, epoch and text columns into UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.errors import SchemaError
from tidegauge.functions.scalar import floor_div

# An integer epoch above the first bound is nanoseconds, at or below the
# last one it is not an epoch at all; seconds end where the year 5138 begins.
NANOS_ABOVE = 10**18
SECONDS_UP_TO = 10**11
SECONDS_ABOVE = 10**9

# Text layouts tried after ISO-8601, in order.
TEXT_LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ssXX",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "yyyyMMdd'T'HHmmss",
    "yyyyMMdd",
    "MMMM d, yyyy HH:mm:ss",
    "MMMM d, yyyy",
    "MMM d, yyyy HH:mm:ss",
    "MMM d, yyyy",
    "d MMMM yyyy HH:mm:ss",
    "d MMMM yyyy",
    "d MMM yyyy HH:mm:ss",
    "d MMM yyyy",
)

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def parse_text(col: Column, strict: bool = True) -> Column:
    """Parse text to a timestamp; nulls stay null, bad text is an error when ``strict``."""
    # A cast alone would read a bare time as today's, and a year as its first day.
    dated = F.when(col.rlike(r"^\s*[+-]?\d{4,}-\d{1,2}"), col)
    parsed = F.coalesce(
        dated.try_cast("timestamp"),
        *[F.try_to_timestamp(col, F.lit(layout)) for layout in TEXT_LAYOUTS],
    )
    if not strict:
        return parsed
    complaint = F.raise_error(F.concat(F.lit("not a timestamp: "), col)).cast("timestamp")
    return F.when(parsed.isNull() & col.isNotNull(), complaint).otherwise(parsed)


def from_epoch(col: Column, unit: str) -> Column:
    """An integer epoch of a known unit; nanoseconds floor to microseconds."""
    whole = col.cast("bigint")
    if unit == "s":
        return F.timestamp_seconds(whole)
    if unit == "ms":
        return F.timestamp_millis(whole)
    if unit == "us":
        return F.timestamp_micros(whole)
    if unit == "ns":
        return F.timestamp_micros(floor_div(whole, 1000))
    raise SchemaError(f"unknown epoch unit {unit!r}; use s, ms, us or ns")


def epoch_unit(df: DataFrame, column: str) -> str | None:
    """The unit of an integer epoch column, from its largest magnitude; None if all null."""
    extremes = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if extremes["lo"] is None:
        return None
    largest = max(abs(extremes["lo"]), abs(extremes["hi"]))
    if largest > NANOS_ABOVE:
        return "ns"
    if largest <= SECONDS_ABOVE:
        raise SchemaError(f"{column!r}: {largest} is too small to be a Unix epoch")
    if largest <= SECONDS_UP_TO:
        return "s"
    raise SchemaError(f"{column!r}: {largest} may be milli- or microseconds; give the unit")


def normalize_ts(
    df: DataFrame, column: str, unit: str | None = None, strict: bool = True, keep_nanos: bool = False
) -> DataFrame:
    """Replace ``column`` by a UTC timestamp, whatever it holds now.

    Only an integer column of unstated unit costs a pass (a two-value aggregate).
    ``keep_nanos`` keeps the full value of a nanosecond epoch in ``<column>_ns``.
    """
    if column not in df.columns:
        raise SchemaError(f"column {column!r} not found; have {df.columns}")
    dtype, col = df.schema[column].dataType, F.col(column)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn(column, col.cast("timestamp"))
    if isinstance(dtype, _INTEGERS):
        unit = unit or epoch_unit(df, column)
        if unit is None:
            return df.withColumn(column, F.lit(None).cast("timestamp"))
        if unit == "ns" and keep_nanos:
            df = df.withColumn(f"{column}_ns", col.cast("bigint"))
        return df.withColumn(column, from_epoch(col, unit))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return df.withColumn(column, F.timestamp_seconds(col.cast("double")))
    if isinstance(dtype, T.StringType):
        return df.withColumn(column, parse_text(col, strict))
    raise SchemaError(f"{column!r} of type {dtype.simpleString()} cannot be a timestamp")
