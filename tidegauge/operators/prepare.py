"""Row and column preparation that needs no shuffle."""

from __future__ import annotations

from datetime import datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from tidegauge.schema import METRIC, SeriesSchema


def literal_time(df: DataFrame, column: str, moment: datetime | str) -> Column:
    """A bound of the column's own type, so the comparison reaches the scan.

    Text with an offset is turned to UTC. A date stands for its midnight, so on a date column
    a bound later in the day becomes the next date.
    """
    if isinstance(moment, str):
        try:
            moment = datetime.fromisoformat(moment)
        except ValueError:
            return F.lit(moment).cast(df.schema[column].dataType)
    moment = naive_utc(moment)
    if isinstance(df.schema[column].dataType, DateType) and moment.time() != time(0):
        moment += timedelta(days=1)
    return F.lit(str(moment)).cast(df.schema[column].dataType)


def naive_utc(moment: datetime) -> datetime:
    """The moment in UTC without a zone; one without a zone is UTC already."""
    return moment if moment.tzinfo is None else moment.astimezone(timezone.utc).replace(tzinfo=None)


def drop_null_ts(df: DataFrame, time: str) -> DataFrame:
    return df.where(F.col(time).isNotNull())


def fill_nulls(df: DataFrame, schema: SeriesSchema) -> DataFrame:
    """Tags and other text become ``''``, metrics -1. Opt in: -1 changes averages."""
    numbers = [c for c in schema.by_role(METRIC) if c in df.columns]
    texts = [c for c, t in df.dtypes if t == "string" and c != schema.time and c not in numbers]
    return df.na.fill(-1, subset=numbers).na.fill("", subset=texts)


def project_all(df: DataFrame, schema: SeriesSchema) -> DataFrame:
    """The schema's columns by name."""
    return df.select(*schema.columns)


def time_filter(
    df: DataFrame,
    time: str,
    start: datetime | str,
    end: datetime | str,
    partition: tuple[str, str] | None = None,
) -> DataFrame:
    """Rows with ``start <= time < end``.

    ``partition=(column, unit)`` names a derived time partition; the bounds are added on
    it too, because a filter on the time alone does not prune a derived partition.
    """
    low, high = literal_time(df, time, start), literal_time(df, time, end)
    kept = df.where((F.col(time) >= low) & (F.col(time) < high))
    if partition is None:
        return kept
    column, unit = partition
    return kept.where(
        (F.col(column) >= partition_value(low, unit)) & (F.col(column) <= partition_value(high, unit))
    )


# Units a table can be partitioned by.
PARTITION_UNITS = ("HOUR", "DAY", "WEEK", "MONTH", "YEAR")


def partition_value(ts: Column, unit: str) -> Column:
    """The partition a timestamp belongs to: a date, or text down to the hour."""
    name = unit.upper()
    if name not in PARTITION_UNITS:
        raise ValueError(f"cannot partition by {unit!r}; use one of {', '.join(PARTITION_UNITS)}")
    if name == "HOUR":
        return F.date_format(ts, "yyyy-MM-dd-HH")
    return F.to_date(F.date_trunc(name, ts))
