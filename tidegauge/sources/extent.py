"""What a series covers: its times, its rows and where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.schema import SAMPLE_ROWS


def scan_time_column(df: DataFrame, time: str) -> DataFrame:
    """The time column alone; only its pages are read."""
    return df.select(time)


def time_bounds(df: DataFrame, time: str) -> DataFrame:
    """First and last time; both null for an empty series."""
    return df.agg(F.min(time).alias("min_ts"), F.max(time).alias("max_ts"))


def row_count(df: DataFrame) -> DataFrame:
    """The exact number of rows; a Parquet scan reads no column for it."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def rows_per_file(df: DataFrame) -> DataFrame:
    """Rows read from each file of a file-based source."""
    return df.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def sample_head(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows met, for role inference; not a random sample."""
    return df.limit(n)
