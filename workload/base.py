"""Registering a query next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.prepare import project_all
from tidegauge.schema import SeriesSchema
from tidegauge.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The window used by queries over one window.
START, END = "2024-01-05 03:17:00", "2024-01-12 11:45:30"
IN_WINDOW = f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'"


class Tables:
    """The test tables of one scale, read lazily by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``function(tables)`` under ``name``; ``sql`` gives the same rows elsewhere."""

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, since sums differ in their last bits, and drop the zone of times.

    The values of ``events`` have two decimals, so the average of 32 of them can end in a 5
    at the seventh; a tenth of a billionth keeps such ties from hanging on the last bit.
    """
    nudge = 1e-10 if digits == 6 else 0.0
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.DoubleType):
            out.append(F.round(F.col(f.name) + nudge, digits).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            out.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def events_schema(df: DataFrame) -> SeriesSchema:
    """``events`` as a series: the event type is the tag, the value the metric."""
    return SeriesSchema("events", "ts", ("event_type",), ("value",), df.schema)


def events_columns(df: DataFrame) -> DataFrame:
    return project_all(df, events_schema(df))
