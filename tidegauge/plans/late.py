"""Late rows: append them to the raw table and bring the roll-up up to date."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.generate import late_rows, late_windows
from tidegauge.plans.rollup import Rollup, query_rollup, refresh_rollup


def late_arrival_cycle(
    spark: SparkSession,
    raw_path: str,
    rollup: Rollup,
    key: str,
    rows_per_round: int = 100,
    rounds: int = 1,
    seed: int = 42,
) -> list[tuple[datetime, datetime]]:
    """For each round: pick a late window, append rows to the raw table in it, refresh
    the buckets they fall in. Returns the windows; ``query_late`` reads them back.

    The raw table is a folder of Parquet files; only window bounds reach the driver.
    """
    base = spark.read.parquet(raw_path)
    windows = late_windows(base, rollup.time, rounds, seed).orderBy("window_id").collect()
    schema = base.schema
    for w in windows:
        batch = late_rows(
            spark.read.schema(schema).parquet(raw_path),
            rollup.time, key, w["start"], w["end"], rows_per_round, seed + w["window_id"],
        )
        batch.write.mode("append").parquet(raw_path)
        refresh_rollup(spark.read.schema(schema).parquet(raw_path), rollup, w["start"], w["end"])
    return [(w["start"], w["end"]) for w in windows]


def query_late(
    spark: SparkSession, rollup: Rollup, windows: list[tuple[datetime, datetime]], metric: str
) -> DataFrame:
    """The roll-up in every late window, as one frame."""
    parts = [
        query_rollup(spark, rollup, start, end, [metric]).select(F.lit(i).cast("bigint").alias("round"), "*")
        for i, (start, end) in enumerate(windows)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
