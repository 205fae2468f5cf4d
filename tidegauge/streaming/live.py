"""Answering queries while the table is being written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators.sweep import query_pool
from tidegauge.session import materialize

BATCH = "batch_id"


def load_and_query(
    stream: DataFrame,
    table: str,
    answers: str,
    checkpoint: str,
    time: str,
    windows: DataFrame,
    tag: str,
    metric: str,
    key: Sequence[str],
) -> StreamingQuery:
    """Append each micro-batch to ``table``, then run the reader workload on what is
    committed so far; the size of every answer goes to ``answers``.

    Tables and answers have a folder per batch, so a replayed batch replaces itself.
    """
    schema = stream.schema
    windows = materialize(windows, "windows")  # the same ones for every batch

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/{BATCH}={batch_id}")
        committed = read_committed(spark, table, schema)
        pool = query_pool(committed, time, windows, tag, metric, key)
        sizes = [
            answer().groupBy("window_id").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("query"), "*")
            for name, answer in pool.items()
        ]
        out = sizes[0]
        for part in sizes[1:]:
            out = out.unionByName(part)
        out.write.mode("overwrite").parquet(f"{answers}/{BATCH}={batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(step)
        .start()
    )


def read_committed(spark: SparkSession, table: str, schema) -> DataFrame:
    """The rows of all finished batches."""
    return spark.read.option("basePath", table).parquet(table).select(*schema.fieldNames())
