"""Loading files exactly once, however often the load is interrupted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def resumable_load(
    stream: DataFrame, target: str, checkpoint: str, partition_by: list[str] | None = None
) -> StreamingQuery:
    """Load everything present into Parquet under ``target`` and stop.

    The checkpoint remembers the finished files and the sink's log the committed ones, so
    calling this again loads only what is new.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()
