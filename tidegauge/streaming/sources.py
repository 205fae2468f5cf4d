"""Series arriving as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
    files: str | None = None,
    max_files: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """A stream over the files of a folder; ``files`` is a name pattern.

    ``max_files`` and ``max_bytes`` bound what one micro-batch takes, which is how a load
    is slowed to what the sink can bear.
    """
    reader = spark.readStream.schema(schema).format(file_format)
    if files is not None:
        reader = reader.option("pathGlobFilter", files)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path)
