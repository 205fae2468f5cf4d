"""Whole binary files written and read by Spark, in any file system it reaches.

Python on an executor cannot open a remote folder, and Spark has no writer of raw bytes, but
its text writer copies a string's bytes as they are and ends each row with a separator. So a
file is one row, and the separator is the file's last four bytes, which every format written
here ends with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_files(df: DataFrame, column: str, folder: str, ending: bytes) -> None:
    """Write each row's bytes, followed by ``ending``, as a file of its own."""
    (
        df.select(F.col(column).cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", ending.decode("latin-1"))
        .text(folder)
    )


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and ``content`` of every file; a file is read whole, so keep files small."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")
