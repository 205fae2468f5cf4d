"""Writing series and results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.keys import keyed_join
from tidegauge.operators.ordering import number_rows

# The folders of ``write_parts``: a plain name, so readers get no column from it.
PART = "part"
PART_FOLDER = "part-{:05d}"

# How times are written in CSV (UTC, microseconds).
CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_parts(df: DataFrame, path: str, parts: int, device: str = "device_id") -> None:
    """``parts`` folders with disjoint, consecutive device ranges of equal device count.

    The devices are numbered, not the rows. A folder holds as many files as its rows
    need, so a device with a third of all rows does not end up in one task. Folders are
    named ``part-00000`` and on, and files have the columns of ``df`` alone.
    """
    numbered = number_rows(df.select(device).distinct(), [device], "_row")
    n_devices = numbered.count()
    per_part = max(1, n_devices // parts)
    part = F.least(F.expr(f"(_row - 1) div {per_part}"), F.lit(parts - 1)).cast("int")
    if PART in (c.lower() for c in df.columns):
        raise ValueError(f"write_parts needs the name {PART} for itself")
    placed = keyed_join(df, numbered.select(device, part.alias(PART)), [device])
    (
        placed.hint("rebalance", PART)
        .write.option("compression", "snappy")
        .partitionBy(PART)
        .parquet(path)
    )
    _name_folders(df.sparkSession, path)


def _name_folders(spark: SparkSession, path: str) -> None:
    """Take the column out of the folder names: Spark writes ``part=3``."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name, _, number = status.getPath().getName().partition("=")
        if name == PART and number.isdigit():
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, PART_FOLDER.format(int(number)))
            if not fs.rename(status.getPath(), target):
                raise OSError(f"cannot rename {status.getPath()} to {target}")


def times_as_text(df: DataFrame) -> DataFrame:
    """Time columns as ISO-8601 text."""
    times = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: F.date_format(c, CSV_TIME) for c in times}) if times else df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    times_as_text(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    times_as_text(df).write.mode(mode).json(path)


# The columns a stored operation log is laid out by.
LOG_LAYOUT = ("run_id", "database_name", "operation")


def write_measurements(log: DataFrame, path: str) -> None:
    """Append an operation log, one folder per run, database and operation.

    Rebalanced on the layout, so a folder gets few files and a hot folder several tasks.
    """
    (
        log.hint("rebalance", *LOG_LAYOUT)
        .write.mode("append")
        .option("compression", "snappy")
        .partitionBy(*LOG_LAYOUT)
        .parquet(path)
    )
