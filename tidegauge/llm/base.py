"""Registration, tables and small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import configure, materialize, new_path

__all__ = ["ORACLES", "QUERIES", "held_out", "materialize", "new_path", "packed", "prepared", "query", "table", "unpacked"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Rows and bytes of one Arrow batch of whole documents.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


_SHIPPED: set[str] = set()


def prepared(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on: the engine's settings, small Arrow batches, our code.

    The package goes to the executors with the job, so they need not have it installed.
    """
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        context.addPyFile(_packed())
        _SHIPPED.add(context.applicationId)
    return spark


def _packed() -> str:
    """The package as a zip file, which the driver serves to the executors."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="code-"), "tidegauge-code.zip")
    with zipfile.ZipFile(path, "w") as file:
        for top, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    own = os.path.join(top, name)
                    file.write(own, os.path.relpath(own, os.path.dirname(package)))
    return path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def packed(df: DataFrame, *own: str) -> DataFrame:
    """The columns ``own``, and all others in a struct ``kept``, out of the way of added names."""
    spare = "_"
    while spare in df.columns:
        spare += "_"
    kept = [F.col(f"`{c}`") for c in df.columns if c not in own]
    # A struct has a field at least, or it can't be stored.
    return df.select(F.struct(F.lit(True).alias(spare), *kept).alias("kept"), *[F.col(f"`{c}`") for c in own])


def unpacked(df: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """``columns`` in their order again, of rows that ``packed`` made."""
    return df.select(*[F.col(f"`{c}`") if c in own else F.col(f"kept.`{c}`").alias(c) for c in columns])


def query(name: str, sql: str | None = None):
    """Register ``function(spark, folder)`` under ``name``; ``sql`` gives the same rows."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2.

    A null id counts as not held out, and is not learnt from either.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
