"""Partitioned series tables: create, append, reset and check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalar import row_bytes
from tidegauge.operators.ordering import chunk_rows, number_rows
from tidegauge.operators.prepare import partition_value
from tidegauge.schema import SeriesSchema, sql_type
from tidegauge.sinks.snapshots import delete, names_in
from tidegauge.sources.tables import drop_table

# The derived time partition of a table.
PARTITION = "p"


def create_table(
    spark: SparkSession, name: str, schema: SeriesSchema, partition_by: str = "DAY", path: str | None = None
) -> None:
    """An empty Parquet table partitioned by the time column's hour, day, week, month or year."""
    empty = spark.createDataFrame([], schema.struct)
    writer = with_partition(empty, schema.time, partition_by).write.format("parquet").partitionBy(PARTITION)
    if path is not None:
        writer = writer.option("path", path)
    if not spark.catalog.tableExists(name):
        writer.saveAsTable(name)


def with_partition(df: DataFrame, time: str, partition_by: str) -> DataFrame:
    return df.withColumn(PARTITION, partition_value(F.col(time), partition_by))


def ingest_append(
    df: DataFrame, name: str, schema: SeriesSchema, partition_by: str = "DAY", cluster: bool = True
) -> int:
    """Append the rows and return how many were written.

    Rows are rebalanced on the partition column: each partition gets few files, and a
    partition with a third of the rows is split over several tasks. The tag order inside
    the files lets readers skip row groups. The count comes from the write itself.
    """
    rows = with_partition(df.select(*schema.columns), schema.time, partition_by)
    if cluster:
        rows = rows.hint("rebalance", PARTITION).sortWithinPartitions(PARTITION, *schema.tags, schema.time)
    written = Observation()
    counted = rows.observe(written, F.count(F.lit(1)).alias("n"))
    counted.select(*df.sparkSession.table(name).columns).write.mode("append").insertInto(name)
    return written.get["n"]


def ingest_reset(
    df: DataFrame, name: str, schema: SeriesSchema, partition_by: str = "DAY", path: str | None = None
) -> int:
    """Replace the table by one with these rows, loaded aside first.

    The rows may come from the table itself, and a load that fails leaves the table as it was:
    only when all rows are stored does the new table take the name. With ``path`` each load
    has a folder of its own below it. Of folders only the old table's own, there, is removed.
    """
    spark = df.sparkSession
    old = _location(spark, name)
    mark = uuid.uuid4().hex
    aside = f"{name}_{mark}"
    own = None if path is None else f"{path.rstrip('/')}/load-{mark}"
    create_table(spark, aside, schema, partition_by, own)
    try:
        written = ingest_append(df.select(*schema.columns), aside, schema, partition_by)
    except BaseException:
        drop_table(spark, aside)
        if own is not None:
            delete(spark, own)
        raise
    drop_table(spark, name)
    spark.sql(f"ALTER TABLE {aside} RENAME TO {name}")
    if path is not None and old is not None:
        _remove_load(spark, old, path, f"load-{mark}")
    return written


def _remove_load(spark: SparkSession, old: str, path: str, kept: str) -> None:
    """Remove the files at ``old`` if that is a load of ``path``, or ``path`` itself; ``kept`` stays."""
    plain = lambda p: p.split(":", 1)[-1].rstrip("/").replace("//", "/")
    own, top = plain(old), plain(path)
    if not top.strip("/"):
        return
    if own.endswith(top):
        for name in names_in(spark, path):
            if name != kept:
                delete(spark, f"{path.rstrip('/')}/{name}")
    elif own.rsplit("/load-", 1)[0].endswith(top):
        delete(spark, old)


def _location(spark: SparkSession, name: str) -> str | None:
    """Where a table's files are; None if there is no such table."""
    if not spark.catalog.tableExists(name):
        return None
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()
    return found["data_type"] if found else None


def ingest_batches(df: DataFrame, order: list[str], batch_size: int, workers: int = 1) -> DataFrame:
    """The rows with the batch and the worker that would write them.

    Batches hold ``batch_size`` rows in ``order``; inside a batch the rows go to the
    workers in equal runs, the first ones taking the remainder, and none is dropped.
    """
    if workers <= 1:
        return chunk_rows(df, order, batch_size, "batch_id").withColumn("worker", F.lit(0).cast("bigint"))
    numbered = number_rows(df, order, "_row")
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    place = F.expr(f"(_row - 1) % {int(batch_size)}")
    batch = F.expr(f"(_row - 1) div {int(batch_size)}")
    length = F.least(F.lit(batch_size).cast("bigint"), F.lit(total).cast("bigint") - F.col("batch_id") * batch_size)
    return (
        numbered.withColumn("batch_id", batch)
        .withColumn("_length", length)
        .withColumn("_place", place)
        .withColumn("worker", F.expr(f"(_place * {int(workers)}) div greatest(_length, {int(workers)})"))
        .drop("_row", "_length", "_place")
    )


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 10_000, workers: int = 8, **options: str) -> None:
    """Append to a table behind JDBC with at most ``workers`` connections."""
    types = ", ".join(f"{f.name} {sql_type(f.dataType)}" for f in df.schema)
    (
        df.coalesce(workers)
        .write.format("jdbc")
        .options(url=url, dbtable=table, batchsize=str(batch_size), createTableColumnTypes=types, **options)
        .mode("append")
        .save()
    )


def reconcile(table: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: rows found, rows expected, rows missing, and whether they agree."""
    found = table.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = expected.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = table.sparkSession.range(1)
    return (
        one.select(found.alias("found_rows"), wanted.alias("expected_rows"))
        .withColumn("missing_rows", F.col("expected_rows") - F.col("found_rows"))
        .withColumn("complete", F.col("missing_rows") == 0)
    )


def estimate_bytes(df: DataFrame) -> DataFrame:
    """The logical size of all rows: fixed widths plus text bytes."""
    return df.agg(F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0)).cast("bigint").alias("bytes"))
