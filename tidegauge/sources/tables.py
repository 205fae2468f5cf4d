"""Catalog tables and tables of other databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_on: str,
    low: str,
    high: str,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A table behind JDBC, read by ``partitions`` tasks over ranges of ``split_on``."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=split_on,
            lowerBound=low,
            upperBound=high,
            numPartitions=str(partitions),
            **options,
        )
        .load()
    )


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Remove a table; a missing one is no error."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
