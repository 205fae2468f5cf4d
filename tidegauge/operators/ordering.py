"""Global order without a single-task window.

``ranged`` range-partitions rows on the full sort key, so a key holding a third of all
rows is spread over as many partitions as it needs, and stamps each row with its partition
and its position in it. Numbers, running sums and previous values are then computed inside
the partitions and corrected by one small row per (partition, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.operators.keys import keyed_join
from tidegauge.session import materialize

CHUNK, POSITION = "_chunk", "_position"


def ranged(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """Sort ``df`` across the cluster and stamp ``_chunk`` and ``_position``.

    The result is written to the shared folder: range bounds come from a sample, so a
    recomputed partition could otherwise hold other rows than the first time.
    """
    stamp = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", stamp)
        .withColumn(CHUNK, F.shiftright("_id", 33).cast("int"))
        .withColumn(POSITION, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    return materialize(placed, label)


def _offsets(totals: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Running totals of the chunks before each one; at most one row per (chunk, key)."""
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        CHUNK, *keys, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums]
    )


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Number all rows 1..n in ``order`` (end it with a unique column)."""
    placed = ranged(df, [F.col(c) for c in order], "numbered")
    # One row per chunk, so the window without keys sees at most one row per partition.
    totals = placed.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("n"))
    numbered = keyed_join(placed, materialize(_offsets(totals, [], ["n"]), "offsets"), [CHUNK])
    return numbered.withColumn(name, F.col("_before_n") + F.col(POSITION) + 1).drop(
        CHUNK, POSITION, "_before_n"
    )


def chunk_rows(df: DataFrame, order: list[str], size: int, name: str = "chunk_id") -> DataFrame:
    """Cut the ordered rows into chunks of ``size``; the last one keeps the remainder."""
    return number_rows(df, order, "_row").withColumn(name, F.expr(f"(_row - 1) div {int(size)}")).drop("_row")


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]
) -> DataFrame:
    """Running sums per key: ``values`` maps each column to the name of its running sum."""
    placed = ranged(df, [F.col(c) for c in (*keys, *order)], "running")
    within = W.partitionBy(CHUNK, *keys).orderBy(POSITION).rowsBetween(W.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(c).over(within).alias(out) for c, out in values.items()])
    totals = placed.groupBy(CHUNK, *keys).agg(*[F.sum(c).alias(out) for c, out in values.items()])
    joined = keyed_join(local, _offsets(totals, keys, list(values.values())), [CHUNK, *keys])
    for out in values.values():
        joined = joined.withColumn(out, F.col(out) + F.col(f"_before_{out}"))
    return joined.drop(CHUNK, POSITION, *[f"_before_{out}" for out in values.values()])


def previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """The value of the row before, per key: ``values`` maps each column to the new name.

    Nulls count as values; the first row of a key gets null.
    """
    placed = ranged(df, [F.col(c) for c in (*keys, *order)], "previous")
    columns = list(values)
    inside = W.partitionBy(CHUNK, *keys).orderBy(POSITION)
    local = placed.select(
        "*",
        F.lag(POSITION).over(inside).alias("_seen"),
        *[F.lag(c).over(inside).alias(values[c]) for c in columns],
    )
    last = placed.groupBy(CHUNK, *keys).agg(F.max_by(F.struct(*columns), POSITION).alias("_last"))
    carried = last.select(
        CHUNK, *keys, F.lag("_last").over(W.partitionBy(*keys).orderBy(CHUNK)).alias("_carried")
    )
    joined = keyed_join(local, carried, [CHUNK, *keys])
    for c in columns:
        joined = joined.withColumn(
            values[c], F.when(F.col("_seen").isNull(), F.col(f"_carried.{c}")).otherwise(F.col(values[c]))
        )
    return joined.drop(CHUNK, POSITION, "_seen", "_carried")
