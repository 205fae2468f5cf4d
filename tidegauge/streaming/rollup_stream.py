"""Roll-ups that follow a stream.

Three forms. ``stateful_rollup`` keeps open buckets in state and gives up on rows later than
the watermark. ``repaired_rollup`` splits these rows off before they reach it, and merges
their partial results with the stored ones. ``delta_rollup`` keeps no state: every micro-batch stores
its own partial results, and because sum, count, min and max merge, rows of any lateness and
order end up in the right bucket.

All write one folder per micro-batch and overwrite it, so a replayed batch replaces
itself instead of counting twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions.buckets import EPOCH, watermarked_bucket, interval_text, width_of
from tidegauge.operators.prepare import partition_value
from tidegauge.operators.queries import merged, partials
from tidegauge.plans.rollup import BUCKET, DATE, Rollup, averages, store_partitions
from tidegauge.session import materialize
from tidegauge.sinks.snapshots import delete, names_in
from tidegauge.streaming.sources import file_stream

BATCH = "batch_id"
# Of the rows that a stateful roll-up reads: series may have a batch_id of their own.
SPLIT = "split_batch_id"

# Rows up to this late still reach a stateful roll-up.
LATENESS = timedelta(hours=48)


def stateful_rollup(stream: DataFrame, rollup: Rollup, lateness: timedelta = LATENESS) -> DataFrame:
    """Tumbling partial results per bucket and tags, for output mode ``update``."""
    timed = stream.withColumn(rollup.time, F.col(rollup.time).cast("timestamp"))
    width = width_of(rollup.granularity)
    shift = (rollup.origin - EPOCH) % width
    held = F.window(rollup.time, interval_text(width), None, interval_text(shift) if shift else None)
    return (
        timed.withWatermark(rollup.time, interval_text(lateness))
        .groupBy(held.alias("_window"), *rollup.tags)
        .agg(*partials(rollup.metrics, timed))
        .select(F.col("_window.start").alias(BUCKET), *rollup.tags, *_partial_names(rollup.metrics))
    )


def _partial_names(metrics: Sequence[str]) -> list[str]:
    return [f"{p}_{m}" for m in metrics for p in ("sum", "cnt", "min", "max")]


def write_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store what each micro-batch changed; an emitted bucket carries its full value."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def latest_rollup(spark: SparkSession, path: str, rollup: Rollup) -> DataFrame:
    """The roll-up as the change log leaves it: the newest value of every bucket.

    What ``compact_changes`` has folded is read from there, and of the log only what is newer.
    """
    names = _partial_names(rollup.metrics)
    keys = [BUCKET, *rollup.tags]
    folded = _folded(path, rollup)
    state = folded.table.snapshot(spark)
    newer = _batches(spark, path, BATCH, state.marks.get("changes", -1))
    changes = _changes(spark, path, newer)
    if state.number:
        old = folded.table.read(spark, state.number).select(*keys, *names, F.lit(-1).cast("long").alias(BATCH))
        if changes is None:
            return old.drop(BATCH)
        kinds = {f.name: f.dataType for f in changes.schema}
        changes = changes.unionByName(old.select(*[F.col(c).cast(kinds[c]) for c in (*keys, *names, BATCH)]))
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*names), BATCH).alias("_row")).select(*keys, "_row.*")


def compact_changes(spark: SparkSession, path: str, rollup: Rollup) -> int:
    """Fold the change log at ``path`` into one stored row per bucket; returns the batches folded.

    Only dates with new changes are rewritten, and the folded batches leave the log, so it
    holds no more than what came since. A batch that is replayed afterwards is known by its
    number and counts no more. Readers that were planned before should be done.
    """
    folded = _folded(path, rollup)
    newer = _batches(spark, path, BATCH, folded.table.snapshot(spark).marks.get("changes", -1))
    fold(spark, folded, _changes(spark, path, newer), None, {"changes": max(newer, default=-1)})
    for batch in _batches(spark, path, BATCH, -1):
        if batch <= folded.table.snapshot(spark).marks.get("changes", -1):
            delete(spark, f"{path}/{BATCH}={batch}")
    return len(newer)


def _folded(path: str, rollup: Rollup) -> Rollup:
    return replace(rollup, path=f"{path}_folded")


def _batches(spark: SparkSession, path: str, name: str, after: int) -> list[int]:
    """The stored batches with a number above ``after``."""
    found = (n.removeprefix(f"{name}=") for n in names_in(spark, path) if n.startswith(f"{name}="))
    return sorted(n for n in map(int, found) if n > after)


def _changes(spark: SparkSession, path: str, batches: list[int]) -> DataFrame | None:
    """The changes of some batches alone, with their number."""
    if not batches:
        return None
    folders = [f"{path}/{BATCH}={n}" for n in batches]
    return spark.read.option("basePath", path).parquet(*folders).withColumn(BATCH, F.col(BATCH).cast("long"))


def fold(
    spark: SparkSession, rollup: Rollup, changes: DataFrame | None, late: DataFrame | None, marks: dict[str, int],
    raw: T.StructType | None = None,
) -> bool:
    """Bring new changes and late rows into the stored roll-up; False if there are none.

    A change carries a bucket's full value of the rows in time and replaces the one before.
    Late rows become partial results, which merge with those stored. Both are stored next to
    each other and to their sum, so either can move on later, and only the dates that they
    touch are rewritten. ``marks`` are set with the same switch: what they count is in.
    """
    names, keys = _partial_names(rollup.metrics), [BUCKET, *rollup.tags]
    parts = []
    if changes is not None:
        newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*names), BATCH).alias("row")).select(*keys, "row.*")
        parts.append((newest.withColumn(DATE, partition_value(F.col(BUCKET), rollup.unit)), "base"))
    if late is not None:
        parts.append((rollup.rows(late), "late"))
    if not parts:
        return False
    state = rollup.table.snapshot(spark)
    # The types of a roll-up of the raw rows, whatever the stream has made of them.
    model = state.schema if raw is None else rollup.rows(spark.createDataFrame([], raw)).schema
    model = model if model is not None else parts[0][0].schema
    typed = [F.col(n).cast(model[n].dataType) for n in (DATE, *keys, *names)]
    fields = [f"{kind}_{n}" for kind in ("base", "late") for n in names]
    new = None
    for df, kind in parts:
        own = df.select(*typed).withColumnsRenamed({n: f"{kind}_{n}" for n in names}).withColumn(f"_{kind}", F.lit(1))
        new = own if new is None else new.unionByName(own, allowMissingColumns=True)
    new = materialize(new, "fold")
    dates = {str(r[DATE]) for r in new.select(DATE).distinct().collect()}
    if not dates:
        return False
    both = new
    if state.number and (known := dates & state.parts.keys()):
        old = rollup.table.read(spark, state.number, known.__contains__).select(DATE, *keys, *fields)
        both = new.unionByName(old.withColumn("_base", F.lit(0)), allowMissingColumns=True)
    for n in fields + ["_base"]:
        if n not in both.columns:
            both = both.withColumn(n, F.lit(None).cast(model[n.split("_", 1)[1]].dataType if n != "_base" else "int"))
    base = F.struct(*[f"base_{n}" for n in names])
    merge = {"sum": F.sum, "cnt": F.sum, "min": F.min, "max": F.max}
    merged_late = [merge[n[:3]](f"late_{n}").cast(model[n].dataType).alias(f"late_{n}") for n in names]
    grouped = both.groupBy(DATE, *keys).agg(F.max_by(base, "_base").alias("row"), *merged_late).select(
        DATE, *keys, "row.*", *[f"late_{n}" for n in names]
    )
    rollup.table.stage(grouped.select(DATE, *keys, *[_both(n, model[n].dataType) for n in names], *fields), [BUCKET]).commit(
        spark, dates.__contains__, marks
    )
    return True


def _both(name: str, kind: T.DataType):
    """The rows in time and the late ones in one partial result."""
    base, late = F.col(f"base_{name}"), F.col(f"late_{name}")
    if name.startswith(("min_", "max_")):
        value = (F.least if name.startswith("min_") else F.greatest)(base, late)
    else:
        value = F.coalesce(base + late, base, late)
    return value.cast(kind).alias(name)


def split_late(
    stream: DataFrame, rollup: Rollup, path: str, checkpoint: str, lateness: timedelta = LATENESS
) -> StreamingQuery:
    """Store each micro-batch's rows, the late ones apart (``is_late``).

    A row is late when it lies more than ``lateness`` before the newest row of an earlier
    batch. A watermark over the other rows, batch after batch, drops none of them.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = _mark(spark, path, batch_id - 1)
        time, newest = F.col(rollup.time).cast("timestamp"), F.lit(mark).cast("timestamp")
        late = time < newest - F.expr(f"interval {interval_text(lateness)}")
        target = f"{path}/{SPLIT}={batch_id}"
        batch.withColumn("is_late", F.coalesce(late, F.lit(False))).write.mode("overwrite").partitionBy("is_late").parquet(target)
        stored = spark.read.schema(batch.schema).parquet(target)
        stored.agg(F.greatest(F.max(time), newest).cast("string").alias("newest")).write.mode("overwrite").parquet(
            _mark_path(path, batch_id)
        )

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def repaired_rollup(stream: DataFrame, rollup: Rollup, path: str, lateness: timedelta = LATENESS) -> None:
    """Bring the stored roll-up up to date with ``stream``, rows of any lateness included.

    Rows within ``lateness`` go through ``stateful_rollup``; later ones are summed up and
    merged with what is stored. A run reads the batches that came since the last one and
    rewrites the dates that they touch, in one switch that also notes them as done. The steps
    follow each other: the stateful form sees a batch only when it is stored whole, and a
    replayed one never twice. ``path`` keeps rows, changes and checkpoints between runs.
    """
    spark = stream.sparkSession
    rows, log = f"{path}/rows", f"{path}/changes"
    split_late(stream, rollup, rows, f"{path}/split", lateness).awaitTermination()
    on_time = file_stream(spark, f"{rows}/{SPLIT}=*/is_late=false", stream.schema)
    write_changes(stateful_rollup(on_time, rollup, lateness), log, f"{path}/state").awaitTermination()
    marks = rollup.table.snapshot(spark).marks
    changed, split = _batches(spark, log, BATCH, marks.get("changes", -1)), _batches(spark, rows, SPLIT, marks.get("late", -1))
    late = [f"{rows}/{SPLIT}={n}/is_late=true" for n in split if "is_late=true" in names_in(spark, f"{rows}/{SPLIT}={n}")]
    done = {"changes": max(changed, default=marks.get("changes", -1)), "late": max(split, default=marks.get("late", -1))}
    fold(
        spark, rollup, _changes(spark, log, changed), spark.read.schema(stream.schema).parquet(*late) if late else None,
        done, stream.schema,
    )
    # What is folded leaves the log.
    for n in _batches(spark, log, BATCH, -1):
        if n <= rollup.table.snapshot(spark).marks.get("changes", -1):
            delete(spark, f"{log}/{BATCH}={n}")


def delta_rollup(
    stream: DataFrame, rollup: Rollup, path: str, checkpoint: str, lateness: timedelta = LATENESS
) -> StreamingQuery:
    """Store each micro-batch's partial results, and how many of its rows were late.

    A row is late when it lies more than ``lateness`` before the newest row of an earlier
    batch. ``is_late`` splits the partial results, so late rows can be counted and traced.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        mark = _mark(batch.sparkSession, path, batch_id - 1)
        late = F.lit(False)
        if mark is not None:
            late = F.col(rollup.time) < F.lit(mark).cast(batch.schema[rollup.time].dataType) - F.expr(
                f"interval {interval_text(lateness)}"
            )
        (
            batch.withColumn("is_late", late)
            .groupBy("is_late", *_grouping(rollup))
            .agg(*partials(rollup.metrics), F.count(F.lit(1)).alias("n_rows"), F.max(rollup.time).alias("_newest"))
            .write.mode("overwrite")
            .parquet(f"{path}/{BATCH}={batch_id}")
        )
        stored = batch.sparkSession.read.parquet(f"{path}/{BATCH}={batch_id}")
        newest = F.max("_newest") if mark is None else F.greatest(F.max("_newest"), F.lit(mark))
        stored.agg(newest.alias("newest")).write.mode("overwrite").parquet(_mark_path(path, batch_id))

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def _mark_path(path: str, batch_id: int) -> str:
    return f"{path}_marks/{batch_id}"


def _mark(spark: SparkSession, path: str, batch_id: int):
    """The newest time up to a batch: one stored row, so no batch rereads its forerunners."""
    if batch_id < 0:
        return None
    return spark.read.parquet(_mark_path(path, batch_id)).first()["newest"]


def _grouping(rollup: Rollup) -> list:
    return [watermarked_bucket(rollup.time, rollup.granularity, rollup.origin).alias(BUCKET), *rollup.tags]


def read_deltas(spark: SparkSession, path: str, rollup: Rollup) -> DataFrame:
    """The merged roll-up, in the shape of a stored one."""
    deltas = spark.read.parquet(path)
    return (
        deltas.groupBy(BUCKET, *rollup.tags)
        .agg(*merged(rollup.metrics))
        .withColumn(DATE, partition_value(F.col(BUCKET), rollup.unit))
    )


def compact_deltas(spark: SparkSession, path: str, rollup: Rollup, target: str) -> None:
    """Merge all batches into a stored roll-up at ``target`` that ``query_rollup`` reads."""
    store_partitions(read_deltas(spark, path, rollup), replace(rollup, path=target))


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows and late rows over all batches."""
    return spark.read.parquet(path).agg(
        F.sum("n_rows").alias("n_rows"), F.sum(F.when(F.col("is_late"), F.col("n_rows")).otherwise(0)).alias("late_rows")
    )

