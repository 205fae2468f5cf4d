"""Streams over the event files, run to the end of what is there."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidegauge.operators.generate import shuffle_timestamps
from tidegauge.operators.ordering import chunk_rows
from tidegauge.plans.rollup import Rollup, query_rollup
from tidegauge.session import new_path
from tidegauge.streaming import live
from tidegauge.streaming import rollup_stream as rs
from tidegauge.streaming.sources import file_stream
from workload.base import query, tidy
from workload.series import daily_windows

_MERGED = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts_bucket, event_type, round(avg(value) + 1e-10, 6) AS avg_value,
    min(value) AS min_value, max(value) AS max_value FROM {rows} GROUP BY 1, 2"""


def _view() -> Rollup:
    return Rollup("", "ts", ("event_type",), ("value",), "1 hour")


@query("stream_tumbling", _MERGED.format(rows="events"))
def _(t):
    """The stateful roll-up, fed by the event file itself."""
    base = new_path(t.spark, "tumbling")
    stream = file_stream(t.spark, t.folder, t.events.schema, files="events.parquet")
    changes = rs.stateful_rollup(stream, _view())
    rs.write_changes(changes, f"{base}/changes", f"{base}/checkpoint").awaitTermination()
    return tidy(rs.averages(rs.latest_rollup(t.spark, f"{base}/changes", _view()), _view()))


def _delivered(t, batches: dict[str, str]):
    """Write the parts of ``events`` to a folder one after the other; each is one file."""
    path = new_path(t.spark, "delivery")
    for where in batches.values():
        t.events.where(where).coalesce(1).write.mode("append").parquet(path)
    return path


# The last third of the month comes first, so the rest is more than 48 hours late.
_PARTS = {
    "newest": "ts >= TIMESTAMP_NTZ '2024-01-20'",
    "oldest": "ts < TIMESTAMP_NTZ '2024-01-10'",
    "middle": "ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-20'",
}


@query("stream_late_repaired", _MERGED.format(rows="events"))
def _(t):
    """The stateful roll-up over several batches, rows behind its watermark repaired from the stored rows."""
    base = new_path(t.spark, "repaired")
    view = Rollup(f"{base}/rollup", "ts", ("event_type",), ("value",), "1 hour")
    stream = file_stream(t.spark, _delivered(t, _PARTS), t.events.schema, max_files=1)
    rs.repaired_rollup(stream, view, f"{base}/stream")
    return tidy(query_rollup(t.spark, view))


def _deltas(t) -> str:
    base = new_path(t.spark, "deltas")
    stream = file_stream(t.spark, _delivered(t, _PARTS), t.events.schema, max_files=1)
    rs.delta_rollup(stream, _view(), f"{base}/deltas", f"{base}/checkpoint").awaitTermination()
    return f"{base}/deltas"


@query("stream_late_data", _MERGED.format(rows="events"))
def _(t):
    """Rows weeks late still reach their bucket."""
    return tidy(rs.averages(rs.read_deltas(t.spark, _deltas(t), _view()), _view()))


@query(
    "stream_late_counts",
    "SELECT count(*) AS n_rows, count(*) FILTER (ts < TIMESTAMP '2024-01-20') AS late_rows FROM events",
)
def _(t):
    return rs.late_counts(t.spark, _deltas(t)).select(
        F.col("n_rows").cast("bigint").alias("n_rows"), F.col("late_rows").cast("bigint").alias("late_rows")
    )


_SHUFFLED = """WITH c AS (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 300 AS chunk_id FROM events),
    z AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS n FROM c),
    a AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY event_id) AS slot, row_number() OVER (PARTITION BY chunk_id
          ORDER BY CAST('0x' || substring(md5(n || ':' || event_id), 1, 15) AS BIGINT), event_id) AS mixed FROM z),
    s AS (SELECT x.event_type, x.value, y.ts FROM a x JOIN a y ON x.chunk_id = y.chunk_id AND x.slot = y.mixed) """


@query("stream_out_of_order", _SHUFFLED + _MERGED.format(rows="s"))
def _(t):
    """Times shuffled within batches of 300, streamed file by file."""
    base = new_path(t.spark, "disorder")
    chunks = chunk_rows(t.events.drop("props"), ["ts", "event_id"], 300)
    mixed = shuffle_timestamps(chunks, "ts", "chunk_id", "event_id").drop("chunk_id")
    mixed.repartition(4, "event_id").write.parquet(f"{base}/in")
    stream = file_stream(t.spark, f"{base}/in", mixed.schema, max_files=1)
    rs.delta_rollup(stream, _view(), f"{base}/deltas", f"{base}/checkpoint").awaitTermination()
    return tidy(rs.averages(rs.read_deltas(t.spark, f"{base}/deltas", _view()), _view()))


@query(
    "stream_rate_limited",
    "SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_batches FROM events",
)
def _(t):
    """Three files, one per micro-batch."""
    base = new_path(t.spark, "paced")
    stream = file_stream(t.spark, _delivered(t, _PARTS), t.events.schema, max_files=1)
    view = Rollup("", "ts", (), ("value",), timedelta(days=1))
    rs.delta_rollup(stream, view, f"{base}/deltas", f"{base}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{base}/deltas").agg(
        F.sum("n_rows").cast("bigint").alias("n_rows"), F.count_distinct("batch_id").alias("n_batches")
    )


@query(
    "stream_query_while_writing",
    """WITH w AS (SELECT epoch_us(d) // 86400000000 AS window_id, d + INTERVAL 390 MINUTE AS s, d + INTERVAL 2190 MINUTE AS e
                  FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events)),
       b(batch_id, lo) AS (VALUES (0, TIMESTAMP '2024-01-20'), (1, TIMESTAMP '2024-01-10'), (2, TIMESTAMP '2000-01-01')),
       h AS (SELECT batch_id, window_id, event_type, ts FROM b JOIN events ON ts >= lo JOIN w ON ts >= s AND ts < e)
       SELECT batch_id, 'time_range' AS query, window_id, count(*) AS n_rows FROM h GROUP BY 1, 3
       UNION ALL SELECT batch_id, 'aggregation', window_id, count(DISTINCT time_bucket(INTERVAL 1 HOUR, ts)) FROM h GROUP BY 1, 3
       UNION ALL SELECT batch_id, 'last_point', window_id, count(DISTINCT event_type) FROM h GROUP BY 1, 3""",
)
def _(t):
    """Every answer sees exactly the batches committed before it."""
    base = new_path(t.spark, "live")
    parts = {k: _PARTS[k] for k in ("newest", "middle", "oldest")}
    stream = file_stream(t.spark, _delivered(t, parts), t.events.schema, max_files=1)
    live.load_and_query(
        stream, f"{base}/table", f"{base}/answers", f"{base}/checkpoint",
        "ts", daily_windows(t.events), "event_type", "value", ["event_id"],
    ).awaitTermination()
    return t.spark.read.parquet(f"{base}/answers").select("batch_id", "query", "window_id", "n_rows")
