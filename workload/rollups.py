"""Roll-ups: build, read, refresh, and compare with the raw rows."""

from __future__ import annotations

from datetime import datetime, timedelta


from tidegauge.operators.generate import late_rows
from tidegauge.plans import late, rollup as r
from tidegauge.session import new_path
from workload.base import END, START, query, tidy

LOW, HIGH = datetime.fromisoformat(START), datetime.fromisoformat(END)

# A shipment series: two tags, two metrics.
SHIP_TAGS, SHIP_METRICS = ("l_returnflag", "l_linestatus"), ("l_quantity", "l_extendedprice")
SHIP_START, SHIP_END = datetime(1995, 3, 1), datetime(1996, 2, 10)


def events_rollup(t, granularity="1 hour") -> r.Rollup:
    return r.Rollup(new_path(t.spark, "rollup"), "ts", ("event_type",), ("value",), granularity)


def _rollup_sql(width: str = "1 HOUR", rows: str = "events", where: str = "") -> str:
    return f"""SELECT time_bucket(INTERVAL {width}, ts) AS ts_bucket, event_type, round(avg(value) + 1e-10, 6) AS avg_value,
               min(value) AS min_value, max(value) AS max_value FROM {rows} GROUP BY 1, 2 {where}"""


_IN_VIEW = f"HAVING ts_bucket >= TIMESTAMP '{START}' AND ts_bucket < TIMESTAMP '{END}'"


@query(
    "bucket_tag_agg",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ts_bucket, event_type, round(avg(value) + 1e-10, 6) AS avg_value
        FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}' GROUP BY 1, 2""",
)
def _(t):
    return tidy(r.bucket_tag_agg(t.events, "ts", ["event_type"], "value", "1 hour", LOW, HIGH))


@query("rollup_create", _rollup_sql())
def _(t):
    view = events_rollup(t)
    r.create_rollup(t.events, view)
    return tidy(r.query_rollup(t.spark, view))


@query(
    "rollup_create_all_metrics",
    """SELECT time_bucket(INTERVAL 1 DAY, l_shipdate) AS ts_bucket, l_returnflag, l_linestatus,
              round(avg(l_quantity) + 1e-10, 6) AS avg_l_quantity, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity,
              round(avg(l_extendedprice) + 1e-10, 6) AS avg_l_extendedprice, min(l_extendedprice) AS min_l_extendedprice,
              max(l_extendedprice) AS max_l_extendedprice FROM lineitem GROUP BY 1, 2, 3""",
)
def _(t):
    view = r.Rollup(new_path(t.spark, "rollup"), "l_shipdate", SHIP_TAGS, SHIP_METRICS, "1 day")
    r.create_rollup(t.lineitem, view)
    return tidy(r.query_rollup(t.spark, view))


@query("rollup_query", _rollup_sql(where=_IN_VIEW))
def _(t):
    view = events_rollup(t)
    r.create_rollup(t.events, view)
    return tidy(r.query_rollup(t.spark, view, LOW, HIGH))


# Rows that arrive late: all purchases of the window, which the first build does not see.
_LATE = f"event_type = 'purchase' AND ts >= TIMESTAMP_NTZ '{START}' AND ts < TIMESTAMP_NTZ '{END}'"


@query("rollup_refresh", _rollup_sql())
def _(t):
    view = events_rollup(t)
    r.create_rollup(t.events.where(f"NOT ({_LATE})"), view)
    r.refresh_rollup(t.events, view, LOW, HIGH)
    return tidy(r.query_rollup(t.spark, view))


@query("rollup_refresh_7h", _rollup_sql("7 HOUR").replace("ts)", "ts, TIMESTAMP '1970-01-01')"))
def _(t):
    """Buckets that cross midnight."""
    view = events_rollup(t, "7 hours")
    r.create_rollup(t.events.where(f"NOT ({_LATE})"), view)
    r.refresh_rollup(t.events, view, LOW, HIGH)
    return tidy(r.query_rollup(t.spark, view))


@query("rollup_refresh_full", _rollup_sql())
def _(t):
    view = events_rollup(t)
    r.create_rollup(t.events.where(f"NOT ({_LATE})"), view)
    r.refresh_rollup(t.events, view)
    return tidy(r.query_rollup(t.spark, view))


@query("rollup_refresh_deleted", _rollup_sql(rows=f"(SELECT * FROM events WHERE NOT (ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'))"))
def _(t):
    """Every row of the window was deleted: its partitions go, and the rest of theirs stays."""
    view = events_rollup(t)
    r.create_rollup(t.events, view)
    left = t.events.where(f"NOT (ts >= TIMESTAMP_NTZ '{START}' AND ts < TIMESTAMP_NTZ '{END}')")
    r.refresh_rollup(left, view, LOW, HIGH)
    return tidy(r.query_rollup(t.spark, view))


@query("rollup_snapshot", _rollup_sql(rows="(SELECT * FROM events WHERE event_type <> 'purchase')"))
def _(t):
    """The state before a refresh, read after it."""
    view = events_rollup(t)
    r.create_rollup(t.events.where("event_type <> 'purchase'"), view)
    r.refresh_rollup(t.events, view)
    return tidy(r.averages(r.read_rollup(t.spark, view, number=1), view))


@query(
    "rollup_vs_raw",
    f"""WITH x AS ({_rollup_sql()}) SELECT 'raw' AS side, ts_bucket, event_type, avg_value FROM x
        WHERE event_type = 'purchase' AND ts_bucket >= time_bucket(INTERVAL 1 HOUR, TIMESTAMP '{START}')
          AND ts_bucket < TIMESTAMP '{END}'""",
)
def _(t):
    """A roll-up that never saw the purchases disagrees on exactly their buckets."""
    view = events_rollup(t)
    r.create_rollup(t.events.where("event_type <> 'purchase'"), view)
    return tidy(r.rollup_vs_raw(t.events, view, "value", LOW, HIGH))


@query("rollup_vs_raw_fresh", "SELECT 'raw' AS side, ts AS ts_bucket, event_type, value AS avg_value FROM events WHERE false")
def _(t):
    view = events_rollup(t)
    r.create_rollup(t.events, view)
    return tidy(r.rollup_vs_raw(t.events, view, "value", LOW, HIGH))


def _hash_bits(text: str) -> str:
    return f"CAST('0x' || substring(md5({text}), 1, 15) AS BIGINT)"


def _rounds_sql(rounds: int, rows: int) -> str:
    """The raw table after each round: late rows are its own rows of the window where it has
    that many, else any rows with times drawn inside the window."""
    parts = [
        f"""b AS (SELECT max(ts) AS hi FROM events),
            w AS (SELECT i AS round, hi - to_minutes(CAST(30 + floor(CAST('0x' || substring(md5('late:42:' || i), 1, 8) AS BIGINT) / 4294967296.0 * 2850) AS BIGINT)) AS s
                  FROM b, range({rounds}) r(i)),
            x0 AS (SELECT event_id, event_type, value, ts FROM events)"""
    ]
    for i in range(rounds):
        stamp = f"make_timestamp(epoch_us(s) + {_hash_bits(f"'stamp:{42 + i}:' || event_id")} % 3600000000)"
        parts.append(f"""
            n{i} AS (SELECT s, (SELECT count(*) FROM x{i} WHERE ts >= s AND ts < s + INTERVAL 1 HOUR) >= {rows} AS own FROM w WHERE round = {i}),
            p{i} AS (SELECT x{i}.*, n{i}.* FROM x{i}, n{i} WHERE NOT own OR (ts >= s AND ts < s + INTERVAL 1 HOUR)
                     ORDER BY {_hash_bits(f"'sample:{42 + i}:' || event_id")} >> 8, event_id LIMIT {rows}),
            x{i + 1} AS (SELECT * FROM x{i} UNION ALL SELECT event_id, event_type, value, CASE WHEN own THEN ts ELSE {stamp} END FROM p{i})""")
    return "WITH " + ",".join(parts)


@query(
    "late_arrival_cycle",
    f"""{_rounds_sql(3, 100)}, v AS ({_rollup_sql(rows='x3')})
        SELECT round, v.* FROM v JOIN w ON ts_bucket >= s AND ts_bucket < s + INTERVAL 1 HOUR""",
)
def _(t):
    """Three rounds of late rows; what the refreshed roll-up shows in their windows."""
    raw = new_path(t.spark, "raw")
    t.events.write.parquet(raw)
    view = events_rollup(t)
    r.create_rollup(t.spark.read.parquet(raw), view)
    windows = late.late_arrival_cycle(t.spark, raw, view, "event_id", rows_per_round=100, rounds=3)
    return tidy(late.query_late(t.spark, view, windows, "value"))


_MOVED = """SELECT event_id, make_timestamp(epoch_us(TIMESTAMP '2024-01-20 10:17:00')
    + CAST('0x' || substring(md5('stamp:42:' || event_id), 1, 15) AS BIGINT) % 60000000) AS ts, user_id, event_type, value, props
    FROM (SELECT * FROM events ORDER BY CAST('0x' || substring(md5('sample:42:' || event_id), 1, 15) AS BIGINT) >> 8, event_id LIMIT 500)"""


@query("late_arrival_refresh", f"WITH x AS (SELECT * FROM events UNION ALL SELECT * FROM ({_MOVED})) {_rollup_sql(rows='x')}")
def _(t):
    """Late rows inside one minute, then a refresh of that minute: equal to a full rebuild."""
    raw = new_path(t.spark, "raw")
    t.events.write.parquet(raw)
    view = events_rollup(t)
    r.create_rollup(t.spark.read.parquet(raw), view)
    start = datetime(2024, 1, 20, 10, 17)
    end = start + timedelta(minutes=1)
    late_rows(t.events, "ts", "event_id", start, end, 500).write.mode("append").parquet(raw)
    r.refresh_rollup(t.spark.read.parquet(raw), view, start, end)
    return tidy(r.query_rollup(t.spark, view))


@query(
    "rollup_speedup",
    """WITH m AS (SELECT 'db' || (user_id % 3) AS database_name, event_type, round(value * 1e6) AS ns FROM events),
       s AS (SELECT database_name, avg(ns / 1e6) FILTER (event_type = 'view') AS raw_mean_ms,
             avg(ns / 1e6) FILTER (event_type = 'click') AS rollup_mean_ms FROM m GROUP BY 1)
       SELECT database_name, round(raw_mean_ms, 6) AS raw_mean_ms, round(rollup_mean_ms, 6) AS rollup_mean_ms,
              round(raw_mean_ms / rollup_mean_ms, 6) AS speedup FROM s""",
)
def _(t):
    log = t.events.selectExpr(
        "concat('db', user_id % 3) AS database_name",
        "event_type AS operation",
        "CAST(round(value * 1e6) AS bigint) AS elapsed_ns",
    )
    return tidy(r.speedup(log, "view", "click"))


