"""Scans, preparation, generators and the five query families."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegauge.functions import scalar, units
from tidegauge.functions.buckets import bucket
from tidegauge.functions.timeparse import normalize_ts
from tidegauge.operators import generate as g
from tidegauge.operators import ordering, prepare
from tidegauge.operators import queries as q
from tidegauge.operators import sweep as s
from tidegauge.schema import SeriesSchema, infer_roles, override_time
from tidegauge.session import materialize
from tidegauge.sources import extent, files
from workload.base import END, IN_WINDOW, START, events_schema, query, tidy

MONDAY = datetime(1970, 1, 5)

# ---- scans ---------------------------------------------------------------------------


@query("scan_parquet", "SELECT * FROM events")
def _(t):
    return files.scan_parquet(t.spark, f"{t.folder}/events.parquet")


@query("scan_time_column", "SELECT ts FROM events")
def _(t):
    return extent.scan_time_column(t.events, "ts")


@query("row_count", "SELECT count(*) AS row_count FROM lineitem")
def _(t):
    return extent.row_count(t.lineitem)


@query("rows_per_file", "SELECT 'lineitem.parquet' AS file_name, count(*) AS n_rows FROM lineitem")
def _(t):
    return extent.rows_per_file(t.lineitem)


@query("time_bounds", "SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM events")
def _(t):
    return extent.time_bounds(t.events, "ts")


@query("sample_head", "SELECT least(count(*), 10000) AS n_rows, CAST(0 AS BIGINT) AS n_strange FROM events")
def _(t):
    """Which rows come first is open; their number is not, and all lie in the table."""
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    head = materialize(extent.sample_head(t.events.select(*columns), 10_000), "head")
    strange = head.exceptAll(t.events.select(*columns)).agg(F.count(F.lit(1)).alias("n_strange"))
    return head.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_strange", strange.scalar())


@query(
    "slice_rows",
    "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 250 OFFSET 400",
)
def _(t):
    return q.slice_by_time(t.events.select("event_id", "ts", "value"), "ts", ["event_id"], 400, 250)


@query(
    "iter_chunks",
    """SELECT event_id, ts, (row_number() OVER (ORDER BY ts, event_id) - 1) // 300 AS chunk_id FROM events""",
)
def _(t):
    return ordering.chunk_rows(t.events.select("event_id", "ts"), ["ts", "event_id"], 300)


@query(
    "union_sources",
    """SELECT l_shipdate AS ts, l_returnflag AS tag, l_quantity AS metric FROM lineitem
       UNION ALL SELECT o_orderdate, o_orderpriority, o_totalprice FROM orders""",
)
def _(t):
    shipped = t.lineitem.selectExpr("l_shipdate AS ts", "l_returnflag AS tag", "l_quantity AS metric")
    ordered = t.orders.selectExpr("o_orderpriority AS tag", "o_totalprice AS metric", "o_orderdate AS ts")
    return files.union_sources([shipped, ordered])


# ---- preparation ---------------------------------------------------------------------


@query("normalize_ts_native", "SELECT event_id, ts FROM events")
def _(t):
    return tidy(normalize_ts(t.events.select("event_id", "ts"), "ts"))


@query("normalize_ts_date", "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts FROM events")
def _(t):
    return tidy(normalize_ts(t.events.selectExpr("event_id", "CAST(ts AS DATE) AS ts"), "ts"))


@query("normalize_ts_integer_s", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def _(t):
    seconds = t.events.select("event_id", scalar.cast_precision(F.col("ts"), "s").alias("ts"))
    return tidy(normalize_ts(seconds, "ts"))


@query("normalize_ts_integer_ns", "SELECT event_id, ts, epoch_us(ts) * 1000 AS ts_ns FROM events")
def _(t):
    nanos = t.events.select("event_id", scalar.cast_precision(F.col("ts"), "ns").alias("ts"))
    return tidy(normalize_ts(nanos, "ts", keep_nanos=True))


@query("normalize_ts_float", "SELECT event_id, date_trunc('second', ts) + INTERVAL 500 MILLISECOND AS ts FROM events")
def _(t):
    seconds = scalar.cast_precision(F.col("ts"), "s").cast("double") + 0.5
    return tidy(normalize_ts(t.events.select("event_id", seconds.alias("ts")), "ts"))


@query(
    "normalize_ts_string",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL
              WHEN event_type = 'click' THEN date_trunc('second', ts) - INTERVAL 90 MINUTE
              WHEN event_type = 'error' THEN date_trunc('day', ts) ELSE ts END AS ts FROM events""",
)
def _(t):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", None)
        .when(kind == "click", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30")))
        .when(kind == "error", F.date_format("ts", "MMMM d, yyyy"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )
    return tidy(normalize_ts(t.events.select("event_id", text.alias("ts")), "ts"))


@query("drop_null_ts", "SELECT event_id, ts FROM events WHERE event_type <> 'error'")
def _(t):
    holes = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))
    return prepare.drop_null_ts(holes, "ts")


@query(
    "fill_nulls",
    """SELECT event_id, ts, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS event_type,
              CASE WHEN event_type = 'click' THEN -1.0 ELSE value END AS value FROM events""",
)
def _(t):
    kind = F.col("event_type")
    holes = t.events.select(
        "event_id",
        "ts",
        F.when(kind != "error", kind).alias("event_type"),
        F.when(kind != "click", F.col("value")).alias("value"),
    )
    return prepare.fill_nulls(holes, events_schema(holes))


@query(
    "cast_precision",
    """SELECT event_id, epoch_us(ts) AS ts_us, epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) * 1000 AS ts_ns FROM events""",
)
def _(t):
    return t.events.select(
        "event_id", *[scalar.cast_precision(F.col("ts"), u).alias(f"ts_{u}") for u in ("us", "ms", "ns")]
    )


@query(
    "convert_units",
    """SELECT event_id, round(value * 1.8 + 32, 6) AS value, round(user_id / 1000.0, 6) AS user_id FROM events""",
)
def _(t):
    wanted = {"value": ("Celsius", "Fahrenheit"), "user_id": ("m", "km"), "absent": ("pa", "bar")}
    return tidy(units.convert_units(t.events.select("event_id", "value", "user_id"), wanted))


@query(
    "infer_roles",
    """WITH d AS (SELECT count(*) AS n_rows, count(DISTINCT event_type) AS e, count(DISTINCT props) AS p FROM events)
       SELECT 0 AS position, 'event_id' AS column_name, CAST(0 AS BIGINT) AS n_distinct, n_rows, 'metric' AS role FROM d
       UNION ALL SELECT 1, 'ts', 0, n_rows, 'timestamp' FROM d
       UNION ALL SELECT 2, 'user_id', 0, n_rows, 'metric' FROM d
       UNION ALL SELECT 3, 'event_type', e, n_rows, CASE WHEN e < 0.05 * n_rows THEN 'tag' ELSE 'other' END FROM d
       UNION ALL SELECT 4, 'value', 0, n_rows, 'metric' FROM d
       UNION ALL SELECT 5, 'props', p, n_rows, CASE WHEN p < 0.05 * n_rows THEN 'tag' ELSE 'other' END FROM d""",
)
def _(t):
    return infer_roles(t.events).na.fill(0, ["n_distinct"])


@query(
    "override_ts",
    "SELECT event_id, ts, date_trunc('second', ts) + INTERVAL 60 SECOND AS received FROM events",
)
def _(t):
    late = scalar.cast_precision(F.col("ts"), "s") + 60
    df = t.events.select("event_id", "ts", late.alias("received"))
    moved, _ = override_time(df, SeriesSchema("events", "ts", (), ("received",), df.schema), "received")
    return tidy(moved)


@query("project_all", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(t):
    return prepare.project_all(t.events, events_schema(t.events))


@query("time_filter", f"SELECT * FROM events WHERE {IN_WINDOW}")
def _(t):
    return prepare.time_filter(t.events, "ts", START, END)


@query(
    "bucket",
    """SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, time_bucket(INTERVAL 1 HOUR, ts) AS hour,
              time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS thursday,
              time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-05') AS monday FROM events""",
)
def _(t):
    return (
        t.events.select("event_id", "ts")
        .withColumn("quarter", bucket("ts", "15 minutes"))
        .withColumn("hour", bucket("ts", "1 hour"))
        .withColumn("thursday", bucket("ts", "7 days"))
        .withColumn("monday", bucket("ts", "7 days", MONDAY))
        .drop("ts")
    )


@query(
    "config_digest",
    """SELECT event_id, substring(md5('{"event_type":"' || event_type || '","user_id":' || user_id || '}'), 1, 8) AS digest
       FROM events""",
)
def _(t):
    return t.events.select("event_id", scalar.config_digest(["user_id", "event_type"]).alias("digest"))


# ---- the five query families ---------------------------------------------------------


@query("time_range", f"SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE {IN_WINDOW}")
def _(t):
    return q.time_range(t.events, "ts", START, END)


@query("time_range_limit", f"SELECT * FROM events WHERE {IN_WINDOW} ORDER BY ts, event_id LIMIT 1000")
def _(t):
    return q.time_range(t.events, "ts", START, END, ["event_id"], limit=1000)


def _bucket_sql(width: str, where: str = "", origin: str = "") -> str:
    return f"""SELECT time_bucket(INTERVAL {width}, ts{origin}) AS bucket, round(avg(value) + 1e-10, 6) AS avg_value,
               min(value) AS min_value, max(value) AS max_value FROM events {where} GROUP BY 1"""


@query("bucket_agg_1h", _bucket_sql("1 HOUR", f"WHERE {IN_WINDOW}"))
def _(t):
    return tidy(q.bucket_agg(t.events, "ts", "value", "1 hour", START, END))


@query(
    "bucket_agg_all_metrics",
    """SELECT time_bucket(INTERVAL 1 DAY, l_shipdate) AS bucket,
              round(avg(l_quantity) + 1e-10, 6) AS avg_l_quantity, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity,
              round(avg(l_extendedprice) + 1e-10, 6) AS avg_l_extendedprice, min(l_extendedprice) AS min_l_extendedprice,
              max(l_extendedprice) AS max_l_extendedprice FROM lineitem GROUP BY 1""",
)
def _(t):
    return tidy(q.bucket_agg(t.lineitem, "l_shipdate", ["l_quantity", "l_extendedprice"], "1 day"))


_LAST = f"""SELECT user_id, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id
            ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE {IN_WINDOW}) WHERE r = 1"""


@query("last_point", _LAST)
def _(t):
    return q.last_point(t.events, "user_id", "value", "ts", ["event_id"], START, END)


@query("last_point_agg", _LAST)
def _(t):
    return q.last_point_agg(t.events, "user_id", "value", "ts", ["event_id"], START, END)


@query(
    "tag_agg",
    f"""SELECT user_id, count(*) AS cnt, round(avg(value) + 1e-10, 6) AS avg_value FROM events WHERE {IN_WINDOW} GROUP BY 1""",
)
def _(t):
    return tidy(q.tag_agg(t.events, "user_id", "value", "ts", START, END))


@query("downsample_1m", _bucket_sql("1 MINUTE"))
def _(t):
    return tidy(q.downsample(t.events, "ts", "value", "1 minute"))


@query("downsample_1h", _bucket_sql("1 HOUR"))
def _(t):
    return tidy(q.downsample(t.events, "ts", "value", "1 hour"))


@query("downsample_1d", _bucket_sql("1 DAY"))
def _(t):
    return tidy(q.downsample(t.events, "ts", "value", "1 day"))


@query("downsample_1w", _bucket_sql("7 DAY", origin=", TIMESTAMP '1970-01-05'"))
def _(t):
    return tidy(q.downsample(t.events, "ts", "value", "7 days", origin=MONDAY))


def _level_sql(label: str, width: str) -> str:
    return f"SELECT '{label}' AS granularity, * FROM ({_bucket_sql(width)})"


@query(
    "downsample_multi",
    " UNION ALL ".join(
        _level_sql(label, width)
        for label, width in (("1 minute", "1 MINUTE"), ("1 hour", "1 HOUR"), ("1 day", "1 DAY"))
    ),
)
def _(t):
    return tidy(q.downsample_multi(t.events, "ts", "value"))


# ---- many windows --------------------------------------------------------------------

# One 30-hour window per day of the data, starting at 06:30, so neighbours overlap.
_DAILY = """w AS (SELECT epoch_us(d) // 86400000000 AS window_id, d + INTERVAL 390 MINUTE AS s, d + INTERVAL 2190 MINUTE AS e
            FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events))"""
_HITS = f"WITH {_DAILY}, h AS (SELECT w.window_id, events.* FROM events JOIN w ON ts >= s AND ts < e)"


def daily_windows(events):
    day = F.expr("CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ)")
    return (
        events.select(day.alias("d"))
        .distinct()
        .select(
            F.unix_date(F.to_date("d")).cast("bigint").alias("window_id"),
            F.expr("d + INTERVAL 390 MINUTE").alias("start"),
            F.expr("d + INTERVAL 2190 MINUTE").alias("end"),
        )
    )


@query("window_sweep_range", f"{_HITS} SELECT window_id, event_id, ts, value FROM h")
def _(t):
    rows = t.events.select("event_id", "ts", "value")
    return s.sweep_range(rows, "ts", daily_windows(t.events), ["event_id"])


@query(
    "window_sweep_bucket",
    f"""{_HITS} SELECT window_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, round(avg(value) + 1e-10, 6) AS avg_value,
        min(value) AS min_value, max(value) AS max_value FROM h GROUP BY 1, 2""",
)
def _(t):
    return tidy(s.sweep_bucket(t.events, "ts", daily_windows(t.events), "value"))


@query(
    "window_sweep_tag",
    f"{_HITS} SELECT window_id, user_id, count(*) AS cnt, round(avg(value) + 1e-10, 6) AS avg_value FROM h GROUP BY 1, 2",
)
def _(t):
    return tidy(s.sweep_tag(t.events, "ts", daily_windows(t.events), "user_id", "value"))


_LIMITED = """SELECT '{name}' AS operation, window_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts
    FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY ts, event_id) AS r FROM {rows})
    WHERE r <= {limit} GROUP BY 2"""


@query(
    "window_sweep",
    f"""WITH {_DAILY}, h AS (SELECT w.window_id, events.* FROM events JOIN w ON ts >= s AND ts < e),
        m AS (SELECT w.window_id, events.* FROM events JOIN w ON ts >= s AND ts < s + INTERVAL 1 HOUR) """
    + " UNION ALL ".join(
        _LIMITED.format(name=name, rows=rows, limit=limit)
        for name, rows, limit in (
            ("time_range_1h_limit_5", "m", 5),
            ("time_range_1h_limit_100", "m", 100),
            ("time_range_30h_limit_5", "h", 5),
            ("time_range_30h_limit_100", "h", 100),
        )
    ),
)
def _(t):
    long = daily_windows(t.events)
    short = long.withColumn("end", F.expr("start + INTERVAL 1 HOUR"))
    rows = t.events.select("event_id", "ts")
    return s.window_sweep(rows, "ts", {"1h": short, "30h": long}, ["event_id"], [5, 100])


@query(
    "window_sweep_limit_10000",
    f"""WITH {_DAILY}, h AS (SELECT w.window_id, events.* FROM events JOIN w ON ts >= s AND ts < e) """
    + " UNION ALL ".join(
        _LIMITED.format(name=f"time_range_limit_{limit}", rows="h", limit=limit) for limit in (1000, 10_000, 1_000_000)
    ),
)
def _(t):
    """Limits up to a million: ends are looked up by rank."""
    rows = t.events.select("event_id", "ts")
    return s.window_sweep(rows, "ts", {"30h": daily_windows(t.events)}, ["event_id"], [1000, 10_000, 1_000_000])


@query(
    "window_sweep_range_limit",
    f"""WITH {_DAILY}, h AS (SELECT w.window_id, event_id, ts, value, row_number() OVER (PARTITION BY window_id ORDER BY ts, event_id) AS r
        FROM events JOIN w ON ts >= s AND ts < e) SELECT window_id, event_id, ts, value FROM h WHERE r <= 25""",
)
def _(t):
    """The first 25 rows of every window."""
    return s.sweep_range(t.events.select("event_id", "ts", "value"), "ts", daily_windows(t.events), ["event_id"], 25)


_EVENT_WINDOWS = """w AS (SELECT event_id AS window_id, ts - to_minutes(event_id % 97) AS s,
    ts - to_minutes(event_id % 97) + to_minutes(1 + event_id % 300) AS e FROM events)"""


@query(
    "window_sweep_bucket_many",
    f"""WITH {_EVENT_WINDOWS}, h AS (SELECT window_id, ts, value FROM events JOIN w ON ts >= s AND ts < e)
        SELECT window_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, round(avg(value) + 1e-10, 6) AS avg_value,
        min(value) AS min_value, max(value) AS max_value FROM h GROUP BY 1, 2""",
)
def _(t):
    """As many windows as events, of one minute to five hours."""
    start = F.expr("ts - make_dt_interval(0, 0, CAST(event_id % 97 AS INT))")
    windows = t.events.select(F.col("event_id").alias("window_id"), start.alias("start")).withColumn(
        "end", F.expr("start + make_dt_interval(0, 0, CAST(1 + window_id % 300 AS INT))")
    )
    return tidy(s.sweep_bucket(t.events, "ts", windows, "value"))


def _pool(t):
    return s.query_pool(
        t.events, "ts", daily_windows(t.events), "event_type", "value", ["event_id"], limits=[50, 200]
    )


@query(
    "query_pool_range",
    f"""{_HITS} SELECT window_id, event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER
        (PARTITION BY window_id ORDER BY ts, event_id) AS r FROM h) WHERE r <= 50""",
)
def _(t):
    return _pool(t)["time_range"]()


@query(
    "query_pool_bucket",
    f"""{_HITS} SELECT window_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, round(avg(value) + 1e-10, 6) AS avg_value,
        min(value) AS min_value, max(value) AS max_value FROM h GROUP BY 1, 2""",
)
def _(t):
    return tidy(_pool(t)["aggregation"]())


@query(
    "query_pool_last",
    f"""{_HITS} SELECT window_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY window_id, event_type
        ORDER BY ts DESC, event_id DESC) AS r FROM h) WHERE r = 1""",
)
def _(t):
    return _pool(t)["last_point"]()


_RANDOM_WINDOWS = """WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
    w AS (SELECT CAST(i AS BIGINT) AS window_id, lo + to_microseconds(CAST(floor(CAST('0x' || substring(md5('window:42:' || i), 1, 8) AS BIGINT) / 4294967296.0
          * (epoch_us(hi) - epoch_us(lo) - 86400000000)) AS BIGINT)) AS s FROM b, range(20) r(i)),
    h AS (SELECT window_id, events.* FROM events JOIN w ON ts >= s AND ts < s + INTERVAL 1 DAY)"""


@query(
    "query_pool_shared",
    f"""{_RANDOM_WINDOWS} SELECT 'aggregation' AS query, window_id, time_bucket(INTERVAL 1 HOUR, ts) AS bucket, CAST(NULL AS VARCHAR) AS event_type,
        round(avg(value) + 1e-10, 6) AS avg_value, round(min(value) + 1e-10, 6) AS min_value, round(max(value) + 1e-10, 6) AS max_value, CAST(NULL AS DOUBLE) AS last_value,
        CAST(NULL AS TIMESTAMP) AS last_ts FROM h GROUP BY 2, 3
        UNION ALL SELECT 'last_point', window_id, NULL, event_type, NULL, NULL, NULL, round(value + 1e-10, 6), ts FROM (SELECT *, row_number() OVER
        (PARTITION BY window_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM h) WHERE r = 1""",
)
def _(t):
    """Twenty random days: buckets and last points from one scan."""
    windows = s.pool_windows(t.events, "ts", timedelta(days=1))
    return tidy(s.pool_answers(t.events, "ts", windows, "event_type", "value", ["event_id"]))


# ---- generators ----------------------------------------------------------------------


def _unit(text: str) -> str:
    """The hashed uniform of the generators, in SQL."""
    return f"CAST('0x' || substring(md5({text}), 1, 8) AS BIGINT) / 4294967296.0"


def _bits(text: str) -> str:
    return f"CAST('0x' || substring(md5({text}), 1, 15) AS BIGINT)"


@query("generate_iot")
def _(t):
    """One sensor per customer."""
    return g.generate_series(t.customer.select(F.col("c_custkey").alias("device")), 24)


@query(
    "generate_iot_profile",
    """SELECT 'device_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS device_id, CAST(24 AS BIGINT) AS readings,
              TIMESTAMP '2024-01-01 00:00:00' AS first_ts, TIMESTAMP '2024-01-01 23:59:59.999999' AS last_ts,
              true AS plausible FROM customer""",
)
def _(t):
    series = g.generate_series(t.customer.select(F.col("c_custkey").alias("device")), 24)
    plausible = (
        F.col("temperature").between(-40, 125)
        & F.col("humidity").between(0, 100)
        & F.col("voltage").between(2.3, 4.3)
        & F.col("pressure").between(99325, 103325)
    )
    return tidy(
        series.groupBy("device_id").agg(
            F.count(F.lit(1)).alias("readings"),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
            F.min(plausible).alias("plausible"),
        )
    )


@query(
    "random_windows",
    f"""WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
        o AS (SELECT CAST(i AS BIGINT) AS window_id, lo + to_microseconds(CAST(floor({_unit("'window:42:' || i")}
              * (epoch_us(hi) - epoch_us(lo) - 3600000000)) AS BIGINT)) AS start FROM b, range(50) r(i))
        SELECT window_id, start, start + INTERVAL 1 HOUR AS "end" FROM o""",
)
def _(t):
    return g.random_windows(t.events, "ts", 50, timedelta(hours=1))


@query(
    "late_windows",
    f"""WITH b AS (SELECT max(ts) AS hi FROM events),
        o AS (SELECT CAST(i AS BIGINT) AS window_id,
              hi - to_minutes(CAST(30 + floor({_unit("'late:42:' || i")} * 2850) AS BIGINT)) AS start FROM b, range(50) r(i))
        SELECT window_id, start, start + INTERVAL 1 HOUR AS "end" FROM o""",
)
def _(t):
    return g.late_windows(t.events, "ts", 50)


_MIXED = f"""WITH c AS (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 300 AS chunk_id FROM events),
    z AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS n FROM c),
    a AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY event_id) AS slot,
          row_number() OVER (PARTITION BY chunk_id ORDER BY {_bits("n || ':' || event_id")}, event_id) AS mixed FROM z)"""


@query(
    "shuffle_timestamps",
    f"""{_MIXED} SELECT x.event_id, x.chunk_id, x.value, y.ts FROM a x JOIN a y
        ON x.chunk_id = y.chunk_id AND x.slot = y.mixed""",
)
def _(t):
    chunks = ordering.chunk_rows(t.events.select("event_id", "ts", "value"), ["ts", "event_id"], 300)
    return g.shuffle_timestamps(chunks, "ts", "chunk_id", "event_id")


_SAMPLE = f"{_bits(chr(39) + 'sample:42:' + chr(39) + ' || event_id')} >> 8"


@query(
    "late_rows_sampled",
    f"SELECT * FROM events WHERE {IN_WINDOW} ORDER BY {_SAMPLE}, event_id LIMIT 100",
)
def _(t):
    return g.late_rows(
        t.events, "ts", "event_id", datetime.fromisoformat(START), datetime.fromisoformat(END), 100
    )


@query(
    "late_rows_restamped",
    f"""SELECT event_id, user_id, event_type, value, props, make_timestamp(epoch_us(TIMESTAMP '2024-01-20 00:00:00')
        + {_bits("'stamp:42:' || event_id")} % 1000000) AS ts FROM (SELECT * FROM events ORDER BY {_SAMPLE}, event_id LIMIT 100)""",
)
def _(t):
    """A window of one second: too few rows of its own, so others are moved into it."""
    start = datetime(2024, 1, 20)
    return g.late_rows(t.events, "ts", "event_id", start, start + timedelta(seconds=1), 100)
