"""Files and tables: written in the shared folder, read back, and checked."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidegauge.functions.scalar import micros
from tidegauge.operators.latency import load_rates, running_load
from tidegauge.operators.ordering import number_rows
from tidegauge.schema import SeriesSchema
from tidegauge.session import new_path
from tidegauge.sinks import files as out
from tidegauge.sinks import tables
from tidegauge.sources import files
from tidegauge.sources.tables import scan_table
from tidegauge.streaming.load import resumable_load
from tidegauge.streaming.sources import file_stream
from workload.base import events_schema, query, tidy

EVENTS_TYPES = "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"
EVENTS_TIMED = EVENTS_TYPES.replace("ts string", "ts timestamp")


@query("scan_csv", "SELECT * FROM events")
def _(t):
    path = new_path(t.spark, "csv")
    out.write_csv(t.events, path)
    return tidy(files.scan_csv(t.spark, path, schema=EVENTS_TYPES))


@query("scan_json", "SELECT * FROM events")
def _(t):
    path = new_path(t.spark, "json")
    out.write_json(t.events, path)
    return tidy(files.scan_json(t.spark, path, schema=EVENTS_TYPES))


@query("resolve_sources", "SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'view'")
def _(t):
    """A folder, a glob and a file at once, in two formats."""
    base = new_path(t.spark, "sources")
    out.write_parts(t.events.where("event_type <> 'click'"), f"{base}/parts", 3, "user_id")
    out.write_json(t.events.where("event_type = 'click'"), f"{base}/lines")
    out.write_parquet(t.events.where("event_type = 'view'"), f"{base}/views/nested")
    found = files.resolve_sources(t.spark, [f"{base}/parts", f"{base}/lines/*.json", f"{base}/views"])
    return tidy(files.scan_files(t.spark, found, EVENTS_TIMED))


@query("resolve_deep_glob", "SELECT * FROM events WHERE event_type IN ('view', 'click')")
def _(t):
    """Files of one name pattern at any depth, in two formats."""
    base = new_path(t.spark, "deep")
    for kind in ("view", "click", "purchase"):
        out.write_parquet(t.events.where(f"event_type = '{kind}'"), f"{base}/{kind}s/nested/data.{'parq' if kind == 'purchase' else 'set'}")
    return tidy(files.load_dataset(t.spark, f"{base}/**/data.set/*.parquet"))


@query("scan_json_folder", "SELECT * FROM events")
def _(t):
    """A folder that holds lines and whole arrays."""
    path = new_path(t.spark, "json")
    out.write_json(t.events.where("event_id % 3 > 0"), path)
    rows = out.times_as_text(t.events.where("event_id % 3 = 0"))
    array = rows.groupBy(F.expr("event_id div 10000").alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    array.write.mode("append").partitionBy("part").text(path)
    return tidy(files.scan_json(t.spark, path, schema=EVENTS_TYPES))


@query(
    "load_series",
    """SELECT event_id, ts, user_id, event_type, round(value * 9 / 5 + 32 + 1e-10, 6) AS value FROM events""",
)
def _(t):
    """Read, roles, time and units in one step."""
    path = new_path(t.spark, "series")
    rows = t.events.selectExpr("event_id", "unix_micros(CAST(ts AS timestamp)) * 1000L AS ts", "user_id", "event_type", "value")
    out.write_parquet(rows, path)
    df, found = files.load_series(t.spark, path, units={"value": ("celsius", "fahrenheit")})
    assert found.time == "ts" and "value" in found.metrics
    return tidy(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query("write_parquet", "SELECT * FROM lineitem")
def _(t):
    path = new_path(t.spark, "parquet")
    out.write_parquet(t.lineitem, path)
    return t.spark.read.parquet(path)


@query(
    "write_parts",
    """WITH d AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
       SELECT user_id, CAST(least(7, r // greatest(1, n // 8)) AS INT) AS part, count(*) AS n_rows FROM events JOIN d USING (user_id) GROUP BY 1, 2""",
)
def _(t):
    """Eight parts; every device lies in one of them."""
    path = new_path(t.spark, "parts")
    out.write_parts(t.events, path, 8, "user_id")
    stored = t.spark.read.option("recursiveFileLookup", "true").parquet(path)
    part = F.regexp_extract("_metadata.file_path", "/part-([0-9]+)/", 1).cast("int").alias("part")
    return stored.groupBy("user_id", part).agg(F.count(F.lit(1)).alias("n_rows"))


@query("write_csv", "SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts FROM events")
def _(t):
    path = new_path(t.spark, "csv")
    out.write_csv(t.events.select("event_id", "ts"), path)
    return t.spark.read.schema("event_id string, ts string").option("header", True).csv(path)


@query("export_json", "SELECT event_id, event_type, props FROM events")
def _(t):
    path = new_path(t.spark, "json")
    out.write_json(t.events.select("event_id", "event_type", "props"), path)
    return t.spark.read.schema("event_id bigint, event_type string, props string").json(path)


@query("write_measurements", "SELECT event_type AS operation, count(*) AS n_rows, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _(t):
    """Two appends of a log; both are there, each row in its own operation's folder."""
    path = new_path(t.spark, "log")
    log = t.events.selectExpr(
        "'run' AS run_id", "CAST(user_id AS string) AS database_name", "event_type AS operation", "value"
    )
    log = log.withColumn("database_name", F.lit("db"))
    out.write_measurements(log.where("value < 40"), path)
    out.write_measurements(log.where("value >= 40"), path)
    stored = t.spark.read.parquet(path)
    return tidy(
        stored.groupBy("operation").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total")), 4
    )


def _table(t, df, schema: SeriesSchema, unit: str) -> str:
    name = f"series_{uuid.uuid4().hex}"
    tables.create_table(t.spark, name, schema, unit, new_path(t.spark, name))
    tables.ingest_append(df, name, schema, unit)
    return name


def _orders(t) -> tuple:
    return t.orders, SeriesSchema(
        "orders", "o_orderdate", ("o_orderstatus", "o_orderpriority"), ("o_totalprice",), t.orders.schema
    )


def _events(t) -> tuple:
    return t.events, events_schema(t.events)


def _partition_query(unit: str, table: str, sql: str, source) -> None:
    @query(f"create_table_{unit.lower()}", f"SELECT {sql} AS p, count(*) AS n_rows FROM {table} GROUP BY 1")
    def _(t):
        df, schema = source(t)
        stored = scan_table(t.spark, _table(t, df, schema, unit))
        # Hours are text, other partitions dates.
        day = (F.col("p") if unit == "HOUR" else F.date_format("p", "yyyy-MM-dd")).alias("p")
        return stored.groupBy("p").agg(F.count(F.lit(1)).alias("n_rows")).select(day, "n_rows")


for _unit, _name, _sql, _source in (
    ("HOUR", "events", "strftime(ts, '%Y-%m-%d-%H')", _events),
    ("DAY", "events", "strftime(ts, '%Y-%m-%d')", _events),
    ("WEEK", "events", "strftime(date_trunc('week', ts), '%Y-%m-%d')", _events),
    ("MONTH", "orders", "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d')", _orders),
    ("YEAR", "orders", "strftime(date_trunc('year', o_orderdate), '%Y-%m-%d')", _orders),
):
    _partition_query(_unit, _name, _sql, _source)


@query("scan_table", "SELECT * FROM orders")
def _(t):
    orders, schema = _orders(t)
    return scan_table(t.spark, _table(t, orders, schema, "MONTH")).drop("p")


@query("ingest_append", "SELECT * FROM orders UNION ALL SELECT * FROM orders")
def _(t):
    orders, schema = _orders(t)
    name = _table(t, orders, schema, "MONTH")
    tables.ingest_append(orders, name, schema, "MONTH")
    return scan_table(t.spark, name).drop("p")


@query("ingest_reset", "SELECT * FROM orders")
def _(t):
    """What the table held before is gone."""
    orders, schema = _orders(t)
    name = _table(t, orders.withColumn("o_totalprice", F.lit(0.0)), schema, "YEAR")
    tables.ingest_reset(orders, name, schema, "YEAR", new_path(t.spark, name))
    return scan_table(t.spark, name).drop("p")


@query("ingest_reset_self", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    """A table that is replaced by some of its own rows, after a load that failed."""
    orders, schema = _orders(t)
    name = f"series_{uuid.uuid4().hex}"
    path = new_path(t.spark, name)
    tables.ingest_reset(orders, name, schema, "YEAR", path)
    broken = orders.withColumn("o_totalprice", F.expr("o_totalprice + if(o_orderkey > 0, raise_error('stop'), 0)"))
    try:
        tables.ingest_reset(broken, name, schema, "YEAR", path)
    except Exception as failure:
        if "stop" not in str(failure):
            raise
    tables.ingest_reset(scan_table(t.spark, name).where("o_orderstatus = 'F'"), name, schema, "YEAR", path)
    return scan_table(t.spark, name).drop("p")


@query(
    "ingest_batches",
    """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS total FROM events),
       b AS (SELECT event_id, r // 700 AS batch_id, r % 700 AS place, least(700, total - (r // 700) * 700) AS length FROM n)
       SELECT event_id, batch_id, (place * 3) // greatest(length, 3) AS worker FROM b""",
)
def _(t):
    return tables.ingest_batches(t.events.select("event_id", "ts"), ["ts", "event_id"], 700, 3).drop("ts")


@query(
    "reconcile",
    """SELECT (SELECT count(*) FROM orders) AS found_rows, (SELECT count(*) FROM lineitem) AS expected_rows,
              (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM orders) AS missing_rows,
              (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM orders) AS complete""",
)
def _(t):
    return tables.reconcile(t.orders, t.lineitem)


@query("estimate_bytes", "SELECT CAST(sum(32 + strlen(event_type) + strlen(props)) AS BIGINT) AS bytes FROM events")
def _(t):
    return tables.estimate_bytes(t.events)


@query("resumable_load", "SELECT * FROM events")
def _(t):
    """Loaded in two goes: the second takes only the files that came after the first."""
    base = new_path(t.spark, "load")
    source, target, checkpoint = f"{base}/in", f"{base}/out", f"{base}/checkpoint"
    t.events.where("value < 40").repartition(3, "event_id").write.parquet(source)
    for _round in range(2):
        stream = file_stream(t.spark, source, t.events.schema, max_files=1)
        resumable_load(stream, target, checkpoint).awaitTermination()
        if _round == 0:
            t.events.where("value >= 40 OR value IS NULL").write.mode("append").parquet(source)
    return t.spark.read.schema(t.events.schema).parquet(target)


_LOADS = "SELECT event_type AS load_id, epoch_us(ts) AS at_us, event_id, 1 + event_id % 1000 AS n FROM events"
_RUNNING = f"""SELECT load_id, event_id, CAST(sum(n) OVER (PARTITION BY load_id ORDER BY at_us, event_id) AS BIGINT) AS rows_so_far,
    (at_us - min(at_us) OVER (PARTITION BY load_id)) / 1e6 AS elapsed_s FROM ({_LOADS})"""


def _progress(t):
    return t.events.select(
        F.col("event_type").alias("load_id"),
        micros(F.col("ts")).alias("at_us"),
        "event_id",
        (F.lit(1) + F.col("event_id") % 1000).alias("n"),
    )


@query("running_load", f"SELECT load_id, event_id, rows_so_far, round(elapsed_s, 6) AS elapsed_s FROM ({_RUNNING})")
def _(t):
    running = running_load(_progress(t), "load_id", "at_us", "event_id", "n")
    return tidy(running.select("load_id", "event_id", "rows_so_far", "elapsed_s"))


@query(
    "load_rates",
    f"""WITH r AS (SELECT *, CASE WHEN elapsed_s > 0 THEN rows_so_far / elapsed_s ELSE 0 END AS rate FROM ({_RUNNING}))
        SELECT load_id, round(min(rate) FILTER (rate > 0), 6) AS min_rate, round(avg(rate) FILTER (rate > 0), 6) AS avg_rate,
               round(max(rate), 6) AS max_rate, max(rows_so_far) AS total_rows, round(max(elapsed_s), 6) AS duration_s,
               round(max(rows_so_far) / max(elapsed_s), 6) AS overall_rate FROM r GROUP BY 1""",
)
def _(t):
    return tidy(load_rates(_progress(t), "load_id", "at_us", "event_id", "n"))


@query(
    "number_rows",
    "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS row_number FROM lineitem",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return number_rows(rows, ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"])


