"""Measurement-log analytics over a log that ``events`` stands in for.

An event is one measured operation: its type names the operation, its value is the time it
took in milliseconds, its user decides database, batch size and workers. The first three
days are the warm-up. Runs are the ten-day periods of one operation on one database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import compare as c
from tidegauge.operators import latency as m
from tidegauge.operators import resources as res
from tidegauge.operators import runs as runs_ops
from tidegauge.operators import verdicts as v
from tidegauge.session import materialize
from workload.base import query, tidy

DBS = ["db0", "db1", "db2"]

_OPERATION = """CASE event_type WHEN 'click' THEN 'time_range_1h_limit_100' WHEN 'view' THEN 'aggregation_1day'
    WHEN 'purchase' THEN 'last_point' WHEN 'signup' THEN 'ingestion' ELSE 'custom_probe' END"""
_BENCHMARK = """CASE event_type WHEN 'click' THEN 'time_range' WHEN 'view' THEN 'aggregation'
    WHEN 'purchase' THEN 'last_point' WHEN 'signup' THEN 'ingestion' ELSE 'custom' END"""

# Spelled so that both engines accept it; only the day of the month differs.
_LOG = f"""SELECT event_id, ts, {_BENCHMARK} || '-db' || (user_id % 3) || '-' || CAST({{day}} AS {{text}}) AS run_id,
    'db' || (user_id % 3) AS database_name, {_OPERATION} AS operation, {_BENCHMARK} AS benchmark_name,
    CASE WHEN ts < {{warm}} '2024-01-04' THEN 'warmup' ELSE 'measurement' END AS phase,
    CAST(event_id AS INT) AS iteration,
    CAST(CASE WHEN user_id % 5 < 2 THEN 1000 ELSE 10000 END AS INT) AS batch_size,
    CAST(CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 ELSE 16 END AS INT) AS workers,
    CAST(round(value * 1e6) AS BIGINT) AS elapsed_ns, 1 + event_id % 1000 AS rows_processed,
    70 * (1 + event_id % 1000) AS bytes_processed"""
_LOG_SPARK = _LOG.format(day="(day(ts) - 1) div 10", text="STRING", warm="TIMESTAMP_NTZ")
_LOG_SQL = _LOG.format(day="(day(ts) - 1) // 10", text="VARCHAR", warm="TIMESTAMP") + " FROM events"

_RATES = f"""SELECT *, CASE WHEN elapsed_ns > 0 THEN rows_processed / (elapsed_ns / 1e9) ELSE 0 END AS rows_per_second,
    CASE WHEN elapsed_ns > 0 THEN bytes_processed / 1048576.0 / (elapsed_ns / 1e9) ELSE 0 END AS mb_per_second
    FROM ({_LOG_SQL})"""

OP = ["database_name", "operation"]


def operation_log(t) -> DataFrame:
    columns = _LOG_SPARK.replace("SELECT ", "", 1)
    events = t.events
    name = f"events_{abs(hash(t.folder))}"
    events.createOrReplaceTempView(name)
    return m.derive_rates(t.spark.sql(f"SELECT {columns} FROM {name}"))


@query(
    "derive_rates",
    f"SELECT event_id, round(rows_per_second, 3) AS rows_per_second, round(mb_per_second, 3) AS mb_per_second FROM ({_RATES})",
)
def _(t):
    return tidy(operation_log(t).select("event_id", "rows_per_second", "mb_per_second"), 3)


@query("measurement_only", f"SELECT event_id, operation, elapsed_ns FROM ({_LOG_SQL}) WHERE phase = 'measurement'")
def _(t):
    return m.measurement_only(operation_log(t)).select("event_id", "operation", "elapsed_ns")


@query(
    "pass_totals",
    f"""SELECT run_id, CAST(sum(elapsed_ns) AS BIGINT) AS elapsed_ns, CAST(sum(rows_processed) AS BIGINT) AS rows_processed,
        CAST(sum(bytes_processed) AS BIGINT) AS bytes_processed FROM ({_LOG_SQL}) GROUP BY 1""",
)
def _(t):
    return m.pass_totals(operation_log(t), ["run_id"])


_Q = f"""q AS (SELECT database_name, operation, quantile_cont(elapsed_ns, 0.25) AS q1, quantile_cont(elapsed_ns, 0.75) AS q3
    FROM log GROUP BY 1, 2)"""
_WITH = f"WITH log AS ({_RATES}), {_Q}"


@query(
    "latency_quartiles",
    f"""{_WITH} SELECT database_name, operation, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr FROM q""",
)
def _(t):
    return tidy(m.quartiles(operation_log(t), OP))


_FENCED = "elapsed_ns < q1 - 1.5 * (q3 - q1) OR elapsed_ns > q3 + 1.5 * (q3 - q1)"


@query("flag_outliers", f"{_WITH} SELECT event_id, {_FENCED} AS is_outlier FROM log JOIN q USING (database_name, operation)")
def _(t):
    return m.flag_outliers(operation_log(t), OP).select("event_id", "is_outlier")


@query(
    "outlier_counts",
    f"""{_WITH} SELECT database_name, operation, count(*) FILTER ({_FENCED}) AS outlier_count, count(*) AS sample_count
        FROM log JOIN q USING (database_name, operation) GROUP BY 1, 2""",
)
def _(t):
    return m.outlier_counts(operation_log(t), OP)


def _pct(points: dict[str, float], name: str) -> str:
    return ", ".join(
        f"""round(max(CASE WHEN rn = greatest(1, CAST(floor({p} * n + 0.5) AS BIGINT))
            THEN greatest(1, least(60000000000, elapsed_ns)) END) / 1e6, 6) AS {name.format(k)}"""
        for k, p in points.items()
    )


@query(
    "latency_percentiles",
    f"""{_WITH}, i AS (SELECT log.*, row_number() OVER (PARTITION BY database_name, operation ORDER BY elapsed_ns) AS rn,
        count(*) OVER (PARTITION BY database_name, operation) AS n FROM log JOIN q USING (database_name, operation)
        WHERE NOT ({_FENCED})) SELECT database_name, operation, {_pct(m.LATENCY_POINTS, "{}_ms")} FROM i GROUP BY 1, 2""",
)
def _(t):
    return tidy(m.latency_percentiles(operation_log(t), OP))


@query(
    "latency_moments",
    f"""{_WITH} SELECT database_name, operation, round(avg(elapsed_ns) / 1e6, 6) AS mean_ms, round(min(elapsed_ns) / 1e6, 6) AS min_ms,
        round(max(elapsed_ns) / 1e6, 6) AS max_ms, round(stddev_pop(elapsed_ns) / 1e6, 6) AS stddev_ms FROM log GROUP BY 1, 2""",
)
def _(t):
    return tidy(m.latency_moments(operation_log(t), OP))


@query(
    "throughput_stats",
    f"""{_WITH} SELECT database_name, operation, """
    + ", ".join(
        f"round(avg({x}), 3) AS {x}_mean, round(quantile_cont({x}, 0.95), 3) AS {x}_p95, round(quantile_cont({x}, 0.99), 3) AS {x}_p99"
        for x in ("rows_per_second", "mb_per_second")
    )
    + " FROM log GROUP BY 1, 2",
)
def _(t):
    return tidy(m.throughput_stats(operation_log(t), OP), 3)


# ---- summaries -----------------------------------------------------------------------

_K = "run_id, database_name, operation, batch_size, workers"
_SUMMARY_CTE = f"""log AS ({_RATES}), ms AS (SELECT * FROM log WHERE phase = 'measurement'),
    qs AS (SELECT {_K}, quantile_cont(elapsed_ns, 0.25) AS q1, quantile_cont(elapsed_ns, 0.75) AS q3 FROM ms GROUP BY ALL),
    fl AS (SELECT ms.*, q1, q3, NOT ({_FENCED}) AS inlier FROM ms JOIN qs USING ({_K})),
    rk AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY elapsed_ns) AS rn, count(*) OVER (PARTITION BY {_K}) AS n
           FROM fl WHERE inlier),
    pc AS (SELECT {_K}, {_pct(m.LATENCY_POINTS, "latency_{}_ms")} FROM rk GROUP BY ALL),
    ag AS (SELECT {_K}, CAST(sum(rows_processed) AS BIGINT) AS total_rows, count(*) AS sample_count,
           round(avg(rows_per_second), 3) AS rows_per_second_mean, round(quantile_cont(rows_per_second, 0.95), 3) AS rows_per_second_p95,
           round(quantile_cont(rows_per_second, 0.99), 3) AS rows_per_second_p99, round(avg(mb_per_second), 3) AS mb_per_second_mean,
           round(avg(elapsed_ns) / 1e6, 6) AS latency_mean_ms, round(min(elapsed_ns) / 1e6, 6) AS latency_min_ms,
           round(max(elapsed_ns) / 1e6, 6) AS latency_max_ms, round(max(q3 - q1) / 1e6, 6) AS latency_iqr_ms,
           round(stddev_pop(elapsed_ns) / 1e6, 6) AS latency_stddev_ms, count(*) FILTER (NOT inlier) AS latency_outlier_count
           FROM fl GROUP BY ALL),
    su AS (SELECT {_K}, """ + ", ".join(
    f"coalesce({x}, 0) AS {x}"
    for x in (
        "total_rows", "sample_count", "rows_per_second_mean", "rows_per_second_p95", "rows_per_second_p99", "mb_per_second_mean",
        "latency_p50_ms", "latency_p95_ms", "latency_p99_ms", "latency_p999_ms", "latency_mean_ms", "latency_min_ms",
        "latency_max_ms", "latency_iqr_ms", "latency_stddev_ms", "latency_outlier_count",
    )
) + f""" FROM (SELECT DISTINCT {_K} FROM log) LEFT JOIN ag USING ({_K}) LEFT JOIN pc USING ({_K})),
    summaries AS (SELECT *, run_id || '/' || operation || '/' || batch_size || '/' || workers AS id FROM su)"""  # fmt: skip
_RUNS_CTE = f"""runs AS (SELECT run_id, benchmark_name, database_name, min(ts) AS started_at,
    CASE WHEN database_name = 'db2' AND max(day(ts)) > 20 THEN NULL ELSE max(ts) END AS completed_at
    FROM ({_LOG_SQL}) GROUP BY 1, 2, 3)"""
_SUMMARIES = f"WITH {_SUMMARY_CTE}"
_LABELLED = f"""WITH {_SUMMARY_CTE}, {_RUNS_CTE},
    lab AS (SELECT summaries.*, coalesce(benchmark_name, 'unknown') AS benchmark_name FROM summaries LEFT JOIN
            (SELECT run_id, benchmark_name FROM runs WHERE benchmark_name <> 'custom') USING (run_id))"""


def summaries(t) -> DataFrame:
    """The summary table, computed for each query and stored like any summary table."""
    return materialize(_fresh_summaries(t), "summaries")


def _fresh_summaries(t) -> DataFrame:
    rows = m.summarize(operation_log(t))
    rounded = [F.round(x, 3).alias(x) if "per_second" in x else F.round(x, 6).alias(x) if k == "double" else F.col(x) for x, k in rows.dtypes]
    key = F.concat_ws("/", "run_id", "operation", "batch_size", "workers")
    return rows.select(*rounded).withColumn("id", key)


def runs(t) -> DataFrame:
    unfinished = (F.col("database_name") == "db2") & (F.max(F.day("ts")) > 20)
    return (
        operation_log(t)
        .groupBy("run_id", "benchmark_name", "database_name")
        .agg(F.min("ts").alias("started_at"), F.when(~unfinished, F.max("ts")).alias("completed_at"))
    )


def labelled(t) -> DataFrame:
    """Summaries with their benchmark; the runs of ``custom`` are missing from the run table."""
    return runs_ops.label_benchmark(summaries(t), runs(t).where("benchmark_name <> 'custom'"))


@query("summarize", f"{_SUMMARIES} SELECT * FROM summaries")
def _(t):
    return _fresh_summaries(t)


@query(
    "flatten_summary",
    f"{_SUMMARIES} SELECT *, " + ", ".join(f"CAST(NULL AS DOUBLE) AS resource_{f}" for f in m.RESOURCE_FIELDS) + " FROM summaries",
)
def _(t):
    return m.flatten_summary(m.nest_summary(summaries(t)))


# ---- resource samples ----------------------------------------------------------------

_SAMPLES_COLUMNS = """'run' || o_orderstatus AS run_id, o_orderkey AS sample_id,
    {ns} AS timestamp_ns, o_totalprice / 1000 AS cpu_percent, o_totalprice / 10 AS rss_mb, o_totalprice / 5 AS vm_used_mb,
    o_totalprice / 100 AS disk_read_mb, o_totalprice / 200 AS disk_write_mb, o_totalprice / 300 AS net_sent_mb,
    o_totalprice / 400 AS net_recv_mb, CAST(round(o_totalprice * 1000) AS BIGINT) AS disk_bytes, o_custkey * 4096 AS net_bytes"""
_SAMPLES_SQL = f"SELECT {_SAMPLES_COLUMNS.format(ns='epoch_us(o_orderdate) * 1000')} FROM orders"


def samples(t) -> DataFrame:
    """Resource samples, one per order."""
    name = f"orders_{abs(hash(t.folder))}"
    t.orders.createOrReplaceTempView(name)
    ns = "unix_micros(CAST(o_orderdate AS TIMESTAMP)) * 1000"
    return t.spark.sql(f"SELECT {_SAMPLES_COLUMNS.format(ns=ns)} FROM {name}")


_RESOURCE_SQL = f"""SELECT run_id, round(avg(cpu_percent) FILTER (rn > 1), 6) AS cpu_percent_mean,
    round(max(cpu_percent) FILTER (rn > 1), 6) AS cpu_percent_max, round(avg(rss_mb), 4) AS rss_mb_mean, round(max(rss_mb), 4) AS rss_mb_max,
    round(avg(vm_used_mb), 4) AS vm_used_mb_mean, round(max(vm_used_mb), 4) AS vm_used_mb_max,
    round(sum(disk_read_mb), 3) AS disk_read_mb_total, round(sum(disk_write_mb), 3) AS disk_write_mb_total,
    round(sum(net_sent_mb), 3) AS net_sent_mb_total, round(sum(net_recv_mb), 3) AS net_recv_mb_total,
    count(*) AS sample_count, round((max(timestamp_ns) - min(timestamp_ns)) / 1e9, 6) AS duration_s
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ns, sample_id) AS rn FROM ({_SAMPLES_SQL})) GROUP BY 1"""


def _rounded_resources(t) -> DataFrame:
    got = res.resource_summary(samples(t))
    digits = lambda x: 3 if x.endswith("total") else 4 if x.startswith(("rss", "vm")) else 6
    return got.select(*[F.round(x, digits(x)).alias(x) if k == "double" else F.col(x) for x, k in got.dtypes])


@query("resource_summary", _RESOURCE_SQL)
def _(t):
    return _rounded_resources(t)


@query(
    "counter_deltas",
    f"""SELECT run_id, sample_id, round(coalesce(greatest(0, disk_bytes - lag(disk_bytes) OVER w), 0) / 1048576.0, 6) AS disk_bytes_mb,
        round(coalesce(greatest(0, net_bytes - lag(net_bytes) OVER w), 0) / 1048576.0, 6) AS net_bytes_mb
        FROM ({_SAMPLES_SQL}) WINDOW w AS (PARTITION BY run_id ORDER BY timestamp_ns, sample_id)""",
)
def _(t):
    got = res.counter_deltas(samples(t), ["run_id"], ["timestamp_ns", "sample_id"], ["disk_bytes", "net_bytes"])
    return tidy(got.select("run_id", "sample_id", "disk_bytes_mb", "net_bytes_mb"))


# Every monitored run borrows the samples of one order status; db2 was not monitored.
_STATUS = "CASE database_name WHEN 'db0' THEN 'runF' WHEN 'db1' THEN 'runO' END"
_ATTACHED = f"""{_SUMMARIES}, rs AS ({_RESOURCE_SQL}), att AS (SELECT summaries.*, rs.cpu_percent_mean AS resource_cpu_percent_mean,
    rs.rss_mb_mean AS resource_rss_mb_mean, rs.sample_count AS resource_sample_count
    FROM summaries LEFT JOIN rs ON rs.run_id = {_STATUS})"""


def attached(t) -> DataFrame:
    per_status = _rounded_resources(t).withColumnRenamed("run_id", "status")
    known = summaries(t).select("run_id", F.expr(_STATUS).alias("status")).distinct()
    per_run = known.join(per_status, "status").drop("status")
    return res.attach_resources(summaries(t), per_run)


@query(
    "attach_resources",
    f"""{_ATTACHED} SELECT id, run_id, latency_p99_ms, resource_cpu_percent_mean, resource_rss_mb_mean FROM att""",
)
def _(t):
    return attached(t).select("id", "run_id", "latency_p99_ms", "resource_cpu_percent_mean", "resource_rss_mb_mean")


@query(
    "resource_rows",
    f"""{_ATTACHED} SELECT database_name, operation, resource_cpu_percent_mean FROM att WHERE resource_cpu_percent_mean IS NOT NULL""",
)
def _(t):
    return res.resource_rows(attached(t))


@query(
    "resource_timeline",
    f"""SELECT run_id, round((timestamp_ns - min(timestamp_ns) OVER (PARTITION BY run_id)) / 1e9, 6) AS time_s,
        round(cpu_percent, 6) AS cpu_percent, round(rss_mb, 6) AS rss_mb FROM ({_SAMPLES_SQL})""",
)
def _(t):
    return tidy(res.resource_timeline(samples(t)))


# ---- runs ----------------------------------------------------------------------------

_RUNS = f"WITH {_RUNS_CTE}"


@query(
    "upsert_runs",
    f"""WITH {_RUNS_CTE} SELECT run_id, benchmark_name, database_name, started_at, completed_at FROM runs""",
)
def _(t):
    """Every run was written at its start and again at its end; the last write counts."""
    finished = runs(t).withColumn("version", F.lit(1))
    started = finished.withColumn("completed_at", F.lit(None).cast("timestamp_ntz")).withColumn("version", F.lit(0))
    return runs_ops.upsert_runs(started.unionByName(finished))


@query("complete_run", f"{_RUNS} SELECT run_id, coalesce(completed_at, TIMESTAMP '2024-02-01') AS completed_at FROM runs")
def _(t):
    all_runs = runs(t)
    closing = all_runs.where("completed_at IS NULL").select(
        "run_id", F.expr("TIMESTAMP_NTZ '2024-02-01'").alias("finished_at")
    )
    return runs_ops.complete_run(all_runs, closing).select("run_id", "completed_at")


@query("list_runs", f"{_RUNS} SELECT * FROM runs ORDER BY started_at DESC, run_id")
def _(t):
    return runs_ops.list_runs(runs(t))


@query(
    "load_summaries",
    f"""{_SUMMARIES} SELECT * FROM summaries WHERE run_id IN ('time_range-db1-0', 'time_range-db1-1', 'ingestion-db1-2')
        AND database_name = 'db1' AND operation = 'time_range_1h_limit_100'""",
)
def _(t):
    wanted = ["time_range-db1-0", "time_range-db1-1", "ingestion-db1-2"]
    return runs_ops.load_summaries(summaries(t), wanted, "db1", "time_range_1h_limit_100")


@query(
    "load_summaries_of_runs",
    f"""WITH {_SUMMARY_CTE}, {_RUNS_CTE} SELECT * FROM summaries WHERE run_id IN (SELECT run_id FROM runs WHERE completed_at IS NOT NULL)""",
)
def _(t):
    """Summaries of all completed runs, however many."""
    return runs_ops.load_summaries(summaries(t), runs(t).where("completed_at IS NOT NULL"))


@query(
    "latest_runs",
    f"""{_RUNS} SELECT benchmark_name, database_name, arg_max(run_id, started_at) AS run_id, max(started_at) AS started_at
        FROM runs WHERE completed_at IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return runs_ops.latest_runs(runs(t))


@query("label_benchmark", f"{_LABELLED} SELECT id, run_id, benchmark_name FROM lab")
def _(t):
    return labelled(t).select("id", "run_id", "benchmark_name")


@query(
    "benchmark_order",
    f"""{_RUNS}, o AS (SELECT DISTINCT benchmark_name FROM runs) SELECT benchmark_name,
        CAST(CASE benchmark_name WHEN 'ingestion' THEN 1 WHEN 'time_range' THEN 3 WHEN 'aggregation' THEN 4
        WHEN 'last_point' THEN 5 ELSE 11 END AS INT) AS position FROM o""",
)
def _(t):
    return runs_ops.benchmark_order(runs(t))


# ---- comparison ----------------------------------------------------------------------


def _pivot_sql(metric: str) -> str:
    cells = ", ".join(f"arg_max({metric}, id) FILTER (database_name = '{d}') AS {d}" for d in DBS)
    return f"{_SUMMARIES} SELECT operation, batch_size, workers, {cells} FROM summaries GROUP BY 1, 2, 3"


@query("compare_pivot", _pivot_sql("latency_p99_ms"))
def _(t):
    return c.compare_pivot(summaries(t), "latency_p99_ms")


@query("run_id_pivot", _pivot_sql("run_id"))
def _(t):
    return c.run_id_pivot(summaries(t), DBS)


@query(
    "compare_runs",
    f"""{_SUMMARIES}, a AS (SELECT operation, batch_size, workers, database_name, arg_max(latency_p99_ms, id) AS value_a
            FROM summaries WHERE run_id LIKE '%-0' GROUP BY ALL),
        b AS (SELECT operation, batch_size, workers, database_name, arg_max(latency_p99_ms, id) AS value_b
            FROM summaries WHERE run_id LIKE '%-1' AND workers > 1 GROUP BY ALL)
        SELECT operation, batch_size, workers, database_name, value_a, value_b,
               round(CASE WHEN value_a <> 0 THEN (value_b - value_a) * 100.0 / value_a END, 6) AS delta_pct
        FROM a FULL JOIN b USING (operation, batch_size, workers, database_name)""",
)
def _(t):
    first = summaries(t).where("run_id LIKE '%-0'")
    second = summaries(t).where("run_id LIKE '%-1' AND workers > 1")
    return tidy(c.compare_runs(first, second, "latency_p99_ms"))




# The rows of the threshold table that the log's operations fall under.
_P99_LEVEL = """CASE WHEN p <= {0} THEN 'Great' WHEN p <= {1} THEN 'Solid' WHEN p <= {2} THEN 'Fair' ELSE 'Slow' END"""
_LEVEL = f"""CASE WHEN benchmark_name = 'ingestion' THEN (CASE WHEN r >= 500000 THEN 'Great' WHEN r >= 100000 THEN 'Solid'
        WHEN r >= 20000 THEN 'Fair' ELSE 'Slow' END)
    WHEN operation = 'time_range_1h_limit_100' THEN {_P99_LEVEL.format(75, 400, 4000)}
    WHEN operation = 'aggregation_1day' THEN {_P99_LEVEL.format(75, 650, 6500)}
    WHEN operation = 'last_point' THEN {_P99_LEVEL.format(150, 1300, 13000)}
    ELSE {_P99_LEVEL.format(75, 650, 6500)} END"""
_JUDGED = f"{_LABELLED}, j AS (SELECT *, {_LEVEL} AS verdict FROM (SELECT *, latency_p99_ms AS p, rows_per_second_mean AS r FROM lab))"
_THREE = "CASE WHEN verdict IN ('Great', 'Solid') THEN 'OK' ELSE verdict END"


@query("verdict_absolute", f"{_JUDGED} SELECT id, benchmark_name, verdict FROM j")
def _(t):
    return v.verdict_absolute(labelled(t)).select("id", "benchmark_name", "verdict")


@query("verdict_report", f"{_JUDGED} SELECT id, benchmark_name, {_THREE} AS verdict FROM j")
def _(t):
    return v.verdict_report(labelled(t)).select("id", "benchmark_name", "verdict")


_SCORE = """CASE WHEN benchmark_name = 'ingestion' THEN -rows_per_second_mean
    WHEN latency_p99_ms = 0 THEN 'inf'::DOUBLE ELSE latency_p99_ms END"""
_RELATIVE = f"""rel AS (SELECT id, benchmark_name, CASE WHEN up = 1 THEN 'Fastest' WHEN down = 1 THEN 'Slowest' ELSE 'Middle' END AS verdict
    FROM (SELECT id, benchmark_name, row_number() OVER (w ORDER BY {_SCORE}, id) AS up, row_number() OVER (w ORDER BY {_SCORE} DESC, id DESC) AS down,
          count(*) OVER w AS n FROM lab WINDOW w AS (PARTITION BY benchmark_name, operation, batch_size, workers)) WHERE n > 1)"""


@query("verdict_relative", f"{_LABELLED}, {_RELATIVE} SELECT * FROM rel")
def _(t):
    return v.verdict_relative(labelled(t)).select("id", "benchmark_name", "verdict")


@query(
    "assign_verdicts",
    f"{_JUDGED}, {_RELATIVE} SELECT j.id, coalesce(rel.verdict, j.verdict) AS verdict FROM j LEFT JOIN rel ON rel.id = j.id",
)
def _(t):
    return v.assign_verdicts(labelled(t)).select("id", "verdict")


_BEST = """bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark_name ORDER BY
    CASE WHEN benchmark_name = 'ingestion' THEN -rows_per_second_mean ELSE latency_p99_ms END, id) AS k FROM {}) WHERE k = 1)"""


@query(
    "best_per_benchmark",
    f"""{_LABELLED}, {_BEST.format("lab")} SELECT benchmark_name, operation, database_name, rows_per_second_mean, latency_p99_ms FROM bs""",
)
def _(t):
    return v.best_per_benchmark(labelled(t))


@query(
    "leader_trailer",
    f"""{_LABELLED}, s AS (SELECT *, benchmark_name = 'ingestion' AS fast, {_SCORE} AS lead,
            CASE WHEN benchmark_name = 'ingestion' THEN rows_per_second_mean ELSE latency_p99_ms END AS val FROM lab),
        e AS (SELECT benchmark_name, operation, bool_or(fast) AS fast, first(database_name ORDER BY lead, id) AS best_database,
            first(val ORDER BY lead, id) AS best_value,
            first(database_name ORDER BY CASE WHEN fast THEN val ELSE -val END, id) AS worst_database,
            first(val ORDER BY CASE WHEN fast THEN val ELSE -val END, id) AS worst_value, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT benchmark_name, operation, best_database, best_value, worst_database, worst_value,
            round(CASE WHEN fast THEN best_value / nullif(worst_value, 0) ELSE worst_value / nullif(best_value, 0) END, 6) AS ratio
        FROM e WHERE n > 1""",
)
def _(t):
    return tidy(v.leader_trailer(labelled(t)))


@query(
    "cv_percent",
    f"""{_SUMMARIES} SELECT id, round(CASE WHEN latency_mean_ms > 0 THEN latency_stddev_ms / latency_mean_ms * 100 END, 6) AS cv_percent
        FROM summaries""",
)
def _(t):
    return tidy(c.cv_percent(summaries(t)).select("id", "cv_percent"))


@query(
    "report_rollup",
    f"""{_JUDGED}, {_BEST.format("j")} SELECT (SELECT max(total_rows) FROM lab) AS max_total_rows,
            coalesce(max(rows_per_second_mean) FILTER (benchmark_name = 'ingestion'), 0) AS peak_rows_per_second,
            round(avg(latency_p99_ms) FILTER (benchmark_name <> 'ingestion'), 6) AS mean_query_p99_ms,
            count(*) FILTER ({_THREE} = 'OK') AS passed, (SELECT count(DISTINCT benchmark_name) FROM lab) AS total,
            (SELECT count(*) FROM runs WHERE completed_at IS NULL) AS unfinished_runs FROM bs""",
)
def _(t):
    return tidy(v.report_rollup(labelled(t), runs(t)))


def _half_up(value: str) -> str:
    """Three digits with ties away from zero in decimal, which is how Spark rounds."""
    return f"CAST(round(CAST({value} AS DECIMAL(28, 9)), 3) AS DOUBLE)"


@query(
    "mean_by_op_db",
    f"{_SUMMARIES} SELECT operation, database_name, {_half_up('avg(latency_p99_ms)')} AS latency_p99_ms FROM summaries GROUP BY 1, 2",
)
def _(t):
    return c.mean_by_op_db(summaries(t), "latency_p99_ms")


@query(
    "percentile_melt",
    f"""{_SUMMARIES}, u AS ("""
    + " UNION ALL ".join(
        f"SELECT operation, database_name, '{label}' AS percentile, {x} AS ms FROM summaries"
        for x, label in c.PERCENTILE_LABELS.items()
    )
    + f") SELECT operation, percentile, database_name, {_half_up('avg(ms)')} AS latency_ms FROM u WHERE ms IS NOT NULL GROUP BY 1, 2, 3",
)
def _(t):
    return c.percentile_melt(summaries(t))


@query(
    "throughput_series",
    f"{_SUMMARIES} SELECT operation, database_name, batch_size, rows_per_second_mean FROM summaries ORDER BY batch_size",
)
def _(t):
    return c.throughput_series(summaries(t))


@query(
    "overview",
    f"""{_SUMMARIES} SELECT count(DISTINCT run_id) AS runs, count(DISTINCT operation) AS operations,
        count(DISTINCT database_name) AS databases, CAST(sum(total_rows) AS BIGINT) AS total_rows FROM summaries""",
)
def _(t):
    return c.overview(summaries(t))


@query(
    "scaling_table",
    f"""{_SUMMARIES}, w AS (SELECT database_name, """
    + ", ".join(f"avg(latency_p99_ms) FILTER (workers = {n}) AS workers_{n}" for n in (1, 4, 8, 16))
    + """ FROM summaries GROUP BY 1) SELECT database_name, """
    + ", ".join(f"round(workers_{n}, 6) AS workers_{n}" for n in (1, 4, 8, 16))
    + ", round(workers_16 / workers_1, 6) AS degradation FROM w",
)
def _(t):
    return tidy(c.scaling_table(summaries(t), "latency_p99_ms"))


@query(
    "throughput_rank",
    f"""{_SUMMARIES}, a AS (SELECT operation, database_name, round(avg(rows_per_second_mean), 6) AS rows_per_second_mean FROM summaries GROUP BY 1, 2)
        SELECT *, CAST(rank() OVER (PARTITION BY operation ORDER BY rows_per_second_mean DESC) AS INT) AS rank FROM a""",
)
def _(t):
    return tidy(c.throughput_rank(summaries(t)))
