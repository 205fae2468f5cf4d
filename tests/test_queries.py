from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.errors import SchemaError
from tidegauge.operators import generate as g
from tidegauge.operators import prepare
from tidegauge.operators import queries as q
from tidegauge.operators import sweep as s

T0 = datetime(2024, 1, 1)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_window_is_half_open(simple):
    got = q.time_range(simple, "ts", T0 + timedelta(minutes=10), T0 + timedelta(minutes=20))
    assert got.count() == 10 and got.agg(F.max("ts")).first()[0] == T0 + timedelta(minutes=19)


def test_half_a_window_is_refused(simple):
    with pytest.raises(SchemaError):
        q.time_range(simple, "ts", T0, None)


@pytest.mark.parametrize("sort_in_one_task", [q.SORT_IN_ONE_TASK, 0])
@pytest.mark.parametrize(("offset", "length"), [(0, 1), (0, 10), (95, 10), (37, 41), (0, 1000), (100, 5), (5, 0)])
def test_slices(simple, monkeypatch, sort_in_one_task, offset, length):
    monkeypatch.setattr(q, "SORT_IN_ONE_TASK", sort_in_one_task)
    monkeypatch.setattr(q, "TIME_SLICES", 7)
    got = q.slice_by_time(simple, "ts", ["device"], offset, length).orderBy("ts")
    assert rows(got) == rows(simple.orderBy("ts"))[offset : offset + length]


def test_limit_with_one_hot_moment(spark):
    """A third of the rows share one time; the key settles which ones are first."""
    df = spark.range(900).select(
        "id", F.expr("timestamp_seconds(CASE WHEN id % 3 = 0 THEN 500 ELSE id END)").alias("ts")
    )
    got = q.time_range(df, "ts", key=["id"], limit=400)
    want = df.orderBy("ts", "id").limit(400)
    assert sorted(rows(got)) == sorted(rows(want))


def test_limit_on_nothing(simple):
    assert q.time_range(simple.where("false"), "ts", key=["device"], limit=5).count() == 0


@pytest.mark.parametrize("top_k_max", [q.TOP_K_MAX, 0])
def test_limited_groups(simple, monkeypatch, top_k_max):
    monkeypatch.setattr(q, "TOP_K_MAX", top_k_max)
    assert [r["device"] for r in q.tag_agg(simple, "device", "value", "ts", limit=2).collect()] == ["d00", "d01"]
    assert q.bucket_agg(simple, "ts", "value", "10 minutes", limit=3).count() == 3
    assert q.last_point(simple, "device", "value", "ts", limit=4).count() == 4


def test_last_point_ties_go_to_the_larger_key(spark):
    df = spark.createDataFrame(
        [("a", 1.0, T0, 1), ("a", 2.0, T0, 2), (None, 3.0, T0, 3), ("b", None, T0, 4)],
        "tag string, v double, ts timestamp_ntz, id int",
    )
    for form in (q.last_point, q.last_point_agg):
        got = {r["tag"]: r["v"] for r in form(df, "tag", "v", "ts", ["id"]).collect()}
        assert got == {"a": 2.0, None: 3.0, "b": None}


def test_averages_of_partials_skip_nulls(spark):
    df = spark.createDataFrame(
        [(T0, 1.0), (T0, None), (T0 + timedelta(hours=2), None)], "ts timestamp_ntz, v double"
    )
    got = {(r["granularity"], r["bucket"]): r["avg_v"] for r in q.downsample_multi(df, "ts", "v", ["1 hour", "1 day"]).collect()}
    assert got == {("1 hour", T0): 1.0, ("1 hour", T0 + timedelta(hours=2)): None, ("1 day", T0): 1.0}


def test_levels_that_do_not_nest(simple):
    """25 and 40 minutes share 5-minute partial results."""
    got = q.downsample_multi(simple, "ts", "value", ["25 minutes", "40 minutes"])
    for width in ("25 minutes", "40 minutes"):
        one = q.downsample(simple, "ts", "value", width).withColumn("avg_value", F.round("avg_value", 9))
        many = got.where(F.col("granularity") == width).drop("granularity").withColumn("avg_value", F.round("avg_value", 9))
        assert rows(one) == rows(many)


def test_fill_nulls_leaves_the_time_alone(spark, simple_schema):
    df = spark.createDataFrame([(None, None, None)], simple_schema.struct)
    assert rows(prepare.fill_nulls(df, simple_schema)) == [(None, "", -1.0)]


def brute(df, time, windows):
    data, found = df.collect(), []
    for w in windows:
        found += [(w[0], r["id"]) for r in data if w[1] <= r[time] < w[2]]
    return sorted(found)


def test_sweep_equals_brute_force(spark):
    """Windows of very different lengths, empty ones, and ones that overlap or repeat."""
    df = spark.range(500).select("id", F.expr("CAST(timestamp_millis(id * id * 40) AS timestamp_ntz)").alias("ts"))
    base = datetime(1970, 1, 1)
    moments = [(0, 1), (0, 3600), (17, 17), (40, 10), (5000, 5001), (100, 9000), (100, 9000), (9990, 20000), (1, 100000)]
    windows = [(i, base + timedelta(seconds=a), base + timedelta(seconds=b)) for i, (a, b) in enumerate(moments)]
    frame = s.windows_frame(spark, [w[1:] for w in windows])
    want = brute(df, "ts", windows)
    assert sorted(rows(s.sweep_range(df, "ts", frame, ["id"]).select("window_id", "id"))) == want
    for limit in (1, 7, 10_000):
        cut = [w for i, w in enumerate(want) if sum(v[0] == w[0] for v in want[:i]) < limit]
        assert sorted(rows(s.sweep_range(df, "ts", frame, ["id"], limit).select("window_id", "id"))) == cut


def test_limits_with_ties(spark):
    """Repeated rows, null keys and one moment for a third of all rows: exactly the limit, by time and key."""
    base = datetime(2024, 1, 1)
    data = [(base + timedelta(seconds=i // 7), None if i % 5 == 0 else i % 3) for i in range(300)] + [(base + timedelta(seconds=20), i % 4) for i in range(150)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, k int").repartition(5)
    windows = [(base + timedelta(seconds=a), base + timedelta(seconds=b)) for a, b in ((0, 60), (20, 21), (19, 30), (50, 50), (90, 99))]
    order = lambda r: (r[0], r[1] is not None, r[1] or 0)
    for limit in (1, 5, 160, 1000):
        want = []
        for i, (low, high) in enumerate(windows):
            want += [(i, *r) for r in sorted((r for r in data if low <= r[0] < high), key=order)[:limit]]
        got = rows(s.sweep_range(df, "ts", s.windows_frame(spark, windows), ["k"], limit).select("window_id", "ts", "k"))
        assert sorted(got, key=lambda r: (r[0], order(r[1:]))) == want
        extents = s.window_sweep(df, "ts", {"w": s.windows_frame(spark, windows)}, ["k"], [limit]).collect()
        found = {i: [r for r in want if r[0] == i] for i, *_ in want}
        assert {(r["window_id"], r["n_rows"], r["first_ts"], r["last_ts"]) for r in extents} == {
            (i, len(own), own[0][1], own[-1][1]) for i, own in found.items()
        }


def test_sweep_before_1970_and_exact_powers(spark):
    df = spark.createDataFrame([(i, datetime(1969, 12, 31, 23, 59, 59) + timedelta(microseconds=i * 2**18)) for i in range(16)], "id int, ts timestamp_ntz")
    start = datetime(1969, 12, 31, 23, 59, 59)
    windows = [(i, start + timedelta(microseconds=a), start + timedelta(microseconds=a + 2**k)) for i, (a, k) in enumerate([(0, 20), (1, 20), (2**18, 18), (2**20 - 1, 21)])]
    got = s.sweep_range(df, "ts", s.windows_frame(spark, [w[1:] for w in windows]), ["id"]).select("window_id", "id")
    assert sorted(rows(got)) == brute(df, "ts", windows)


def test_sweep_without_windows(spark, simple):
    none = s.windows_frame(spark, [])
    assert s.sweep_bucket(simple, "ts", none, "value").count() == 0


def test_generator_does_not_depend_on_partitioning(spark):
    one = g.generate_iot(spark, 7, 11, seed=5)
    many = g.generate_series(spark.range(7).withColumnRenamed("id", "device").repartition(5), 11, seed=5)
    assert sorted(rows(one)) == sorted(rows(many))
    other = g.generate_iot(spark, 7, 11, seed=6)
    assert set(rows(one.select("temperature"))) != set(rows(other.select("temperature")))


def test_generator_parts_continue_the_numbering(spark):
    whole = g.generate_iot(spark, 10, 3)
    parts = g.generate_iot(spark, 6, 3).unionByName(g.generate_iot(spark, 4, 3, first_device=6))
    assert sorted(rows(whole)) == sorted(rows(parts))


def test_generator_blocks(spark, monkeypatch):
    monkeypatch.setattr(g, "READINGS_PER_BLOCK", 4)
    got = g.generate_series(spark.range(3).withColumnRenamed("id", "device"), 11)
    assert sorted(rows(got)) == sorted(rows(g.generate_iot(spark, 3, 11)))


def test_generator_grid_and_distributions(spark):
    df = g.generate_iot(spark, 100, 200)
    got = df.select(
        F.count("*"), F.count_distinct("device_id"), F.min("timestamp").cast("string"), F.max("timestamp").cast("string"),
        F.avg("temperature"), F.stddev("temperature"), F.avg("humidity"), F.variance(F.col("humidity") / 100),
        F.avg("voltage"), F.stddev("voltage"), F.avg("pressure"), F.stddev("pressure"),
        F.min("humidity"), F.max("humidity"), F.min("device_id"),
    ).first()
    assert got[:4] == (20000, 100, "2024-01-01 00:00:00", "2024-01-01 23:59:59.999999") and got[14] == "device_000000"
    assert got[4] == pytest.approx(20, abs=0.2) and got[5] == pytest.approx(5, rel=0.03)
    assert got[6] == pytest.approx(100 * 2 / 7, rel=0.02) and got[7] == pytest.approx(10 / 392, rel=0.05)
    assert got[8] == pytest.approx(3.3, abs=0.01) and got[9] == pytest.approx(0.1, rel=0.03)
    assert got[10] == pytest.approx(101325, abs=10) and got[11] == pytest.approx(200, rel=0.03)
    assert 0 <= got[12] and got[13] <= 100


def test_random_windows(simple):
    hour = timedelta(hours=1)
    got = g.random_windows(simple, "ts", 20, hour).collect()
    assert len({r["start"] for r in got}) == 20
    assert all(T0 <= r["start"] and r["end"] - r["start"] == hour and r["end"] <= T0 + timedelta(minutes=99) for r in got)
    assert got == g.random_windows(simple, "ts", 20, hour).collect()
    week = timedelta(weeks=1)
    full = (0, T0, T0 + timedelta(minutes=99))
    assert rows(g.random_windows(simple, "ts", 3, week)) == [full]
    assert rows(g.random_windows(simple, "ts", 3, week, repeat_full=True)) == [(i, *full[1:]) for i in range(3)]
    assert g.random_windows(simple.where("false"), "ts", 3, hour).count() == 0


def test_late_windows(events):
    last = events.agg(F.max("ts")).first()[0]
    for r in g.late_windows(events, "ts", 30).collect():
        assert timedelta(minutes=30) <= last - r["start"] <= timedelta(hours=48) and r["end"] - r["start"] == timedelta(hours=1)
    assert g.late_windows(events.where("false"), "ts", 3).count() == 0


def test_late_rows(events):
    start, end = datetime(2024, 1, 10), datetime(2024, 1, 20)
    own = g.late_rows(events, "ts", "event_id", start, end, 50)
    assert own.join(events, events.columns, "left_anti").count() == 0 and own.count() == 50
    assert own.select("event_id").distinct().count() == 50
    moved = g.late_rows(events, "ts", "event_id", start, start + timedelta(seconds=2), 50)
    assert moved.count() == 50 and moved.where(~F.col("ts").between(start, start + timedelta(seconds=2))).count() == 0
    assert g.late_rows(events, "ts", "event_id", start, start, 50).count() == 0
    everything = g.late_rows(events, "ts", "event_id", start, start + timedelta(seconds=2), 5000)
    assert everything.count() == events.count()


def test_shuffle_keeps_the_times_of_a_batch(events):
    batches = events.withColumn("batch", F.expr("event_id div 250"))
    mixed = g.shuffle_timestamps(batches, "ts", "batch", "event_id")
    assert mixed.columns == batches.columns
    pairs = ["batch", "ts"]
    assert mixed.select(pairs).exceptAll(batches.select(pairs)).count() == 0
    moved = mixed.join(batches, ["event_id", "ts"], "left_anti").count()
    assert moved > 0.9 * events.count()
    again = g.shuffle_timestamps(batches.repartition(3), "ts", "batch", "event_id")
    assert again.exceptAll(mixed).count() == 0


def test_bucket_sweep(spark, events):
    """Overlapping, nested, repeated, touching, empty and outlying windows."""
    day = lambda d, h=0: datetime(2024, 1, d, h)
    windows = [
        (day(3), day(9)), (day(4), day(5, 7)), (day(4), day(5, 7)), (day(9), day(10)), (day(20), day(20)),
        (day(20, 3), day(20, 4)), (datetime(2023, 1, 1), datetime(2023, 6, 1)), (day(29), datetime(2024, 6, 1)),
    ]
    got = s.sweep_bucket(events, "ts", s.windows_frame(spark, windows), "value", "6 hours")
    want = []
    for i, (start, end) in enumerate(windows):
        for r in q.bucket_agg(events, "ts", "value", "6 hours", start, end).collect():
            want.append((i, r["bucket"], round(r["avg_value"], 9), r["min_value"], r["max_value"]))
    assert sorted((r[0], r[1], round(r[2], 9), r[3], r[4]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("kind", ["bigint", "decimal(12,3)"])
def test_bucket_sweep_keeps_types(spark, events, kind):
    """Sums beyond a bigint, decimals, and window ids that are text."""
    value = F.expr("9000000000000000000 - event_id") if kind == "bigint" else F.expr("event_id / 7")
    series = events.select("ts", value.cast(kind).alias("value"))
    windows = s.windows_frame(spark, [(datetime(2024, 1, 3), datetime(2024, 1, 9)), (datetime(2024, 1, 4), datetime(2024, 1, 5, 7))])
    named = windows.withColumn("window_id", F.concat(F.lit("w"), "window_id"))
    want = {}
    for r in series.where("ts >= '2024-01-03' AND ts < '2024-01-09'").collect():
        for name, low, high in (("w0", 3, datetime(2024, 1, 9)), ("w1", 4, datetime(2024, 1, 5, 7))):
            if datetime(2024, 1, low) <= r["ts"] < high:
                at = r["ts"].replace(hour=r["ts"].hour // 6 * 6, minute=0, second=0, microsecond=0)
                want.setdefault((name, at), []).append(r["value"])
    want = sorted((*k, float(sum(v)) / len(v), min(v), max(v)) for k, v in want.items())
    got = s.sweep_bucket(series, "ts", named, "value", "6 hours")
    assert [k for _, k in got.dtypes] == ["string", "timestamp_ntz", "double", kind, kind]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("granularity", ["1 hour", "1 second"])
def test_bucket_sweep_of_many_windows(spark, granularity):
    """More windows than buckets, before and after 1970, ends on and off grains of every size."""
    import random

    draw, tick = random.Random(5), timedelta(microseconds=1)
    base = datetime(1969, 12, 31, 20)
    data = [(base + draw.randrange(8 * 3600 * 10**6) * tick, float(i)) for i in range(400)]
    data += [(base + k * timedelta(hours=1) / 8, float(k)) for k in range(60)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, value double")
    windows = []
    for _ in range(500):
        start = base + draw.choice([draw.randrange(8 * 3600 * 10**6) * tick, draw.randrange(64) * timedelta(hours=1) / 8])
        windows.append((start, start + draw.choice([3 * tick, timedelta(minutes=7.5), timedelta(hours=2.3), timedelta(minutes=1)])))
    width = {"1 hour": timedelta(hours=1), "1 second": timedelta(seconds=1)}[granularity]
    want = {}
    for i, (low, high) in enumerate(windows):
        for ts, value in data:
            if low <= ts < high:
                want.setdefault((i, ts - (ts - datetime(1970, 1, 1)) % width), []).append(value)
    got = s.sweep_bucket(df, "ts", s.windows_frame(spark, windows), "value", granularity).collect()
    assert {(r[0], r[1]): (round(r[2], 9), r[3], r[4]) for r in got} == {
        k: (round(sum(v) / len(v), 9), min(v), max(v)) for k, v in want.items()
    }
    assert len(got) == len(want)


@pytest.mark.parametrize("zone", ["timestamp", "timestamp_ntz"])
def test_sweeps_take_zoned_times(spark, events, zone):
    series = events.withColumn("ts", F.col("ts").cast(zone))
    frame = s.windows_frame(spark, [(datetime(2024, 1, 3), datetime(2024, 1, 4)), (datetime(2024, 1, 3, 12), datetime(2024, 1, 5))])
    assert s.sweep_bucket(series, "ts", frame, "value").count() > 0
    assert s.sweep_tag(series, "ts", frame, "event_type", "value").agg(F.sum("cnt")).first()[0] == sum(
        events.where(F.col("ts").between(a, b)).count()
        for a, b in [("2024-01-03", "2024-01-03 23:59:59.999999"), ("2024-01-03 12:00:00", "2024-01-04 23:59:59.999999")]
    )


def test_pool_answers_share_one_scan(spark, events):
    windows = s.pool_windows(events, "ts", timedelta(days=1))
    assert windows.count() == 20 and s.pool_windows(events, "ts", timedelta(days=1), rounds=25).count() == 25
    both = s.pool_answers(events, "ts", windows, "event_type", "value", ["event_id"])
    text = both._jdf.queryExecution().sparkPlan().toString()
    assert text.count("event_id") and text.count("Expand") == 1 and text.count("FileScan parquet") == 2  # rows and windows
    pool = s.query_pool(events, "ts", windows, "event_type", "value", ["event_id"])
    assert both.where("query = 'last_point'").count() == pool["last_point"]().count()
