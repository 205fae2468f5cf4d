from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegauge.errors import SchemaError
from tidegauge.functions import scalar
from tidegauge.functions.buckets import align_out, bucket, ceil_to, floor_to, width_of, window_length
from tidegauge.functions.timeparse import normalize_ts
from tidegauge.functions.units import LINEAR_UNITS, convert_units

NEW_YEAR = "2024-01-01 00:00:00"


def parsed(spark, values, kind, **options):
    df = normalize_ts(spark.createDataFrame([(v,) for v in values], f"ts {kind}"), "ts", **options)
    assert df.schema["ts"].dataType.simpleString() == "timestamp"
    return [r[0] for r in df.select(F.col("ts").cast("string")).collect()]


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        ([datetime(2024, 1, 1)], "timestamp_ntz"),
        ([datetime(2024, 1, 1, tzinfo=timezone.utc)], "timestamp"),
        ([datetime(2024, 1, 1).date()], "date"),
        ([1704067200], "bigint"),
        ([1704067200], "int"),
        ([1704067200000000000], "bigint"),
        ([1704067200.0], "double"),
        (["2024-01-01T00:00:00Z"], "string"),
        (["2024-01-01T01:00:00+01:00"], "string"),
        (["2024-01-01 00:00:00"], "string"),
        (["January 1, 2024"], "string"),
        (["1 Jan 2024"], "string"),
        (["2024/01/01"], "string"),
    ],
)
def test_one_instant_many_spellings(spark, values, kind):
    assert parsed(spark, values, kind) == [NEW_YEAR]


def test_nulls_stay_null(spark):
    assert parsed(spark, [None, None], "bigint") == [None, None]
    assert parsed(spark, ["2024-01-01T00:00:00Z", None], "string") == [NEW_YEAR, None]
    assert parsed(spark, [None, 1704067200], "bigint") == [None, NEW_YEAR]


def test_fractions(spark):
    assert parsed(spark, [1704067200.5], "double") == [NEW_YEAR + ".5"]
    assert parsed(spark, [1704067200000001999], "bigint") == [NEW_YEAR + ".000001"]


@pytest.mark.parametrize("values", [[42], [-3600], [10**9], [1704067200000], [1704067200000000]])
def test_doubtful_epochs_are_refused(spark, values):
    with pytest.raises(SchemaError):
        parsed(spark, values, "bigint")


def test_given_units(spark):
    assert parsed(spark, [1704067200000], "bigint", unit="ms") == [NEW_YEAR]
    assert parsed(spark, [1704067200000000], "bigint", unit="us") == [NEW_YEAR]
    assert parsed(spark, [-1], "bigint", unit="ns") == ["1969-12-31 23:59:59.999999"]


def test_unit_does_not_depend_on_row_order(spark):
    assert parsed(spark, [0, 1704067200], "bigint") == ["1970-01-01 00:00:00", NEW_YEAR]


def test_bad_text(spark):
    with pytest.raises(PySparkException, match="not a timestamp"):
        parsed(spark, ["soon"], "string")
    assert parsed(spark, ["soon"], "string", strict=False) == [None]


def test_wrong_column_or_type(spark):
    with pytest.raises(SchemaError):
        normalize_ts(spark.range(1), "ts")
    with pytest.raises(SchemaError):
        normalize_ts(spark.range(1).select(F.lit(True).alias("ts")), "ts")


def test_every_unit_has_its_inverse(spark):
    for (a, b), (scale, offset) in LINEAR_UNITS.items():
        back_scale, back_offset = LINEAR_UNITS[(b, a)]
        assert (12.5 * scale + offset) * back_scale + back_offset == pytest.approx(12.5)


def test_unknown_unit_is_refused(spark):
    with pytest.raises(SchemaError):
        convert_units(spark.range(1), {"id": ("m", "mile")})
    assert convert_units(spark.range(1), {"absent": ("m", "mile")}).columns == ["id"]


def test_widths():
    assert width_of("30 minutes") == timedelta(minutes=30)
    assert width_of("1 day") == timedelta(days=1)
    assert window_length("1Week") == timedelta(weeks=1)
    for wrong in ("fortnight", "0 hours", "1 month", "-1 hour"):
        with pytest.raises(SchemaError):
            width_of(wrong)
    with pytest.raises(SchemaError):
        window_length("1month")


@pytest.mark.parametrize("width", ["1 minute", "7 hours", "1 day", "7 days"])
@pytest.mark.parametrize("origin", [datetime(1970, 1, 1), datetime(1970, 1, 5), datetime(2000, 1, 1, 3)])
def test_driver_and_cluster_agree_on_buckets(spark, width, origin):
    moments = [datetime(2024, 2, 29, 23, 59, 59, 999999), datetime(1969, 12, 31, 5), datetime(2024, 1, 1)]
    df = spark.createDataFrame([(m,) for m in moments], "ts timestamp_ntz")
    got = [r[0] for r in df.select(bucket("ts", width, origin)).collect()]
    assert got == [floor_to(m, width, origin) for m in moments]


def test_alignment():
    start, end = datetime(2024, 1, 1, 0, 10), datetime(2024, 1, 1, 2)
    assert align_out(start, end, "1 hour") == (datetime(2024, 1, 1), end)
    assert ceil_to(end, "1 hour") == end


def test_precision_floors_before_the_epoch(spark):
    df = spark.createDataFrame([(datetime(1969, 12, 31, 23, 59, 59, 999500),)], "ts timestamp_ntz")
    got = df.select(*[scalar.cast_precision(F.col("ts"), u).alias(u) for u in ("s", "ms", "us", "ns")]).first()
    assert tuple(got) == (-1, -1, -500, -500000)


def test_digest_ignores_column_order(events):
    a = events.select(scalar.config_digest(["user_id", "props"]).alias("d")).first()["d"]
    b = events.select(scalar.config_digest(["props", "user_id"]).alias("d")).first()["d"]
    assert a == b and len(a) == 8


def test_uniforms_are_uniform(spark):
    u = spark.range(20000).select(scalar.hashed_unit([F.lit("t"), F.col("id")]).alias("u"))
    got = u.agg(F.min("u"), F.max("u"), F.avg("u"), F.variance("u")).first()
    assert 0 <= got[0] < 0.001 and 0.999 < got[1] < 1
    assert got[2] == pytest.approx(0.5, abs=0.01) and got[3] == pytest.approx(1 / 12, abs=0.005)
