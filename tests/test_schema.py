from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.errors import SchemaError
from tidegauge.operators.generate import generate_iot, iot_schema
from tidegauge.schema import (
    SeriesSchema,
    apply_hint,
    infer_roles,
    infer_schema,
    override_time,
    spark_type,
    sql_type,
)


def roles(df, **options):
    return {r["column_name"]: r["role"] for r in infer_roles(df, **options).collect()}


def test_roles_of_a_plain_series(spark):
    df = generate_iot(spark, 5, 200)
    assert roles(df) == {
        "timestamp": "timestamp",
        "device_id": "tag",
        "temperature": "metric",
        "humidity": "metric",
        "voltage": "metric",
        "pressure": "metric",
    }


def test_threshold_is_strict(spark):
    df = spark.range(100).select(F.expr("timestamp_seconds(id)").alias("ts"), (F.col("id") % 5).cast("string").alias("t"))
    assert roles(df)["t"] == "other"  # 5 / 100 is not below 0.05
    assert roles(df, threshold=0.051)["t"] == "tag"


def test_empty_string_column_is_a_tag(spark):
    df = spark.createDataFrame([], "ts timestamp, t string, flag boolean")
    assert roles(df) == {"ts": "timestamp", "t": "tag", "flag": "other"}


def test_second_time_column_and_booleans_are_other(spark):
    df = spark.createDataFrame([], "n int, ts timestamp, day date, flag boolean")
    assert roles(df) == {"n": "metric", "ts": "timestamp", "day": "other", "flag": "other"}


def test_time_by_name_wins_over_later_time_type(spark):
    df = spark.createDataFrame([], "Time bigint, ts timestamp")
    assert roles(df) == {"Time": "timestamp", "ts": "other"}


def test_no_time_column_is_an_error(spark):
    with pytest.raises(SchemaError):
        infer_schema(spark.createDataFrame([], "a int, b string"))


def test_nulls_do_not_count_as_values(spark):
    df = spark.range(100).select(
        F.expr("timestamp_seconds(id)").alias("ts"), F.when(F.col("id") < 96, F.lit("x")).alias("t")
    )
    assert infer_roles(df).where("column_name = 't'").first()["n_distinct"] == 1


def test_approximate_roles_agree_on_clear_cases(events):
    assert roles(events, approximate=True)["event_type"] == roles(events)["event_type"] == "tag"


def test_schema_round_trip(spark):
    df = generate_iot(spark, 2, 2)
    schema = iot_schema(df)
    again = SeriesSchema.from_json(schema.to_json())
    assert (again.name, again.time, again.tags, again.metrics) == (schema.name, schema.time, schema.tags, schema.metrics)
    assert again.struct["timestamp"].dataType == T.TimestampType()


def test_lookups(simple_schema):
    assert simple_schema.by_role("tag") == ["device"]
    assert simple_schema.by_role("metric") == ["value"]
    assert simple_schema.by_role("other") == []
    assert simple_schema.role("ts") == "timestamp"
    with pytest.raises(KeyError):
        simple_schema.role("absent")


def test_metric_and_tag_choice(simple_schema):
    assert simple_schema.pick_metric() == "value"
    assert simple_schema.pick_metric("device") == "device"
    assert simple_schema.pick_metric("absent") == "value"
    assert SeriesSchema("x", "ts").pick_metric() == "value"
    assert SeriesSchema("x", "ts").pick_tag() == "device_id"


def test_hint(simple):
    schema = apply_hint(simple, "s", "ts", ["device"], [])
    assert schema.role("value") == "other"
    with pytest.raises(SchemaError, match="absent"):
        apply_hint(simple, "s", "ts", ["absent"])


def test_metadata_travels_with_the_frame(simple, simple_schema):
    marked = simple_schema.apply(simple)
    assert marked.schema["device"].metadata == {"role": "tag"}
    assert SeriesSchema.from_struct("again", marked.schema).metrics == ("value",)


def test_override_time(spark):
    df = spark.createDataFrame([("2024-01-01", 1704067260)], "ts string, at bigint")
    schema = SeriesSchema("s", "ts", (), ("at",), df.schema)
    moved, changed = override_time(df, schema, "at")
    assert changed.time == "at" and changed.role("ts") == "other" and changed.metrics == ()
    assert moved.select(F.date_format("at", "HH:mm:ss")).first()[0] == "00:01:00"
    assert override_time(df, schema, "ts")[1] is schema
    with pytest.raises(SchemaError):
        override_time(df, schema, "absent")


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("int8", T.ByteType()), ("int32", T.IntegerType()), ("int64", T.LongType()), ("uint32", T.LongType()),
        ("uint64", T.DecimalType(20, 0)), ("float32", T.FloatType()), ("double", T.DoubleType()),
        ("large_string", T.StringType()), ("boolean", T.BooleanType()), ("timestamp[ns]", T.TimestampType()),
        ("date32", T.DateType()), ("binary", T.StringType()),
    ],
)
def test_stored_type_names(name, expected):
    assert spark_type(name) == expected


@pytest.mark.parametrize(
    ("dtype", "expected"),
    [
        (T.ShortType(), "INTEGER"), (T.LongType(), "BIGINT"), (T.FloatType(), "REAL"), (T.DoubleType(), "DOUBLE PRECISION"),
        (T.StringType(), "TEXT"), (T.TimestampType(), "TIMESTAMP WITH TIME ZONE"), (T.DateType(), "TIMESTAMP WITH TIME ZONE"),
        (T.BooleanType(), "BOOLEAN"), (T.BinaryType(), "TEXT"), (T.DecimalType(20, 0), "DECIMAL(20,0)"),
    ],
)
def test_external_types(dtype, expected):
    assert sql_type(dtype) == expected
