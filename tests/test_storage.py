from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from tidegauge.errors import SourceError
from tidegauge.operators.generate import generate_iot, iot_schema
from tidegauge.schema import apply_hint
from tidegauge.sinks import files as out
from tidegauge.sinks import tables
from tidegauge.sources import files
from tidegauge.sources.object_store import account_of, connection_settings, is_object_url, rewrite_url
from tidegauge.sources.tables import drop_table, scan_table, table_exists


def test_csv_times_in_all_layouts(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        "ts,device,value\n2024-01-01T00:00:00Z,a,1\n2024-01-01T01:00:00+01:00,a,2\n"
        '2024-01-01 00:00:00,"b ""x"", y",3\n2024-01-01,c,4\n'
    )
    df = files.scan_csv(spark, str(path))
    assert df.schema["ts"].dataType.simpleString() == "timestamp"
    assert df.select("ts").distinct().count() == 1
    assert df.where("device = 'b \"x\", y'").count() == 1


@pytest.mark.parametrize("layout", ["lines", "array", "pretty"])
def test_json_lines_and_arrays(spark, tmp_path, layout):
    rows = [{"ts": "2024-01-01T00:00:00Z", "v": 1}, {"ts": "2024-01-02T00:00:00Z", "v": 2}]
    path = tmp_path / "a.json"
    if layout == "lines":
        path.write_text("\n".join(json.dumps(r) for r in rows))
    else:
        path.write_text("\n " + json.dumps(rows, indent=2 if layout == "pretty" else None))
    df = files.scan_json(spark, str(path))
    assert df.count() == 2 and df.schema["ts"].dataType.simpleString() == "timestamp"


def test_sources(spark, events, tmp_path):
    events.limit(10).coalesce(1).write.parquet(str(tmp_path / "b" / "deep"))
    events.limit(5).coalesce(1).write.parquet(str(tmp_path / "a"))
    found = files.resolve_sources(spark, [str(tmp_path)])
    assert len(found) == 2 and found == sorted(found)
    assert files.load_dataset(spark, str(tmp_path)).count() == 15
    assert files.load_dataset(spark, [str(tmp_path / "a"), str(tmp_path / "a" / "*.parquet")]).count() == 10


def test_deep_globs(spark, tmp_path):
    """``**`` stands for any folders or none; names are matched whole, and hidden files left out."""
    for name in ("x1.csv", "a/x2.csv", "a/b/x3.csv", "a/b/y.csv", "a/c d/x 4.jsonl", "a/_tmp/x5.csv", "a/b/x6.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("v\n1\n" if name.endswith("csv") else '{"v": 1}\n')
    names = lambda glob: [f[len(str(tmp_path)) + 1 :] for f in files.resolve_sources(spark, [f"{tmp_path}/{glob}"])]
    assert names("**/x*.csv") == ["a/b/x3.csv", "a/x2.csv", "x1.csv"]
    assert names("a/**/*.csv") == ["a/b/x3.csv", "a/b/y.csv", "a/x2.csv"]
    assert names("**/b/*.csv") == ["a/b/x3.csv", "a/b/y.csv"]
    assert names("a/**") == ["a/b/x3.csv", "a/b/y.csv", "a/c d/x 4.jsonl", "a/x2.csv"]
    assert names("a/b*/x?.csv") == ["a/b/x3.csv"]
    assert files.load_dataset(spark, f"{tmp_path}/**/x*").count() == 4


def test_json_folder_of_lines_and_arrays(spark, tmp_path):
    rows = [{"ts": "2024-01-01T00:00:00Z", "v": i} for i in range(5)]
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.json").write_text(json.dumps(rows[:2]))
    (tmp_path / "b.json").write_text("\n\n  " + json.dumps(rows[2:4], indent=2))
    (tmp_path / "c.json").write_text(json.dumps(rows[4]))
    (tmp_path / "d.json").write_text("")
    for paths in ([str(tmp_path)], [str(tmp_path / "*.json")], [str(tmp_path / f"{n}.json") for n in "abcd"]):
        assert sorted(r["v"] for r in files.scan_json(spark, *paths, schema="ts timestamp, v bigint").collect()) == [0, 1, 2, 3, 4]


def test_load_series(spark, tmp_path):
    """Roles, times and units in one step, inferred and by a hint."""
    lines = "".join(f"{1704067200 + i},d{i % 2},{i}.5,note {i}\n" for i in range(100))
    (tmp_path / "s.csv").write_text("ts,device,temp,note\n" + lines)
    df, found = files.load_series(spark, f"{tmp_path}/**/*.csv", units={"temp": ("celsius", "fahrenheit")})
    assert (found.time, found.tags, found.metrics) == ("ts", ("device",), ("temp",))
    first = df.orderBy("ts").first()
    assert df.schema["ts"].dataType.simpleString() == "timestamp" and first["temp"] == pytest.approx(0.5 * 1.8 + 32)
    assert found.struct["ts"].dataType == df.schema["ts"].dataType and df.schema["device"].metadata["role"] == "TAG"
    assert str(df.select(F.col("ts").cast("timestamp_ntz")).orderBy("ts").first()[0]) == "2024-01-01 00:00:00"
    hinted, own = files.load_series(spark, str(tmp_path / "s.csv"), hint=apply_hint(df, "h", "ts", ["note"], ["temp"]))
    assert own.tags == ("note",) and own.name == "h" and hinted.count() == 100


def test_missing_sources(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for wrong in (["/no/such/file.parquet"], [str(tmp_path / "empty")], [str(tmp_path / "*.csv")], []):
        with pytest.raises(SourceError):
            files.resolve_sources(spark, wrong)
    with pytest.raises(SourceError):
        files.scan_files(spark, ["a.xlsx"])


def test_mixed_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v,ts\n1,2024-01-01\n")
    (tmp_path / "b.jsonl").write_text('{"ts": "2024-01-02", "v": 2, "extra": true}\n')
    df = files.load_dataset(spark, [str(tmp_path / "*.csv"), str(tmp_path / "*.jsonl")])
    assert sorted(df.columns) == ["extra", "ts", "v"] and df.count() == 2


def test_object_urls():
    want = "abfss://data@acct.dfs.core.windows.net/year=2024/"
    assert rewrite_url("https://acct.blob.core.windows.net/data/year=2024/") == want
    assert rewrite_url("az://data/year=2024/", "acct") == want
    assert rewrite_url(want) == want
    assert rewrite_url("abfs://data@acct.dfs.core.windows.net/year=2024/") == want
    assert account_of("https://acct.blob.core.windows.net/data") == "acct"
    assert is_object_url("AZ://x/y") and not is_object_url("/data/x.parquet")
    with pytest.raises(SourceError):
        rewrite_url("az://data/x.parquet")


def test_object_credentials():
    text = "DefaultEndpointsProtocol=https;AccountName=acct;AccountKey=abc==;EndpointSuffix=core.windows.net"
    assert connection_settings(connection_string=text, sas_token="x") == {
        "fs.azure.account.key.acct.dfs.core.windows.net": "abc=="
    }
    assert connection_settings("acct", sas_token="?sv=1")["fs.azure.sas.fixed.token.acct.dfs.core.windows.net"] == "sv=1"
    assert connection_settings() == {}
    with pytest.raises(SourceError):
        connection_settings(sas_token="x")


def test_csv_round_trip_keeps_microseconds(spark, events, tmp_path):
    out.write_csv(events, str(tmp_path / "csv"))
    first = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert first[0] == "event_id,ts,user_id,event_type,value,props" and first[1].split(",")[1].endswith("Z")


def test_parts_are_disjoint(spark, tmp_path):
    df = generate_iot(spark, 10, 50)
    out.write_parts(df, str(tmp_path / "p"), 3)
    stored = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "p"))
    assert stored.columns == df.columns == files.load_dataset(spark, str(tmp_path / "p")).columns
    folder = F.regexp_extract("_metadata.file_path", "/part-([0-9]+)/", 1).alias("part")
    parts = stored.groupBy(folder).agg(F.min("device_id"), F.max("device_id"), F.count("*")).orderBy("part").collect()
    assert [p[3] for p in parts] == [150, 150, 200]
    with pytest.raises(ValueError):
        out.write_parts(df.withColumn("Part", F.lit(1)), str(tmp_path / "q"), 3)
    assert all(a[2] < b[1] for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("unit", ["HOUR", "day", "WEEK", "MONTH", "YEAR"])
def test_table_life_cycle(spark, tmp_path, unit):
    df = generate_iot(spark, 5, 10)
    schema, name = iot_schema(df), f"t_{uuid.uuid4().hex}"
    assert not table_exists(spark, name)
    tables.create_table(spark, name, schema, unit, str(tmp_path / name))
    tables.create_table(spark, name, schema, unit, str(tmp_path / name))  # again: no error
    assert scan_table(spark, name).count() == 0
    assert tables.ingest_append(df, name, schema, unit) == 50
    assert tables.ingest_append(df, name, schema, unit) == 50
    assert scan_table(spark, name).count() == 100
    check = tables.reconcile(scan_table(spark, name), df).first()
    assert check.asDict() == {"found_rows": 100, "expected_rows": 50, "missing_rows": -50, "complete": False}
    assert tables.ingest_reset(df, name, schema, unit, str(tmp_path / name)) == 50
    assert scan_table(spark, name).count() == 50
    drop_table(spark, name)
    drop_table(spark, name)


def test_bad_partition_unit(spark, tmp_path):
    df = generate_iot(spark, 1, 1)
    with pytest.raises(ValueError, match="FORTNIGHT"):
        tables.create_table(spark, "never", iot_schema(df), "FORTNIGHT", str(tmp_path))


def test_batches_lose_no_row(spark, simple):
    got = tables.ingest_batches(simple, ["ts", "device"], 33, workers=4)
    sizes = {(r["batch_id"], r["worker"]): r["count"] for r in got.groupBy("batch_id", "worker").count().collect()}
    assert sum(sizes.values()) == 100
    assert {b for b, _ in sizes} == {0, 1, 2, 3} and {w for b, w in sizes if b == 0} == {0, 1, 2, 3}
    assert sizes[(3, 0)] == 1
    one = tables.ingest_batches(simple, ["ts", "device"], 33)
    assert one.agg(F.max("worker"), F.max("batch_id")).first()[:] == (0, 3)


def test_measurement_layout(spark, tmp_path):
    log = spark.createDataFrame(
        [("r", "db", "a", 1), ("r", "db", "b", 2)], "run_id string, database_name string, operation string, n int"
    )
    out.write_measurements(log, str(tmp_path / "log"))
    out.write_measurements(log, str(tmp_path / "log"))
    assert (tmp_path / "log" / "run_id=r" / "database_name=db" / "operation=b").is_dir()
    assert spark.read.parquet(str(tmp_path / "log")).where("operation = 'b'").agg(F.sum("n")).first()[0] == 4


def test_bytes(spark):
    df = spark.createDataFrame([(1, "añ", None)], "a bigint, b string, c string")
    assert tables.estimate_bytes(df).first()[0] == 8 + 3
    assert tables.estimate_bytes(df.limit(0)).first()[0] == 0
