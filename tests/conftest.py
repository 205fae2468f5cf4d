from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegauge import build_session  # noqa: E402
from tidegauge.schema import SeriesSchema  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="session")
def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet")


@pytest.fixture(scope="session")
def simple(spark):
    """100 minutes of five devices."""
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=i), f"d{i % 5:02d}", 20.0 + (i * 7 % 11) - 5) for i in range(100)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, device string, value double")


@pytest.fixture(scope="session")
def simple_schema(simple):
    return SeriesSchema("simple", "ts", ("device",), ("value",), simple.schema)
