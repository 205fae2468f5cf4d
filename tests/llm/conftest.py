from __future__ import annotations

import pytest

from tidegauge.llm.base import prepared


@pytest.fixture(autouse=True, scope="session")
def _prepared(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return prepared(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, repeated rows, ties, odd white space, a long text and extra columns."""
    long = " ".join(f"w{i * 7919 % 1013}" for i in range(6000))
    text = "the quick brown fox jumps over the lazy dog again and again until the evening comes"
    rows = [
        (1, text, "en", 1), (2, text, "en", 2), (2, text, "en", 2), (3, text + " now", None, 3),
        (4, None, "en", 4), (5, "", "fr", 5), (6, " \n\t ", None, 6), (7, "a b", "fr", 7), (8, "A  b", "fr", 8),
        (9, long, "en", 9), (10, long + " end", "en", 10), (None, text, "en", 11), (None, None, None, 12),
        (11, "x y z\r\n12,5 don't \U0001f600 中文", "en", 13),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
