"""Systematic mixing against exact fractions, its bounds, and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import pytest

from tidegauge.llm import mixing


def level(sizes, weights, share, limit):
    """Targets by resharing what is above the limit until nothing is."""
    total, open_, out = share * sum(sizes), set(range(len(sizes))), {}
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if total * weights[i] / weight > limit * sizes[i]}
        if not over:
            return [out.get(i, total * weights[i] / weight) for i in range(len(sizes))]
        for i in over:
            out[i] = Fraction(limit) * sizes[i]
            total -= out[i]
        open_ -= over
    return [out[i] for i in range(len(sizes))]


def brute(rows, weights=(3, 1, 2), share=Fraction(3, 2), limit=2):
    """(key, size, source size, target, copies) of every row (key, source, size)."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, s, n in rows if s == name) for name in names]
    aims = level(sizes, [weights[i % len(weights)] for i in range(len(names))], share, limit)
    out = []
    for name, size, aim in zip(names, sizes, aims, strict=True):
        rate = Fraction(round(aim / size * 10**12), 10**12) if size else Fraction(0)
        text = "11" + ("" if name is None else "=" + name)
        at = Fraction(int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 10**6, 10**6)
        own = sorted((r for r in rows if r[1] == name), key=lambda r: (-r[2], r[0]))
        for key, _, n in own:
            out.append((key, n, size, float(aim), math.floor(at + rate) - math.floor(at)))
            at += rate
    return sorted(out)


def table_of(rows):
    return sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["copies"]) for r in rows)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    names = ["a"] * 6 + ["b", "c", "", "é", None, "Z", "\U0001f600"]
    return [(i, draw.choice(names), int(draw.paretovariate(0.8))) for i in range(3000)]


def test_against_fractions(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(7)
    got = table_of(mixing.mix(df).collect())
    want = brute(rows)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12) for a, b in zip(got, want, strict=True))
    assert table_of(mixing.mix(df.repartition(3)).collect()) == got


def test_bounds(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df).collect()
    assert all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in got)
    assert math.isclose(sum({r["source"]: r["target"] for r in got}.values()), 1.5 * sum(r[2] for r in rows))
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert own[0]["target"] <= 2 * own[0]["source_size"] * (1 + 1e-12)
    out = mixing.emitted(mixing.mix(df)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {r["doc_id"]: r["copies"] for r in got if r["copies"]}


def test_expected_copies_are_unbiased(spark):
    """The same eleven documents in 600 sources of one weight: 1.5 copies each, by 600 offsets."""
    rows = [(k, f"s{s}", 1 + k) for s in range(600) for k in range(11)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(df, weights=(1,)).groupBy("doc_id").avg("copies").collect()
    assert len(got) == 11 and all(abs(r[1] - 1.5) < 0.1 for r in got)


def test_odd_rows(spark):
    schema = "doc_id long, source string, size long, row string, Target string, _chunk int, n int"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "r", "t", 5, 1), (1, None, 4, "r", "t", 5, 2), (1, None, 4, "r", "t", 5, 2), (None, "a", 0, None, None, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and got[0].asDict().keys() == {"doc_id", "source", "row", "_chunk", "n", *mixing.ADDED}
    assert sum(r["taken"] for r in got) == 12 and all(r["_chunk"] == 5 for r in got if r["row"])
    zero = mixing.mix(spark.createDataFrame([(1, "a", 0), (2, "b", None)], "doc_id long, source string, size long")).collect()
    assert [r["taken"] for r in zero] == [0, 0]
    for wrong in ({"weights": ()}, {"share": 3.0}, {"limit": 0.0}):
        with pytest.raises(ValueError):
            mixing.mix(spark.createDataFrame(rows, schema), **wrong)


def test_words(spark, odd):
    from pyspark.sql import functions as F

    for r in odd.select("text", F.expr(mixing.n_words("text")).alias("n")).collect():
        plain = (r["text"] or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " "))
        assert r["n"] == len([w for w in plain.split(" ") if w])
