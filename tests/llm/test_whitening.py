"""Rank-one updates and whitening against direct eigendecompositions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import whitening
from tidegauge.llm.spectra import Spectrum, rank_one, secular_roots


def scatter(x):
    return (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))


def holds(own, x):
    want = scatter(x)
    top = max(np.abs(want).max(), 1.0)
    assert own.n == len(x) and (own.sums == x.sum(axis=0)).all()
    assert np.abs(own.vectors * own.values @ own.vectors.T - want).max() <= 1e-12 * top
    assert np.abs(own.vectors.T @ own.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert (np.diff(own.values) >= 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=5, max_size=5), min_size=1, max_size=40), st.integers(0, 40))
def test_updates_and_merges(rows, cut):
    """Small whole numbers: many equal eigenvalues and vanishing components."""
    x = np.array(rows, np.int64)
    one, block, left, right = (Spectrum.empty(5) for _ in range(4))
    for row in x:
        one.add(row)
    block.add_block(x)
    left.add_block(x[:cut])
    right.add_block(x[cut:])
    left.merge(right)
    for own in (one, block, left):
        holds(own, x)


def test_wide_blocks():
    x = np.floor(np.random.default_rng(1).standard_normal((900, 24)) * np.geomspace(1000, 1, 24)).astype(np.int64)
    own = Spectrum.empty(24)
    for i in range(0, 900, 300):
        own.add_block(x[i : i + 300])
    holds(own, x)


def test_roots_of_close_poles():
    d = np.array([1.0, 1.0 + 1e-13, 2.0, 2.0 + 1e-9, 5.0])
    z = np.array([0.5, 1e-8, 0.3, 0.7, 1e-3])
    roots, apart = secular_roots(d, z * z)
    # Distances keep their signs where a root rounds to an eigenvalue.
    assert ((apart < 0) == (np.arange(5)[None, :] <= np.arange(5)[:, None])).all() and roots[-1] <= d[-1] + z @ z
    value = np.abs(1 + (z * z / apart).sum(axis=1))
    assert (value <= 1e-9 * (1 + np.abs(z * z / apart).sum(axis=1))).all()
    want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
    assert np.allclose(roots, want, rtol=1e-14)
    values, vectors = rank_one(d, np.eye(5), z)
    assert np.allclose(vectors * values @ vectors.T, np.diag(d) + np.outer(z, z), atol=1e-14)


def test_whitening(spark):
    draw = np.random.default_rng(5)
    x = draw.standard_normal((700, 9)) @ draw.standard_normal((9, 9)) / 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[0].tolist()) for i in range(350)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    found, own = whitening.whiten(df, components=3)
    whole = np.floor(x.astype(np.float32).astype(float) * 256).astype(np.int64)
    distinct = np.unique(whole, axis=0)
    values, vectors = np.linalg.eigh(scatter(distinct) / len(distinct))
    assert own.n == len(distinct) and own.identity_error < 1e-10
    assert np.allclose(own.values, values[::-1][:3], rtol=1e-12)
    assert np.allclose(own.explained, values[::-1][:3] / values.sum(), rtol=1e-12)
    got = found.collect()
    assert len(got) == len(rows)
    axes = vectors.T[::-1][:3]
    axes = axes * np.sign((axes * own.axes).sum(axis=1))[:, None]
    for r in got:
        v = np.floor(np.array(r["embedding"]) * 256).astype(np.int64)
        want = (v - distinct.sum(axis=0) / own.n) @ axes.T / np.sqrt(values[::-1][:3])
        assert np.allclose(r["whitened"], want, atol=1e-11)
        assert r["deviation"] == int(sum((own.n * int(a) - int(s)) ** 2 for a, s in zip(v, own.sums, strict=True)))


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<double>, whitened string, Deviation int, x int"
    nothing, own = whitening.whiten(spark.createDataFrame([], schema))
    assert own is None and nothing.count() == 0
    rows = [
        (1, [0.5, 0.25, 0.0], "a", 1, 7), (1, [0.5, 0.25, 0.0], "a", 1, 7), (None, [0.0, 0.25, 0.0], None, None, None),
        (2, None, "a", 1, 7), (3, [None, 1.0, 1.0], "a", 1, 7), (4, [math.inf, 1.0, 1.0], "a", 1, 7), (5, [math.nan] * 3, "a", 1, 7),
        (6, [], "a", 1, 7), (7, [-0.001, 0.25, 0.0], "a", 1, 7),
    ]
    found, own = whitening.whiten(spark.createDataFrame(rows, schema))
    got = found.collect()
    assert found.columns == ["vec_id", "embedding", "x", "whitened", "deviation"]
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 1, 7] and own.n == 3
    # One direction varies: the others have no variance and no values.
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in got)
    assert own.explained[0] == 1.0 and own.identity_error < 1e-12
    alone, own = whitening.whiten(spark.createDataFrame(rows[:2], schema))
    assert [r["whitened"] for r in alone.collect()] == [[None] * 3] * 2 and own.explained == [0.0] * 3
    with pytest.raises(Exception, match="one length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_large_deviations():
    own = whitening.Whitening(1 << 40, np.array([3, 4]), np.ones(1), np.ones((1, 2)), 1.0)
    assert own.deviations(np.array([[1 << 10, 0]])) == [None]
    own.n = 1 << 20
    assert own.deviations(np.array([[1 << 10, 0]])) == [((1 << 30) - 3) ** 2 + 16]
