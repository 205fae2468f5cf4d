"""Shards, archives, vectors, and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidegauge.llm import embeddings, sharding, warc
from tidegauge.llm.base import new_path
from tidegauge.llm.components import components


@pytest.mark.parametrize("rows, shards", [(0, 4), (1, 4), (37, 5), (1000, 40)])
def test_shards(spark, rows, shards):
    frame = spark.range(rows).selectExpr("cast(id % 7 AS long) AS doc_id", "id AS shard").repartition(3)
    got = sharding.shuffle_to_shards(frame, shards).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i % 7 for i in range(rows))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_matrix_is_hypergeometric(spark):
    """The first block's share of the first of two shards over many seeds, against exact moments."""
    blocks = spark.createDataFrame([(0, 30), (1, 50)], "block long, rows long")
    draws = []
    for seed in range(60):
        rows = {r["block"]: r["quota"] for r in sharding.communication_matrix(blocks, 2, seed).collect()}
        assert rows[0][0] + rows[0][1] == 30 and rows[0][0] + rows[1][0] == 40
        draws.append(rows[0][0])
    sd = math.sqrt(30 * 0.5 * 0.5 * 50 / 79)
    assert abs(np.mean(draws) - 15) < 4 * sd / math.sqrt(60) and 0.5 * sd < np.std(draws) < 1.6 * sd


def test_archives(spark):
    pages = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (None, "u", "x"), (6, "u", "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha1", F.lit(1))
    folder = new_path(spark, "test-warc")
    warc.write_archives(frame, folder)
    rows = {r["page_id"]: r for r in warc.read_archives(spark, folder).collect()}
    assert len(rows) == len(pages)
    keeper = {"<p>é</p>": 2, "": 4, "x" * 300_000: 5, "x": 6}
    for page, _, html in pages:
        data, r = (html or "").encode(), rows[page]
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        last = keeper[html or ""]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == last else ("revisit", last))
        assert r["payload"] == (data if page == last else None)
    wanted = spark.createDataFrame([(5,), (2,)], "page_id long")
    assert {r["page_id"] for r in warc.read_archives(spark, folder, wanted).collect()} == {2, 5}
    content = spark.read.format("binaryFile").load(folder).first()["content"]
    assert zstandard.ZstdDecompressor().stream_reader(bytes(content), read_across_frames=True).read(8) == b"WARC/1.1"
    assert bytes(content).endswith(warc.ENDING)


def test_empty_archive(spark):
    folder = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 9), (20, 21), (22, 21), (21, 20)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {5: 3, 9: 3, 21: 20, 22: 20} | {i: 100 for i in range(101, 141)}


def test_vectors(spark):
    draw = np.random.default_rng(7)
    centres = draw.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.12 * draw.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2002, None), (2003, [0.0] * 16), (2004, [float("nan")] * 16), (2005, [None] * 16), (2006, []), (2007, [1.0, 2.0]), (2008, [2.0, 4.0])]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("own", F.lit(1))).collect()}
    whole = [(k, v) for k, v in rows if v and len(v) == 16 and None not in v and not np.isnan(v).any() and any(v)]
    unit = np.array([v for _, v in whole])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    counts = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[k]["n_links"] for k, _ in whole])
    assert (found <= counts).all() and found.sum() >= 0.9 * counts.sum()
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (2002, 2003, 2004, 2005, 2006))
    assert got[2008]["component_id"] == 2007 and got[2008]["n_links"] == 1
    assert got[2001]["component_id"] == got[0]["component_id"]


def test_links_of_a_hot_group_are_whole(spark):
    """A third of the rows are different vectors near each other, which every tree cuts into many leaves."""
    draw = np.random.default_rng(11)
    values = draw.standard_normal((9000, 24))
    values[:3000] = values[0] + 0.25 * draw.standard_normal((3000, 24))
    values[3000] = values[7]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(frame).collect()}
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    counts = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert 0.2 < counts[:3000].mean() / 3000
    found = np.array([got[i] for i in range(9000)])
    assert (found <= counts).all() and found[:3001].sum() >= 0.99 * counts[:3001].sum()
