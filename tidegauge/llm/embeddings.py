"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits vectors again and again at the median of their projections on a random
direction; vectors near a split go to both sides (spill), so near vectors part less often.
Many trees make it unlikely that a similar pair parts in all. Splits are fitted on a bounded
sample of the vectors and travel as a broadcast; every vector is put into the leaves of every
tree. Vectors of a leaf are compared exactly, in double precision, and pairs of at least
THRESHOLD link. Only a spanning set of links leaves a leaf, and components are joined from
those.

Splits cut through a large group of mutually near vectors again and again, so most of its
pairs meet in no leaf, although its vectors have partners enough to be joined. Links are
therefore not counted in leaves but in components, where every vector is compared with every
other: a link is missed only if the forest leaves its ends in different components.

Leaves and components of many vectors are compared in pairs of blocks, so no task holds more
than two blocks. Equal vectors are one vector with a weight: copies add to the counts but are
never compared.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors
of another length are compared among themselves. A repeated ``vec_id`` is a copy like any
other, one row each. A null ``vec_id`` counts as a link of others but has a null component.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.base import materialize, query, table
from tidegauge.llm.components import components

THRESHOLD = 0.9
TREES = 12
LEAF_ROWS = 256
# Share of the sample's rows on either side of a split that go both ways.
SPILL = 0.04
# Vectors that splits are fitted on. Leaves grow with the data beyond it, and are cut into blocks.
SAMPLE_ROWS = 20_000
BLOCK = 512
# Blocks of components: every row goes to each block of its component, so fewer and larger ones.
COMPONENT_BLOCK = 2048
# Rows of a block compared at once.
STRIP = 256


class Tree:
    """Split directions and bounds of a balanced tree, as arrays over its inner nodes."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int, leaf_rows: int = LEAF_ROWS, spill: float = SPILL):
        random = np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(1, rows) / leaf_rows))))
        self.depth = min(self.depth, max(0, int(np.log2(max(1, len(sample)) / 8))))
        nodes = (1 << self.depth) - 1
        self.directions = random.standard_normal((nodes, sample.shape[1])).astype(np.float32)
        self.low, self.high = np.zeros(nodes), np.zeros(nodes)
        held = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = held.pop(node, np.zeros(0, np.int64))
            x = sample[own] @ self.directions[node].astype(np.float64)
            middle, self.low[node], self.high[node] = (
                np.quantile(x, (0.5, 0.5 - spill, 0.5 + spill)) if len(x) else (0.0, 0.0, 0.0)
            )
            held[2 * node + 1], held[2 * node + 2] = own[x < middle], own[x >= middle]

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves; a row in several leaves comes several times."""
        rows, nodes = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            x = np.einsum("ij,ij->i", vectors[rows], self.directions[nodes])
            left, right = x < self.high[nodes], x >= self.low[nodes]
            rows, nodes = (
                np.concatenate([rows[left], rows[right]]),
                np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2]),
            )
        return rows, nodes - ((1 << self.depth) - 1)


def _usable(column: str) -> str:
    return (
        f"{column} IS NOT NULL AND size({column}) > 0 AND forall({column}, x -> x IS NOT NULL AND NOT isnan(x) "
        f"AND abs(x) < double('inf')) AND exists({column}, x -> x <> 0)"
    )


def _arrays(rows: list[list[float]] | np.ndarray) -> np.ndarray:
    own = np.asarray(rows, np.float64)
    # Scale first, so that no square overflows or vanishes.
    own = own / np.abs(own).max(axis=1, keepdims=True)
    return own / np.linalg.norm(own, axis=1, keepdims=True)


def forest(vectors: DataFrame, rows: int, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, seed: int = 41) -> list[Tree]:
    """Trees fitted on about ``sample_rows`` of the ``rows`` vectors, drawn by a hash of the vector."""
    part = F.expr(f"shiftrightunsigned(xxhash64(vector, {seed}), 11) * 1.1102230246251565e-16D")
    share = float(sample_rows) / max(rows, 1)
    sample = _arrays([r[0] for r in vectors.where(part < share).select("vector").toLocalIterator()] or [[1.0]])
    return [Tree(sample, rows, seed + t) for t in range(trees)]


def _paired(rows: DataFrame, key: str, block_rows: int) -> DataFrame:
    """``members`` (own, weight, vector, side) of every pair of blocks of rows (own, weight, vector) with a ``key``.

    ``side`` is 0 and 1 in a pair of two blocks, and 2 in a block with itself. Keys of one row have no pairs.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    block = F.expr("pmod(xxhash64(own), blocks)")
    sides = F.explode(F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(k, block).alias("i"), F.greatest(k, block).alias("j"),
            F.when(k == block, 2).when(k > block, 0).otherwise(1).alias("side"),
        ),
    ))
    spread = rows.join(
        sizes.where("n > 1").selectExpr(key, f"(n + {block_rows - 1}) div {block_rows} AS blocks"), key
    ).withColumn("s", sides)
    return spread.groupBy(key, "s.i", "s.j").agg(
        F.collect_list(F.struct("own", "weight", "vector", "s.side")).alias("members")
    ).select("members")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Own numbers, weights and unit vectors of a pair of blocks, and the members of its two sides."""
    for batch in batches:
        for held in batch.column("members"):
            rows = held.values
            sides = rows.field("side").to_numpy()
            left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
            if len(left) and len(right):
                vectors = rows.field("vector").flatten().to_numpy().reshape(len(rows), -1)
                yield rows.field("own").to_numpy(), rows.field("weight").to_numpy(), _arrays(vectors), left, right


def _strips(unit: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Some members of the left side, and which members of the right side link with them."""
    for k in range(0, len(left), STRIP):
        some = left[k : k + STRIP]
        yield some, (unit[some] @ unit[right].T >= threshold) & (some[:, None] != right)


def _spanning(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs that join the members of every pair of blocks as their links do."""
    for own, _, unit, left, right in _pairs(batches):
        roots, links = np.arange(len(own)), []
        for some, near in _strips(unit, left, right, threshold):
            for k in np.flatnonzero(near.any(axis=1)):
                joined = np.unique(roots[np.append(right[near[k]], some[k])])
                if len(joined) > 1:
                    links += [(joined[0], x) for x in joined[1:]]
                    roots[np.isin(roots, joined)] = joined[0]
        if links:
            a, b = own[np.array(links)].T
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _counted(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of every member of every pair of blocks, copies by weight."""
    for own, weight, unit, left, right in _pairs(batches):
        counts, heavy = np.zeros(len(own)), weight.astype(np.float64)
        within = len(left) == len(own) == len(right)
        for some, near in _strips(unit, left, right, threshold):
            linked = near.astype(np.float64)
            counts[some] += linked @ heavy[right]
            if not within:  # within a block a pair comes both ways, across blocks once
                counts[right] += heavy[some] @ linked
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array(own[used], pa.int64()), "n": pa.array(counts[used].astype(np.int64), pa.int64())}
            )


def near_duplicates(
    df: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``df`` (vec_id, embedding).

    Groups are found with high probability, links within a group are all counted, and none is below ``threshold``.
    """
    vector = F.expr("cast(embedding AS array<double>)")
    rows = materialize(
        df.select("vec_id", vector.alias("vector")).withColumn("usable", F.expr(_usable("vector")))
        .select("vec_id", F.when(F.col("usable"), F.col("vector")).alias("vector")),
        "vectors",
    )
    classes = rows.where("vector IS NOT NULL").groupBy("vector").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")
    )
    classes = materialize(
        classes.select(F.xxhash64("vector").alias("own"), "vector", "weight", "least"), "classes"
    )
    parts = []
    for size, n in sorted((r["size"], r["n"]) for r in classes.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()):
        parts.append(_links(classes.where(F.size("vector") == size), n, threshold, trees, sample_rows))
    found = None
    for p in parts:
        found = p if found is None else found.unionByName(p)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "links")
    roots = components(found)
    rooted = materialize(
        classes.join(roots, F.col("own") == F.col("node"), "left")
        .select("own", "vector", "least", "weight", F.coalesce("root", "own").alias("root")),
        "rooted",
    )
    run = lambda batches: _counted(batches, threshold)
    counts = (
        _paired(rooted.select("root", "own", "weight", "vector"), "root", COMPONENT_BLOCK)
        .mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    )
    grouped = rooted.join(counts, F.col("own") == F.col("a"), "left").select(
        "own", "least", "weight", "root", F.coalesce("n", F.lit(0)).alias("n")
    )
    first = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(first, "root").select(
        "own", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return rows.withColumn("own", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))).join(named, "own", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _links(classes: DataFrame, rows: int, threshold: float, trees: int, sample_rows: int) -> DataFrame:
    """Links (a, b) that join classes of vectors of one length as the links found in leaves do."""
    shared = classes.sparkSession.sparkContext.broadcast(forest(classes, rows, trees, sample_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _arrays(batch.column("vector").to_pylist())
            leaves: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for t, tree in enumerate(shared.value):
                for row, leaf in zip(*(x.tolist() for x in tree.leaves(unit)), strict=True):
                    leaves[row].append((t << 40) + leaf)
            columns = {n: batch.column(n) for n in ("own", "vector", "weight")}
            yield pa.RecordBatch.from_pydict(columns | {"leaves": pa.array(leaves, pa.list_(pa.int64()))})

    placed = materialize(
        classes.select("own", "vector", "weight").mapInArrow(
            place, "own long, vector array<double>, weight long, leaves array<long>"
        ),
        "placed",
    )
    run = lambda batches: _spanning(batches, threshold)
    leaved = placed.select(F.explode("leaves").alias("leaf"), "own", "weight", "vector")
    return _paired(leaved, "leaf", BLOCK).mapInArrow(run, "a long, b long")


@query("op7_projection_forest")
def _vectors(spark, folder):
    """Every vector with its links and its group."""
    return near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding"))
