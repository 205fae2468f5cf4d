"""Benchmark decontamination by SimHash of item-sized windows.

A document is leaked into when a window of it, as long as a benchmark item, has a weighted
Jaccard similarity of at least THRESHOLD with the item: five-word shingles weighted by how
often they occur, the sum of the smaller weights over the sum of the larger. Words are
lower-case runs between white space; fewer than five are one shingle.

Windows are fingerprinted by SimHash of their words. A fingerprint of 64 bits is cut into
RADIUS + 1 blocks, so two that differ in at most RADIUS bits agree in some block: an equi-join
on (size, block, value) finds every pair within the radius, and the exact similarity is
computed for those alone. Windows that share no shingle with any item have similarity 0
whatever their fingerprint, so only those at a shared shingle, aligned with it, are
fingerprinted; this is exact, and the corpus is read once without a shuffle. A similarity of
0.75 leaves at most a seventh of the shingles on either side unshared, a few words of a
window. RADIUS covers most of the spread of the fingerprints, not all: of 600 items cut to a
similarity of 0.75 to 0.76, the least that counts, 577 were found (145 of 150 with 25 words,
146 with 40, 143 with 60 and 143 with 100).

The benchmark's shingles are written before they are joined, so the planner knows their size
and broadcasts or shuffles accordingly. Everything is DataFrame functions.

Null and empty texts, of documents or items, match nothing. Repeated rows are found each for
itself; of several windows for one item the most similar counts, then the first. Extra
columns of documents are ignored; ``find`` returns its own columns only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.base import materialize, packed, query, table, unpacked

SHINGLE = 5
THRESHOLD = 0.75
RADIUS = 15

_SPACE = "[\\\\x20\\\\x09-\\\\x0D]"
# Hashes of the words; no text, or white space alone, has none.
_WORDS = (
    f"if(text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]', "
    f"transform(split(btrim(lower(text), ' \\t\\n\\u000B\\f\\r'), '{_SPACE}+'), w -> xxhash64(w)), "
    "cast(array() AS array<bigint>))"
)


def _shingles(words: str) -> str:
    parts = ", ".join(f"element_at({words}, i + {k})" for k in range(SHINGLE))
    return (
        f"CASE WHEN size({words}) = 0 THEN cast(array() AS array<bigint>) "
        f"WHEN size({words}) < {SHINGLE} THEN array(xxhash64({words})) "
        f"ELSE transform(sequence(1, size({words}) - {SHINGLE - 1}), i -> xxhash64({parts})) END"
    )


def _fingerprint(words: str) -> str:
    """Bit b is the majority of the words' bits b, a word counting as often as it occurs."""
    votes = f"aggregate({words}, 0L, (t, h) -> t + (shiftrightunsigned(h, b) & 1L))"
    return f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {votes} > size({words}), shiftleft(1L, b), 0L))"


def _blocks(fingerprint: str, radius: int) -> str:
    """The fingerprint cut into radius + 1 blocks, as structs of block and value."""
    count = radius + 1
    edges = [64 * k // count for k in range(count + 1)]
    return "array(" + ", ".join(
        f"named_struct('block', {k}, 'value', shiftrightunsigned({fingerprint}, {a}) & {(1 << (b - a)) - 1}L)"
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ) + ")"


_SIMILARITY = """
transform(array(array_distinct(concat(a, b))), all -> aggregate(
    transform(all, s -> named_struct('x', size(filter(a, v -> v = s)), 'y', size(filter(b, v -> v = s)))),
    named_struct('low', 0, 'high', 0),
    (t, n) -> named_struct('low', t.low + least(n.x, n.y), 'high', t.high + greatest(n.x, n.y)),
    t -> t.low / cast(t.high AS double)))[0]
"""


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, the hashes of its words, its size, shingles and fingerprint; empty items left out."""
    own = benchmark.select("item_id", "text").selectExpr("item_id", f"{_WORDS} AS words").where("size(words) > 0")
    return own.selectExpr(
        "item_id", "size(words) AS n", f"{_shingles('words')} AS shingles", f"{_fingerprint('words')} AS fingerprint"
    )


def windows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The item-sized windows of ``docs`` that share a shingle with an item, aligned with it.

    Columns: row (a number of the document), doc_id, text_hash, n (the item's size), start
    (the first word, from 0) and words (hashes). At the ends a window may be shorter than n.
    Places are found first, by text, so copies meet before anything is shuffled; then only
    texts with a place are cut into words again.
    """
    # Written, so the planner knows its size.
    places = materialize(known.select("n", F.posexplode("shingles").alias("offset", "shingle")).distinct(), "places")
    text_hash = F.xxhash64("text").alias("text_hash")
    own = docs.select("doc_id", "text")
    hashed = own.select(text_hash, F.expr(f"{_WORDS} AS words"))
    found = hashed.select("text_hash", F.posexplode(F.expr(_shingles("words"))).alias("at", "shingle"))
    # An item of fewer words is one shingle of its own size.
    for size in range(1, SHINGLE):
        if not known.where(F.col("n") == size).isEmpty():
            runs = f"transform(sequence(1, size(words) - {size - 1}), i -> xxhash64(slice(words, i, {size})))"
            found = found.unionByName(
                hashed.where(f"size(words) >= {size}").select("text_hash", F.posexplode(F.expr(runs)).alias("at", "shingle"))
            )
    met = (
        found.join(places, "shingle")
        .selectExpr("text_hash", "n", "greatest(at - offset, 0) AS start", "at - offset + n AS stop")
        .distinct()
        .groupBy("text_hash").agg(F.collect_list(F.struct("n", "start", "stop")).alias("spots"))
    )
    # Numbers that later groups rely on must not change when a lost task runs again: stored.
    placed = materialize(
        own.select("doc_id", "text", text_hash).join(met, "text_hash").select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "spots", F.expr(f"{_WORDS} AS words")
        ),
        "placed",
    )
    return placed.select("row", "doc_id", "text_hash", "words", F.explode("spots").alias("spot")).selectExpr(
        "row", "doc_id", "text_hash", "spot.n", "spot.start",
        "slice(words, spot.start + 1, least(spot.stop, size(words)) - spot.start) AS words",
    )


def find(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS
) -> DataFrame:
    """Leaks: doc_id, text_hash, item_id, start_word, n_words, distance (bits), similarity; a row per document and item."""
    if not 0 <= radius < 64:
        raise ValueError("radius must be within a fingerprint of 64 bits")
    known = materialize(items(benchmark), "items")
    found = windows(docs, known).selectExpr(
        "*", f"{_shingles('words')} AS a", f"{_fingerprint('words')} AS print"
    ).selectExpr("row", "doc_id", "text_hash", "n", "start", "size(words) AS size", "a", "print")
    cut = found.withColumn("cell", F.explode(F.expr(_blocks("print", radius))))
    cells = known.selectExpr(
        "item_id", "n", "shingles AS b", "fingerprint", f"explode({_blocks('fingerprint', radius)}) AS cell"
    )
    near = (
        cut.join(cells, ["n", "cell"])
        .withColumn("distance", F.expr("bit_count(print ^ fingerprint)"))
        .where(F.col("distance") <= radius)
        .drop("cell").distinct()
        .withColumn("similarity", F.expr(_SIMILARITY))
        .where(F.col("similarity") >= threshold)
    )
    best = F.max_by(F.struct("start", "size", "distance", "similarity"), F.struct("similarity", -F.col("start"), "size"))
    return near.groupBy("row", "doc_id", "text_hash", "item_id").agg(best.alias("best")).select(
        "doc_id", "text_hash", "item_id", F.col("best.start").alias("start_word"),
        F.col("best.size").alias("n_words"), "best.distance", "best.similarity",
    )


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with no leak. A leak depends on the text alone, so texts are compared."""
    leaked = find(docs, benchmark, threshold, radius).select("text_hash").distinct()
    own = packed(docs, "text").withColumn("text_hash", F.xxhash64("text"))
    return unpacked(own.join(leaked, "text_hash", "left_anti"), docs.columns, "text")


@query("op10_simhash_leaks")
def _leaks(spark, folder):
    """Every benchmark item found in a document, with the window that holds it."""
    return find(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")
