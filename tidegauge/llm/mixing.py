"""Mixing sources to target weights by systematic sampling.

Every source gets a target: its weight's part of ``share`` times all sizes, but at most
``limit`` times its own size, where the excess of those that stop goes to the others by
weight. A document's expected copies are its source's target over its source's size. Inside
each source expected copies are summed up in order, one random offset is added, and the
document is emitted once for each integer that its step of the sum crosses. So every
document is expected exactly as often as its source asks, is emitted at most one time more
or less than that, and since documents lie in falling order of size, what a source gives
differs from its target by less than its largest document.

Expected copies are decimals, so the sums are exact however many rows there are, and copies
never exceed ``limit`` rounded up. Rows are sorted across the cluster by source and size, so
a source with a third of all rows is spread over many tasks, and prefix sums are corrected
by one small row per task and source. The sorted rows are stored: a lost task reads them
again. The offset is a hash of source and seed, so reruns agree.

Null sources are a source of their own, the last; null sizes count as 0. Rows with equal
source, size and id can stand for each other. An empty table gives no rows. All columns are
kept, except ones named like the five that are added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.llm.base import materialize, query, table
from tidegauge.operators.keys import keyed_join
from tidegauge.operators.ordering import CHUNK, POSITION, number_rows, ranged, running_sum

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
SEED = 11

ADDED = ("size", "source_size", "target", "copies", "taken")
# Expected copies of one document, in steps of 1e-12.
_COPIES = "decimal(20, 12)"


def n_words(text: str) -> str:
    """SQL for the number of words of a text column, 0 for null."""
    return f"coalesce(regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0)"


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """source, source_size, target from one row (source, source_size) per source.

    ``weights`` repeat over the sources in the order of their code points, null last. With
    sources in the order in which they would reach their limit, the level (words per weight)
    that is left for source ``i`` if all before it stop grows while sources do stop and falls
    afterwards: the common level is its maximum.
    """
    if not weights or min(weights) <= 0 or limit <= 0 or not 0 <= share <= limit:
        raise ValueError("weights and limit must be positive, and the share at most the limit")
    cycle = ", ".join(f"{float(w)}D" for w in weights)
    sizes = sizes.withColumn("_unknown", F.col("source").isNull())
    weighed = number_rows(sizes, ["_unknown", "source"], "_place").selectExpr(
        "source", "source_size", "_place", f"element_at(array({cycle}), cast((_place - 1) % {len(weights)} + 1 as int)) AS _weight"
    ).withColumn("_cap", F.expr(f"{float(limit)}D * source_size")).withColumn("_stop", F.expr("_cap / _weight"))
    summed = materialize(
        running_sum(weighed, [], ["_stop", "_place"], {"_cap": "_caps", "_weight": "_weights"}), "levels"
    )
    total = summed.agg(F.sum("source_size").alias("words"), F.sum("_weight").alias("weights")).first()
    words, whole = float(total["words"] or 0), float(total["weights"] or 0)
    # Of each source: what is left for it and those after it, over their weights.
    left = f"({float(share) * words!r}D - (_caps - _cap)) / ({whole!r}D - (_weights - _weight))"
    top = summed.agg(F.expr(f"max({left})")).first()[0] or 0.0
    return summed.select("source", "source_size", F.expr(f"least(_cap, {float(top)!r}D * _weight)").alias("target"))


def mix(
    df: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: int = SEED,
) -> DataFrame:
    """Every row with its size, its source's size and target, and the ``copies`` the mix takes.

    ``size`` and ``source`` are columns of ``df``; ``taken`` is copies times size. ``emitted``
    gives the mix itself.
    """
    kept = [c for c in df.columns if c.lower() not in ADDED]
    own = df.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(f"`{source}`").cast("string").alias("source"),
        F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("size"),
        F.col(f"`{key}`").alias("key"),
    )
    placed = ranged(own, [F.col("source"), F.desc("size"), F.col("key")], "mix")
    sizes = materialize(placed.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    offset = f"conv(substr(md5(concat('{int(seed)}', coalesce(concat('=', source), ''))), 1, 8), 16, 10)"
    wanted = materialize(
        targets(sizes, weights, share, limit).selectExpr(
            "source", "source_size", "target",
            f"cast(if(source_size = 0, 0D, target / source_size) as {_COPIES}) AS expected",
            f"cast(cast({offset} as bigint) % 1000000 as decimal(6, 0)) * 0.000001BD AS offset",
        ),
        "targets",
    )
    # Expected copies are equal inside a source, so a task's part of their sum is a multiple.
    counts = placed.groupBy(CHUNK, "source").agg(F.count(F.lit(1)).alias("n"), F.min(POSITION).alias("first"))
    before = W.partitionBy("source").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    firsts = materialize(
        keyed_join(counts, wanted, ["source"]).select(
            CHUNK, "source", "source_size", "target", "expected", "first",
            (F.coalesce(F.sum(F.col("n") * F.col("expected")).over(before), F.lit(0)) + F.col("offset")).alias("start"),
        ),
        "starts",
    )
    summed = f"start + cast({POSITION} - first + {{}} as decimal(12, 0)) * expected"
    crossed = f"cast(floor({summed.format(1)}) - floor({summed.format(0)}) as bigint)"
    return keyed_join(placed, firsts, [CHUNK, "source"]).withColumn("copies", F.expr(crossed)).select(
        "row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def emitted(mixed: DataFrame, number: str = "copy") -> DataFrame:
    """The mix: every row as often as its ``copies``, numbered from 1 in the column ``number``."""
    return mixed.where("copies > 0").withColumn(number, F.expr("explode(sequence(1L, copies))"))


SQL = r"""
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighed AS (
    SELECT *, CAST([3, 1, 2][(place - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM sources
), levels AS (
    SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighed WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), wanted AS (
    SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels
), dealt AS (
    SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS DECIMAL(20, 12)) AS expected,
        CAST(CAST('0x' || substr(md5('11' || coalesce('=' || source, '')), 1, 8) AS BIGINT) % 1000000 AS DECIMAL(18, 6)) / 1000000 AS unit
    FROM wanted
), numbered AS (
    SELECT s.doc_id, s.size, d.source_size, d.target, CAST(d.expected AS DECIMAL(38, 12)) AS expected, CAST(d.unit AS DECIMAL(38, 12)) AS unit,
        row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, s.doc_id NULLS FIRST) AS n
    FROM sized s JOIN dealt d ON s.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(n * expected + unit) - floor((n - 1) * expected + unit) AS BIGINT) AS taken FROM numbered
"""


@query("op11_systematic_mix", SQL)
def _mix(spark, folder):
    """All documents mixed by word counts: 150 % of them, no source more than twice."""
    sized = table(spark, folder, "documents").selectExpr("doc_id", "source", f"{n_words('text')} AS size")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")
