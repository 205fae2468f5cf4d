"""A uniform shuffle into shards of exact size, from a hypergeometric communication matrix.

Every input partition is a block. How many rows each block sends to each shard is drawn
first, from the block sizes and the shard sizes alone: the matrix of a uniform permutation is
multivariate hypergeometric, so it is drawn by halving the blocks again and again, and each
half's share of every shard by one hypergeometric draw after the other. Then each block
permutes its rows, deals them out by its row of the matrix, and every shard permutes what
arrives. Shard sizes are at most one apart, whatever the blocks look like.

The draws invert the hypergeometric distribution from its mode outwards, ten standard
deviations to each side. They are hashes of (seed, node, shard), and the permuted blocks are
written to the shared folder before anything is counted, so a lost executor changes nothing.
Shards of many rows are permuted in parts: a random key's leading bits choose the part, and
the parts' counts give the first slot of each.

Rows are dealt by their place, never by their values: nulls, repeated rows and hot keys need
no care. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.llm.base import materialize, query, table

# Rows of a shard that one task permutes.
PART_ROWS = 20_000
_UNIT = "shiftrightunsigned({}, 11) * 1.1102230246251565e-16D"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, so it is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _log_factorial(x: str) -> str:
    exact = f"ln(cast(factorial(cast({x} as int)) as double))"
    series = f"({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x})"
    return f"if({x} < 18D, {exact}, {series})"


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - ({_log_factorial(k)}) - ({_log_factorial(f'({n} - {k})')}))"


def _hypergeometric(total: str, good: str, drawn: str, unit: str) -> str:
    """SQL for the number of ``good`` among ``drawn`` of ``total``, by inversion at ``unit``."""
    state = "named_struct('u', {u}, 'x', {x}, 'hi', {hi}, 'ph', {ph}, 'lo', {lo}, 'pl', {pl})"
    up = f"if(s.hi < g.hi, s.ph * ({good} - s.hi) * ({drawn} - s.hi) / ((s.hi + 1D) * ({total} - {good} - {drawn} + s.hi + 1D)), 0D)"
    down = f"if(s.lo > g.lo, s.pl * s.lo * ({total} - {good} - {drawn} + s.lo) / (({good} - s.lo + 1D) * ({drawn} - s.lo + 1D)), 0D)"
    chosen = "if(s.x >= 0D, s.x, if(s.u < p.u, s.hi + 1D, if(s.u < p.u + p.d, s.lo - 1D, -1D)))"
    walked = _let(
        f"named_struct('u', {up}, 'd', {down})", "p",
        state.format(
            u="s.u - p.u - p.d", x=chosen, hi="least(s.hi + 1D, g.hi)", ph="p.u", lo="greatest(s.lo - 1D, g.lo)", pl="p.d"
        ),
    )
    mode = f"least(g.hi, greatest(g.lo, floor(({drawn} + 1D) * ({good} + 1D) / ({total} + 2D)) * 1D))"
    first = f"exp({_log_choose(good, 'm')} + {_log_choose(f'({total} - {good})', f'({drawn} - m)')} - {_log_choose(total, drawn)})"
    start = state.format(u=f"{unit} - p0", x=f"if({unit} < p0, m, -1D)", hi="m", ph="p0", lo="m", pl="p0")
    steps = (
        f"cast(least(g.hi - g.lo, 12D + 10D * sqrt({drawn} * ({good} / greatest({total}, 1D)) * "
        f"(({total} - {good}) / greatest({total}, 1D)) * ({total} - {drawn}) / greatest({total} - 1D, 1D))) as bigint)"
    )
    walk = f"aggregate(sequence(1L, {steps}), {start}, (s, i) -> {walked}, s -> if(s.x >= 0D, s.x, m))"
    drawn_value = _let(mode, "m", _let(first, "p0", walk))
    bounds = f"named_struct('lo', greatest(0D, {drawn} - ({total} - {good})), 'hi', least({drawn}, {good}))"
    return _let(bounds, "g", f"if(g.lo >= g.hi, g.lo, {drawn_value})")


def _share(room: str, rows: str, seed: str) -> str:
    """SQL for how many of ``rows`` go to each shard, given the ``room`` left in each."""
    draw = _hypergeometric("a.total", "k", "a.rows", "unit")
    unit = _UNIT.format(f"xxhash64({seed}, size(a.out))")
    step = _let(
        "cast(k0 as double)", "k",
        _let(unit, "unit", _let(
            draw, "x",
            "named_struct('total', a.total - k, 'rows', a.rows - x, 'out', concat(a.out, array(cast(x as bigint))))",
        )),
    )
    total = f"cast(aggregate({room}, 0L, (t, v) -> t + v) as double)"
    start = f"named_struct('total', {total}, 'rows', cast({rows} as double), 'out', cast(array() as array<bigint>))"
    return f"aggregate({room}, {start}, (a, k0) -> {step}, a -> a.out)"


def communication_matrix(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """One row per block: ``block`` and ``quota``, its rows for each shard.

    ``blocks`` has ``block`` and ``rows``. Only block and shard counts pass through here.
    """
    count = blocks.count()
    nodes = blocks.agg(F.sort_array(F.collect_list(F.struct("block", "rows"))).alias("blocks")).where(
        "size(blocks) > 0"
    ).selectExpr(
        "blocks", "aggregate(blocks, 0L, (t, b) -> t + b.rows) AS total"
    ).selectExpr(
        "blocks",
        f"transform(sequence(0, {shards - 1}), j -> total div {shards} + if(j < total % {shards}, 1L, 0L)) AS room",
    )
    for level in range(max(count - 1, 0).bit_length()):
        halves = "if(size(blocks) > 1, {}, {})"
        nodes = nodes.selectExpr(
            "room",
            halves.format("slice(blocks, 1, size(blocks) div 2)", "slice(blocks, 1, 0)") + " AS first",
            halves.format("slice(blocks, size(blocks) div 2 + 1, size(blocks))", "blocks") + " AS second",
        ).selectExpr(
            "room", "first", "second", "aggregate(first, 0L, (t, b) -> t + b.rows) AS rows",
        ).selectExpr(
            "room", "first", "second",
            _share("room", "rows", f"{seed}L, {level}, element_at(second, 1).block") + " AS share",
        ).selectExpr(
            "explode(array(named_struct('blocks', first, 'room', share), "
            "named_struct('blocks', second, 'room', zip_with(room, share, (r, s) -> r - s)))) AS node"
        ).selectExpr("node.blocks", "node.room").where("size(blocks) > 0")
        if level % 6 == 5:
            nodes = nodes.repartition(F.element_at("blocks", 1)["block"])
    return nodes.selectExpr("element_at(blocks, 1).block AS block", "room AS quota")


def shuffle_to_shards(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Every permutation of the rows is equally likely, up to the quality of the hashes. All
    columns are kept, except ones named shard or slot, which are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    permuted = materialize(
        own.withColumn("u", F.rand(seed)).sortWithinPartitions("u")
        .withColumn("id", F.monotonically_increasing_id())
        .selectExpr("row", "shiftright(id, 33) AS block", f"id & {(1 << 33) - 1}L AS place"),
        "permuted",
    )
    blocks = permuted.groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
    matrix = materialize(
        communication_matrix(blocks, shards, seed).selectExpr(
            "block",
            "aggregate(quota, cast(array() as array<bigint>), "
            "(a, q) -> concat(a, array(if(size(a) = 0, 0L, element_at(a, -1)) + q))) AS bounds",
        ),
        "matrix",
    )
    rows = matrix.selectExpr("element_at(bounds, -1) AS n").agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-rows // (shards * PART_ROWS)))
    dealt = permuted.join(matrix, "block").selectExpr(
        "row", "block", "place", "size(filter(bounds, b -> b <= place)) AS shard",
        f"shiftrightunsigned(xxhash64({seed + 1}L, block, place), 1) AS key",
    ).withColumn("part", F.expr(f"cast(floor(key / 9223372036854775808D * {parts}) as int)"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = W.partitionBy("shard", "part").orderBy("key", "block", "place")
    placed = dealt.withColumn("rank", F.row_number().over(within)).join(firsts, ["shard", "part"])
    return placed.select("row.*", "shard", (F.col("first") + F.col("rank") - 1).alias("slot"))


SHARDS = 40


@query("op2_hypergeometric_shards")
def _shards(spark, folder):
    """All documents in 40 shards whose row counts are at most one apart."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    return shuffle_to_shards(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
