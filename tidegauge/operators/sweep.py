"""Many query windows answered by one job.

Windows are matched through a shared bucket: every window lists the buckets it touches,
every row knows its bucket, and the exact bounds are checked on the matches. That is an
equi-join, where a plain range condition would be a nested loop. Bucket sweeps aggregate rows
before they meet a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.functions.buckets import EPOCH, bucket, width_of
from tidegauge.functions.scalar import floor_div, micros
from tidegauge.operators.generate import random_windows
from tidegauge.operators.keys import keyed_join
from tidegauge.operators.ordering import running_sum
from tidegauge.operators.prepare import literal_time, naive_utc
from tidegauge.operators.queries import average, merged, partials
from tidegauge.session import materialize

# Times that a bucket may be halved for many windows.
HALVINGS_MAX = 12
# Rows of windows' parts, or of the series, that one task of a bucket sweep is dealt on average.
TASK_ROWS = 1 << 19


def windows_frame(spark: SparkSession, windows: Sequence[tuple[datetime, datetime]]) -> DataFrame:
    """``(window_id, start, end)`` rows of zone-less UTC moments."""
    columns = [list(range(len(windows))), [w[0] for w in windows], [w[1] for w in windows]]
    names = ["window_id", "start", "end"]
    arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.timestamp("us"), pa.timestamp("us")))]
    return spark.createDataFrame(pa.table(arrays, names=names), "window_id bigint, start timestamp_ntz, end timestamp_ntz")


def _listed(windows: DataFrame) -> DataFrame:
    """The windows that hold a moment, with their bounds in microseconds; stored, so the planner knows their size."""
    own = windows.where(F.col("end") > F.col("start")).select("window_id", "start", "end")
    return materialize(own.withColumns({"_from": micros(F.col("start")), "_to": micros(F.col("end"))}), "windows")


def _length_class(windows: DataFrame) -> DataFrame:
    """Windows with their bounds in microseconds and ``_class``, the power of two that
    their length rounds up to."""
    return _listed(windows).withColumn("_class", F.length(F.bin(F.col("_to") - F.col("_from"))))


def match_windows(df: DataFrame, time: str, windows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of every row next to each ``window_id`` whose window holds it.

    Windows of a class share a bucket width that is at least their length and less than
    twice it, so a window lies in at most two buckets and a row meets few windows that do
    not hold it, also when short and long windows are mixed. A row has one bucket per
    class in use.
    """
    kind = df.schema[time].dataType
    classed = _length_class(windows)
    used = classed.agg(
        F.collect_set("_class").alias("classes"),  # at most 63 of them
        F.min("start").cast(kind).alias("lo"),
        F.max("end").cast(kind).alias("hi"),
    ).first()
    if not used["classes"]:
        kind = windows.schema["window_id"].dataType
        return df.select(F.lit(None).cast(kind).alias("window_id"), *columns).limit(0)
    listed = classed.select(
        "window_id",
        "_class",
        F.col("start").cast(kind).alias("_start"),
        F.col("end").cast(kind).alias("_end"),
        F.explode(F.expr("sequence(shiftright(_from, _class), shiftright(_to - 1, _class))")).alias("_cell"),
    )
    cells = [
        F.struct(F.lit(k).alias("_class"), F.shiftright("_at", k).alias("_cell"))
        for k in sorted(used["classes"])
    ]
    needed = list(dict.fromkeys([time, *columns]))
    rows = (
        df.select(*needed)
        .where((F.col(time) >= F.lit(used["lo"])) & (F.col(time) < F.lit(used["hi"])))
        .withColumn("_at", micros(F.col(time)))
    )
    if len(cells) == 1:
        rows = rows.withColumns({"_class": F.lit(used["classes"][0]), "_cell": cells[0]["_cell"]})
    else:
        rows = rows.select(*needed, F.explode(F.array(*cells)).alias("_c")).select(*needed, "_c.*")
    inside = (
        (rows["_class"] == listed["_class"])
        & (rows["_cell"] == listed["_cell"])
        & (rows[time] >= listed["_start"])
        & (rows[time] < listed["_end"])
    )
    return rows.join(listed, inside).select("window_id", *columns)


def sweep(
    df: DataFrame, time: str, windows: DataFrame, keys: dict[str, Column], aggregates: list[Column],
    columns: Sequence[str],
) -> DataFrame:
    """Aggregate each window by ``keys``; ``columns`` are the inputs to both."""
    matched = match_windows(df, time, windows, columns)
    return matched.groupBy("window_id", *[c.alias(n) for n, c in keys.items()]).agg(*aggregates)


def _ranked(df: DataFrame, time: str, listed: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The sweep line: rows and window ends in one order across the cluster.

    Gives the rows of the windows' span with ``_rank``, their number by (time, key), and
    ``listed`` with ``_before`` and ``_upto``, the ranks reached at the start and the end of
    each window. A window's rows are those with the ranks between, so neither counting nor
    limiting them brings them together.
    """
    kind = df.schema[time].dataType
    ends = listed.select(F.explode(F.array("start", "end")).alias("_moment")).distinct()
    span = listed.agg(F.min("start").cast(kind).alias("low"), F.max("end").cast(kind).alias("high")).first()
    needed = list(dict.fromkeys([time, *key]))
    own = df.select(*needed, F.lit(1).alias("_row")).where((F.col(time) >= F.lit(span["low"])) & (F.col(time) < F.lit(span["high"])))
    # At one moment ends come first: a window starts before the rows of its start and ends before those of its end.
    marks = ends.select(F.col("_moment").cast(kind).alias(time), F.lit(0).alias("_row"))
    summed = running_sum(own.unionByName(marks, allowMissingColumns=True), [], [time, "_row", *key], {"_row": "_rank"})
    placed = materialize(summed, "ranked")
    reached = placed.where("_row = 0").select(F.col(time).cast(listed.schema["start"].dataType).alias("_moment"), "_rank")
    at = lambda name, rank: reached.select(F.col("_moment").alias(name), F.col("_rank").alias(rank))
    return placed.where("_row = 1").drop("_row"), listed.join(at("start", "_before"), "start").join(at("end", "_upto"), "end")


def sweep_range(
    df: DataFrame, time: str, windows: DataFrame, key: Sequence[str], limit: int = 0
) -> DataFrame:
    """The rows of every window; with ``limit`` the first ones of each by (time, key).

    A limited window ends at the row whose rank is its first one's plus the limit: rows are
    compared with that row, whatever the limit, and no task sorts a window.
    """
    if limit <= 0:
        return match_windows(df, time, windows, df.columns)
    listed = _listed(windows)
    ranked, placed = _ranked(df, time, listed, key)
    order = list(dict.fromkeys([time, *key]))
    last = F.least("_upto", F.col("_before") + limit)
    wanted = placed.where("_upto > _before").select("window_id", "start", "end", last.alias("_rank"))
    stops = wanted.join(ranked, "_rank").select("window_id", "start", "end", "_rank", F.struct(*order).alias("_stop"))
    # Rows may be equal in time and key: of those at the stop only as many as the limit leaves.
    ties = ranked.groupBy(F.struct(*order).alias("_stop")).agg(F.min("_rank").alias("_least"))
    stops = materialize(keyed_join(stops, ties, ["_stop"]).withColumn("_left", F.expr("_rank - _least + 1")), "stops")
    limits = stops.select(F.col("window_id").alias("_id"), "_stop", "_left")
    after = stops.select("window_id", "start", F.least(F.col("end"), _next(F.col("_stop")[time], stops)).alias("end"))
    matched = match_windows(df, time, after, df.columns)
    place = F.struct(*[F.col(c) for c in order])
    held = matched.join(limits, matched["window_id"] == limits["_id"]).where(place <= F.col("_stop"))
    at_stop = held.where(place == F.col("_stop"))
    rank = F.row_number().over(W.partitionBy("window_id").orderBy(F.lit(1)))
    kept = at_stop.withColumn("_n", rank).where("_n <= _left")
    names = ["window_id", *df.columns]
    return held.where(place < F.col("_stop")).select(*names).unionByName(kept.select(*names))


def _next(moment: Column, windows: DataFrame) -> Column:
    """The end of a window that holds ``moment`` as its last."""
    kind = windows.schema["end"].dataType
    return (moment.cast("timestamp") + F.expr("interval 1 microsecond")).cast(kind)


def sweep_bucket(
    df: DataFrame, time: str, windows: DataFrame, metric: str, granularity: str = "1 hour"
) -> DataFrame:
    """avg, min and max per bucket of every window.

    The series is aggregated once per grain, a bucket or a part of one that comes from halving
    it: the more windows there are for a bucket, the finer. Grains are merged upwards to
    halves, quarters and so on of each bucket. A window then is its whole buckets, in the
    buckets of its ends at most two parts of each size, and at its ends the rows of less than
    a grain, which alone are compared with it. Every step is an equi-join, and all windows go
    the same way, few or many. Parts are many times the windows, so the tasks that sort them are
    as many as they need: a task's memory doesn't follow the input.
    """
    listed = _listed(windows)
    width = width_of(granularity) // timedelta(microseconds=1)
    facts = listed.agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"),
        F.min("_from").alias("low"), F.max("_to").alias("high"), F.sum((F.col("_to") - F.col("_from")) / width).alias("buckets"),
    ).first()
    ends = 2 * facts["n"] * width // max(1, (facts["high"] or 0) - (facts["low"] or 0))
    halvings = min(ends.bit_length(), (width & -width).bit_length() - 1, HALVINGS_MAX)
    grain = width >> halvings
    span = [literal_time(df, time, naive_utc(facts[c] or EPOCH)) for c in ("first", "last")]
    rows = df.select(time, metric).where((F.col(time) >= span[0]) & (F.col(time) < span[1])).select(
        micros(F.col(time)).alias("_at"), metric
    )
    # A window has at most its whole buckets and, of each size, a part at both ends.
    tasks = _tasks(df, 2 * (halvings + 1) * facts["n"] + int(facts["buckets"] or 0), rows)
    fine = rows.groupBy(floor_div(F.col("_at"), grain).alias("_grain")).agg(*partials([metric], df))
    names = [c for c in fine.columns if c != "_grain"]
    sizes = [F.struct(F.lit(k).alias("_level"), F.shiftright("_grain", k).alias("_part")) for k in range(halvings + 1)]
    parts = fine.select(F.explode(F.array(*sizes)).alias("_p"), *names).groupBy("_p._level", "_p._part").agg(*merged([metric]))
    place = ["_level", "_part"]
    whole = _window_parts(listed, grain, halvings).repartition(tasks, *place).join(parts.repartition(tasks, *place), place).select(
        "window_id", F.expr(f"shiftright(_part, {halvings} - _level)").alias("_number"), *names
    )
    pieces = _window_ends(listed, grain)
    at = floor_div(F.col("_at"), grain).alias("_grain")
    inside = (F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high"))
    cut = (
        rows.select("_at", metric, at).repartition(tasks, "_grain").join(pieces.repartition(tasks, "_grain"), "_grain").where(inside)
        .groupBy("window_id", F.shiftright("_grain", halvings).alias("_number")).agg(*partials([metric], df))
    )
    both = whole.unionByName(cut).repartition(tasks, "window_id", "_number")
    held = both.groupBy("window_id", "_number").agg(*merged([metric]))
    kind = df.select(bucket(time, granularity).alias("bucket")).schema["bucket"].dataType
    start = F.timestamp_micros(F.col("_number") * F.lit(width)).cast(kind).alias("bucket")
    return held.select("window_id", start, average(metric).alias(f"avg_{metric}"), f"min_{metric}", f"max_{metric}")


def _tasks(df: DataFrame, parts: int, rows: DataFrame) -> int:
    """Tasks for ``parts`` window parts and the rows: about TASK_ROWS each, and no core idle."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-(parts + rows.count()) // TASK_ROWS))


def _window_parts(listed: DataFrame, grain: int, halvings: int) -> DataFrame:
    """The whole grains of every window as few parts of ``2 ** _level`` grains; none crosses a bucket."""
    first, after = -floor_div(-F.col("_from"), grain), floor_div(F.col("_to"), grain)
    own = listed.select("window_id", first.alias("_first"), after.alias("_after"))
    part = lambda level, number: F.struct(F.lit(level).alias("_level"), number.alias("_part"))
    ranges = lambda k: (F.shiftright(F.col("_first") + F.lit((1 << k) - 1), k), F.shiftright("_after", k))
    odd = []
    for k in range(halvings):
        low, high = ranges(k)
        one = low.bitwiseAND(F.lit(1))
        odd.append(F.when((low < high) & (one == 1), part(k, low)))
        odd.append(F.when((low + one < high) & (high.bitwiseAND(F.lit(1)) == 1), part(k, high - 1)))
    low, high = ranges(halvings)
    buckets = F.when(low < high, F.transform(F.sequence(low, high - 1), lambda x: part(halvings, x)))
    found = F.coalesce(buckets, F.expr("cast(array() AS array<struct<_level:int,_part:bigint>>)"))
    if odd:
        found = F.concat(F.array_compact(F.array(*odd)), found)
    return own.select("window_id", F.explode(found).alias("_p")).select("window_id", "_p.*")


def _window_ends(listed: DataFrame, grain: int) -> DataFrame:
    """What whole grains leave of every window: pieces ``_low`` to ``_high`` of a ``_grain``."""
    low, high = F.col("_from"), F.col("_to")
    first, after = -floor_div(-low, grain), floor_div(high, grain)
    piece = lambda number, a, b: F.struct(number.alias("_grain"), a.alias("_low"), b.alias("_high"))
    within_one = first > after
    pieces = F.array(
        F.when(within_one, piece(after, low, high)),
        F.when(~within_one & (low < first * grain), piece(first - 1, low, first * grain)),
        F.when(~within_one & (after * grain < high), piece(after, after * grain, high)),
    )
    return listed.select("window_id", F.explode(F.array_compact(pieces)).alias("_e")).select("window_id", "_e.*")


def sweep_tag(df: DataFrame, time: str, windows: DataFrame, tag: str, metric: str) -> DataFrame:
    counted = [F.count(F.lit(1)).alias("cnt"), F.avg(metric).alias(f"avg_{metric}")]
    return sweep(df, time, windows, {tag: F.col(tag)}, counted, [time, tag, metric])


def sweep_last(
    df: DataFrame, time: str, windows: DataFrame, tag: str, metric: str, key: Sequence[str]
) -> DataFrame:
    """The newest point of every tag value in every window."""
    matched = match_windows(df, time, windows, list(dict.fromkeys([tag, metric, time, *key])))
    newest = W.partitionBy("window_id", tag).orderBy(*[F.desc(c) for c in (time, *key)])
    return (
        matched.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .select("window_id", tag, metric, time)
    )


# Fixed value: the mixed workload asks for at least this many windows.
POOL_WINDOWS = 20


def pool_windows(df: DataFrame, time: str, length: timedelta, rounds: int = 0, seed: int = 42) -> DataFrame:
    """The windows of the mixed workload: one a round, POOL_WINDOWS at least, at random in the series."""
    return random_windows(df, time, max(POOL_WINDOWS, rounds), length, seed)


def query_pool(
    df: DataFrame,
    time: str,
    windows: DataFrame,
    tag: str,
    metric: str,
    key: Sequence[str],
    limits: Sequence[int] = (0,),
) -> dict[str, Callable[[], DataFrame]]:
    """The mixed reader workload: range, bucket and last-point answers for every window.

    Each answer is made when it is called for; the smallest limit applies to the rows.
    """
    limit = min(limits) if limits else 0
    return {
        "time_range": lambda: sweep_range(df, time, windows, key, limit),
        "aggregation": lambda: sweep_bucket(df, time, windows, metric),
        "last_point": lambda: sweep_last(df, time, windows, tag, metric, key),
    }


def pool_answers(
    df: DataFrame, time: str, windows: DataFrame, tag: str, metric: str, key: Sequence[str], granularity: str = "1 hour"
) -> DataFrame:
    """Bucket and last-point answers of all windows from one scan and one exchange.

    Every row that lies in a window is grouped by its bucket and by its tag at once (grouping
    sets), and both combine before they are shuffled. ``query`` tells the answers apart.
    """
    columns = list(dict.fromkeys([time, tag, metric, *key]))
    matched = match_windows(df, time, windows, columns).withColumn("bucket", bucket(time, granularity))
    newest = F.max_by(F.struct(F.col(metric).alias("last"), F.col(time).alias("last_ts")), F.struct(time, *key))
    sets = matched.groupingSets([["window_id", "bucket"], ["window_id", tag]], "window_id", "bucket", tag)
    both = sets.agg(F.grouping(tag).alias("_by_bucket"), *partials([metric], df), newest.alias("_newest"))
    by_bucket = F.col("_by_bucket") == 1
    only = lambda here, value, name: F.when(here, value).alias(name)
    return both.select(
        F.when(by_bucket, "aggregation").otherwise("last_point").alias("query"), "window_id", "bucket", tag,
        only(by_bucket, average(metric), f"avg_{metric}"), only(by_bucket, F.col(f"min_{metric}"), f"min_{metric}"),
        only(by_bucket, F.col(f"max_{metric}"), f"max_{metric}"),
        only(~by_bucket, F.col("_newest.last"), f"last_{metric}"), only(~by_bucket, F.col("_newest.last_ts"), "last_ts"),
    )


def window_sweep(
    df: DataFrame,
    time: str,
    sized_windows: dict[str, DataFrame],
    key: Sequence[str],
    limits: Sequence[int] = (0,),
) -> DataFrame:
    """Row counts and time bounds of the scan for every window x size x limit.

    The result names each combination the way a sweep over sizes and limits does, e.g.
    ``time_range_1h_limit_100``. Rows and window ends are ranked in one order, so all of a
    window's answers are looked up by ranks, whatever the limits, and no row meets a window.
    """
    windows = reduce(
        DataFrame.unionByName,
        [
            w.select(F.struct(F.lit(size).alias("size"), "window_id").alias("window_id"), "start", "end")
            for size, w in sized_windows.items()
        ],
    )
    ranked, placed = _ranked(df, time, _listed(windows), key)
    places = placed.where("_upto > _before").withColumn("_limit", F.explode(F.array(*[F.lit(n) for n in dict.fromkeys(limits)])))
    ends = materialize(
        places.select(
            "window_id", "_limit", (F.col("_before") + 1).alias("_first"),
            F.when(F.col("_limit") > 0, F.least("_upto", F.col("_before") + F.col("_limit"))).otherwise(F.col("_upto")).alias("_last"),
        ),
        "places",
    )
    at = lambda rank, name: ranked.select(F.col("_rank").alias(rank), F.col(time).alias(name))
    found = ends.join(at("_first", "first_ts"), "_first").join(at("_last", "last_ts"), "_last")
    name = [F.lit("time_range")]
    if len(sized_windows) > 1:
        name.append(F.col("window_id.size"))
    if len(limits) > 1:
        name.append(F.when(F.col("_limit") > 0, F.concat(F.lit("limit_"), F.col("_limit"))))
    return found.select(
        F.concat_ws("_", *name).alias("operation"),
        F.col("window_id.window_id").alias("window_id"),
        (F.col("_last") - F.col("_first") + 1).alias("n_rows"),
        "first_ts",
        "last_ts",
    )
