"""Exact order statistics per group, for groups of any size.

Group sizes are counted first. The values of a group that is proven small are sorted as an
array inside one aggregate: one shuffle, however many groups there are. Larger groups are
never gathered. Their values are counted in logarithmic cells (a fixed function of the value, so every pass
agrees), the cells holding the wanted ranks are found from those counts, and only the rows
of these cells are counted again by exact value. Both counts combine map-side, so neither
a hot group nor a hot value reaches one task as rows. The cell counts are small and are
stored, so a statistic costs one scan for the counts and one for each set of ranks,
however many groups, columns and percentiles it covers. Only when a cell holds more rows
than a task should sort are the wanted cells split into finer ones first, by one more scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegauge.operators.keys import keyed_join
from tidegauge.session import materialize

# Cells per factor e, first and when split: 0.8 % and 0.0001 % wide.
COARSE, FINE = 128, 1 << 20

# Rows of one cell a task sorts by value without splitting the cell first.
CELL_ROWS_MAX = 2_000_000

# Rows of a group that are sorted as one array.
GROUP_ROWS_MAX = 100_000

METRIC = "_metric"

# {column: {name of the result: fraction}}
Points = Mapping[str, Mapping[str, float]]


def cell_of(x: Column, per_e: int = COARSE) -> Column:
    """A cell number that never decreases as the double ``x`` grows."""
    beyond = 1000 * per_e  # the logarithm of a double lies within 745 of zero
    size = F.floor(F.log(F.abs(x)) * per_e) + beyond
    return (
        F.when(F.isnan(x), F.lit(3 * beyond))
        .when(x == float("inf"), F.lit(2 * beyond))
        .when(x == float("-inf"), F.lit(-2 * beyond))
        .when(x > 0, size)
        .when(x < 0, -size)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


@dataclass(frozen=True)
class Cells:
    """The values of some columns of a frame, and how many fall in each cell."""

    keys: list[str]
    rows: DataFrame
    counts: DataFrame
    fullest: int

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> Cells:
        """Count the columns' non-null values per group, in one scan."""
        keys = list(keys)
        if len(columns) == 1:
            value = F.col(columns[0]).cast("double").alias("_value")
            pairs = df.select(*keys, F.lit(columns[0]).alias(METRIC), value)
        else:
            listed = F.array(
                *[F.struct(F.lit(c).alias(METRIC), F.col(c).cast("double").alias("_value")) for c in columns]
            )
            pairs = df.select(*keys, F.explode(listed).alias("_pair")).select(*keys, "_pair.*")
        rows = pairs.where(F.col("_value").isNotNull()).withColumn("_cell", cell_of(F.col("_value")))
        keys = [*keys, METRIC]
        fullest = Observation()
        counts = rows.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        stored = materialize(counts.observe(fullest, F.max("_n").alias("n")), "cells")
        return cls(keys, rows, stored, fullest.get["n"] or 0)

    def linear(self, points: Points) -> DataFrame:
        """Percentiles with linear interpolation between neighbours; one row per group
        with a column per point."""
        size, spots = F.col("_size"), []
        for c, group in points.items():
            for name, p in group.items():
                place = F.lit(float(p)) * (size - 1)
                low = F.floor(place).cast("bigint") + 1
                spots.append((c, name, place - F.floor(place), low, F.least(low + 1, size)))
        wanted = F.lit(None)
        for c in points:
            mine = F.array(*[r for column, _, _, a, b in spots if column == c for r in (a, b)])
            wanted = F.when(F.col(METRIC) == c, mine).otherwise(wanted)
        found = self._at_ranks(lambda placed: placed.withColumn("_ranks", wanted), ["_size"])
        out = []
        for c, name, weight, low, high in spots:
            at = lambda r: F.max(F.when((F.col(METRIC) == c) & (F.col("_rank") == r), F.col("_value")))  # noqa: B023, E731
            share = F.max(F.when(F.col(METRIC) == c, weight))
            between = F.when(share > 0, at(low) + (at(high) - at(low)) * share).otherwise(at(low))
            out.append(between.alias(name))
        return found.groupBy(*self.keys[:-1]).agg(*out)

    def nearest(self, column: str, points: Mapping[str, float], population: DataFrame) -> DataFrame:
        """Percentiles of one column by rank ``max(1, floor(p * n + 0.5))``.

        ``population`` (the keys, ``skip``, ``n``) leaves out the ``skip`` smallest values
        and counts the next ``n``, so a trimmed population needs no filtered copy.
        """
        rank = {}
        for name, p in points.items():
            rank[name] = F.col("skip") + nearest_rank(F.col("n"), p)
        people = population.select(*self.keys[:-1], "skip", "n")

        def ranked(placed: DataFrame) -> DataFrame:
            mine = placed.where(F.col(METRIC) == column)
            return keyed_join(mine, people, self.keys[:-1]).withColumn("_ranks", F.array(*rank.values()))

        found = self._at_ranks(ranked, ["skip", "n"])
        at = {name: F.max(F.when(F.col("_rank") == r, F.col("_value"))) for name, r in rank.items()}
        return found.groupBy(*self.keys[:-1]).agg(*[v.alias(name) for name, v in at.items()])

    def _at_ranks(self, ranked: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
        """One row per group and wanted rank: ``_rank``, ``_value`` and the carried columns.

        ``ranked`` adds ``_ranks array<bigint>``, 1-based, to the cell counts, which know
        the size of their group as ``_size``. Ranks outside it give no row.
        """
        keys = self.keys
        # The windows sort one row per occupied cell, a number bounded by the cell size.
        upto = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
        placed = self.counts.withColumns(
            {
                "_before": F.sum("_n").over(upto) - F.col("_n"),
                "_size": F.sum("_n").over(W.partitionBy(*keys)),
            }
        )
        wanted = _holding(ranked(placed)).select(*keys, *carried, "_cell", "_before", "_ranks")
        # Stored, so that the planner knows its size before it plans the join: while it is
        # small it is broadcast and the rows are not shuffled.
        wanted = materialize(wanted, "wanted")
        near = keyed_join(self.rows, wanted, [*keys, "_cell"])
        if self.fullest > CELL_ROWS_MAX:
            near = self._split(near, wanted, carried)
        place = [*keys, *carried, "_cell", "_before", "_ranks"]
        exact = near.groupBy(*place, "_value").agg(F.count(F.lit(1)).alias("_n"))
        # The distinct values of one cell.
        among = W.partitionBy(*keys, "_cell").orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
        counted = exact.withColumn("_before", F.col("_before") + F.sum("_n").over(among) - F.col("_n"))
        return _holding(counted).select(*keys, *carried, F.explode("_ranks").alias("_rank"), "_value")

    def _split(self, near: DataFrame, wanted: DataFrame, carried: list[str]) -> DataFrame:
        """Narrow the wanted cells down to fine ones by counting their rows again."""
        keys = self.keys
        fine = near.withColumn("_fine", cell_of(F.col("_value"), FINE))
        place = [*keys, *carried, "_cell", "_before", "_ranks"]
        counts = fine.groupBy(*place, "_fine").agg(F.count(F.lit(1)).alias("_n"))
        among = W.partitionBy(*keys, "_cell").orderBy("_fine").rowsBetween(W.unboundedPreceding, 0)
        placed = counts.withColumn("_before", F.col("_before") + F.sum("_n").over(among) - F.col("_n"))
        narrow = materialize(_holding(placed).drop("_cell", "_n").withColumnRenamed("_fine", "_cell"), "fine")
        rows = self.rows.withColumn("_cell", cell_of(F.col("_value"), FINE))
        return keyed_join(rows, narrow, [*keys, "_cell"])


def _holding(counted: DataFrame) -> DataFrame:
    """The rows whose ``_n`` values after the ``_before`` first ones include a wanted rank;
    ``_ranks`` keeps the ranks they include."""
    inside = F.filter(
        F.array_distinct("_ranks"),
        lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_n")),
    )
    return counted.withColumn("_ranks", inside).where(F.size("_ranks") > 0)


def by_group_size(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    small: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``small(rows)`` for the groups a task can sort, ``large(rows)`` for the others.

    The few large groups are listed, so their rows are told apart by a broadcast join.
    """
    keys = list(keys)
    most = F.greatest(*[F.count(c) for c in columns]) if len(columns) > 1 else F.count(columns[0])
    seen = Observation()
    sizes = df.groupBy(*keys).agg(most.alias("_size")).observe(seen, F.max("_size").alias("most"))
    big = materialize(sizes.where(F.col("_size") > GROUP_ROWS_MAX).select(*keys), "large-groups")
    if (seen.get["most"] or 0) <= GROUP_ROWS_MAX:
        return small(df)
    flagged = keyed_join(df, big.withColumn("_big", F.lit(True)), keys, "left")
    few = flagged.where(F.col("_big").isNull()).drop("_big")
    many = flagged.where(F.col("_big")).drop("_big")
    return small(few).unionByName(large(many))


def sorted_values(column: Column) -> Column:
    """The non-null values of a group in order; only for groups proven small."""
    return F.sort_array(F.collect_list(column.cast("double")))


def linear_at(values: Column, p: float) -> Column:
    """The interpolated percentile of a sorted array; null when it is empty."""
    place = F.lit(float(p)) * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    weight = place - low
    below, above = F.get(values, low), F.get(values, low + 1)
    return F.when(weight > 0, below + (above - below) * weight).otherwise(below)


def nearest_rank(n: Column, p: float) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(float(p)) * n + F.lit(0.5))).cast("bigint")


def linear_percentiles(df: DataFrame, keys: Sequence[str], points: Points) -> DataFrame:
    """Interpolated percentiles of several columns, one row per group that has values."""
    keys = list(keys)

    def small(rows: DataFrame) -> DataFrame:
        arrays = {c: f"_sorted{i}" for i, c in enumerate(points)}
        grouped = rows.groupBy(*keys).agg(*[sorted_values(F.col(c)).alias(a) for c, a in arrays.items()])
        some = F.greatest(*[F.size(a) for a in arrays.values()], F.lit(0)) > 0
        named = [linear_at(F.col(arrays[c]), p).alias(name) for c, group in points.items() for name, p in group.items()]
        return grouped.where(some).select(*keys, *named)

    return by_group_size(
        df, keys, list(points), small, lambda rows: Cells.of(rows, keys, list(points)).linear(points)
    )
