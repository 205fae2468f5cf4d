"""Joining a large frame with a small one computed from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; the right side's keys are dropped.

    No broadcast hint: the planner broadcasts the right side only when its size is below
    ``autoBroadcastJoinThreshold`` and otherwise sort-merges with skew splitting. A right
    side that comes out of an aggregate has no known size until it has run, by when the
    left side is being shuffled already; where the left side is a whole table, callers
    ``materialize`` the right one first.
    """
    renamed = right.select([F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    joined = left.join(renamed, same_keys(keys), how)
    return joined.drop(*[f"__{k}" for k in keys])


def same_keys(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
