"""Small column expressions shared by the operators; all of them stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.errors import SchemaError

MICROS_PER_MILLI = 1_000
MICROS_PER_SECOND = 1_000_000
BYTES_PER_MIB = 1_048_576.0


def floor_div(col: Column, by: int) -> Column:
    """Integer division that rounds towards minus infinity."""
    return F.call_function("div", col - F.pmod(col, F.lit(by)), F.lit(by))


def micros(col: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (UTC session)."""
    return F.unix_micros(col.cast("timestamp"))


def cast_precision(ts: Column, unit: str) -> Column:
    """A timestamp as an integer epoch; milliseconds and seconds floor."""
    value = micros(ts)
    if unit == "us":
        return value
    if unit == "ms":
        return floor_div(value, MICROS_PER_MILLI)
    if unit == "s":
        return floor_div(value, MICROS_PER_SECOND)
    if unit == "ns":
        return value * F.lit(1000).cast("bigint")
    raise SchemaError(f"unknown precision {unit!r}; use s, ms, us or ns")


def hashed_bits(parts: list[Column], digits: int = 15) -> Column:
    """The leading hex digits of an MD5 over ``parts`` as a non-negative long.

    Portable: any SQL engine with MD5 gives the same number for the same row.
    """
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def hashed_unit(parts: list[Column]) -> Column:
    """A uniform number in [0, 1) decided by ``parts`` alone."""
    return hashed_bits(parts, 8) / F.lit(4294967296.0)


def config_digest(columns: list[str]) -> Column:
    """Eight hex digits naming the values of ``columns``, whatever order they are given in."""
    return F.substring(F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))), 1, 8)


# Bytes one value takes; text counts its own length.
_WIDTHS = {
    "boolean": 1,
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "date": 4,
    "float": 4,
    "bigint": 8,
    "double": 8,
    "timestamp": 8,
    "timestamp_ntz": 8,
}


def row_bytes(struct: T.StructType) -> Column:
    """The logical size of a row: fixed widths plus the bytes of its text (nulls take none)."""
    fixed = 0
    parts: list[Column] = []
    for f in struct:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)).cast("bigint"))
        else:
            fixed += _WIDTHS.get(f.dataType.simpleString(), 8)
    total = F.lit(fixed).cast("bigint")
    for part in parts:
        total = total + part
    return total


def ratio(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    """``numerator / denominator``, or ``default`` when the denominator is zero or null."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(default).cast("double"))
