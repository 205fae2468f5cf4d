"""Linear unit conversion of metric columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.errors import SchemaError

# Fixed values: (from, to) -> (scale, offset), applied as value * scale + offset.
LINEAR_UNITS = {
    ("celsius", "fahrenheit"): (9 / 5, 32.0),
    ("fahrenheit", "celsius"): (5 / 9, -32.0 * 5 / 9),
    ("pa", "bar"): (1e-5, 0.0),
    ("bar", "pa"): (1e5, 0.0),
    ("pa", "kpa"): (1e-3, 0.0),
    ("kpa", "pa"): (1e3, 0.0),
    ("m", "km"): (1e-3, 0.0),
    ("km", "m"): (1e3, 0.0),
    ("m_per_s", "km_per_h"): (3.6, 0.0),
    ("km_per_h", "m_per_s"): (1 / 3.6, 0.0),
}


def convert_units(df: DataFrame, conversions: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Convert ``{column: (from, to)}``; absent columns are skipped, unknown pairs refused."""
    changed = {}
    for column, (source, target) in conversions.items():
        if column not in df.columns:
            continue
        pair = (source.lower(), target.lower())
        if pair not in LINEAR_UNITS:
            raise SchemaError(f"no conversion {source!r} -> {target!r}; have {sorted(LINEAR_UNITS)}")
        scale, offset = LINEAR_UNITS[pair]
        changed[column] = F.col(column).cast("double") * F.lit(scale) + F.lit(offset)
    return df.withColumns(changed) if changed else df
