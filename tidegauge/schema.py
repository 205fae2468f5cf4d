"""Column roles: which column is the time, which are tags, which are metrics."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.errors import SchemaError
from tidegauge.functions.timeparse import normalize_ts

TIMESTAMP, TAG, METRIC, OTHER = "timestamp", "tag", "metric", "other"

# Lower-cased column names read as the time column whatever their type.
TIME_NAMES = ("time", "ts", "timestamp", "datetime", "date", "created_at", "event_time")

# A string column is a tag when distinct / rows is below this.
TAG_THRESHOLD = 0.05

# Rows read when inferring from a sample.
SAMPLE_ROWS = 50_000

_TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NUMBER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _whole_decimal(kind: T.DataType) -> bool:
    """Unsigned 64-bit integers are read as decimals without digits after the point."""
    return isinstance(kind, T.DecimalType) and kind.scale == 0


@dataclass(frozen=True)
class SeriesSchema:
    """The roles of a series' columns, in column order."""

    name: str
    time: str
    tags: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    struct: T.StructType = field(default_factory=T.StructType)

    @property
    def columns(self) -> list[str]:
        return self.struct.fieldNames()

    def role(self, column: str) -> str:
        if column not in self.columns:
            raise KeyError(column)
        if column == self.time:
            return TIMESTAMP
        if column in self.tags:
            return TAG
        return METRIC if column in self.metrics else OTHER

    def by_role(self, role: str) -> list[str]:
        return [c for c in self.columns if self.role(c) == role]

    def pick_metric(self, override: str | None = None) -> str:
        """The metric to aggregate: the override if present, else the first, else ``value``."""
        if override is not None and override in self.columns:
            return override
        return self.metrics[0] if self.metrics else "value"

    def pick_tag(self, override: str | None = None) -> str:
        if override is not None and override in self.columns:
            return override
        return self.tags[0] if self.tags else "device_id"

    def annotated(self) -> T.StructType:
        """The Spark schema with the role of each column in its metadata."""
        return T.StructType(
            [
                T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, "role": self.role(f.name)})
                for f in self.struct
            ]
        )

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "struct": json.loads(self.annotated().json())})

    @classmethod
    def from_json(cls, text: str) -> SeriesSchema:
        data = json.loads(text)
        return cls.from_struct(data["name"], T.StructType.fromJson(data["struct"]))

    @classmethod
    def from_struct(cls, name: str, struct: T.StructType) -> SeriesSchema:
        """Read the roles back from column metadata."""
        roles = {f.name: f.metadata.get("role", OTHER) for f in struct}
        times = [c for c, r in roles.items() if r == TIMESTAMP]
        if not times:
            raise SchemaError(f"no column of {name!r} is marked as its time")
        return cls(
            name,
            times[0],
            tuple(c for c, r in roles.items() if r == TAG),
            tuple(c for c, r in roles.items() if r == METRIC),
            struct,
        )

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the roles attached as column metadata."""
        fields = self.annotated().fields
        return df.select([F.col(f.name).alias(f.name, metadata=f.metadata) for f in fields])


def time_column(struct: T.StructType) -> str:
    """The first column with a time type or a name from ``TIME_NAMES``."""
    for f in struct:
        if isinstance(f.dataType, _TIME_TYPES) or f.name.lower() in TIME_NAMES:
            return f.name
    raise SchemaError("no time column: name one of " + ", ".join(TIME_NAMES) + " or give a hint")


def infer_roles(df: DataFrame, threshold: float = TAG_THRESHOLD, approximate: bool = False) -> DataFrame:
    """One row per column: position, name, distinct values, rows and role.

    One pass over the string columns only. The exact distinct counts are combined map-side
    per (column, value); ``approximate`` swaps in sketches for very wide or long strings.
    """
    time = time_column(df.schema)
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != time]
    count = F.approx_count_distinct if approximate else F.count_distinct
    stats = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[count(F.col(c)).alias(f"d{i}") for i, c in enumerate(strings)],
    )
    rows = []
    for position, f in enumerate(df.schema):
        n_distinct = F.lit(None).cast("bigint")
        if f.name == time:
            role = F.lit(TIMESTAMP)
        elif isinstance(f.dataType, _NUMBER_TYPES) or _whole_decimal(f.dataType):
            role = F.lit(METRIC)
        elif f.name in strings:
            n_distinct = F.col(f"d{strings.index(f.name)}")
            is_tag = (F.col("n_rows") == 0) | (n_distinct < threshold * F.col("n_rows"))
            role = F.when(is_tag, TAG).otherwise(OTHER)
        else:
            role = F.lit(OTHER)
        rows.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(f.name).alias("column_name"),
                n_distinct.alias("n_distinct"),
                F.col("n_rows"),
                role.alias("role"),
            )
        )
    return stats.select(F.inline(F.array(*rows)))


def infer_schema(
    df: DataFrame, name: str = "series", threshold: float = TAG_THRESHOLD, approximate: bool = False
) -> SeriesSchema:
    """Infer the roles; only one row per column reaches the driver."""
    roles = {r["column_name"]: r["role"] for r in infer_roles(df, threshold, approximate).collect()}
    return SeriesSchema(
        name,
        time_column(df.schema),
        tuple(c for c in df.columns if roles[c] == TAG),
        tuple(c for c in df.columns if roles[c] == METRIC),
        df.schema,
    )


def apply_hint(
    df: DataFrame, name: str, time: str, tags: list[str] | tuple = (), metrics: list[str] | tuple = ()
) -> SeriesSchema:
    """Take the roles from the caller; columns not named are ``OTHER``."""
    missing = [c for c in (time, *tags, *metrics) if c not in df.columns]
    if missing:
        raise SchemaError(f"hint for {name!r} names missing columns: {missing}")
    return SeriesSchema(name, time, tuple(tags), tuple(metrics), df.schema)


def override_time(df: DataFrame, schema: SeriesSchema, column: str) -> tuple[DataFrame, SeriesSchema]:
    """Make ``column`` the time column, normalised; the old one becomes ``OTHER``."""
    if column not in df.columns:
        raise SchemaError(f"time column {column!r} not found; have {df.columns}")
    if column == schema.time:
        return df, schema
    out = normalize_ts(df, column)
    changed = replace(
        schema,
        time=column,
        tags=tuple(c for c in schema.tags if c != column),
        metrics=tuple(c for c in schema.metrics if c != column),
        struct=out.schema,
    )
    return changed.apply(out), changed


# Type names accepted in stored schemas.
_TYPE_NAMES = {
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(),
    "float32": T.FloatType(),
    "double": T.DoubleType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "large_string": T.StringType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "timestamp[ns]": T.TimestampType(),
    "timestamp[us]": T.TimestampType(),
    "timestamp[ms]": T.TimestampType(),
    "date32": T.DateType(),
}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a stored type name; unknown names are kept as text."""
    return _TYPE_NAMES.get(name, T.StringType())


def sql_type(dtype: T.DataType) -> str:
    """The external SQL type, for ``createTableColumnTypes`` when writing over JDBC."""
    if isinstance(dtype, (*_TIME_TYPES,)):
        return "TIMESTAMP WITH TIME ZONE"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dtype, T.LongType):
        return "BIGINT"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return "INTEGER"
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    if isinstance(dtype, T.FloatType):
        return "REAL"
    if isinstance(dtype, T.DoubleType):
        return "DOUBLE PRECISION"
    return "TEXT"
