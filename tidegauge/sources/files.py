"""Parquet, CSV and JSON sources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.errors import SourceError
from tidegauge.functions.timeparse import normalize_ts, parse_text
from tidegauge.functions.units import convert_units
from tidegauge.schema import TAG_THRESHOLD, TIME_NAMES, SeriesSchema, apply_hint, infer_schema
from tidegauge.sources.object_store import is_object_url, rewrite_url

# File endings read, by format.
PARQUET = (".parquet", ".parq")
CSV = (".csv",)
JSON = (".json", ".jsonl", ".ndjson")


def scan_parquet(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame:
    """Parquet with the columns of all files; ``base`` is the folder above partition folders."""
    reader = spark.read.option("mergeSchema", "true")
    return (reader.option("basePath", base) if base else reader).parquet(*paths)


def scan_csv(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema where possible: without one Spark reads the files
    twice. Text columns named like a time are parsed."""
    # Quotes inside quotes are doubled, as everywhere but in Spark's default.
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is not None:
        df = reader.schema(schema).csv(list(paths))
    else:
        df = reader.option("inferSchema", True).csv(list(paths))
    return _parse_times(df)


def scan_json(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines and files holding one array, also mixed in one folder or glob.

    Which is which is found on the executors, from the first character of each file. Lines
    split across tasks; an array file cannot and is read by one task per file.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    arrays = _array_files(spark, paths)
    if not arrays:
        return _parse_times(reader.json(list(paths)))
    lines = sorted({r["path"] for r in _listing(spark, *paths).select("path").collect()} - set(arrays))
    parts = [reader.json(lines)] if lines else []
    parts.append(reader.option("multiLine", True).json(arrays))
    return _parse_times(union_sources(parts))


def _array_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files whose first character that is not blank opens an array.

    Only the first piece of each file is looked at, and its lines combine map-side.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").text(list(paths))
        .where("_metadata.file_block_start = 0")
        .select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.ltrim("value").alias("value"))
        .where("value <> ''")
    )
    heads = lines.groupBy("path").agg(F.min_by(F.substring("value", 1, 1), "at").alias("head"))
    return sorted(r["path"] for r in heads.where("head = '['").collect())


def _parse_times(df: DataFrame) -> DataFrame:
    texts = [
        f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name.lower() in TIME_NAMES
    ]
    return df.withColumns({c: parse_text(F.col(c)) for c in texts}) if texts else df


def _ending(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def resolve_sources(spark: SparkSession, sources: Sequence[str], account: str | None = None) -> list[str]:
    """Files behind a list of files, directories, globs and object-store URLs.

    Directories give all Parquet files below them, globs the files of every format, and
    ``**`` in a glob any folders, or none. Files of one source are sorted; a source that is
    missing or gives nothing is an error. Spark lists, so it sees what the executors see and
    large trees are listed by them; one query per source brings the names.
    """
    out: list[str] = []
    for source in sources:
        path = rewrite_url(source, account) if is_object_url(source) else source
        try:
            found = _list_files(spark, path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            raise SourceError(f"source not found: {source}") from None
        if not found:
            raise SourceError(f"no data files in {source}")
        out.extend(found)
    if not out:
        raise SourceError("no sources given")
    return out


def _listing(spark: SparkSession, *paths: str) -> DataFrame:
    """``path`` of every file below some paths; no file is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path")


def _list_files(spark: SparkSession, path: str) -> list[str]:
    steps = path.split("/")
    deep = next((i for i, step in enumerate(steps) if "**" in step), None)
    is_glob = any(c in path for c in "*?")
    if not is_glob and _ending(path) in PARQUET + CSV + JSON:
        return [path] if _listing(spark, path).count() else []
    endings = PARQUET + CSV + JSON if is_glob else PARQUET
    if deep is None:
        found = _listing(spark, path)
    else:
        # Spark's own globs know no ``**``: everything below is listed, and names are compared.
        below = "/".join(steps[:deep]) or ("/" if path.startswith("/") else ".")
        named = [*steps, "*"] if steps[-1] == "**" else steps
        whole = "/".join(map(_step_pattern, named)).replace("(?:[^/]+/)*/", "(?:[^/]+/)*")
        found = _listing(spark, below).where(F.col("path").rlike(f"{whole}$"))
    named = found.where(F.lower("path").rlike(r"(%s)$" % "|".join(e.replace(".", r"\.") for e in endings)))
    return sorted(_plain(r["path"]) for r in named.collect())


def _step_pattern(step: str) -> str:
    """A regular expression for one step of a glob."""
    if step == "**":
        return "(?:[^/]+/)*"
    signs = {"*": "[^/]*", "?": "[^/]"}
    return "".join(signs.get(c, re.escape(c)) for c in step.replace("**", "*"))


def _plain(path: str) -> str:
    """A local file without its scheme, as users name it."""
    return path.removeprefix("file://" if path.startswith("file://") else "file:")


def scan_files(spark: SparkSession, files: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Read resolved files of any supported format as one frame.

    Files of one format are one multi-path scan, so thousands of files do not make a
    thousand-branch plan.
    """
    by_format: dict[str, list[str]] = {"parquet": [], "csv": [], "json": []}
    for f in files:
        ending = _ending(f)
        if ending in PARQUET or ending == "":
            by_format["parquet"].append(f)
        elif ending in CSV:
            by_format["csv"].append(f)
        elif ending in JSON:
            by_format["json"].append(f)
        else:
            raise SourceError(f"unsupported format: {f}")
    parts = []
    if by_format["parquet"]:
        by_base: dict[str | None, list[str]] = {}
        for f in by_format["parquet"]:
            by_base.setdefault(_partition_base(f), []).append(f)
        parts += [scan_parquet(spark, *own, base=base) for base, own in by_base.items()]
    if by_format["csv"]:
        parts.append(scan_csv(spark, *by_format["csv"], schema=schema))
    if by_format["json"]:
        parts.append(scan_json(spark, *by_format["json"], schema=schema))
    return union_sources(parts)


def _partition_base(path: str) -> str | None:
    """The folder above the first ``column=value`` folder, if there is one."""
    folders = path.split("/")[:-1]
    first = next((i for i, name in enumerate(folders) if "=" in name), None)
    return None if first is None else "/".join(folders[:first])


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, columns matched by name."""
    if not parts:
        raise SourceError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_dataset(
    spark: SparkSession, sources: str | Sequence[str], schema: T.StructType | None = None
) -> DataFrame:
    """Resolve and read: the usual way in."""
    listed = [sources] if isinstance(sources, str) else list(sources)
    return scan_files(spark, resolve_sources(spark, listed), schema)


def load_series(
    spark: SparkSession,
    sources: str | Sequence[str],
    name: str = "series",
    hint: SeriesSchema | None = None,
    units: Mapping[str, tuple[str, str]] | None = None,
    epoch: str | None = None,
    threshold: float = TAG_THRESHOLD,
    approximate: bool = False,
) -> tuple[DataFrame, SeriesSchema]:
    """Read, find the roles, normalise the time and convert units: the whole load in one step.

    ``hint`` gives the roles (its columns must be there); without it they are inferred in one
    pass over the text columns. The time becomes a UTC timestamp; ``epoch`` is the unit of a
    numeric one, where its size leaves doubt. ``units`` maps columns to (from, to) and applies
    last. Roles are attached to the columns.
    """
    df = load_dataset(spark, sources)
    if hint is None:
        found = infer_schema(df, name, threshold, approximate)
    else:
        found = apply_hint(df, hint.name, hint.time, hint.tags, hint.metrics)
    df = convert_units(normalize_ts(df, found.time, epoch), units or {})
    found = replace(found, struct=df.schema)
    return found.apply(df), found
