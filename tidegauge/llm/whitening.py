"""Embedding whitening by incremental eigendecomposition.

Vectors become whole numbers (``floor(scale * entry)``), and the distinct ones are the fit
list, so copies have no weight. Each task folds its part of the list into a ``Spectrum``, the
decomposed scatter of the vectors it has met, by centred rank-one updates; spectra are then
combined by further rank-one updates, FAN_IN at a time, until one is left (``spectra.py``).
Its eigenvectors are refined by Rayleigh-Ritz: a pass over the fit list projects the
covariance on them, and the small projected matrix, nearly diagonal by then, turns them to
the eigenvectors to double precision. A last pass measures how far the whitened fit list's
covariance is from the identity. What travels are matrices of the vectors' length squared;
only the last spectrum and the projected matrix reach the driver.

Spectra are written after each round, so a lost task repeats its own round alone.

Rows whose vector is null, empty or holds null or non-finite entries are left out; repeated
rows and ids are kept one by one. Vectors of several lengths are refused. Where the list
varies in fewer directions than components are asked for, the others have no variance, their
whitened values are null, and they don't count in the identity error. An empty table gives no
rows. Columns named like those that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.base import materialize, query, table
from tidegauge.llm.spectra import Spectrum

SCALE = 256.0
COMPONENTS = 4
# Rows that are turned into a triangle together before they update a spectrum.
BLOCK_ROWS = 4096
# Spectra that one task combines.
FAN_IN = 16
# Eigenvalues below this share of the largest are rounding.
FLOOR = 1e-12

_SPECTRUM = "n long, sums binary, eigenvalues binary, vectors binary"
ADDED = ("whitened", "deviation")


@dataclass
class Whitening:
    """What a fit gives: the fit list's size and sums, and its leading eigenpairs."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    # A row per component.
    axes: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))).tolist()

    @property
    def scales(self) -> np.ndarray:
        """What each component is divided by; not a number where there is no variance."""
        top = self.values.max(initial=0.0)
        sound = self.values > FLOOR * top
        return np.where(sound, np.sqrt(np.where(sound, self.values, 1.0)), np.nan)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.axes.T / self.scales

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - sums)^2, exactly; None beyond 64 bits."""
        reach = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0))
        whole = x if reach * reach * x.shape[1] < 1 << 63 else x.astype(object)
        out = ((self.n * whole - self.sums.astype(whole.dtype)) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in out]


def whole_vectors(df: DataFrame, vector: str, scale: float = SCALE, name: str = "x") -> DataFrame:
    """The rows with a sound vector, and the vector in whole numbers as ``name``."""
    column = f"`{vector}`"
    sound = f"coalesce(size({column}) > 0 and forall({column}, c -> c is not null and abs(cast(c as double)) < double('Infinity')), false)"
    x = f"transform({column}, c -> cast(floor(cast(c as double) * {float(scale)!r}D) as bigint))"
    return df.where(sound).withColumn(name, F.expr(x))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """The lists of one length in a column as rows."""
    if not len(column):
        return np.zeros((0, 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = len(flat) // len(column)
    if not (np.diff(column.offsets.to_numpy()) == size).all():
        raise ValueError("vectors to be whitened must have one length")
    return flat.reshape(len(column), size)


def _blocks(batches: Iterable[pa.RecordBatch], name: str = "x") -> Iterator[np.ndarray]:
    """The vectors of all batches, BLOCK_ROWS or fewer at a time."""
    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            held.append(_matrix(batch.column(name)))
        if sum(map(len, held)) >= BLOCK_ROWS:
            yield _stacked(held)
            held = []
    if held:
        yield _stacked(held)


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    if len({p.shape[1] for p in parts}) > 1:
        raise ValueError("vectors to be whitened must have one length")
    return np.concatenate(parts)


def _packed(spectrum: Spectrum | None) -> Iterator[pa.RecordBatch]:
    if spectrum is not None:
        row = {"n": spectrum.n, "sums": spectrum.sums.tobytes(), "eigenvalues": spectrum.values.tobytes(), "vectors": spectrum.vectors.tobytes()}
        yield pa.RecordBatch.from_pylist([row])


def _unpacked(row: dict) -> Spectrum:
    values = np.frombuffer(row["eigenvalues"])
    sums = np.frombuffer(row["sums"], np.int64)
    return Spectrum(row["n"], sums, values, np.frombuffer(row["vectors"]).reshape(len(values), len(values)))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = None
    for block in _blocks(batches):
        own = own or Spectrum.empty(block.shape[1])
        if block.shape[1] != len(own.sums):
            raise ValueError("vectors to be whitened must have one length")
        own.add_block(block)
    yield from _packed(own)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = None
    for batch in batches:
        for row in batch.to_pylist():
            other = _unpacked(row)
            if own is None:
                own = other
            elif len(own.sums) != len(other.sums):
                raise ValueError("vectors to be whitened must have one length")
            else:
                own.merge(other)
    yield from _packed(own)


def spectrum(fit_list: DataFrame) -> Spectrum | None:
    """The decomposed scatter of the distinct vectors ``x``; None without any."""
    parts = materialize(fit_list.mapInArrow(_fold, _SPECTRUM), "spectra")
    left = parts.count()
    while left > 1:
        left = -(-left // FAN_IN)
        parts = materialize(parts.repartition(left).mapInArrow(_combine, _SPECTRUM), "spectra")
        # A task that was dealt no spectrum gives none.
        left = parts.count()
    rows = parts.collect()
    return _unpacked(rows[0].asDict()) if rows else None


def _summed(fit_list: DataFrame, product) -> np.ndarray | None:
    """The sum over the list of ``product(block)``, a symmetric matrix per block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks(batches):
            own = product(block)
            total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": total[i, j]})

    entries = fit_list.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not entries:
        return None
    out = np.zeros((max(e["j"] for e in entries) + 1,) * 2)
    for e in entries:
        out[e["i"], e["j"]] = out[e["j"], e["i"]] = e["v"]
    return out


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit to a stored list of distinct vectors ``x``; None without any."""
    first = spectrum(fit_list)
    if first is None:
        return None
    mean, basis = first.sums / first.n, np.linalg.qr(first.vectors)[0]

    def projected(block: np.ndarray) -> np.ndarray:
        own = (block - mean) @ basis
        return own.T @ own

    values, turn = np.linalg.eigh(_summed(fit_list, projected) / first.n)
    axes = (basis @ turn).T[::-1]
    axes /= np.linalg.norm(axes, axis=1)[:, None]
    values = np.maximum(values[::-1], 0.0)
    own = Whitening(first.n, first.sums, values[:components], axes[:components], float(values.sum()))
    sound = ~np.isnan(own.scales)
    if sound.any():

        def spread(block: np.ndarray) -> np.ndarray:
            # A column of ones brings the sums along with the products.
            white = np.column_stack([own.project(block)[:, sound], np.ones(len(block))])
            return white.T @ white

        total = _summed(fit_list, spread) / own.n
        covariance = total[:-1, :-1] - np.outer(total[-1, :-1], total[-1, :-1])
        own.identity_error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return own


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: float = SCALE) -> tuple[DataFrame, Whitening | None]:
    """Rows with a sound vector and their ``whitened`` values (array) and ``deviation`` (long), and the fit."""
    if components < 1:
        raise ValueError("components must be positive")
    kept = [c for c in df.columns if c.lower() not in ADDED]
    held = whole_vectors(df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{vector}`").alias("v")), "v", scale)
    own = fit(materialize(held.select("x").distinct(), "fit"), components)
    schema = T.StructType(
        [held.schema["row"], T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                white = pa.array(own.project(x).ravel(), from_pandas=True)
                lists = pa.FixedSizeListArray.from_arrays(white, len(own.axes)).cast(pa.list_(pa.float64()))
                added = {"whitened": lists, "deviation": pa.array(own.deviations(x), pa.int64())}
                yield pa.RecordBatch.from_pydict({"row": batch.column("row"), **added})

    return held.select("row", "x").mapInArrow(run, schema).select("row.*", *ADDED), own


@query("op13_whitening")
def _whiten(spark, folder):
    """Every sound vector on the leading four components."""
    found, own = whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    number = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = ", ".join(f"{v!r}D" for v in (own.explained if own else [0.0]))
    return number.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(own.n if own else 0).cast("long").alias("n"), "deviation",
        "whitened", F.expr(f"element_at(array({explained}), at + 1)").alias("explained"),
        F.lit(own.identity_error if own else 0.0).alias("identity_error"),
    )
