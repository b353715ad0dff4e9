"""Whitening of embeddings from an exact integer scatter matrix.

Every entry c becomes the integer y = floor(64 c), which is x without its shift. Tasks sum y and its cross-products exactly:
the entries are cut into limbs small enough for float64 matrix products to be exact, the products are joined to integers
of any size, and these travel as base-2^30 digits, so that Spark's sums stay exact too. The driver joins the digits, forms
n·YᵀY - SSᵀ, which is n² times the covariance, without any rounding, and only then turns it into floats and takes ``eigh``.

A driver's share is one matrix of the embeddings' dimension, whatever the number of rows; rows never leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import small_arrow_batches

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: |floor(64 c)| beyond this is cut to it, so that x and its limbs fit a long.
LARGEST = 1 << 61
LIMB, DIGIT = 20, 30
#: Rows of one exact product: 2^12 products of two limbs stay below 2^53.
ROWS = 1 << 12


def integers(values: np.ndarray) -> np.ndarray:
    """floor(64 c) of float64 entries as int64, cut to ±LARGEST."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    return np.clip(scaled, -float(LARGEST), float(LARGEST)).astype(np.int64)


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """y = Σ limb_i 2^(20 i): all limbs but the last in [0, 2^20), as few as the largest entry needs."""
    count = max(1, -(-int(np.abs(y).max(initial=0)).bit_length() // LIMB))
    out = [((y >> (LIMB * i)) & ((1 << LIMB) - 1)).astype(np.float64) for i in range(count - 1)]
    return [*out, (y >> (LIMB * (count - 1))).astype(np.float64)]


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the rows of y as arrays of Python integers."""
    d = y.shape[1]
    sums, cross = np.zeros(d, object), np.zeros((d, d), object)
    for start in range(0, len(y), ROWS):
        limbs = _limbs(y[start : start + ROWS])
        for i, a in enumerate(limbs):
            sums += a.sum(0).astype(np.int64).astype(object) * (1 << (LIMB * i))
            for j, b in enumerate(limbs):
                cross += (a.T @ b).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return sums, cross


def _digits(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) in base 2^30, with the sign on each digit."""
    sign, rest, place = (1, -1)[value < 0], abs(value), 0
    while rest:
        yield place, sign * (rest & ((1 << DIGIT) - 1))
        rest, place = rest >> DIGIT, place + 1


def vectors_of(df: DataFrame) -> DataFrame:
    """vec_id and the embedding as array<double> of the rows that have one without null, NaN or infinite entries.

    Where lengths differ, the rows of the commonest length (of several, the longest) remain; empty vectors don't.
    """
    plain = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return plain.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite))


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n rows, the exact sums of y, eigenvalues and unit eigenvectors (columns) by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def directions(self, components: int) -> np.ndarray:
        """Eigenvectors over the roots of their eigenvalues; NaN where the eigenvalue is zero within rounding."""
        values = self.values[:components]
        least = max(self.values.max(initial=0.0), 0.0) * self.dimension * np.finfo(float).eps
        roots = np.sqrt(np.where(values > least, values, np.nan))
        return self.vectors[:, :components] / roots

    def scaled(self, y: np.ndarray) -> np.ndarray:
        """n·x - S of each entry, exactly, as Python integers where int64 could overflow."""
        largest = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if largest < 1 << 62 else object
        return y.astype(kind) * self.n - np.array(self.sums, kind)


def _batches(batches: Iterator[pa.RecordBatch], d: int | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            yield batch.column("vec_id"), flat.reshape(batch.num_rows, d)


def fit(spark: SparkSession, vectors: DataFrame) -> Whitening | None:
    """Components of the covariance of x over all ``vectors`` (see ``vectors_of``), of one length; None of no row.

    The digits' sums brought to the driver are at most 9 for each of d (d + 1) entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, values in _batches(batches, -1):
            part = scatter(integers(values))
            n, total = n + len(values), part if total is None else (total[0] + part[0], total[1] + part[1])
        if n:
            d = len(total[0])
            rows = [(-1, 0, 0, n), (-2, 0, 0, d * n)]
            rows += [(d, i, place, digit) for i in range(d) for place, digit in _digits(total[0][i])]
            rows += [(i, j, place, digit) for i in range(d) for j in range(i, d) for place, digit in _digits(total[1][i, j])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["i", "j", "place", "digit"])

    parts = vectors.mapInArrow(run, "i long, j long, place long, digit long")
    summed = parts.groupBy("i", "j", "place").agg(F.sum("digit").alias("digit")).collect()
    found: dict[tuple[int, int], int] = {}
    for i, j, place, digit in summed:
        found[i, j] = found.get((i, j), 0) + (digit << (DIGIT * place))
    if not found:
        return None
    n = found[-1, 0]
    d = found[-2, 0] // n
    sums = [found.get((d, i), 0) for i in range(d)]
    covariance = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            # A quotient of integers is rounded once.
            covariance[i, j] = covariance[j, i] = (n * found.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    values, vectors_ = np.linalg.eigh(covariance)
    return Whitening(n, sums, values[::-1].copy(), vectors_[:, ::-1].copy(), float(np.trace(covariance)))


def whitened(model: Whitening, values: np.ndarray, components: int) -> tuple[np.ndarray, list[int]]:
    """(rows, components) of whitened entries, and the exact deviation of each row."""
    scaled = model.scaled(integers(values))
    centred = (scaled / model.n).astype(np.float64)
    squares = scaled if scaled.dtype == object or int(np.abs(scaled).max(initial=0)) ** 2 * model.dimension < 1 << 63 else scaled.astype(object)
    return centred @ model.directions(components), [int(v) for v in (squares * squares).sum(1)]


def _identity_error(spark: SparkSession, vectors: DataFrame, model: Whitening, components: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over the components that have a variance."""
    k = min(components, model.dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, values in _batches(batches, model.dimension):
            w, _ = whitened(model, values, components)
            total += np.vstack([w.sum(0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k)), pa.array(np.tile(np.arange(k), k + 1)), pa.array(total.ravel())], names=["i", "j", "value"])

    parts = vectors.mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1, k))
    for i, j, value in parts:
        total[i, j] = value
    mean = total[0] / model.n
    off = np.abs(total[1:] / model.n - np.outer(mean, mean) - np.eye(k))
    there = ~np.isnan(model.directions(components)).any(0)
    return float(off[np.ix_(there, there)].max(initial=0.0))


def whiten(spark: SparkSession, embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector of ``embeddings`` (vec_id, embedding) and component, fitted on all of them.

    vec_id, component (from 1, by falling eigenvalue, at most the dimension), n, deviation (decimal: Σ (n·x - S)², exact),
    whitened ((x - S/n) on the unit eigenvector, over the root of its eigenvalue), explained (share of the trace) and
    identity_error (one value, measured on the whitened rows). Vectors that are null, empty, or hold a null or an entry that
    is not finite give no row; of vectors of several lengths those of the commonest remain. Repeated rows count and come
    out as often as they are there. Where an eigenvalue is zero within rounding, as with one row or equal rows, whitened is
    null; explained is 0 where the trace is. deviation is null beyond 38 digits. No usable vector gives no row.
    """
    small_arrow_batches(spark, ROWS)
    vectors = vectors_of(embeddings)
    lengths = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dimension = lengths[0]["d"] if lengths else 0
    vectors = vectors.where(F.size("embedding") == dimension)
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, deviation string, whitened array<double>"
    model = fit(spark, vectors) if dimension else None
    if model is None:
        rows = spark.createDataFrame([], schema)
        explained, error, n = [0.0], 0.0, 0
    else:
        k = min(components, dimension)
        error = _identity_error(spark, vectors, model, components)
        explained = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values[:k]]
        n = model.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, values in _batches(batches, dimension):
                w, deviations = whitened(model, values, components)
                flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([ids, pa.array([str(v) for v in deviations]), lists], names=["vec_id", "deviation", "whitened"])

        rows = vectors.mapInArrow(run, schema)
    each = rows.select("vec_id", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), F.posexplode("whitened").alias("p", "whitened"))
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("p") + 1)
    return each.select("vec_id", (F.col("p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
