"""Embedding whitening: leading eigenvectors of the covariance by Chebyshev-filtered subspace iteration.

The covariance is never formed. A pass over the vectors multiplies it with a few
columns; a polynomial of it, three terms at a time, damps the part of the spectrum
that is not wanted.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..operators.materialize import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 64, 1_000_000
# Entries beyond count as this, so that steps and their sums stay whole numbers.
LARGEST = 2.0**40
LOW_BITS = 24
# Passes of one filter, and steps of the search for the least eigenvalue that ride on the first ones.
DEGREE = 10
STEPS = 10
# Residual of an eigenvector, as a share of the largest eigenvalue, with which it is certified.
TOLERANCE = 2e-14
# What more passes can't lower is accepted up to this; beyond it the subspace grows.
FLOOR = 1e-12
# Eigenvalues below this share of the largest are zero in double precision.
ZERO = 1e-12
MOST_LONG = (1 << 63) - 1
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Centre:
    """Mean of whole numbers: its whole part and the rest, over n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray  # n times what the mean exceeds its whole part by

    def steps(self, column: pa.Array) -> np.ndarray:
        """Vectors less the whole part of the mean, exactly."""
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.whole)) - self.whole

    def centred(self, column: pa.Array) -> np.ndarray:
        return self.steps(column) - self.rest / self.n

    def deviations(self, steps: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exactly; null where that is no long."""
        largest = max(abs(int(steps.max(initial=0))), abs(int(steps.min(initial=0)))) + 1
        if steps.shape[1] * (self.n * largest) ** 2 <= MOST_LONG:
            return ((steps * self.n - self.rest) ** 2).sum(axis=1).tolist()
        rest = [int(x) for x in self.rest]
        sums = (sum((self.n * x - r) ** 2 for x, r in zip(row, rest, strict=True)) for row in steps.tolist())
        return [s if s <= MOST_LONG else None for s in sums]


@dataclass
class Spectrum:
    """Leading eigenvalues and eigenvectors (columns), the trace, how many passes they took, and the largest residual."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    residual: float


def quantize(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x of every row whose vector is whole: no null, no entry that is null or not finite."""
    held = F.col(vector)
    entries = F.transform(held, lambda c: F.floor(SCALE * F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(SHIFT).cast("long"))
    whole = held.isNotNull() & F.forall(held, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return embeddings.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("x"))


def _sums(rows: DataFrame, work: Callable[[pa.Array], np.ndarray], cells: int, kind: str = "double") -> np.ndarray:
    """Sum of one array (of so many cells) over all rows: added up within tasks, then cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = work(batch.column(0)).ravel()
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], ["cell", "value"])

    found = rows.select("x").mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(cells, np.int64 if kind == "long" else np.float64)
    out[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return out


def centre(rows: DataFrame, dims: int) -> Centre:
    """Number and mean of the vectors, from exact sums of the upper and lower bits."""

    def work(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        return np.concatenate([(x >> LOW_BITS).sum(axis=0), (x & ((1 << LOW_BITS) - 1)).sum(axis=0), [len(x)]])

    found = [int(v) for v in _sums(rows, work, 2 * dims + 1, "long")]
    n = found[-1]
    sums = [(high << LOW_BITS) + low for high, low in zip(found[:dims], found[dims:-1], strict=True)]
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


class _Least:
    """Steps of Lanczos: a bound below the least eigenvalue, from one more column of passes that are made anyway."""

    def __init__(self, dims: int, rng: np.random.Generator) -> None:
        start = rng.standard_normal(dims)
        self.basis, self.diagonal, self.beside = [start / np.linalg.norm(start)], [], []
        self.steps = min(STEPS, dims)

    @property
    def open(self) -> bool:
        return len(self.diagonal) < self.steps and len(self.basis) > len(self.diagonal)

    def take(self, product: np.ndarray) -> None:
        last = self.basis[-1]
        self.diagonal.append(float(last @ product))
        for _ in range(2):
            for v in self.basis:
                product = product - (v @ product) * v
        self.beside.append(float(np.linalg.norm(product)))
        if self.beside[-1] > 1e-10 * max(self.diagonal[0], 1e-300):
            self.basis.append(product / self.beside[-1])

    def bound(self) -> float:
        if not self.diagonal:
            return 0.0
        values = np.linalg.eigvalsh(np.diag(self.diagonal) + np.diag(self.beside[:-1], 1) + np.diag(self.beside[:-1], -1))
        return max(0.0, float(values[0]) - self.beside[-1])


def spectrum(rows: DataFrame, mean: Centre, components: int, guard: int = 32, seed: int = 7) -> Spectrum:
    """The leading eigenpairs of the covariance of ``rows`` (column x), to double precision.

    A block of components + guard columns is filtered by a Chebyshev polynomial of the
    covariance, of degree ``DEGREE``: one pass over the vectors for each degree, the next
    term from the last two. The interval that the polynomial keeps small reaches from a
    bound below the least eigenvalue (``_Least``) to the block's least Ritz value, so
    everything above grows. Then come QR, one pass for Rayleigh-Ritz, and the residual of
    every wanted pair; it ends when all are certified. Where passes no longer help, the
    subspace doubles, up to all dimensions, where Rayleigh-Ritz is exact.
    """
    dims, rng, passes = len(mean.whole), np.random.default_rng(seed), 0
    least = _Least(dims, rng)

    def times(block: np.ndarray) -> np.ndarray:
        """Covariance times a block: X' (X Q) over centred vectors, one pass."""
        nonlocal passes
        passes += 1
        riding = least.open
        columns = np.column_stack([block, least.basis[-1]]) if riding else block

        def work(column: pa.Array) -> np.ndarray:
            x = mean.centred(column)
            return x.T @ (x @ columns)

        found = _sums(rows, work, columns.size).reshape(columns.shape) / mean.n
        if riding:
            least.take(found[:, -1])
            found = found[:, :-1]
        return found

    def filtered(block: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
        half, middle = max((high - low) / 2, 1e-12 * top), (high + low) / 2
        sigma = half / (top - middle)
        tau = 2 / sigma
        now = (times(block) - middle * block) * (sigma / half)
        for _ in range(DEGREE - 1):
            following = 1 / (tau - sigma)
            block, now = now, (times(now) - middle * now) * (2 * following / half) - (sigma * following) * block
            sigma = following
        return now

    def work(column: pa.Array) -> np.ndarray:
        return (mean.centred(column) ** 2).sum(keepdims=True)

    trace = float(_sums(rows, work, 1)[0]) / mean.n
    wanted, width = min(components, dims), min(components + guard, dims)
    if trace <= 0:
        return Spectrum(np.zeros(0), np.zeros((dims, 0)), 0.0, 0, 0.0)
    block, best = np.linalg.qr(rng.standard_normal((dims, width)))[0], math.inf
    while True:
        product = times(block)
        values, turn = np.linalg.eigh((block.T @ product + product.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        residual = float(np.linalg.norm(product - block * values, axis=0)[:wanted].max()) / values[0]
        if residual <= TOLERANCE or width == dims or residual <= FLOOR and residual > best / 4:
            kept = int((values[:wanted] > ZERO * values[0]).sum())
            return Spectrum(values[:kept], block[:, :kept], trace, passes, residual)
        if residual > best / 4:
            more = min(width, dims - width)
            block, width = np.linalg.qr(np.column_stack([block, rng.standard_normal((dims, more))]))[0], width + more
            best = math.inf
            continue
        best = residual
        high = float(values[-1])
        grown = filtered(block, min(least.bound(), high), high, float(values[0]))
        block = np.linalg.qr(grown / np.linalg.norm(grown, axis=0))[0]


def whiten(embeddings: DataFrame, components: int = 16, guard: int = 32, vector: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector along the leading eigenvectors of the covariance.

    An entry c becomes floor(64 * c) + 1,000,000. The covariance (divisor n) is that of
    the n distinct vectors, centred before multiplying: the sums are exact whole numbers,
    so a vector less the mean has the precision of its own size. See ``spectrum`` for the
    eigenvectors; all passes read one table of distinct vectors, and what comes to the
    driver is one number for each dimension and column, whatever the table holds. One
    more pass measures how far the whitened covariance is from the identity.

    Defined cases: rows whose vector is null or has an entry that is null or not finite
    are left out; shorter vectors go on with zeros (1,000,000) up to the longest; entries
    beyond 2 ** 40 count as 2 ** 40; null ids stay null; repeated rows give repeated results;
    eigenvalues that are zero in double precision have no component, so vectors that are
    all alike give no rows, nor does an empty table; among equal eigenvalues any basis of
    their space is taken; ``deviation`` is null where it is no long. Only vec_id and
    ``vector`` are read. Returns vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error.
    """
    spark = embeddings.sparkSession
    held = materialize(quantize(embeddings, vector))
    sizes = held.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    dims = sizes["most"]
    if not dims:
        return spark.createDataFrame([], WHITENED)
    if sizes["least"] < dims:
        held = held.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dims) - F.size("x"))))
    fit = materialize(held.select("x").distinct())
    mean = centre(fit, dims)
    found = spectrum(fit, mean, components, guard)
    k = len(found.values)
    if not k:
        return spark.createDataFrame([], WHITENED)
    basis, explained = found.vectors / np.sqrt(found.values), found.values / found.trace

    def products(column: pa.Array) -> np.ndarray:
        z = mean.centred(column) @ basis
        return z.T @ z

    error = float(np.abs(_sums(fit, products, k * k).reshape(k, k) / mean.n - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            steps = mean.steps(batch.column(1))
            z = (steps - mean.rest / mean.n) @ basis
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, mean.n, np.int64)),
                pa.array(mean.deviations(steps), pa.int64()).take(pa.array(each)), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.select("vec_id", "x").mapInArrow(run, WHITENED)
