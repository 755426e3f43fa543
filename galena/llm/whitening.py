"""Whitening of embeddings by an incremental eigendecomposition.

Each partition keeps the spectrum (mean, eigenvalues, eigenvectors) of the scatter of its vectors and takes in one vector
after the other as a centred rank-one update: the new eigenvalues are the roots of a secular equation, and what the
update does not touch is deflated. Spectra are combined in rounds of a few to a task, each pair of one as a rank-one
update of the other and the difference of their means as one more. The spectrum of all is refined once: the covariance
within its vectors is summed up over all rows and its small eigenproblem solved (Rayleigh-Ritz).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from galena.llm.shared import batches, dropped, free_name, small_batches, tidy, written

EPS = np.finfo(float).eps
#: Entries become floor(SCALE * entry) + OFFSET. OFFSET leaves no trace in what is centred, so it is left out in sums.
SCALE, OFFSET = 64, 1_000_000
#: States (spectra, small matrices) that one task combines.
FAN = 16


class Spectrum:
    """Count, mean, and ascending eigenvalues and eigenvectors (columns) of the scatter of centred vectors."""

    def __init__(self, mean: np.ndarray, n: float = 0, values: np.ndarray | None = None, vectors: np.ndarray | None = None):
        self.n, self.mean = n, np.array(mean, float)
        self.values = np.zeros(len(mean)) if values is None else np.array(values, float)
        self.vectors = np.eye(len(mean)) if vectors is None else np.array(vectors, float)

    def take(self, x: np.ndarray, weight: float = 1) -> None:
        """Takes a vector in, `weight` times."""
        away = x - self.mean
        self.raised(away, self.n * weight / (self.n + weight))
        self.n += weight
        self.mean += away * (weight / self.n)

    def merge(self, other: Spectrum) -> None:
        if not self.n:
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.raised(vector, max(value, 0.0))
        away = other.mean - self.mean
        self.raised(away, self.n * other.n / (self.n + other.n))
        self.n += other.n
        self.mean += away * (other.n / self.n)

    def raised(self, v: np.ndarray, rho: float) -> None:
        """The spectrum after rho * v v^T was added."""
        size = math.sqrt(float(v @ v))
        if rho <= 0 or size == 0:
            return
        z, rho = self.vectors.T @ (v / size), rho * size * size
        most = max(abs(self.values[-1]), abs(self.values[0]), rho)
        live = np.flatnonzero(rho * np.abs(z) > 8 * EPS * most)  # the rest is as it was
        if len(live) > 1:
            live = self.parted(live, z, 8 * EPS * most, rho)
        d, y = self.values[live], z[live]
        if len(live) == 1:
            self.values[live] = d + rho * y * y
        elif len(live):
            roots, turn = secular(d, y, rho)
            self.values[live] = roots
            self.vectors[:, live] = self.vectors[:, live] @ turn
        order = np.argsort(self.values, kind="stable")
        self.values, self.vectors = self.values[order], self.vectors[:, order]

    def parted(self, live: np.ndarray, z: np.ndarray, tol: float, rho: float) -> np.ndarray:
        """Deflates eigenvalues that are next to equal: a rotation of their two vectors leaves the update in one of them."""
        d, y = self.values[live], z[live]
        gap = np.diff(d) * np.abs(y[1:] * y[:-1]) / (y[1:] ** 2 + y[:-1] ** 2)
        if not (gap <= tol).any():
            return live
        kept, last = [], live[0]
        for i in live[1:]:
            r = math.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            if (self.values[i] - self.values[last]) * abs(c * s) <= tol:
                low, high = self.vectors[:, last].copy(), self.vectors[:, i]
                self.vectors[:, last], self.vectors[:, i] = c * low - s * high, s * low + c * high
                low_value, high_value = self.values[last], self.values[i]
                self.values[last], self.values[i] = c * c * low_value + s * s * high_value, s * s * low_value + c * c * high_value
                z[last], z[i] = 0.0, r
            else:
                kept.append(last)
            last = i
        kept.append(last)
        return np.array([i for i in kept if rho * abs(z[i]) > tol])


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho * z z^T for rising d, no z of 0 and rho > 0.

    All roots are found side by side, each as a distance from its nearer pole: a rational interpolation of both sides of
    the equation, kept within a bracket that halves where the interpolation leaves it. The vectors are those of the z for
    which the roots that were found are exact, which keeps them orthogonal.
    """
    k, square = len(d), rho * z * z
    upper = np.append(d[1:], d[-1] + square.sum())
    half = (upper - d) / 2
    apart = d[:, None] - d[None, :]
    at_half = 1 + (square[:, None] / (apart - half)).sum(0)
    right = at_half < 0
    right[-1] = False
    base = np.where(right, upper, d)
    gaps = d[:, None] - base[None, :]
    low, high = np.where(right, -half, 0.0), np.where(right, 0.0, np.append(half[:-1], 2 * half[-1]))
    tau = (low + high) / 2
    below = np.arange(k)[:, None] <= np.arange(k)[None, :]
    near, far = d - base, upper - base
    for _ in range(80):
        part = gaps - tau
        term = square[:, None] / part
        f = 1 + term.sum(0)
        slope = term / part
        psi = np.where(below, slope, 0.0).sum(0)
        phi = slope.sum(0) - psi
        low, high = np.where(f < 0, tau, low), np.where(f < 0, high, tau)
        x, y = near - tau, far - tau
        a, b, c = (x + y) * f - x * y * (psi + phi), x * y * f, f - x * psi - y * phi
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = tau + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
        settled = (np.abs(new - tau) <= 2 * EPS * np.abs(new)) | (np.abs(f) <= EPS * (1 + np.abs(term).sum(0)))
        tau = np.where(settled, tau, new)
        if settled.all():
            break
    part = gaps - tau
    apart[np.arange(k), np.arange(k)] = -1.0
    exact = np.sqrt(np.abs(np.prod(part / -apart.T, axis=1)))
    turn = (np.copysign(exact, z)[:, None]) / part
    return base + tau, turn / np.sqrt((turn * turn).sum(0))


def combined(states: DataFrame, merge: Callable[[dict, dict], dict], name: str) -> Row | None:
    """The one state that merge makes of all rows, FAN or so to a task in each round; None if there are no rows."""
    states = written(states, name)
    schema = states.schema
    arrow = None
    count = states.count()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kind = None, arrow
        for b in batches(frames):
            kind = b.schema
            for row in b.to_pylist():
                own = row if own is None else merge(own, row)
        if own is not None:
            yield pa.RecordBatch.from_pylist([own], kind)

    while count > 1:
        fewer = written(states.repartition(math.ceil(count / FAN)).mapInArrow(run, schema), name)
        dropped(states)
        states, count = fewer, fewer.count()
    return states.first()


def whole(x: np.ndarray, each: int) -> list[int]:
    """Sums of the columns of whole numbers, exactly."""
    if not len(x):
        return [0] * each
    most = int(np.abs(x).max())
    return [int(v) for v in (x.sum(axis=0) if most * len(x) < 2**62 else x.astype(object).sum(axis=0))]


def scaled(vectors: pa.Array, d: int) -> np.ndarray:
    """floor(SCALE * entry) of the rows as 64-bit whole numbers, without OFFSET."""
    x = np.floor(SCALE * vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d))
    if np.abs(x).max(initial=0) > 2**62:
        raise OverflowError("an entry is too large for a 64-bit whole number")
    return x.astype(np.int64)


def spectra(own: DataFrame, d: int) -> DataFrame:
    """A state for each partition: n, sums (exact, without OFFSET), and the spectrum of its rows' scatter."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, sums = None, 0, [0] * d
        for b in batches(frames):
            x = scaled(b.column("vec"), d)
            n, sums = n + len(x), [s + v for s, v in zip(sums, whole(x, d), strict=True)]
            rows, times = np.unique(x, axis=0, return_counts=True)  # copies are one update of their weight
            held = held or Spectrum(rows[0])
            for row, weight in zip(rows.astype(float), times.tolist(), strict=True):
                held.take(row, weight)
        if held is not None:
            exact = pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0)))
            reals = [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in (held.mean, held.values, held.vectors)]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), exact, *reals], names=["n", "sums", "mean", "e", "vectors"])

    return own.mapInArrow(run, "n bigint, sums array<decimal(38,0)>, mean array<double>, e array<double>, vectors array<double>")


def spectrum_of(state: dict) -> Spectrum:
    d = len(state["mean"])
    return Spectrum(state["mean"], state["n"], state["e"], np.array(state["vectors"]).reshape(d, d))


def merge_spectra(a: dict, b: dict) -> dict:
    one = spectrum_of(a)
    one.merge(spectrum_of(b))
    sums = [x + y for x, y in zip(a["sums"], b["sums"], strict=True)]
    return {"n": a["n"] + b["n"], "sums": sums, "mean": one.mean.tolist(), "e": one.values.tolist(), "vectors": one.vectors.ravel().tolist()}


class Fit:
    """What rows are projected by: n, exact sums, and a matrix."""

    def __init__(self, n: int, sums: list[int], matrix: np.ndarray):
        self.n, self.sums, self.matrix = n, sums, matrix
        self.base = [s // n for s in sums]  # a whole number near the mean: what is left is small, so doubles hold it
        self.rest = np.array([(s - b * n) / n for s, b in zip(sums, self.base, strict=True)])

    def projected(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.base, np.int64)).astype(float) - self.rest) @ self.matrix

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) squared, exactly."""
        near, left = x - np.array(self.base, np.int64), [s - b * self.n for s, b in zip(self.sums, self.base, strict=True)]
        if (int(np.abs(near).max(initial=0)) + 1) ** 2 * self.n**2 * len(left) < 2**62:
            return ((near * self.n - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
        return [int(v) for v in ((near.astype(object) * self.n - np.array(left, dtype=object)) ** 2).sum(axis=1)]


def covariance(own: DataFrame, fit: Fit, d: int, name: str) -> np.ndarray:
    """The covariance (divisor n) of what all rows project to. Blocks of rows are centred at the mean of all by the fit;
    the mean of what is projected, which is rounding alone, is taken off at the end."""
    shared, k = own.sparkSession.sparkContext.broadcast(fit), fit.matrix.shape[1]  # d * k numbers

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = np.zeros((k, k)), np.zeros(k), 0
        for b in batches(frames):
            y = shared.value.projected(scaled(b.column("vec"), d))
            total, sums, n = total + y.T @ y, sums + y.sum(axis=0), n + len(y)
        if n:
            yield pa.RecordBatch.from_pylist([{"n": n, "sums": sums.tolist(), "total": total.ravel().tolist()}])

    def add(a: dict, b: dict) -> dict:
        return {"n": a["n"] + b["n"], "sums": np.add(a["sums"], b["sums"]).tolist(), "total": np.add(a["total"], b["total"]).tolist()}

    row = combined(own.mapInArrow(run, "n bigint, sums array<double>, total array<double>"), add, name)
    mean = np.array(row.sums) / row.n
    return np.array(row.total).reshape(k, k) / row.n - np.outer(mean, mean)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """A row for each vector and component: key, component (from 1, by falling eigenvalue), n, deviation (decimal(38,0),
    exact), whitened, explained, identity_error.

    Rows whose vector is null, shorter than the longest one, or holds null or non-finite entries are left out; all others
    are fitted and projected, repeated ones as often as they are there, under whatever key. Components are unit vectors
    whose largest entry is positive. A component of no variance (fewer distinct vectors than dimensions) has a null in
    whitened and is left out of identity_error. A table without vectors gives no rows. Other columns are not looked at.
    """
    spark = df.sparkSession
    small_batches(spark)
    tidy(spark)
    own = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    own = own.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    d = own.agg(F.max(F.size("vec"))).first()[0]
    named = [key, *(free_name(df.select(key), c) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error"))]
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if d is None:
        return spark.createDataFrame([], schema).toDF(*named)
    own = own.where(F.size("vec") == d)
    state = combined(spectra(own.select("vec"), d), merge_spectra, "spectra")
    sums = [int(s) for s in state.sums]
    basis = np.linalg.qr(np.array(state.vectors).reshape(d, d))[0]
    values, turn = np.linalg.eigh(covariance(own.select("vec"), Fit(state.n, sums, basis), d, "ritz"))
    k = min(most, d)
    values, vectors = values[::-1], (basis @ turn)[:, ::-1]
    total = float(values.sum())
    e, vectors = values[:k], vectors[:, :k] * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])[:k]
    live = e > max(total, 0.0) * d * EPS * 16
    fit = Fit(state.n, sums, vectors / np.where(live, np.sqrt(np.where(live, e, 1.0)), 1.0))
    error = np.abs(covariance(own.select("vec"), fit, d, "identity") - np.eye(k))[np.ix_(live, live)].max(initial=0.0)
    explained = e / total if total > 0 else np.zeros(k)
    shared = spark.sparkContext.broadcast((fit, live, np.maximum(explained, 0.0), float(error)))  # d * k numbers

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_fit, has, share, wrong = shared.value
        for b in batches(frames):
            x = scaled(b.column("vec"), d)
            rows = len(x)
            kept = np.repeat(np.arange(rows), k)
            exact = pa.array([Decimal(v) for v in own_fit.deviation(x)], pa.decimal128(38, 0))
            white = own_fit.projected(x).ravel()
            yield pa.RecordBatch.from_arrays([
                b.column("key").take(pa.array(kept)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, own_fit.n, np.int64)), exact.take(pa.array(kept)),
                pa.array(white, mask=~np.tile(has, rows)), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, wrong)),
            ], names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(run, schema).toDF(*named)
