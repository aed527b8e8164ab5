"""Whitening of embeddings by a bidiagonal qd solver.

A component c becomes the whole number x = floor(64 c) + 1000000. One pass sums x exactly; a second reduces the centred rows
block by block to triangular factors (QR), which are joined in groups until one is left; its singular values are those of the
centred rows. On this factor, which is as small as the vectors' dimension: Householder reflections give a bidiagonal matrix,
the shifted differential quotient-difference transform (dqds) its singular values to high relative accuracy, and twisted
factorisations a direction for each. Directions whose values agree to a millionth are found by inverse iteration with
the same factorisations, each kept orthogonal to those before. A third pass measures the covariance of the whitened rows,
the fourth returns them.

Nothing is shuffled but factors and sums; a pass needs a block of rows at a time. Hot groups do not exist.

Defined results: rows whose vector is null, holds null or non-finite entries, or entries of 2**40 or more in size, are dropped,
as are vectors of another length than most have. Null ids stay; repeated rows count as often as they occur; other columns are
not read. Components without variance (beyond rounding) are not returned. A deviation too large for a long is null. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoledger.llm.memory import tidy
from geoledger.llm.vectors import common_length, matrix
from geoledger.session import cut

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LIMIT = float(1 << 40)
BLOCK_ROWS = 4096
JOINED_BYTES = 64 << 20  # factors that one group joins
EPS = float(np.finfo(np.float64).eps)
CLOSE = 1e-6


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


@dataclass
class Moments:
    """Number of rows, sums of each dimension, and the mean as a whole and a fractional part."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.floor = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([s % self.n for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)**2, exactly; null where it exceeds a long."""
        away = x - self.floor
        if len(x) and float(np.abs(away).max() + 1) ** 2 * float(self.n) ** 2 * x.shape[1] < 2.0**62:
            return pa.array(((self.n * away - self.rest) ** 2).sum(axis=1))
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest.tolist())) for row in away.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def moments(df: DataFrame, dimension: int) -> Moments | None:
    """Exact sums; one row for each dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(matrix(batch, dimension, LIMIT)[1])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dimension), pa.int32()), pa.array(np.append(len(x), x.sum(axis=0)))], names=["i", "s"])

    rows = df.select("embedding").mapInArrow(tidy(run), "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r.i: int(r.s) for r in rows}
    return Moments(sums[-1], [sums[i] for i in range(dimension)]) if sums else None


def triangular_factor(df: DataFrame, dimension: int, m: Moments) -> np.ndarray:
    """The triangular factor of all centred rows. Tasks reduce their rows block by block; groups of factors are joined."""

    def reduced(blocks: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack(blocks), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.zeros((0, dimension))
        for batch in batches:
            x = m.centred(whole_numbers(matrix(batch, dimension, LIMIT)[1]))
            for low in range(0, len(x), BLOCK_ROWS):
                factor = reduced([factor, x[low:low + BLOCK_ROWS]])
        if len(factor):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([factor.tobytes()], pa.binary())], names=["k", "factor"])

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        factor = reduced([np.frombuffer(f).reshape(-1, dimension) for f in part["factor"]])
        return pd.DataFrame({"k": [int(part["g"].iloc[0])], "factor": [factor.tobytes()]})

    group = max(2, JOINED_BYTES // (dimension * dimension * 8))
    factors = cut(df.select("embedding").mapInArrow(tidy(run), "k long, factor binary"))
    while factors.agg(F.max("k")).first()[0] > 0:
        factors = cut(factors.withColumn("g", F.floor(F.col("k") / group)).groupBy("g").applyInPandas(join, "k long, factor binary"))
    return np.frombuffer(factors.first().factor).reshape(-1, dimension)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal, and the orthogonal V with r = U B V'."""
    d = r.shape[1]
    work = np.zeros((max(d, len(r)), d))
    work[: len(r)] = r
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        norm = float(np.linalg.norm(x))
        if norm == 0:
            return np.zeros_like(x), 0.0
        h = x.copy()
        target = -norm if x[0] > 0 else norm
        h[0] -= target
        size = np.linalg.norm(h)
        return (h / size if size else h), target

    a, b = np.zeros(d), np.zeros(max(d - 1, 0))
    for j in range(d):
        h, a[j] = reflector(work[j:, j])
        work[j:, j:] -= 2 * np.outer(h, h @ work[j:, j:])
        if j < d - 1:
            h, b[j] = reflector(work[j, j + 1:])
            work[j:, j + 1:] -= 2 * np.outer(work[j:, j + 1:] @ h, h)
            v[:, j + 1:] -= 2 * np.outer(v[:, j + 1:] @ h, h)
    return a, b, v


def _transform(q: list[float], e: list[float], low: int, high: int, shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds step on q[low..high], e[low..high-1]; the third list holds the intermediate d, negative ones if the shift is too large."""
    new_q, new_e, ds = [], [], []
    d = q[low] - shift
    ds.append(d)
    for i in range(low, high):
        s = d + e[i]
        if s == 0.0:
            new_q.append(0.0)
            new_e.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / s
            new_q.append(s)
            new_e.append(e[i] * t)
            d = d * t - shift
        ds.append(d)
        if d < 0 and i < high - 1:  # far from the end: this shift teaches nothing
            break
    new_q.append(d)
    return new_q, new_e, ds


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, largest first, by dqds with deflation."""
    scale = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if scale == 0:
        return np.zeros(len(a))
    q, e = ((a / scale) ** 2).tolist(), ((b / scale) ** 2).tolist()
    out, blocks, tolerance = [], [(0, len(q) - 1, 0.0)], (2 * EPS) ** 2
    while blocks:
        low, high, sigma = blocks.pop()
        least, steps = 0.0, 0  # the least d of the last step bounds the least value from above
        while high > low:
            if e[high - 1] <= tolerance * (sigma + q[high]):
                out.append(sigma + q[high])
                high, least = high - 1, 0.0
                continue
            split = next((i for i in range(high - 2, low - 1, -1) if e[i] <= tolerance * (sigma + min(q[i], q[i + 1]))), None)
            if split is not None:
                blocks.append((low, split, sigma))
                low, least = split + 1, 0.0
                continue
            steps += 1
            if steps > 200 * (len(q) + 1):
                raise ArithmeticError("the qd iteration does not settle")
            shift = least
            while True:
                new_q, new_e, ds = _transform(q, e, low, high, shift)
                if len(ds) == high - low + 1 and min(ds) >= 0:
                    break
                late = (shift + ds[-1]) * (1 - 4 * EPS) if len(ds) == high - low + 1 and min(ds[:-1]) >= 0 else 0.0
                shift = late if 0.5 * shift < late < shift else 0.75 * shift  # a failure at the very end gives a close lower bound
                if shift < EPS * least:
                    shift = 0.0
            q[low:high + 1], e[low:high], sigma, least = new_q, new_e, sigma + shift, min(ds)
        out.append(sigma + q[low])
    return np.sort(np.array(out))[::-1] * scale**2


def _twisted(diagonal: np.ndarray, lower: np.ndarray, value: float) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Twisted factorisation of L D L' - value: twist index, multipliers above and below it, pivots above and below, pivot there."""
    n, tiny = len(diagonal), EPS * EPS * float(np.abs(diagonal).max())
    d, l = diagonal.tolist(), lower.tolist()
    held = lambda x: x if abs(x) > tiny else tiny
    s, down, up_l, up_d = [-value], [], [], []
    for i in range(n - 1):
        pivot = held(s[i] + d[i])
        m = d[i] * l[i] / pivot
        up_d.append(pivot)
        up_l.append(m)
        s.append(m * l[i] * s[i] - value)
    p, low_d, low_u = [0.0] * n, [0.0] * n, [0.0] * n
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = held(d[i] * l[i] * l[i] + p[i + 1])
        t = d[i] / pivot
        low_d[i + 1], low_u[i] = pivot, l[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.abs(np.array(s) + np.array(p) + value)
    r = int(np.argmin(gamma))
    return r, np.array(up_l), np.array(low_u), np.array(up_d), np.array(low_d), held(s[r] + p[r] + value)


def _direction(diagonal: np.ndarray, lower: np.ndarray, value: float) -> np.ndarray:
    """The vector that solves the twisted factors for the unit vector at the twist."""
    r, up, down, _, _, _ = _twisted(diagonal, lower, value)
    z = np.zeros(len(diagonal))
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(r, len(z) - 1):
        z[i + 1] = -down[i] * z[i]
        if abs(z[i + 1]) > 1e150:
            z /= abs(z[i + 1])
    return z / np.linalg.norm(z)


def _solve(factors: tuple, x: np.ndarray) -> np.ndarray:
    """Solve with the twisted factors: towards the twist, divide by the pivots, and back."""
    r, up, down, up_d, low_d, pivot = factors
    y = x.copy()
    for i in range(r):
        y[i + 1] -= up[i] * y[i]
    for i in range(len(y) - 1, r, -1):
        y[i - 1] -= down[i - 1] * y[i]
    y[:r] /= up_d[:r]
    y[r + 1:] /= low_d[r + 1:]
    y[r] /= pivot
    for i in range(r - 1, -1, -1):
        y[i] -= up[i] * y[i + 1]
    for i in range(r, len(y) - 1):
        y[i + 1] -= down[i] * y[i]
    return y


def singular_pairs(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest squared singular values of a bidiagonal matrix and their right vectors (columns)."""
    norm = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    a, b = a.copy(), b.copy()
    for i in range(len(b)):  # rotations of rows clear the row of a vanished diagonal entry
        if abs(a[i]) > EPS * norm:
            continue
        spill, a[i], b[i] = b[i], 0.0, 0.0
        for k in range(i + 1, len(a)):
            size = np.hypot(a[k], spill)
            if size == 0:
                break
            cosine, sine, a[k] = a[k] / size, spill / size, size
            if k < len(b):
                spill, b[k] = -sine * b[k], cosine * b[k]
    cuts = np.flatnonzero(np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:]))) + 1 if len(b) else np.zeros(0, dtype=int)
    found = []  # (value, first index, last index) of each unconnected part
    for low, high in zip([0, *cuts], [*cuts, len(a)]):
        found += [(v, low, high) for v in squared_singular_values(a[low:high], b[low:high - 1])]
    found.sort(key=lambda f: (-f[0], f[1]))
    values, vectors = [], []
    random = np.random.default_rng(0)
    for value, low, high in found[:count]:
        diagonal = np.where(np.abs(a[low:high]) > EPS * norm, a[low:high], EPS * norm)
        lower = b[low:high - 1] / diagonal[:-1]
        near = [z[low:high] for v, z, part in zip(values, vectors, found) if part[1] == low and abs(v - value) <= CLOSE * max(v, value)]
        z = _direction(diagonal**2, lower, value)
        if near:
            held, factors = np.array(near), _twisted(diagonal**2, lower, value)
            z = random.standard_normal(high - low)
            for _ in range(4):
                z -= held.T @ (held @ z)
                z = _solve(factors, z / np.linalg.norm(z))
                z /= np.linalg.norm(z)
            for _ in range(2):
                z -= held.T @ (held @ z)
                z /= np.linalg.norm(z)
        whole = np.zeros(len(a))
        whole[low:high] = z
        values.append(value)
        vectors.append(whole)
    return np.array(values), np.array(vectors).T.reshape(len(a), len(values))


@dataclass
class Whitener:
    """What a pass over rows needs: the moments, the projections (dimension x components) and the explained shares."""

    moments: Moments
    projection: np.ndarray
    explained: np.ndarray


def fit(df: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Fit on all usable rows; null without any."""
    dimension = common_length(df)
    m = moments(df, dimension) if dimension else None
    if m is None:
        return None
    r = triangular_factor(df, dimension, m)
    a, b, v = bidiagonal(r)
    values, z = singular_pairs(a, b, min(components, dimension))
    kept = values > (16 * dimension * EPS) ** 2 * values.max(initial=0)
    values, directions = values[kept], v @ z[:, kept]
    largest = directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])]
    directions = directions * np.sign(largest)  # either sign is right; this one is always the same
    return Whitener(m, directions / np.sqrt(values / m.n), values / float((r * r).sum()))


def identity_error(df: DataFrame, w: Whitener) -> float:
    """Largest difference between the covariance of the whitened rows and the identity, measured over all rows."""
    d, k = w.projection.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y = w.moments.centred(whole_numbers(matrix(batch, d, LIMIT)[1])) @ w.projection
            total += y.sum(axis=0)
            products += y.T @ y
        flat = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "s"])

    rows = df.select("embedding").mapInArrow(tidy(run), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # k (k + 1) rows
    flat = np.zeros(k + k * k)
    for r in rows:
        flat[r.i] = r.s
    mean = flat[:k] / w.moments.n
    return float(np.abs(flat[k:].reshape(k, k) / w.moments.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component."""
    w = fit(df, components)
    if w is None or not w.projection.shape[1]:
        return df.sparkSession.createDataFrame([], _OUT)
    error = identity_error(df, w)
    d, k = w.projection.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = matrix(batch, d, LIMIT)
            ids = batch.column("vec_id").cast(pa.int64())
            for low in range(0, len(rows), BLOCK_ROWS):
                x = whole_numbers(values[low:low + BLOCK_ROWS])
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows[low:low + BLOCK_ROWS])).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(each), w.moments.n)), w.moments.deviations(x).take(each),
                     pa.array((w.moments.centred(x) @ w.projection).ravel()), pa.array(np.tile(w.explained, len(x))),
                     pa.array(np.full(len(each), error))], names=[f.split()[0] for f in _OUT.split(", ")])

    return df.select("vec_id", "embedding").mapInArrow(tidy(run), _OUT)
