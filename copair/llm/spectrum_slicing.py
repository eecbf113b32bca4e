"""Whitening of embeddings; the leading eigenpairs by spectrum slicing.

Sylvester's law: the signs of the pivots of an LDL^T factorisation of ``V - s I`` count the
eigenvalues of ``V`` above the shift ``s``.  Counts bisect the spectrum until an interval
holds the k-th largest eigenvalue alone, Rayleigh quotient iteration converges from there
cubically, and two more counts beside the result certify its number.  Eigenvalues that
rounding cannot part share an interval and get orthonormal vectors of their common space.

Spark gathers what the factorisation needs: entries become integers, equal vectors count
once, their sums are exact, and the centred products are added per task and then over
tasks; only matrices of the vectors' width reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copair.llm.common import written

#: Width of vectors up to which the covariance (8 bytes a cell) may come to the driver.
MAX_WIDTH = 2048
#: Different widths in one table, each with statistics of its own.
MAX_WIDTHS = 64
#: Share of the largest eigenvalue below which an eigenvalue counts as rounding.
_LEAST = 1e-11
_EPS = float(np.finfo(float).eps)
_SCALE, _SHIFT = 64, 1_000_000


# ---------------------------------------------------------------------------
# eigenpairs of a symmetric matrix
# ---------------------------------------------------------------------------

def inertia(m: np.ndarray) -> tuple[int, int, int]:
    """Numbers of positive, zero and negative eigenvalues of a symmetric matrix.

    LDL^T with the pivots of Bunch and Parlett (1 x 1 or 2 x 2, by the largest entries).
    """
    a = np.array(m, dtype=float)
    signs = [0, 0, 0]
    alpha = (1 + math.sqrt(17)) / 8  # their bound on the growth of entries
    zero = len(a) * _EPS * np.abs(a).max(initial=0.0) * 1e-3
    while len(a):
        diagonal = np.abs(a.diagonal())
        k = int(diagonal.argmax())
        off = np.abs(a - np.diag(a.diagonal()))
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if max(diagonal[k], off[i, j]) <= zero:
            signs[1] += len(a)
            break
        if diagonal[k] >= alpha * off[i, j]:
            order = np.r_[k, np.delete(np.arange(len(a)), k)]
            a = a[np.ix_(order, order)]
            signs[0 if a[0, 0] > 0 else 2] += 1
            column = a[1:, 0]
            a = a[1:, 1:] - np.outer(column, column / a[0, 0])
        else:  # a 2 x 2 pivot whose determinant is negative: one sign each
            order = np.r_[i, j, np.delete(np.arange(len(a)), [i, j])]
            a = a[np.ix_(order, order)]
            signs[0] += 1
            signs[2] += 1
            columns = a[2:, :2]
            a = a[2:, 2:] - columns @ np.linalg.solve(a[:2, :2], columns.T)
        a = (a + a.T) / 2
    return signs[0], signs[1], signs[2]


def count_above(v: np.ndarray, shift: float) -> int:
    return inertia(v - shift * np.eye(len(v)))[0]


def _rayleigh(v: np.ndarray, shift: float, start: np.ndarray, known: np.ndarray, low: float, high: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration beside the vectors ``known``; None if it leaves (low, high]."""
    scale = np.abs(v).sum(axis=1).max()
    out = lambda x: x - known.T @ (known @ x)
    x = out(out(start))
    x /= np.linalg.norm(x)
    best: tuple[float, float, np.ndarray] | None = None
    for step in range(60):
        # the first steps keep the interval's shift, so that the vector turns to its eigenvalue
        value = float(x @ v @ x)
        rest = float(np.linalg.norm(out(v @ x - value * x)))
        if low <= value <= high and (best is None or rest < best[0]):
            best = (rest, value, x)
        elif best is not None and rest >= best[0] and best[0] <= 64 * len(v) * _EPS * scale:
            break  # cubic convergence has reached rounding
        at = shift if step < 2 else value
        try:
            y = np.linalg.solve(v - at * np.eye(len(v)), x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(v - (at + 4 * _EPS * scale) * np.eye(len(v)), x)
        y = out(out(y))
        if not np.isfinite(y).all() or not (size := np.linalg.norm(y)):
            break
        x = y / size
    if best is None or best[0] > 1e-10 * scale:
        return None
    return best[1], best[2]


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above rounding, falling, and their unit vectors (rows)."""
    d = len(v)
    if not d or not np.abs(v).max():
        return np.empty(0), np.empty((0, d))
    v = (v + v.T) / 2
    radius = np.abs(v).sum(axis=1) - np.abs(v.diagonal())
    top = float((v.diagonal() + radius).max())  # Gershgorin
    noise = 8 * d * _EPS * top
    counts: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in counts:
            counts[s] = count_above(v, s)
        return counts[s]

    most = min(most, above(max(noise, _LEAST * float(v.diagonal().max()))))
    values, vectors = np.empty(0), np.empty((0, d))
    rng = np.random.default_rng(13)
    while len(values) < most:
        k = len(values) + 1  # eigenvalue k lies in (low, high]
        low, high = noise, top * (1 + 4 * _EPS) + noise
        for s, c in counts.items():
            if c >= k:
                low = max(low, s)
            else:
                high = min(high, s)
        # isolate: k alone in (low, high], or a cluster narrower than rounding
        while above(low) - above(high) > 1 and high - low > noise:
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= k else (low, middle)
        alone = above(low) - above(high) == 1
        found = None
        while found is None and high - low > noise / 8:
            found = _rayleigh(v, (low + high) / 2, rng.standard_normal(d), vectors, low, high)
            if found is None:  # too wide a start: halve and try again
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) >= k else (low, middle)
        if found is None:  # an interval of rounding's width: its middle is the eigenvalue
            found = _rayleigh(v, (low + high) / 2, rng.standard_normal(d), vectors, low - noise, high + noise)
        if found is None:
            raise ArithmeticError(f"no eigenvector found in ({low}, {high}]")
        value, x = found
        gap = max(noise, 4 * _EPS * abs(value))
        if alone and not (above(value - gap) >= k > above(value + gap)):
            raise ArithmeticError(f"counts beside {value} do not number it {k}")
        values, vectors = np.append(values, value), np.vstack([vectors, x])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[order]


# ---------------------------------------------------------------------------
# statistics of the vectors
# ---------------------------------------------------------------------------

@dataclass
class Whitening:
    """What one width of vectors was fitted to."""

    n: int  # distinct integer vectors
    sums: list[int]  # exact, per dimension
    values: np.ndarray  # leading eigenvalues
    vectors: np.ndarray  # their unit eigenvectors, rows
    trace: float
    identity_error: float


def usable(vec: Column) -> Column:
    """Not null, at least one entry, every entry present and finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & (F.size(vec) > 0), F.lit(False))


def as_integers(vec: Column) -> Column:
    return F.transform(vec, lambda c: F.floor(F.lit(float(_SCALE)) * c.cast("double")) + F.lit(_SHIFT))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _summed(rows: DataFrame, width: int, out: int, gram) -> np.ndarray:
    """Sum over all rows of ``gram(matrix)``, an ``out`` x ``out`` matrix: per task, then cell rows over tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((out, out))
        for batch in batches:
            if batch.num_rows:
                total += gram(_matrix(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["i", "cells"])

    parts = rows.mapInArrow(partial, "i int, cells array<double>").select("i", F.posexplode("cells").alias("j", "v"))
    m = np.zeros((out, out))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # out x out cells
        m[r.i, r.j] = r.v
    return m


def _centre(sums: list[int], n: int):
    """``x - sums / n`` of integer matrices: an exact difference from the nearest integers first."""
    base = [round(s / n) for s in sums]
    rest = np.array([(s - n * b) / n for s, b in zip(sums, base)])
    whole = np.array(base, dtype=np.int64)
    return lambda x: (x - whole).astype(float) - rest


def fit(distinct: DataFrame, width: int, components: int = 16) -> Whitening | None:
    """Statistics of ``distinct(x array<long>)``, vectors of one width, each once; None without any."""
    if width > MAX_WIDTH:
        raise ValueError(f"vectors of {width} entries; at most {MAX_WIDTH}")
    cells = distinct.select(F.posexplode("x").alias("j", "x")).groupBy("j").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    if not cells:
        return None
    n = cells[0].n
    sums = [0] * width
    for r in cells:
        sums[r.j] = int(r.s)
    centred = _centre(sums, n)

    def products(x: np.ndarray) -> np.ndarray:
        u = centred(x)
        return u.T @ u

    v = _summed(distinct, width, width, products) / n
    values, vectors = leading(v, components)
    k = len(values)

    def white_products(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ vectors.T / np.sqrt(values)
        one = np.ones((len(w), 1))
        return np.hstack([w, one]).T @ np.hstack([w, one])

    error = 0.0
    if k:
        g = _summed(distinct, width, k + 1, white_products) / n
        error = float(np.abs(g[:k, :k] - np.outer(g[:k, k], g[:k, k]) - np.eye(k)).max())
    return Whitening(n, sums, values, vectors, float(np.trace(v)), error)


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row per vector and component.

    Vectors that are null or empty or hold null or non-finite entries drop out.  Each entry c
    becomes floor(64 c) + 1000000; each distinct vector counts once in the statistics, and
    repeated rows are all returned.  Vectors of different widths are whitened apart.
    ``deviation``, the sum over dimensions of (n x - S)^2, is an exact decimal(38, 0) (null
    beyond it).  Components whose eigenvalue is nothing but rounding do not occur, so fewer
    than ``components`` come back if the vectors span fewer dimensions; a single distinct
    vector has none.  Entries of 2^57 or more in size are an error.  Other columns are not read; an empty table gives no rows.
    """
    x = written(rows.where(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), as_integers(F.col(vec_col)).alias("x")))
    distinct = written(x.select("x").distinct())
    widths = [r[0] for r in distinct.select(F.size("x")).distinct().limit(MAX_WIDTHS + 1).collect()]
    if len(widths) > MAX_WIDTHS:
        raise ValueError(f"vectors of more than {MAX_WIDTHS} widths")
    schema = ("id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    out = None
    for width in sorted(widths):
        of_width = F.size("x") == width
        model = fit(distinct.where(of_width), width, components)
        one = x.where(of_width).select("id", "x").mapInArrow(_projector(model, width), schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.sparkSession.createDataFrame([], schema)


def _projector(model: Whitening, width: int):
    centred = _centre(model.sums, model.n)
    k = len(model.values)
    back = model.vectors.T / np.sqrt(model.values)
    explained = model.values / model.trace if k else model.values

    def deviations(x: np.ndarray) -> list[int | None]:
        most = max(abs(int(x.max())), abs(int(x.min()))) * model.n + max(map(abs, model.sums))
        if width * most * most < 1 << 63:  # exact in 64 bits
            u = model.n * x - np.array(model.sums, dtype=np.int64)
            return (u * u).sum(axis=1).tolist()
        sums = np.array(model.sums, dtype=object)
        u = model.n * x.astype(object) - sums
        return [d if d < 10 ** 38 else None for d in (u * u).sum(axis=1)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column("x"), width)
            rows = len(x)
            white = centred(x) @ back
            each = pa.array(np.repeat(np.arange(rows), k))
            dev = pa.array([d if d is None else Decimal(d) for d in deviations(x)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, model.n)), dev.take(each), pa.array(white.ravel()),
                 pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, model.identity_error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return project
