"""Whitening of embeddings by spectrum slicing.

The covariance V of the distinct vectors is summed over the partitions (centred with the exact means
first). The number of negative pivots of V - s = L D Lᵀ is the number of eigenvalues below s, so
bisection on that count isolates each leading eigenvalue in a slice of its own; Rayleigh quotient
iteration started in the slice converges cubically to its unit eigenvector, and the counts on both sides of the
result certify its number. Slices that can't be divided hold equal eigenvalues (to double
precision); they get an orthonormal basis of their common space.

The driver holds V (dimension squared) and 16 eigenvectors, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Scaled components are held within this size, so that sums and differences stay within Python's and numpy's longs.
LIMIT = 1 << 52
#: Eigenvalues below this share of the largest are rounding noise: such directions hold no variance.
NOISE = 1e-12


def negative_pivots(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix: the negative pivots of its LDLᵀ factors, with 1x1 and
    2x2 pivots chosen as by Bunch and Kaufman."""
    a, count, k = a.copy(), 0, 0
    alpha = (1 + 17**0.5) / 8
    while k < len(a):
        column = np.abs(a[k + 1 :, k])
        most = column.max(initial=0.0)
        two = False
        if abs(a[k, k]) < alpha * most:
            r = k + 1 + int(column.argmax())
            other = max(np.abs(a[r, k:r]).max(initial=0.0), np.abs(a[r + 1 :, r]).max(initial=0.0))
            if abs(a[k, k]) * other < alpha * most**2:
                two = abs(a[r, r]) < alpha * other
                at = k + 1 if two else k
                a[[at, r]] = a[[r, at]]
                a[:, [at, r]] = a[:, [r, at]]
        if two:
            count += 1 if (det := a[k, k] * a[k + 1, k + 1] - a[k + 1, k] ** 2) < 0 else 2 * (a[k, k] < 0)
            pair = a[k : k + 2, k : k + 2]
            if det:
                rest = a[k + 2 :, k : k + 2]
                a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(pair, rest.T)
            k += 2
        else:
            if a[k, k]:
                count += a[k, k] < 0
                rest = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(rest, rest) / a[k, k]
            k += 1
    return int(count)


def above(v: np.ndarray, s: float) -> int:
    """Eigenvalues of v above s."""
    return negative_pivots(s * np.eye(len(v)) - v)


def slices(v: np.ndarray, k: int) -> list[tuple[float, float, int, int]]:
    """(low, high, first, last): intervals, from the top, that hold the eigenvalues numbered first to last
    alone, down to number k. An interval holds several only if it is too narrow to divide."""
    top = float(np.abs(v).sum(axis=1).max(initial=0.0)) * (1 + 1e-12)
    if top == 0:
        return []
    low = NOISE * top
    todo, out = [(low, top * 1.0000001, above(v, low), 0)], []
    while todo:
        low, high, n_low, n_high = todo.pop()
        if n_low == n_high or n_high >= k:
            continue
        if n_low - n_high == 1 and high - low <= 0.05 * high or high - low <= 1e-13 * top:
            out.append((low, high, n_high + 1, n_low))
            continue
        middle = (low + high) / 2
        n = above(v, middle)
        todo += [(low, middle, n_low, n), (middle, high, n, n_high)]  # the upper half comes next
    return out


def _solve(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    """A unit vector along (v - shift)^-1 x."""
    for nudge in (0.0, 1e-15, 1e-13):
        try:
            y = np.linalg.solve(v - shift * (1 + nudge) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and (size := np.linalg.norm(y)):
            return y / size
    return x


def rayleigh(v: np.ndarray, low: float, high: float, known: list[np.ndarray], seed: int) -> tuple[float, np.ndarray]:
    """The eigenpair in (low, high): inverse iteration with the middle as its shift, then Rayleigh quotients."""
    x = np.random.default_rng(seed).normal(size=len(v))
    clear = lambda y: y - sum((b * (b @ y) for b in known), np.zeros(len(v)))
    for _ in range(3):
        x = clear(_solve(v, (low + high) / 2, clear(x)))
        x /= np.linalg.norm(x)
    rho, best = x @ v @ x, None
    for _ in range(60):
        gap = np.linalg.norm(v @ x - rho * x)
        if best is not None and gap >= best[0]:
            break
        best = (gap, rho, x)
        shift = rho if low <= rho <= high else (low + high) / 2
        x = clear(_solve(v, shift, x))
        x /= np.linalg.norm(x)
        rho = x @ v @ x
    return best[1], best[2]


def leading(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues above the noise, falling, and their unit eigenvectors (as rows)."""
    values, vectors = [], []
    top = float(np.abs(v).sum(axis=1).max(initial=0.0))
    todo = slices(v, k)[::-1]
    while todo:
        low, high, first, last = todo.pop()
        if first > k:
            break
        if first == last:
            e, x = rayleigh(v, low, high, vectors, first)
            slack = max(np.linalg.norm(v @ x - e * x) * 2, 1e-14 * top)
            if not (above(v, e + slack) == first - 1 and above(v, e - slack) >= first):  # not the one asked for: halve its slice
                if high - low > 1e-13 * top:
                    middle = (low + high) / 2
                    todo.append((middle, high, first, last) if above(v, middle) >= first else (low, middle, first, last))
                    continue
            values.append(e)
            vectors.append(x)
            continue
        for number in range(first, min(last, k) + 1):  # equal eigenvalues: one vector after the other, each square to the rest
            e, x = rayleigh(v, low, high, vectors, number)
            values.append(e)
            vectors.append(x)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(len(values), len(v))[order]


def _integers(vectors, dim: int) -> np.ndarray:
    out = np.full((len(vectors), dim), SHIFT, np.int64)
    for i, x in enumerate(vectors):
        out[i, : len(x)] = x
    return out


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, from n*x - S by whole numbers."""
    middle = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - middle).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2, exact; None beyond a long."""
    middle, rest = [s // n for s in sums], [s % n for s in sums]
    d = x - np.array(middle, np.int64)
    size = int(np.abs(d).max(initial=0)) + 1
    if x.shape[1] * (size * n) ** 2 < 2**63:
        y = d * n - np.array(rest, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = d.astype(object) * n - np.array(rest, object)
    return [total if (total := int(row)) < 2**63 else None for row in (y * y).sum(axis=1)]


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; shorter vectors count as if 0
    filled them up. Every other row stays, also with a null or repeated vec_id. The fit uses each
    distinct vector once. Components without variance (fewer distinct vectors than components,
    constant dimensions) give no rows; neither does an empty table. Entries beyond 2**52 after
    scaling count as that; a deviation beyond a long is null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long") + SHIFT)
    rows = checkpointed(vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x")))
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dim) - F.size("x")))
    fit = checkpointed(rows.select(filled.alias("x")).distinct())
    few = fit.coalesce(4 * spark.sparkContext.defaultParallelism)  # partial sums are as large as V: few of them

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(dim, object)
        for frame in frames:
            x = _integers(frame["x"], dim)
            n += len(x)
            total = total + (x >> 26).sum(axis=0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
        if n:
            yield pd.DataFrame({"d": range(dim), "n": n, "s": [str(t) for t in total]})

    totals = few.mapInPandas(sums, "d int, n long, s string").groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()
    if not totals:
        return spark.createDataFrame([], RESULT)
    n, s = totals[0]["n"], [int(r["s"]) for r in totals]

    def products(frames: Iterator[pd.DataFrame], project: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            z = _centred(_integers(frame["x"], dim), n, s)
            z = z if project is None else z @ project.T
            held = z.T @ z if held is None else held + z.T @ z
        if held is not None:
            yield pd.DataFrame({"d": range(len(held)), "p": list(held)})

    def gathered(frames: DataFrame) -> np.ndarray:
        """The rows of a matrix, each summed over its partial rows."""
        add = lambda key, g: pd.DataFrame({"d": [key[0]], "p": [np.sum(np.stack(g["p"]), axis=0)]})
        summed = frames.groupBy("d").applyInPandas(add, "d int, p array<double>").collect()
        return np.array([r["p"] for r in sorted(summed)]) / n

    v = gathered(few.mapInPandas(products, "d int, p array<double>"))
    v = (v + v.T) / 2
    values, basis = leading(v, k)
    if not len(values):
        return spark.createDataFrame([], RESULT)
    project = basis / np.sqrt(values)[:, None]
    unit = gathered(few.mapInPandas(lambda f: products(f, project), "d int, p array<double>"))
    error = float(np.abs(unit - np.eye(len(unit))).max())
    explained = values / np.trace(v)

    def result(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = _integers(frame["x"], dim)
            z = _centred(x, n, s) @ project.T
            c = len(project)
            yield pd.DataFrame({
                "vec_id": frame["vec_id"].astype("Int64").repeat(c).to_numpy(), "component": np.tile(np.arange(1, c + 1, dtype=np.int32), len(x)), "n": n,
                "deviation": pd.array(deviations(x, n, s), "Int64").repeat(c), "whitened": z.ravel(), "explained": np.tile(explained, len(x)), "identity_error": error})

    return rows.select("vec_id", filled.alias("x")).mapInPandas(result, RESULT)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
