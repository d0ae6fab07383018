"""Local models of regular cells: constants, polynomials, weighted corner values.

Every fit on a fixed window is a literal matrix times the window array.  Models
are expressed about the cell centre (see functions.area for the families).
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cellweave.functions.batches import as_lists, as_matrix
from cellweave.functions.index import let, offsets, sub_window, total, weighted
from cellweave.operators.windows import with_windows
from cellweave.schema import KEY, GridShape


# ---------------------------------------------------------------- constants

def fit_mirror(w: Column, size: tuple[int, int], k: int = 1) -> Column:
    """Mean of the k x k window (the cell itself for k = 1)."""
    inner = sub_window(w, size, (k, k))
    return F.array(total(inner[p] for p in range(k * k)) / float(k * k))


def fit_two_level(w: Column, size: tuple[int, int], up: float, down: float, k: int = 1) -> Column:
    """Constant snapped to the nearer of two known levels."""
    if not up > down:
        raise ValueError("up has to be greater than down")
    mean = fit_mirror(w, size, k)[0]
    return F.array(F.when(mean > (up + down) / 2, float(up)).otherwise(float(down)))


# ---------------------------------------------------------------- polynomials

def monomials(degree: int, full_rank: bool) -> list[tuple[int, int]]:
    return [(a, b) for a in range(degree + 1) for b in range(degree + 1)
            if full_rank or a + b <= degree]


def usable_degree(degree: int, n_cells: int, noisy: bool) -> int:
    return min(degree, int(math.floor(math.sqrt(n_cells) / (1 + noisy) - 1)))


def integral_matrix(cells, terms) -> np.ndarray:
    """Integrals of monomials over unit cells given by their offsets."""
    def part(d, p):
        return ((d + .5) ** (p + 1) - (d - .5) ** (p + 1)) / (p + 1)
    return np.array([[part(di, a) * part(dj, b) for a, b in terms] for di, dj in cells])


def poly_fit_matrix(k: int, degree: int, full_rank: bool = False, noisy: bool = False) -> np.ndarray:
    """Maps a k x k window to the tensor coefficients of the least-squares fit."""
    d = usable_degree(degree, k * k, noisy)
    terms = monomials(d, full_rank)
    solve = np.linalg.pinv(integral_matrix([(a, b) for a in offsets(k) for b in offsets(k)], terms))
    out = np.zeros(((d + 1) ** 2, k * k))
    for row, (a, b) in zip(solve, terms):
        out[a * (d + 1) + b] = row
    out[np.abs(out) < 1e-14] = 0
    return out


def fit_poly(w: Column, size: tuple[int, int], k: int, degree: int, full_rank: bool = False,
             noisy: bool = False) -> Column:
    m = poly_fit_matrix(k, degree, full_rank, noisy)
    inner = w if size == (k, k) else sub_window(w, size, (k, k))
    return let(inner, lambda x: F.array(*[weighted(x, row) for row in m]))


def weighted_fit_udf(k: int, degree: int, full_rank: bool, weight: str, center_weight: float,
                     distance_weight: float, epsilon: float, delta: float):
    """Least squares with weights that depend on the data, solved in batches."""
    d = usable_degree(degree, k * k, False)
    terms = monomials(d, full_rank)
    spots = np.array([(a, b) for a in offsets(k) for b in offsets(k)])
    A = integral_matrix(spots, terms)
    centre = int(np.flatnonzero((spots == 0).all(axis=1))[0])
    slots = [a * (d + 1) + b for a, b in terms]

    def weights(u: np.ndarray, si: np.ndarray) -> np.ndarray:
        if weight == "center":
            w = np.ones_like(u)
            w[:, centre] += center_weight
        elif weight == "center_smooth":
            w = 1.0 / (1.0 + si)
            w[:, centre] *= 1 + center_weight
        elif weight == "distance":
            w = np.tile(distance_weight * np.sqrt((spots ** 2).sum(axis=1)), (len(u), 1))
            w[:, centre] += center_weight
        elif weight == "smoothness":
            i = np.ones_like(u)
            if np.isfinite(epsilon):
                i = 1.0 / (si + epsilon)
                i *= k * k / np.sqrt((i ** 2).sum(axis=1, keepdims=True))
            gap = (u - u[:, [centre]]) ** 2
            rank = np.argsort(np.argsort(gap, axis=1, kind="stable"), axis=1, kind="stable")
            w = i * np.where(rank <= len(terms), 1 - delta, delta)
            w[:, centre] += center_weight
        else:
            raise ValueError(f"unknown weight {weight!r}")
        return w

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def fit(u: pd.Series, si: pd.Series) -> pd.Series:
        if not len(u):
            return pd.Series([], dtype=object)
        x, s = np.stack(u.to_numpy()), np.stack(si.to_numpy())
        w = np.sqrt(weights(x, s))
        c = np.einsum("nab,nb->na", np.linalg.pinv(w[:, :, None] * A[None]), w * x)
        out = np.zeros((len(x), (d + 1) ** 2))
        out[:, slots] = c
        return pd.Series(list(out))

    return fit


def fit_poly_weighted(w: Column, si: Column, k: int, degree: int, weight: str = "smoothness",
                      full_rank: bool = False, center_weight: float = 0.0, distance_weight: float = 1.0,
                      epsilon: float = 1e-5, delta: float = 0.0) -> Column:
    fit = weighted_fit_udf(k, degree, full_rank, weight, center_weight, distance_weight, epsilon, delta)
    return fit(w, si)


# ---------------------------------------------------------------- corner values

def average_row(cells, x: float) -> np.ndarray:
    """Weights that give the value at x of the polynomial with these cell averages."""
    n = len(cells)
    p = np.arange(n)
    c = np.asarray(cells, dtype=float)[:, None]
    averages = ((c + 1) ** (p + 1) - c ** (p + 1)) / (p + 1)
    return (x ** p) @ np.linalg.inv(averages)


def sub_estimates(n: int, width: int, x: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates at x from `width` of n cells [0, n], and their optimal weights."""
    rows = np.zeros((n - width + 1, n))
    for a in range(n - width + 1):
        rows[a, a:a + width] = average_row(range(a, a + width), x)
    gamma = np.linalg.lstsq(rows.T, average_row(range(n), x), rcond=None)[0]
    return rows, gamma


def blended(values: list[Column], smooth: list[Column], rows: np.ndarray, gamma: np.ndarray) -> Column:
    """Estimates weighted by gamma / (1 + I)^2."""
    alpha = [F.lit(float(g)) / ((1 + s) * (1 + s)) for g, s in zip(gamma, smooth)]
    return _ratio([total(v * F.lit(float(c)) for v, c in zip(values, row) if abs(c) > 1e-14)
                   for row in rows], alpha)


def _ratio(est: list[Column], alpha: list[Column]) -> Column:
    return let(F.array(*alpha), lambda a: total(a[n] * e for n, e in enumerate(est))
               / total(a[n] for n in range(len(est))))


def corner_tensor(kind: str) -> np.ndarray:
    """Solves the defining conditions of the corner polynomials about the centre.

    "4": bilinear.  "5": corners and cell average with equal pure squares.  "9a" /
    "9p": full 3x3 tensor from corners, average and edge averages / edge middles.
    Input order: corners (--, -+, +-, ++), average, edges (i-, i+, j-, j+).
    """
    corners = [(-.5, -.5), (-.5, .5), (.5, -.5), (.5, .5)]
    n = 2 if kind == "4" else 3
    terms = [(a, b) for a in range(n) for b in range(n)]

    def mean(p):
        return (.5 ** (p + 1) - (-.5) ** (p + 1)) / (p + 1)

    point = [[x ** a * y ** b for a, b in terms] for x, y in corners]
    average = [mean(a) * mean(b) for a, b in terms]
    if kind == "4":
        return np.linalg.inv(np.array(point))
    if kind == "5":
        free = [(0, 0), (0, 1), (1, 0), (1, 1)]
        cols = np.zeros((9, 5))
        for c, (a, b) in enumerate(free):
            cols[a * 3 + b, c] = 1
        cols[2, 4] = cols[6, 4] = 1
        return cols @ np.linalg.inv(np.array(point + [average]) @ cols)
    if kind == "9a":
        edges = [[x ** a * mean(b) for a, b in terms] for x in (-.5, .5)]
        edges += [[mean(a) * y ** b for a, b in terms] for y in (-.5, .5)]
    else:
        edges = [[x ** a * 0.0 ** b for a, b in terms] for x in (-.5, .5)]
        edges += [[0.0 ** a * y ** b for a, b in terms] for y in (-.5, .5)]
    return np.linalg.inv(np.array(point + [average] + edges))


def _tensor(kind: str, inputs: Column) -> Column:
    return F.array(*[weighted(inputs, np.where(np.abs(row) < 1e-13, 0, row)) for row in corner_tensor(kind)])


def fit_weno2d(w: Column, si: Column, degree: int = 1) -> Column:
    """Corner values from nine bilinear estimates of each 4x4 part of a 5x5 window."""
    rows, gamma = sub_estimates(4, 2, 2.0)

    def build(x):
        u, s = x["u"], x["s"]
        corners = []
        for i in range(2):
            for j in range(2):
                est, alpha = [], []
                for a in range(3):
                    for b in range(3):
                        est.append(total(u[(i + p) * 5 + j + q] * F.lit(float(rows[a, p] * rows[b, q]))
                                         for p in range(4) for q in range(4) if rows[a, p] * rows[b, q] != 0))
                        mean = total(s[(i + a + p) * 5 + j + b + q] for p in range(2) for q in range(2)) / 4
                        alpha.append(F.lit(float(gamma[a] * gamma[b])) / ((1 + mean) * (1 + mean)))
                corners.append(_ratio(est, alpha))
        return let(F.array(*corners, u[12]), lambda v: _tensor("4" if degree == 1 else "5", v))

    if degree not in (1, 2):
        raise ValueError("degree has to be 1 or 2")
    return let(F.struct(w.alias("u"), si.alias("s")), build)


def _blend(values: list[np.ndarray], smooth: list[np.ndarray], rows: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """`blended` for a batch."""
    alpha = [g / ((1 + s) * (1 + s)) for g, s in zip(gamma, smooth)]
    est = [total(v * c for v, c in zip(values, row) if abs(c) > 1e-14) for row in rows]
    return total(a * e for a, e in zip(alpha, est)) / total(alpha)


def weno1d_udf(coefs: int, points: bool):
    """Dimension by dimension in batches of 5 x 5 windows: the sums are too many to be interpreted row by row."""
    rows, gamma = sub_estimates(4, 2, 2.0)
    mid_rows, mid_gamma = sub_estimates(5, 3, 2.5)
    tensor = corner_tensor(str(coefs) if coefs < 9 else "9p" if points else "9a")
    tensor = np.where(np.abs(tensor) < 1e-13, 0, tensor)

    def pairs(s, width, n):
        return [reduce(np.fmax, s[a:a + width]) for a in range(n - width + 1)]

    def edge(u, s):
        return _blend(u, pairs(s, 2, 4), rows, gamma)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def fit(w: pa.Array, si: pa.Array) -> pa.Array:
        values, smooth = as_matrix(w, 25), as_matrix(si, 25)

        def u(a, b):
            return values[:, a * 5 + b]

        def s(a, b):
            return smooth[:, a * 5 + b]

        # lower / upper edge along j of each row, along i of each column
        along_j = [[edge([u(a, j + q) for q in range(4)], [s(a, j + q) for q in range(4)]) for j in range(2)] for a in range(5)]
        along_i = [[edge([u(i + p, b) for p in range(4)], [s(i + p, b) for p in range(4)]) for b in range(5)] for i in range(2)]
        found = []
        for i in range(2):
            for j in range(2):
                first = edge([along_j[i + p][j] for p in range(4)], [s(i + p, j + 1) for p in range(4)])
                second = edge([along_i[i][j + q] for q in range(4)], [s(i + 1, j + q) for q in range(4)])
                found.append((first + second) / 2)
        if coefs > 4:
            found.append(u(2, 2))
        if coefs == 9 and points:
            found += [_blend(along_i[i], pairs([s(i + 1, q) for q in range(5)], 3, 5), mid_rows, mid_gamma) for i in range(2)]
            found += [_blend([along_j[p][j] for p in range(5)], pairs([s(p, j + 1) for p in range(5)], 3, 5), mid_rows, mid_gamma)
                      for j in range(2)]
        elif coefs == 9:
            found += [along_i[i][2] for i in range(2)] + [along_j[2][j] for j in range(2)]
        zero = np.zeros(len(values))
        return as_lists(np.stack([total([x * c for x, c in zip(found, row) if c != 0] or [zero]) for row in tensor], axis=1))

    return fit


def fit_weno1d(w: Column, si: Column, coefs: int = 4, points: bool = False) -> Column:
    """Dimension by dimension: edge averages of rows, then corner values of those.

    coefs 4 or 5 use the corners (and the average), 9 adds the edge averages or,
    with points=True, the edge middles estimated from five cells.
    """
    if coefs not in (4, 5, 9):
        raise ValueError("coefs has to be 4, 5 or 9")
    return weno1d_udf(coefs, points)(w, si)


def fit_weno1d_points(w: Column, si: Column, coefs: int = 9) -> Column:
    return fit_weno1d(w, si, coefs, points=True)


# ---------------------------------------------------------------- tables

def surface_fits(cells: DataFrame, shape: GridShape | DataFrame, method: str = "mirror", k: int = 3,
                 **options) -> DataFrame:
    """Regular model of every cell: grid_id, i, j, u, family, params.

    `cells` carries si (a label or smoothness index) for the weighted methods.
    """
    needs_si = method in ("weighted", "weno2d", "weno1d", "weno1d_points")
    if method.startswith("weno"):
        k = 5
    w = with_windows(cells, shape, k, k, ["u", "si"] if needs_si else ["u"])
    x, size = F.col("w_u"), (k, k)
    if method == "mirror":
        params = fit_mirror(x, size, k)
    elif method == "two_level":
        params = fit_two_level(x, size, k=k, **options)
    elif method == "poly":
        params = fit_poly(x, size, k, **options)
    elif method == "weighted":
        params = fit_poly_weighted(x, F.col("w_si"), k, **options)
    elif method == "weno2d":
        params = fit_weno2d(x, F.col("w_si"), **options)
    elif method == "weno1d":
        params = fit_weno1d(x, F.col("w_si"), **options)
    elif method == "weno1d_points":
        params = fit_weno1d_points(x, F.col("w_si"), **options)
    else:
        raise ValueError(f"unknown method {method!r}")
    family = "constant" if method in ("mirror", "two_level") else "poly"
    return w.select(*KEY, "u", F.lit(family).alias("family"), params.alias("params"))
