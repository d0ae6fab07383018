"""Marking cells, gradients, orientation and routing of models.

The functions on Columns take a row-major window `w` of size (ki, kj), so they
can share the tiles of one `with_windows` call; the functions on DataFrames wrap
them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.batches import above
from cellweave.functions.index import offsets, sub_window, weighted
from cellweave.operators.windows import convolve_scatter, with_windows
from cellweave.schema import CUT, KEY, REGULAR, GridShape

# Gradient kernels (published operators), rows along i.
SOBEL = [[1, 2, 1], [0, 0, 0], [-1, -2, -1]]
SCHARR = [[3, 10, 3], [0, 0, 0], [-3, -10, -3]]
OPTIM = [[1, 3.5887, 1], [0, 0, 0], [-1, -3.5887, -1]]
OPTIM5 = [[7, 52, 370, 52, 7], [37, 1187, 2589, 1187, 37], [0, 0, 0, 0, 0],
          [-37, -1187, -2589, -1187, -37], [-7, -52, -370, -52, -7]]

KERNELS = {"sobel": SOBEL, "scharr": SCHARR, "optim": OPTIM}


def kernel_pair(method: str = "optim", k: int = 3) -> tuple[list, list]:
    """Kernels of both components; a 5x5 window has one fixed kernel."""
    if k == 5:
        g = OPTIM5
    elif k == 3 and method in KERNELS:
        g = KERNELS[method]
    else:
        raise ValueError(f"no gradient kernel {method!r} of size {k}")
    return g, [list(r) for r in zip(*g)]


# ---------------------------------------------------------------- labels

def label_constant(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"kind": F.lit(REGULAR), "si": F.lit(0.0)})


def piecewise_kind(u: Column, lo: float = 0.0, hi: float = 1.0, eps: float = 1e-10) -> Column:
    return F.when((u > lo + eps) & (u < hi - eps), CUT).otherwise(REGULAR)


def label_piecewise(cells: DataFrame, lo: float = 0.0, hi: float = 1.0, eps: float = 1e-10) -> DataFrame:
    """Cut where the average lies strictly between the two levels."""
    return (cells.withColumn("kind", piecewise_kind(F.col("u"), lo, hi, eps))
            .withColumn("si", F.col("kind").cast("double")))


def label_from_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Labels from a table (grid_id, i, j, si); cells without an entry are regular."""
    m = mask.select(*KEY, F.col("si").cast("double").alias("si"))
    return (cells.join(m, KEY, "left").withColumn("si", F.coalesce("si", F.lit(0.0)))
            .withColumn("kind", F.when(F.col("si") != 0, CUT).otherwise(REGULAR)))


# ---------------------------------------------------------------- gradients

def window_gradient(w: Column, size: tuple[int, int], method: str = "optim", k: int = 3,
                    normalize: bool = False) -> tuple[Column, Column]:
    gi, gj = kernel_pair(method, k)
    inner = w if size == (k, k) else sub_window(w, size, (k, k))
    gx, gy = (weighted(inner, [x for row in g for x in row]) for g in (gi, gj))
    if not normalize:
        return gx, gy
    norm = F.sqrt(gx * gx + gy * gy)
    both = (gx != 0) & (gy != 0)
    return F.when(both, gx / norm).otherwise(gx), F.when(both, gy / norm).otherwise(gy)


def gradient(cells: DataFrame, shape: GridShape | DataFrame, method: str = "optim", k: int = 3,
             normalize: bool = False) -> DataFrame:
    """Cross-correlation with a derivative kernel: columns gx (along i) and gy."""
    w = with_windows(cells, shape, k, k)
    gx, gy = window_gradient(F.col("w_u"), (k, k), method, k, normalize)
    return w.select(*KEY, "u", gx.alias("gx"), gy.alias("gy"))


def gradient_sparse(cells: DataFrame, shape: GridShape | DataFrame, method: str = "optim",
                    k: int = 3) -> DataFrame:
    """The same by scattering, for cyclic grids with missing cells."""
    gi, gj = kernel_pair(method, k)
    return convolve_scatter(cells, shape, {"gx": gi, "gy": gj})


def gradient_magnitude(cells: DataFrame, shape: GridShape | DataFrame) -> DataFrame:
    """Smoothness index: Euclidean norm of the 5x5 gradient."""
    g = gradient(cells, shape, k=5)
    return g.select(*KEY, "u", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("si"))


# ---------------------------------------------------------------- orientation

def fixed_axes(axis: int = 0) -> Column:
    return F.array(F.lit(axis))


def gradient_axes(gx: Column, gy: Column, angle: float = 45.0) -> Column:
    """Independent axes to try: the steeper direction is the dependent one.

    The other axis is proposed too when the gradient is further than `angle`
    degrees from the first.
    """
    ax, ay = F.abs(gx), F.abs(gy)
    first = (ax >= ay).cast("int")
    tilt = F.atan(F.least(ax, ay) / (F.greatest(ax, ay) + 1e-15))
    return F.when(tilt <= angle * math.pi / 180, F.array(first)).otherwise(F.array(first, 1 - first))


def axes_of(u: np.ndarray, gone: np.ndarray, size: tuple[int, int], method: str, angle: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gradient_axes of the 3 x 3 gradient for a batch of windows: the first axis, whether it is NULL, and whether both are tried."""
    inner = [(size[0] // 2 + a) * size[1] + size[1] // 2 + b for a in offsets(3) for b in offsets(3)]
    weights = [[x for row in g for x in row] for g in kernel_pair(method, 3)]
    with np.errstate(all="ignore"):
        ax, ay = (np.abs(weighted(u.T[inner], w)) for w in weights)
        nx, ny = (gone[:, [c for c, x in zip(inner, w) if x]].any(axis=1) for w in weights)
        # as in SQL, the greater and the least of two skip NULL, and NaN is the greatest number
        low = np.where(nx, ay, np.where(ny, ax, np.fmin(ax, ay)))
        top = np.where(nx, ay, np.where(ny, ax, np.maximum(ax, ay)))
        both = (nx & ny) | ~(np.arctan(low / (top + 1e-15)) <= angle * math.pi / 180)
    return (~above(ay, ax)).astype(int), nx | ny, both


def orient_by_gradient(cells: DataFrame, shape: GridShape | DataFrame, k: int = 3,
                       method: str = "optim", angle: float = 45.0) -> DataFrame:
    """One row per cell and proposed axis, in order of preference."""
    g = gradient(cells, shape, method, k)
    return g.select("*", F.posexplode(gradient_axes(F.col("gx"), F.col("gy"), angle)).alias("axis_rank", "axis"))


def orientation_code(cells: DataFrame, shape: GridShape | DataFrame, k: int = 5,
                     method: str = "optim", angle: float = 45.0) -> DataFrame:
    """Cut cells with code 1 (axis 0), 2 (axis 1) or 3 (both are proposed)."""
    g = gradient(cells, shape, method, k).filter((F.col("u") > 0) & (F.col("u") < 1))
    axes = gradient_axes(F.col("gx"), F.col("gy"), angle)
    return g.select(*KEY, F.when(F.size(axes) == 2, 3).otherwise(axes[0] + 1).cast("int").alias("code"))


def orientation_counts(cells: DataFrame, shape: GridShape | DataFrame, **kw) -> DataFrame:
    return orientation_code(cells, shape, **kw).groupBy("grid_id", "code").agg(
        F.count(F.lit(1)).cast("int").alias("n"))


# ---------------------------------------------------------------- routing

def route_all(n_models: int) -> Column:
    return F.array(*[F.lit(m) for m in range(n_models)])


def route_by_label(kind: Column, n_models: int, regular_models=(0,), interface_models=None) -> Column:
    """Models to try in a cell, by its label."""
    rest = [m for m in range(n_models) if m not in regular_models] if interface_models is None \
        else list(interface_models)
    return F.when(kind == CUT, F.array(*[F.lit(m) for m in rest])).otherwise(
        F.array(*[F.lit(m) for m in regular_models]))


def route_by_probability(kind: Column, probability: Column, damping=(1.0, 1.0, 1e-4),
                         regular_models=(0,)) -> Column:
    """Most probable curve class after damping; a damped class brings a fallback along."""
    d = F.array(*[F.lit(float(x)) for x in damping])
    p = F.zip_with(probability, d, lambda a, b: a * b)
    best = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    first = best + (max(regular_models) + 1)
    routed = F.when(F.get(d, best) != 1, F.array(first, best - 1)).otherwise(F.array(first))
    return F.when(kind == CUT, routed).otherwise(F.array(*[F.lit(m) for m in regular_models]))


def class_histogram(df: DataFrame, cls: str, classes: list | None = None) -> DataFrame:
    """Number of cells per class and grid, long or (with `classes`) one column per class."""
    if classes is None:
        return df.groupBy("grid_id", cls).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return df.groupBy("grid_id").agg(*[
        F.count(F.when(F.col(cls) == c, 1)).cast("int").alias(f"n_{c}") for c in classes])
