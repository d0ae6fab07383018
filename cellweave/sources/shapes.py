"""Grids computed from shapes, predicates and textures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.area import area_disc, rectangle_integral
from cellweave.functions.random import uniform
from cellweave.operators.grid_ops import repeat_cells
from cellweave.sources.binning import spine

SHAPE_KEY = ["grid_id", "i", "j"]


def shape_integral(family: str, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Integral of a shape (columns params, value_up, value_down, axis) over a rectangle.

    A disc carries value_down inside; every other family is a curve with axis.
    """
    p = F.col("params")
    if family == "disc":
        inside = area_disc(p[0], p[1], p[2], x0, x1, y0, y1 - y0)
        return F.col("value_up") * (x1 - x0) * (y1 - y0) + (F.col("value_down") - F.col("value_up")) * inside
    m = F.struct("axis", "params", "value_up", "value_down")
    first = F.col("axis") == 0
    # curve families measure s from the lower edge of a unit cell: undo that shift
    dx, dy = F.when(first, 0.0).otherwise(0.5), F.when(first, 0.5).otherwise(0.0)
    return rectangle_integral(family, m, x0 - dx, x1 - dx, y0 - dy, y1 - dy)


def rasterize_shapes(shapes: DataFrame, family: str, window: tuple[float, float] | None = None,
                     origin: tuple[float, float] = (0.0, 0.0), cells: DataFrame | None = None) -> DataFrame:
    """Exact cell averages of one shape per row on its ni x nj grid of the unit square.

    `window` is the size of a sliding cell that ends where the grid cell ends
    (by default the cell itself).  With `cells` only those cells are computed.
    """
    grid = (spine(shapes) if cells is None else
            shapes.join(cells.select(*SHAPE_KEY).distinct(), "grid_id"))
    return grid.select("grid_id", "i", "j", _average(family, *[F.col(c) for c in ("i", "j", "ni", "nj")], window, origin).alias("u"))


def _average(family: str, i: Column, j: Column, ni: Column, nj: Column, window: tuple[float, float] | None = None,
             origin: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Exact average of a shape on one cell of its grid."""
    hi = F.lit(1.0) / ni if window is None else F.lit(float(window[0]))
    hj = F.lit(1.0) / nj if window is None else F.lit(float(window[1]))
    x1 = (i + 1) / ni + F.lit(float(origin[0]))
    y1 = (j + 1) / nj + F.lit(float(origin[1]))
    return shape_integral(family, x1 - hi, x1, y1 - hj, y1) * ni * nj


def true_fine_grid(shapes: DataFrame, family: str, coarse: DataFrame, f: int, packed: bool = False) -> DataFrame:
    """Ground truth f times finer: pure cells repeat, cut cells are computed exactly.

    With `packed` a coarse cell is one row, whose `fine` holds its f x f values in row-major order, or one where all are the
    same; such a table holds a coarse cell as often as `coarse` does.
    """
    cut = (F.col("u") > 0) & (F.col("u") < 1)
    if packed:
        pure = coarse.filter(~cut).select(*SHAPE_KEY, F.array("u").alias("fine"))
        i, j, ni, nj = (F.col(n) * f for n in ("i", "j", "ni", "nj"))
        exact = [_average(family, i + a, j + b, ni, nj) for a in range(f) for b in range(f)]
        wanted = shapes.join(coarse.filter(cut).select(*SHAPE_KEY), "grid_id")
        return pure.unionByName(wanted.select(*SHAPE_KEY, F.array(*exact).alias("fine")))
    pure = repeat_cells(coarse.filter(~cut), f, f)
    wanted = repeat_cells(coarse.filter(cut), f, f)
    finer = shapes.withColumns({"ni": F.col("ni") * f, "nj": F.col("nj") * f})
    exact = rasterize_shapes(finer, family, cells=wanted)
    return pure.select(*SHAPE_KEY, "u").unionByName(exact)


def rasterize_predicate(grids: DataFrame, predicate) -> DataFrame:
    """0/1 image per grid from a test on (i, j, ni, nj) columns."""
    c = spine(grids)
    inside = predicate(F.col("i"), F.col("j"), F.col("ni"), F.col("nj"))
    return c.select("grid_id", "i", "j", inside.cast("double").alias("u"))


def disc_without_rectangle(centre: Column, radius: Column, rows: tuple[Column, Column], columns: tuple[Column, Column]):
    """Predicate for rasterize_predicate: a disc around (centre, centre) without the rectangle rows x columns.

    All four bounds of the rectangle are exclusive.
    """
    def inside(i: Column, j: Column, ni: Column, nj: Column) -> Column:
        from_centre = F.pow(i - centre, 2) + F.pow(j - centre, 2)
        removed = (i > rows[0]) & (i < rows[1]) & (j > columns[0]) & (j < columns[1])
        return (from_centre <= F.pow(radius, 2)) & ~removed

    return inside


def add_texture(pixels: DataFrame, ni: int, nj: int, kind: str = "trigonometric",
                amplitude: float = 0.1, frequency: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """Smooth perturbation on each side of a threshold; at the threshold both apply.

    trigonometric  cos(2 pi i f / nj) above, sin(2 pi d f / nj) below
    parabola       second order forms of the same
    radial         sin(2 pi d f / nj) at and below the threshold only
    traversal      cos(2 pi i f / nj) above the threshold only
    """
    i, j, u = F.col("i"), F.col("j"), F.col("u")
    d = F.sqrt((i - ni / 2) * (i - ni / 2) + (j - nj / 2) * (j - nj / 2))
    x, r = 2 * math.pi * i * frequency / nj, 2 * math.pi * d * frequency / nj
    above, below = (u >= threshold).cast("double"), (u <= threshold).cast("double")
    if kind == "trigonometric":
        wave = above * F.cos(x) + below * F.sin(r)
    elif kind == "parabola":
        wave = above * (1 - 0.5 * x * x) + below * r * r
    elif kind == "radial":
        wave = below * F.sin(r)
    elif kind == "traversal":
        wave = (u > threshold).cast("double") * F.cos(x)
    else:
        raise ValueError(f"unknown texture {kind!r}")
    return pixels.withColumn("u", u + amplitude * wave)


def add_uniform_noise(cells: DataFrame, amplitude: float, seed: int = 42) -> DataFrame:
    keys = [F.col("grid_id"), F.col("i"), F.col("j")]
    return cells.withColumn("u", F.col("u") + uniform(keys, seed, -amplitude, amplitude))
