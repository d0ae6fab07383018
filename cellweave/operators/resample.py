"""Finer grids from fitted cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cellweave.functions.area import FLAT, model_eval, model_integral
from cellweave.operators.grid_ops import repeat_cells
from cellweave.operators.scoring import line_area
from cellweave.schema import KEY, GridShape, with_shape

MODEL = ("axis", "family", "params", "value_up", "value_down")


def resample_average(fits: DataFrame, fi: int, fj: int | None = None, only: DataFrame | None = None,
                     families=("constant", "line", "quadratic")) -> DataFrame:
    """Exact averages of each cell's model on fi x fj parts; `only` restricts the cells.

    Pure row expansion: no shuffle.
    """
    fj = fj or fi
    if only is not None:
        fits = fits.join(only.select(*KEY), KEY, "left_semi")
    a, b = F.floor(F.col("_p") / fj).cast("int"), F.pmod("_p", F.lit(fj))
    x0, y0 = a / F.lit(float(fi)) - 0.5, b / F.lit(float(fj)) - 0.5
    area = model_integral(families, {n: F.col(n) for n in MODEL}, x0, x0 + 1.0 / fi, y0, y0 + 1.0 / fj)
    return (fits.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(fi * fj - 1))))
            .select("grid_id", (F.col("i") * fi + a).cast("int").alias("i"),
                    (F.col("j") * fj + b).cast("int").alias("j"), (area * fi * fj).alias("u")))


def resample_points(fits: DataFrame, shape: GridShape, size: tuple[int, int],
                    families=("constant", "line", "quadratic")) -> DataFrame:
    """Point values on a grid of any size; point ix stands at ix / size * n.

    Each cell emits the points that fall into it, so no join is needed.
    """
    f = with_shape(fits, shape)

    def inside(pos, n, m):
        first, last = F.ceil(F.col(pos) * m / F.col(n)), F.ceil((F.col(pos) + 1) * m / F.col(n)) - 1
        return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int")))

    f = f.withColumn("_a", F.explode(inside("i", "ni", size[0]))).withColumn(
        "_b", F.explode(inside("j", "nj", size[1])))
    x = F.col("_a") / F.lit(float(size[0])) * F.col("ni") - F.col("i") - 0.5
    y = F.col("_b") / F.lit(float(size[1])) * F.col("nj") - F.col("j") - 0.5
    value = model_eval(families, {n: F.col(n) for n in MODEL}, x, y)
    return f.select("grid_id", F.col("_a").alias("i"), F.col("_b").alias("j"), value.alias("u"))


def resample_interface_only(fits: DataFrame, f: int, families=("constant", "line", "quadratic")) -> DataFrame:
    """Regular cells are repeated, only cut cells are resampled from their model."""
    regular = repeat_cells(fits.filter(F.col("kind") == 0).select(*KEY, "u"), f, f)
    return regular.unionByName(resample_average(fits.filter(F.col("kind") != 0), f, families=families))


def packed_interface_only(fits: DataFrame, f: int, families=("constant", "line"), by: tuple[str, ...] = ()) -> DataFrame:
    """resample_interface_only with one row a coarse cell: KEY, `by` and `fine`, its f x f averages in row-major order.

    `fine` has one entry where all are the same by construction.  Families: constants and lines, the latter in Arrow batches.
    """
    if not set(families) <= {"constant", "line"}:
        raise ValueError("only constants and lines are resampled side by side")
    parts = [(a / f - 0.5, b / f - 0.5) for a in range(f) for b in range(f)]
    if "line" in families:
        cut = _line_parts(f)(F.col("axis"), F.col("family"), F.col("params"), F.col("value_up"), F.col("value_down"))
    else:
        cut = F.array(*[F.col("params")[0] * F.lit(x + 1.0 / f - x) * F.lit(y + 1.0 / f - y) * f * f for x, y in parts])
    fine = F.when(F.col("kind") == 0, F.array("u")).when(F.col("kind") != 0, cut)
    return fits.select(*KEY, *by, fine.alias("fine")).filter(F.col("fine").isNotNull())


def _line_parts(f: int):
    """Batches of resample_average for constants and lines, an array a cell."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def values(axis: pa.Array, family: pa.Array, params: pa.Array, up: pa.Array, down: pa.Array) -> pa.Array:
        n, first = len(axis), axis.to_numpy(zero_copy_only=False) == 0
        named = np.array(family.to_pylist(), object)
        other = [x for x in named if x not in ("constant", "line", None)]
        if other:
            raise ValueError(f"family not listed: {other[0]}")
        line, none = named == "line", named == None  # noqa: E711
        begin = params.offsets.to_numpy()[:-1] - params.offsets[0].as_py()
        flat = params.flatten()
        size = params.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        p, holes = np.full((n, 2), np.nan), np.ones((n, 2), bool)
        if len(flat):
            v, gone = flat.to_numpy(zero_copy_only=False).astype(float), flat.is_null().to_numpy(zero_copy_only=False)
            for c in range(2):
                at = np.flatnonzero(size > c)
                p[at, c], holes[at, c] = v[begin[at] + c], gone[begin[at] + c]
        (b, m), (no_b, no_m) = p.T, holes.T
        no_side = up.is_null().to_numpy(zero_copy_only=False) | down.is_null().to_numpy(zero_copy_only=False)
        up, down = (x.to_numpy(zero_copy_only=False).astype(float) for x in (up, down))
        flat_line = (np.abs(m) < FLAT) & ~no_m
        unknown = np.where(line, no_side | no_m | (no_b & ~flat_line), no_b) | none
        out = np.empty((n, f * f))
        with np.errstate(all="ignore"):
            for q in range(f * f):
                x0, y0 = q // f / f - 0.5, q % f / f - 0.5
                x1, y1 = x0 + 1.0 / f, y0 + 1.0 / f
                t0, t1 = np.where(first, x0, y0), np.where(first, x1, y1)
                s0, h = np.where(first, y0, x0) + 0.5, np.where(first, y1 - y0, x1 - x0)
                below = np.where(flat_line & no_b, h * (t1 - t0), line_area(b, m, t0, t1, s0, h))
                area = np.where(line, up * ((t1 - t0) * h) + (down - up) * below, b * (x1 - x0) * (y1 - y0))
                out[:, q] = area * f * f
        values = pa.array(out.ravel(), pa.float64(), mask=np.repeat(unknown, f * f))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * f * f, pa.int32()), values)

    return values


def curve_polyline(fits: DataFrame, resolution: int = 25, families=("line", "quadratic", "arc", "corner")) -> DataFrame:
    """Points of each curve inside its cell, in grid coordinates."""
    from cellweave.functions.area import curve_height

    t = F.col("_q") / F.lit(float(resolution - 1)) - 0.5
    s = None
    for fam in families:
        e = curve_height(fam, F.col("params"), t)
        s = F.when(F.col("family") == fam, e) if s is None else s.when(F.col("family") == fam, e)
    pts = (fits.filter(F.col("family").isin(*families))
           .withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1))))
           .withColumns({"_t": t, "_s": s}).filter((F.col("_s") >= 0) & (F.col("_s") <= 1)))
    along_i = F.col("axis") == 0
    return pts.select(*KEY, F.col("_q").alias("point"),
                      (F.col("i") + F.when(along_i, F.col("_t") + 0.5).otherwise(F.col("_s"))).alias("x"),
                      (F.col("j") + F.when(along_i, F.col("_s")).otherwise(F.col("_t") + 0.5)).alias("y"))
