"""Corners found from the curves of neighbouring cut cells.

Which neighbours a corner rests on is found in windows of curve flags: a branch ends at its first cell beyond the
stencil radius, so everything it passes lies in a window one cell wider, and a search needs no join per step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.area import curve_height, graph_slope, wedge_ray
from cellweave.functions.index import map_index
from cellweave.operators.neighbours import RING_8, RING_16, offset_array
from cellweave.operators.windows import batched_windows
from cellweave.schema import KEY, GridShape, with_shape

GRAPHS = ("line", "quadratic", "curve_poly", "arc", "corner")
CURVES = (*GRAPHS, "wedge")
ENDS = "grid_id string, i int, j int, end int, di int, dj int"


def _look(fits: DataFrame) -> DataFrame:
    m = F.struct("axis", "family", "params").alias("m")
    return fits.filter(F.col("family").isin(*CURVES)).select(
        "grid_id", F.col("i").alias("ti"), F.col("j").alias("tj"), m)


def _hop(df: DataFrame, di: Column, dj: Column) -> DataFrame:
    return df.withColumns({"ti": map_index(F.col("i") + di, F.col("ni"), F.col("mode_i")),
                           "tj": map_index(F.col("j") + dj, F.col("nj"), F.col("mode_j"))})


def first_and_far(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows have two curve cells in the 16-ring, the place of the first, and of the one farthest from it."""
    middle, ring = flags.shape[1] // 2, np.array(RING_16)
    seen = flags[:, middle + ring[:, 0], middle + ring[:, 1]]
    first = seen.argmax(axis=1)
    far = np.abs(ring[None, :, :] - ring[first][:, None, :]).sum(axis=2) * len(ring) + np.arange(len(ring))
    last = np.where(seen & (np.arange(len(ring)) != first[:, None]), far, -1).argmax(axis=1)
    return seen.sum(axis=1) >= 2, ring[first], ring[last]


def follow(flags: np.ndarray, start: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first over curve cells from start to the first beyond the radius: whether there is one, and where.

    The cell itself, its 8-neighbours and the other branch's start are closed.  Of the cells reached in one round the
    one by the first direction counts, then the one of smallest offsets.
    """
    n, k, _ = flags.shape
    middle, rows = k // 2, np.arange(n)
    closed = np.zeros(flags.shape, bool)
    closed[:, middle - 1:middle + 2, middle - 1:middle + 2] = True
    front = np.zeros(flags.shape, bool)
    front[rows, middle + start[:, 0], middle + start[:, 1]] = True
    closed |= front
    closed[rows, middle + other[:, 0], middle + other[:, 1]] = True
    far = np.abs(np.arange(k) - middle)
    clear = (np.maximum(far[:, None], far[None, :]) > radius).ravel()
    found, at = np.abs(start).max(axis=1) > radius, start.copy()
    open_ = ~found
    while open_.any():
        by = np.full(flags.shape, len(RING_8))
        for r, (di, dj) in enumerate(RING_8):
            moved = np.zeros(flags.shape, bool)
            moved[:, max(di, 0):k + min(di, 0), max(dj, 0):k + min(dj, 0)] = front[:, max(-di, 0):k + min(-di, 0), max(-dj, 0):k + min(-dj, 0)]
            by[moved & flags & ~closed & (by == len(RING_8))] = r
        reached = (by < len(RING_8)) & open_[:, None, None]
        order = np.where(reached.reshape(n, -1) & clear, by.reshape(n, -1) * k * k + np.arange(k * k), len(RING_8) * k * k)
        best = order.argmin(axis=1)
        hit = order[rows, best] < len(RING_8) * k * k
        at[hit] = np.stack([best[hit] // k - middle, best[hit] % k - middle], axis=1)
        found |= hit
        closed |= reached
        front = reached
        open_ &= ~hit & reached.any(axis=(1, 2))
    return found, at


def _end_batches(batches: Iterator[pa.RecordBatch], k: int, radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        flags = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, k, k) > 0
        both, one, two = first_and_far(flags)
        kept = np.flatnonzero(both)
        flags, one, two = flags[kept], one[kept], two[kept]
        if radius >= 2:
            (found1, end1), (found2, end2) = follow(flags, one, two, radius), follow(flags, two, one, radius)
            ok = found1 & found2
            kept, one, two = kept[ok], end1[ok], end2[ok]
        keys = batch.take(pa.array(kept))
        for n, end in enumerate((one, two), 1):
            yield pa.RecordBatch.from_arrays(
                [*keys.columns[:3], pa.array(np.full(len(kept), n, np.int32)), *[pa.array(end[:, c].astype(np.int32)) for c in (0, 1)]],
                ["grid_id", "i", "j", "end", "di", "dj"])


def branch_ends(fits: DataFrame, shape: GridShape | DataFrame, stencil_radius: int = 1) -> DataFrame:
    """Two neighbouring curves per curve cell: KEY, n1, n2 struct(di, dj, m).

    Starts from the first curve cell of the 16-ring and the one farthest from it,
    and follows each branch over curve cells until one whose own window of the given
    radius does not contain the start.  `fits` holds every cell of its grids.
    """
    k = 2 * max(2, stencil_radius + 1) + 1
    flags = fits.select(*KEY, F.col("family").isin(*CURVES).cast("double").alias("curve"))
    w = batched_windows(flags, shape, k, ["curve"], F.col("curve") > 0)
    ends = with_shape(w.mapInArrow(partial(_end_batches, k=k, radius=stencil_radius), ENDS), shape)
    found = _hop(ends, F.col("di"), F.col("dj")).join(_look(fits), ["grid_id", "ti", "tj"])
    n = F.struct("di", "dj", "m")
    return found.groupBy(*KEY).agg(*[F.max_by(n, F.col("end") == e).alias(f"n{e}") for e in (1, 2)])


def _tangent(n: Column) -> tuple[Column, Column, Column, Column]:
    """Point and direction (x, y, dx, dy) of a neighbour's curve half-way to the cell."""
    m, first = n["m"], n["m"]["axis"] == 0
    d_t = F.when(first, n["di"]).otherwise(n["dj"]).cast("double")
    d_s = F.when(first, n["dj"]).otherwise(n["di"]).cast("double")
    t, p = -d_t / 2, m["params"]
    y, slope = wedge_ray(p, t)
    for family in GRAPHS:
        own = m["family"] == family
        y = F.when(own, curve_height(family, p, t)).otherwise(y)
        slope = F.when(own, graph_slope(family, p, t)).otherwise(slope)
    along, across = d_t / 2, d_s - 0.5 + y
    x0, y0 = F.when(first, along).otherwise(across), F.when(first, across).otherwise(along)
    return x0, y0, F.when(first, 1.0).otherwise(slope), F.when(first, slope).otherwise(1.0)


def corner_from_neighbours(fits: DataFrame, levels: DataFrame, shape: GridShape | DataFrame, stencil_radius: int = 1,
                           model_idx: int = 9) -> DataFrame:
    """Wedge proposals where the tangents of two neighbouring curves meet.

    Each corner is proposed to its cell and to that cell's cut 8-neighbours.  Reads a
    snapshot of the fits; conflicts are settled by the lowest score afterwards.
    """
    e = branch_ends(fits, shape, stencil_radius)
    for s in ("1", "2"):
        x, y, dx, dy = _tangent(F.col(f"n{s}"))
        e = e.withColumns({f"x{s}": x, f"y{s}": y, f"dx{s}": dx, f"dy{s}": dy})
    det = F.col("dy1") * F.col("dx2") - F.col("dx1") * F.col("dy2")
    step = ((F.col("y2") - F.col("y1")) * F.col("dx2") - (F.col("x2") - F.col("x1")) * F.col("dy2")) / F.col("det")
    e = e.withColumn("det", det).filter(F.abs("det") > 1e-9).withColumn("l", step)
    e = e.withColumns({"vx": F.col("x1") + F.col("l") * F.col("dx1"), "vy": F.col("y1") + F.col("l") * F.col("dy1")})
    e = e.withColumns({f"a{s}": F.atan2(F.col(f"y{s}") - F.col("vy"), F.col(f"x{s}") - F.col("vx")) for s in ("1", "2")})
    e = with_shape(e.join(levels.select(*KEY, "value_up", "value_down"), KEY), shape)
    targets = e.withColumn("o", F.explode(offset_array([(0, 0), *RING_8])))
    targets = _hop(targets, F.col("o.di"), F.col("o.dj")).join(_look(fits).drop("m"), ["grid_id", "ti", "tj"])
    params = F.array(F.col("vx") - F.col("o.di"), F.col("vy") - F.col("o.dj") + 0.5, F.col("a1"), F.col("a2"))
    # the place of the source cell numbers the candidates that meet in one cell
    cand = (1 - F.col("o.di")) * 3 + 1 - F.col("o.dj")
    return targets.select("grid_id", F.col("ti").alias("i"), F.col("tj").alias("j"), F.lit(model_idx).alias("model_idx"),
                          F.lit(0).alias("axis_rank"), cand.cast("int").alias("cand"), F.lit(0).alias("axis"),
                          F.lit("wedge").alias("family"), params.alias("params"), "value_up", "value_down")
