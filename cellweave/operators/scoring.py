"""Scoring proposals against the data and choosing the best one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cellweave.functions.area import FLAT, arc_width, area_below
from cellweave.functions.batches import above, as_matrix, missing
from cellweave.functions.index import let
from cellweave.schema import KEY, REGULAR

#: Most parameters of a family with a fixed number of them; polynomials carry their whole array.
N_PARAMS = 5
FIELDS = ("model_idx", "axis_rank", "cand", "axis", "family", "params", "value_up", "value_down")


def unit_area(families, p, t: Column, s: Column) -> Column:
    """Area below a curve in the unit cell whose lower edge has its middle at (t, s)."""
    real = [f for f in families if f not in ("constant", "poly")]
    if len(real) == 1:
        return area_below(real[0], p, t - 0.5, t + 0.5, s, F.lit(1.0))
    out = F.when(F.col("family") == real[0], area_below(real[0], p, t - 0.5, t + 0.5, s, F.lit(1.0)))
    for f in real[1:]:
        out = out.when(F.col("family") == f, area_below(f, p, t - 0.5, t + 0.5, s, F.lit(1.0)))
    return out


def score_rows(rows: DataFrame, key: list[str], families, size: tuple[int, int], k: int = 3, p: float = 2.0,
               center_weight: float | Column = 0.0, cut_only: bool = False) -> DataFrame:
    """Loss of proposals that stand one per row next to their window w_u (size).

    loss = sum over the k x k neighbours of |data - model average|^p, plus
    center_weight (a number, or an expression over `key`) times the centre term; with cut_only, members whose label in
    w_kind is 0 do not count.  Every member is a row of scalars, so the areas run
    in generated code, and the sums need no shuffle when the rows are still
    partitioned by a part of `key`.  A "constant" proposal is the fallback: its
    loss is infinite.
    """
    half = k // 2
    wide = any(f in ("poly", "curve_poly") for f in families)
    params = [F.get("params", F.lit(n)).alias(f"p{n}") for n in range(N_PARAMS)]
    spots = F.when(F.col("family") == "constant", F.array(F.lit(half * k + half))).otherwise(
        F.sequence(F.lit(0), F.lit(k * k - 1)))
    c = rows.withColumn("_q", F.explode(spots))
    di, dj = F.floor(F.col("_q") / k).cast("int") - half, F.pmod("_q", F.lit(k)) - half
    at = (di + size[0] // 2) * size[1] + dj + size[1] // 2
    scalars = ["model_idx", "axis_rank", "cand", "axis", "family", "value_up", "value_down"]
    along_i = F.col("axis") == 0
    carried = ["params"] if wide else ["_n", *[f"p{n}" for n in range(N_PARAMS)]]
    c = c.withColumn("_n", F.size("params"))
    c = c.select(*key, *scalars, *(["params"] if wide else ["_n", *params]),
                 F.when(along_i, di).otherwise(dj).cast("double").alias("_t"),
                 F.when(along_i, dj).otherwise(di).cast("double").alias("_s"), F.get("w_u", at).alias("_u"),
                 *([F.get("w_kind", at).alias("_k")] if cut_only else []))
    p_ = F.col("params") if wide else [F.col(f"p{n}") for n in range(N_PARAMS)]
    c = c.withColumn("_below", unit_area(families, p_, F.col("_t"), F.col("_s")))
    whole = F.lit(1.0)
    if "arc" in families:
        whole = F.when(F.col("family") == "arc", arc_width(
            p_[0], p_[2], F.col("_t") - 0.5, F.col("_t") + 0.5)).otherwise(1.0)
    gap = F.col("_u") - F.col("value_up") * whole - (F.col("value_down") - F.col("value_up")) * F.col("_below")
    c = c.withColumn("_gap", gap)
    e = F.pow("_gap", 2) if p == 2 else F.abs("_gap") if p == 1 else F.pow(F.abs("_gap"), p)
    if isinstance(center_weight, Column) or center_weight:
        e = e * F.when((F.col("_t") == 0) & (F.col("_s") == 0), 1.0 + center_weight).otherwise(1.0)
    if cut_only:
        e = F.when(F.col("_k") != 0, e).otherwise(0.0)
    e = F.when(F.col("family") == "constant", float("inf")).otherwise(e)
    # parameters follow from the key
    out = c.withColumn("_e", e).groupBy(*key, *scalars, *carried).agg(F.sum("_e").alias("loss"))
    packed = F.col("params") if wide else F.when(F.col("_n") >= 0, F.slice(
        F.array(*[f"p{n}" for n in range(N_PARAMS)]), F.lit(1), F.greatest("_n", F.lit(0))))
    return out.select(*key, *scalars, packed.alias("params"), "loss")


def line_area(b: np.ndarray, m: np.ndarray, t0: np.ndarray | float, t1: np.ndarray | float, s0: np.ndarray | float, h: float) -> np.ndarray:
    """area_line for a batch of lines, where t0 < t1."""
    def g(y):
        return np.where(y <= 0, 0.0, np.where(y <= h, y * y / 2, h * y - h * h / 2))

    with np.errstate(all="ignore"):
        flat = np.maximum(0.0, np.fmin(b + m * (t0 + t1) / 2 - s0, h)) * (t1 - t0)
        return np.where(np.abs(m) < FLAT, flat, (g(b + m * t1 - s0) - g(b + m * t0 - s0)) / m)


def line_losses(near: np.ndarray, gone: np.ndarray, kind: np.ndarray, first: np.ndarray, b: np.ndarray, m: np.ndarray, unknown: np.ndarray,
                up: np.ndarray, down: np.ndarray, p: float, center_weight: float, cut_only: bool) -> np.ndarray:
    """Losses of score_rows for one line a cell, on k x k windows that are turned (`first`: independent axis i); NaN for NULL."""
    n, k, _ = near.shape
    half, terms, counted = k // 2, {}, {}
    with np.errstate(all="ignore"):
        for t in range(k):
            for s in range(k):
                gap = near[:, t, s] - up - (down - up) * line_area(b, m, t - half - 0.5, t - half + 0.5, float(s - half), 1.0)
                e = gap * gap if p == 2 else np.abs(gap) ** p
                if t == half and s == half:
                    e = e * (1.0 + center_weight)
                known = ~gone[:, t, s] & ~unknown
                if cut_only:
                    # a member that does not count adds nothing, whatever its value
                    counts = (kind[:, t, s] != REGULAR) & ~np.isnan(kind[:, t, s])
                    e, known = np.where(counts, e, 0.0), known | ~counts
                terms[t, s], counted[t, s] = np.where(known, e, 0.0), known
        # members add up by their places in the grid, as rows of score_rows do
        total = np.zeros((2, n))
        for q in range(k * k):
            total[0] += terms[q // k, q % k]
            total[1] += terms[q % k, q // k]
    return np.where(np.logical_or.reduce(list(counted.values())), np.where(first, *total), np.nan)


def place_of_best(losses: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """Place of each row's winner, columns standing in the order that decides ties; -1 where no loss is finite, as in best_of."""
    known = np.where(np.isnan(losses), np.inf, losses)
    best, won = np.full(len(losses), np.inf), np.full(len(losses), -1)
    for n, loss in enumerate(known.T):
        better = loss + eps < best if eps > 0 else loss < best
        best, won = np.where(better, loss, best), np.where(better, n, won)
    return won


def best_of(scored: Column, eps: float = 0.0) -> Column:
    """Winner of a cell: smallest loss, first in order on ties.

    With eps > 0 a later proposal replaces the incumbent only if it is better by
    more than eps, so the result depends on the order and is folded.
    """
    known = F.filter(scored, lambda c: c["loss"].isNotNull() & ~F.isnan(c["loss"]))
    if eps == 0:
        return F.array_min(known)
    order = F.array_sort(F.transform(known, lambda c: F.struct(
        c["model_idx"], c["axis_rank"], c["cand"], c.alias("c"))))
    return let(F.transform(order, lambda x: x["c"]), lambda xs: F.aggregate(
        xs, xs[0], lambda best, c: F.when(c["loss"] + eps < best["loss"], c).otherwise(best)))


def score_table(proposals: DataFrame, windows: DataFrame, families, k: int = 3, p: float = 2.0,
                center_weight: float = 0.0, once: bool = False) -> DataFrame:
    """Loss of proposals from any source; windows hold w_u (k x k) per cell.

    Members of equal proposals of a cell, and of several windows of one, add up.  `once` says that there are none, as where
    both come from dense grids; wedges are then not grouped first.
    """
    if tuple(families) == ("wedge",) and not isinstance(center_weight, Column):
        return _wedge_table(proposals, windows, k, p, center_weight, once)
    rows = proposals.join(windows.select(*KEY, "w_u"), KEY)
    return score_rows(rows, KEY, families, (k, k), k, p, center_weight)


def _wedge_table(proposals: DataFrame, windows: DataFrame, k: int, p: float, center_weight: float, once: bool) -> DataFrame:
    """score_table for wedges, whose losses are evaluated in Arrow batches, a row a proposal instead of one a member."""
    if once:
        met = proposals.withColumn("_times", F.lit(1).cast("long")).join(windows.select(*KEY, F.array("w_u").alias("_w")), KEY)
    else:
        met = proposals.groupBy(*KEY, *FIELDS).agg(F.count(F.lit(1)).alias("_times")).join(
            windows.select(*KEY, "w_u").groupBy(*KEY).agg(F.collect_list("w_u").alias("_w")), KEY)

    @F.arrow_udf(T.DoubleType())
    def losses(w: pa.Array, vt: pa.Array, vs: pa.Array, m1: pa.Array, m2: pa.Array, c1: pa.Array, c2: pa.Array,
               axis: pa.Array, up: pa.Array, down: pa.Array, times: pa.Array) -> pa.Array:
        sizes = w.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        flat = w.flatten()
        u, gone = as_matrix(flat, k * k), missing(flat, k * k)
        wedge = [_column(x, row) for x in (vt, vs, m1, m2, c1, c2)]
        (up, no_up), (down, no_down) = _column(up, row), _column(down, row)
        first = axis.to_numpy(zero_copy_only=False)[row] == 0
        total, seen = np.zeros(len(row)), np.zeros(len(row), bool)
        with np.errstate(all="ignore"):
            for q in range(k * k):
                di, dj = q // k - k // 2, q % k - k // 2
                t, s = np.where(first, di, dj).astype(float), np.where(first, dj, di).astype(float)
                below, no_below = _wedge_area(*wedge, t - 0.5, t + 0.5, s)
                gap = u[:, q] - up - (down - up) * below
                e = gap * gap if p == 2 else np.abs(gap) ** p
                if di == 0 and dj == 0:
                    e = e * (1.0 + center_weight)
                known = ~(gone[:, q] | no_up | no_down | no_below)
                total += np.where(known, e, 0.0)
                seen |= known
        if (sizes != 1).any():
            total, seen = np.bincount(row, total, len(sizes)), np.bincount(row, seen, len(sizes)) > 0
        return pa.array(total * times.to_numpy(), pa.float64(), mask=~seen)

    v = [F.get("params", F.lit(n)) for n in range(4)]
    loss = losses("_w", v[0], v[1], F.tan(v[2]), F.tan(v[3]), F.cos(v[2]), F.cos(v[3]), "axis", "value_up", "value_down", "_times")
    return met.select(*KEY, *FIELDS, loss.alias("loss"))


def _column(x: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x.to_numpy(zero_copy_only=False).astype(float, copy=False)[row], x.is_null().to_numpy(zero_copy_only=False)[row]


def _wedge_area(vt, vs, m1, m2, c1, c2, t0, t1, s0) -> tuple[np.ndarray, np.ndarray]:
    """area_wedge of unit height for a batch, each argument before t0 with where it is NULL; the area and where that is NULL."""
    (vt, no_t), (vs, no_s), (m1, no1), (m2, no2), (c1, _), (c2, _) = vt, vs, m1, m2, c1, c2
    turn = np.maximum(t0, np.fmin(np.where(no_t, np.nan, vt), t1))
    # NaN is the greatest number; where an angle is NULL, neither side is true
    right1, right2 = (((c >= 0) | np.isnan(c)) & ~no for c, no in ((c1, no1), (c2, no2)))
    same_right, same_left = right1 & right2, ~right1 & ~no1 & ~right2 & ~no2

    def part(m, no_m, right):
        lo, hi = np.where(right, turn, t0), np.where(right, t1, turn)
        b, flat = vs - m * vt, (np.abs(m) < FLAT) & ~no_m
        no_b = no_t | no_s | no_m
        none = hi <= lo
        # least and greatest skip NULL, so that a flat line without a height fills the rectangle
        area = np.where(none, 0.0, np.where(flat & no_b, hi - lo, line_area(b, m, lo, hi, s0, 1.0)))
        return area, ~none & ~flat & no_b

    # the first half-line's part lies on its own side; the second one's too, and on the right if the first one has none
    (one, no_one), (two, no_two) = part(m1, no1, right1), part(m2, no2, same_right | ~(same_left | right1))
    whole = (t1 - t0) * 1.0
    rest = np.where(np.where(same_right, ~above(m2, m1), ~above(m1, m2)), 0.0, whole)
    return np.where(same_right | same_left, one - two + rest, one + two), no_one | no_two


def select_best(scored: DataFrame, eps: float = 0.0, key: list[str] | None = None) -> DataFrame:
    """Winner per cell of scored proposals: smallest loss, ties by model, axis, candidate."""
    key = key or KEY
    row = F.struct("loss", *FIELDS)
    known = scored.filter(F.col("loss").isNotNull() & ~F.isnan("loss"))
    best = F.min(row) if eps == 0 else best_of(F.collect_list(row), eps)
    return known.groupBy(*key).agg(best.alias("b")).select(
        *key, "b.loss", *[F.col(f"b.{f}").alias(f) for f in FIELDS])


def winner_counts(fits: DataFrame, by=("family", "axis", "kind")) -> DataFrame:
    """How many cells each family (and axis, kind) won."""
    return fits.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("n"))
