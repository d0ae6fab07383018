"""Exact areas, averages and values of local models, as Column expressions.

Local coordinates of a curve cell: t runs along the independent axis and is
zero at the cell centre; s runs along the dependent axis and is zero at the
lower edge of the cell.  A curve s = f(t) has value_down below and value_up on
and above it.  Where a curve is undefined its cell contributes zero.

Families and their parameters:

constant   [c]
poly       tensor coefficients c[a, b] x^a y^b, row-major, about the cell centre
line       [b, m]                 b + m t
quadratic  [c, b, a]              c + b t + a t^2
curve_poly [c0, ..., cd]          any degree (roots are found in Arrow batches)
arc        [tc, sc, r, side]      sc + side sqrt(r^2 - (t - tc)^2), side = +-1
corner     [v, b1, m1, b2, m2]    first line left of v, second line right of it
wedge      [vt, vs, a1, a2]       two half-lines from the vertex at two angles
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from cellweave.functions.index import let, total

FLAT = 1e-7


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(lit(lo), F.least(x, lit(hi)))


# ---------------------------------------------------------------- surfaces

def poly2d_eval(coefs: Column, n: int, x: Column, y: Column) -> Column:
    return total(coefs[a * n + b] * F.pow(x, a) * F.pow(y, b) if a or b else coefs[0]
                 for a in range(n) for b in range(n))


def poly2d_area(coefs: Column, n: int, x0, x1, y0, y1) -> Column:
    """Integral of a tensor polynomial over a rectangle."""
    x0, x1, y0, y1 = map(lit, (x0, x1, y0, y1))
    sx = [(F.pow(x1, a + 1) - F.pow(x0, a + 1)) / (a + 1) for a in range(n)]
    sy = [(F.pow(y1, b + 1) - F.pow(y0, b + 1)) / (b + 1) for b in range(n)]
    return total(coefs[a * n + b] * sx[a] * sy[b] for a in range(n) for b in range(n))


# ---------------------------------------------------------------- graphs

def area_line(b, m, t0, t1, s0, h) -> Column:
    """Area below b + m t inside [t0, t1] x [s0, s0 + h]; no breakpoints needed."""
    b, m, t0, t1, s0, h = map(lit, (b, m, t0, t1, s0, h))

    def g(y):
        return F.when(y <= 0, 0.0).when(y <= h, y * y / 2).otherwise(h * y - h * h / 2)

    flat = clamp(b + m * (t0 + t1) / 2 - s0, 0, h) * (t1 - t0)
    return F.when(t1 <= t0, 0.0).when(F.abs(m) < FLAT, flat).otherwise(
        (g(b + m * t1 - s0) - g(b + m * t0 - s0)) / m)


def quadratic_roots(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Real roots of a t^2 + b t + c (NULL where there is none), stably computed."""
    disc = b * b - 4 * a * c
    q = -(b + F.when(b < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(disc, F.lit(0.0)))) / 2
    straight = F.when(b != 0, -c / b)
    first = F.when(F.abs(a) < 1e-14, straight).when(disc >= 0, q / a)
    second = F.when(F.abs(a) < 1e-14, straight).when((disc >= 0) & (q != 0), c / q)
    return first, second


def area_quadratic(c, b, a, t0, t1, s0, h) -> Column:
    """Area below c + b t + a t^2 inside [t0, t1] x [s0, s0 + h].

    The part above a level y lies between or outside the two roots of f = y; the
    clipped area is the difference of those parts at y = s0 and y = s0 + h.
    """
    c, b, a, t0, t1, s0, h = map(lit, (c, b, a, t0, t1, s0, h))

    def above(y):
        def prim(t):
            return t * ((c - y) + t * (b / 2 + t * a / 3))

        def between(r):
            inner = prim(clamp(F.greatest(r[0], r[1]), t0, t1)) - prim(clamp(F.least(r[0], r[1]), t0, t1))
            return F.when(a > 0, prim(t1) - prim(t0) - inner).otherwise(inner)

        none = F.when(a > 0, prim(t1) - prim(t0)).otherwise(0.0)
        return F.when(b * b - 4 * a * (c - y) <= 0, none).otherwise(
            let(F.array(*quadratic_roots(a, b, c - y)), between))

    return (F.when(t1 <= t0, 0.0).when(F.abs(a) < 1e-9, area_line(c, b, t0, t1, s0, h))
            .otherwise(above(s0) - above(s0 + h)))


def arc_height(tc, sc, r, side, t) -> Column:
    gap = r * r - (t - tc) * (t - tc)
    return F.when(gap >= 0, sc + side * F.sqrt(F.greatest(gap, F.lit(0.0))))


def area_arc(tc, sc, r, side, t0, t1, s0, h) -> Column:
    """Area below a semicircle inside a rectangle (zero beyond its ends)."""
    tc, sc, r, side, t0, t1, s0, h = map(lit, (tc, sc, r, side, t0, t1, s0, h))

    def above(y, ends):
        def prim(t):
            return let(clamp((t - tc) / r, -1, 1), lambda z: (sc - y) * t
                       + side * r * r / 2 * (z * F.sqrt(1 - z * z) + F.asin(z)))

        lo, hi = ends[0], ends[1]
        whole = prim(hi) - prim(lo)
        inner = let(F.sqrt(F.greatest(r * r - (y - sc) * (y - sc), F.lit(0.0))), lambda k: prim(
            clamp(tc + k, lo, hi)) - prim(clamp(tc - k, lo, hi)))
        return (F.when(side > 0, F.when(y <= sc, whole).otherwise(inner))
                .otherwise(F.when(y >= sc, 0.0).otherwise(whole - inner)))

    ends = F.array(clamp(tc - r, t0, t1), clamp(tc + r, t0, t1))
    return let(ends, lambda e: F.when(e[1] <= e[0], 0.0).otherwise(above(s0, e) - above(s0 + h, e)))


def arc_width(tc, r, t0, t1) -> Column:
    """Length of the part of [t0, t1] on which the semicircle exists."""
    return F.greatest(F.lit(0.0), F.least(t1, tc + r) - F.greatest(t0, tc - r))


def area_disc(tc, sc, r, t0, t1, s0, h) -> Column:
    """Area of the part of a disc inside a rectangle: upper minus lower semicircle."""
    return _area_disc(*map(lit, (tc, sc, r, t0, t1, s0, h)))


@F.arrow_udf(T.DoubleType())
def _area_disc(tc: pa.Array, sc: pa.Array, r: pa.Array, t0: pa.Array, t1: pa.Array, s0: pa.Array, h: pa.Array) -> pa.Array:
    """For a batch of rectangles; the sums are those of area_arc for both sides."""
    tc, sc, r, t0, t1, s0, h = (x.to_numpy(zero_copy_only=False).astype(float, copy=False) for x in (tc, sc, r, t0, t1, s0, h))
    with np.errstate(all="ignore"):
        lo, hi = np.clip(tc - r, t0, t1), np.clip(tc + r, t0, t1)

        def turn(t):
            z = np.clip((t - tc) / r, -1, 1)
            return z * np.sqrt(1 - z * z) + np.arcsin(z)

        # what a place adds under an arc hangs on neither the level nor the side, so both sides and levels share it
        ends = turn(lo), turn(hi)

        def arcs(y):
            k = np.sqrt(np.maximum(r * r - (y - sc) * (y - sc), 0.0))
            near = np.clip(tc - k, lo, hi), np.clip(tc + k, lo, hi)
            turns = turn(near[0]), turn(near[1])

            def between(side, at, turns):
                low, high = ((sc - y) * t + side * r * r / 2 * x for t, x in zip(at, turns))
                return high - low

            whole, inner = between(-1, (lo, hi), ends), between(-1, near, turns)
            upper = np.where(y <= sc, between(1, (lo, hi), ends), between(1, near, turns))
            return upper, np.where(y >= sc, 0.0, whole - inner)

        (u0, l0), (u1, l1) = arcs(s0), arcs(s0 + h)
        upper, lower = u0 - u1, l0 - l1
        known = ~np.isnan(tc + sc + r + t0 + t1 + s0 + h)
        return pa.array(np.where(known, np.where(hi <= lo, 0.0, upper - lower), np.nan), pa.float64(), from_pandas=True)


def area_broken(v, b1, m1, b2, m2, t0, t1, s0, h) -> Column:
    """Area below a graph made of two lines that change at t = v."""
    v, t0, t1 = map(lit, (v, t0, t1))
    turn = clamp(v, t0, t1)
    return area_line(b1, m1, t0, turn, s0, h) + area_line(b2, m2, turn, t1, s0, h)


def area_wedge(vt, vs, a1, a2, t0, t1, s0, h) -> Column:
    """Area of value_down for two half-lines leaving (vt, vs) at angles a1, a2.

    Half-lines to different sides form one broken graph.  Half-lines to the same
    side enclose a region, which carries value_down if the first half-line is its
    upper border and value_up if it is the lower one; everything outside, also
    the half-plane without a curve, carries the other value.
    """
    vt, vs, a1, a2, t0, t1, s0, h = map(lit, (vt, vs, a1, a2, t0, t1, s0, h))
    turn = clamp(vt, t0, t1)
    m1, m2 = F.tan(a1), F.tan(a2)
    b1, b2 = vs - m1 * vt, vs - m2 * vt
    right1, right2 = F.cos(a1) >= 0, F.cos(a2) >= 0

    def left(b, m):
        return area_line(b, m, t0, turn, s0, h)

    def right(b, m):
        return area_line(b, m, turn, t1, s0, h)

    whole = (t1 - t0) * h
    return (F.when(right1 & right2, right(b1, m1) - right(b2, m2) + F.when(m1 >= m2, 0.0).otherwise(whole))
            .when(~right1 & ~right2, left(b1, m1) - left(b2, m2) + F.when(m1 <= m2, 0.0).otherwise(whole))
            .when(right1, left(b2, m2) + right(b1, m1))
            .otherwise(left(b1, m1) + right(b2, m2)))


@F.pandas_udf(T.DoubleType())
def area_curve_poly(params: pd.Series, t0: pd.Series, t1: pd.Series,
                    s0: pd.Series, h: pd.Series) -> pd.Series:
    """Area below a polynomial of any degree, for a batch of rectangles."""
    out = np.zeros(len(params))
    deg = params.map(len).to_numpy() - 1
    t0, t1, s0, h = (x.to_numpy(dtype=float) for x in (t0, t1, s0, h))
    for d in np.unique(deg):
        at = np.flatnonzero(deg == d)
        c = np.stack([np.asarray(p, dtype=float) for p in params.iloc[at]])
        lo, hi, y0, yh = t0[at], t1[at], s0[at], h[at]
        points = [lo, hi]
        for y in (y0, y0 + yh):
            points += list(_real_roots(c - np.eye(d + 1)[0] * y[:, None], lo, hi).T)
        x = np.sort(np.clip(np.stack(points, axis=1), lo[:, None], hi[:, None]), axis=1)
        powers = np.arange(d + 1)
        mid = (x[:, 1:] + x[:, :-1]) / 2
        v = np.einsum("nk,nmk->nm", c, mid[..., None] ** powers) - y0[:, None]
        prim = np.einsum("nk,nmk->nm", c / (powers + 1), x[..., None] ** (powers + 1))
        width = np.diff(x, axis=1)
        inner = np.diff(prim, axis=1) - y0[:, None] * width
        out[at] = np.where(v <= 0, 0, np.where(v >= yh[:, None], yh[:, None] * width, inner)).sum(1)
    return pd.Series(out)


def _real_roots(c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Roots of each row's polynomial inside [lo, hi] (others are set to lo)."""
    n, d = len(c), c.shape[1] - 1
    if d == 0:
        return np.repeat(lo[:, None], 1, axis=1)
    lead = np.where(np.abs(c[:, -1]) < 1e-13, 1e-13, c[:, -1])
    comp = np.zeros((n, d, d))
    comp[:, np.arange(1, d), np.arange(d - 1)] = 1
    comp[:, :, -1] = -c[:, :-1] / lead[:, None]
    roots = np.linalg.eigvals(comp)
    real = (np.abs(roots.imag) < 1e-8 * (1 + np.abs(roots.real)))
    r = roots.real
    return np.where(real & (r > lo[:, None]) & (r < hi[:, None]), r, lo[:, None])


# ---------------------------------------------------------------- one entry point

def area_below(family: str, p: Column, t0, t1, s0, h) -> Column:
    """Area that carries value_down inside a rectangle."""
    if family == "line":
        return area_line(p[0], p[1], t0, t1, s0, h)
    if family == "quadratic":
        return area_quadratic(p[0], p[1], p[2], t0, t1, s0, h)
    if family == "arc":
        return area_arc(p[0], p[1], p[2], p[3], t0, t1, s0, h)
    if family == "corner":
        return area_broken(p[0], p[1], p[2], p[3], p[4], t0, t1, s0, h)
    if family == "wedge":
        return area_wedge(p[0], p[1], p[2], p[3], t0, t1, s0, h)
    if family == "curve_poly":
        p = F.array(*p) if isinstance(p, (list, tuple)) else p
        return area_curve_poly(p, lit(t0), lit(t1), lit(s0), lit(h))
    raise ValueError(f"no area for family {family!r}")


def rectangle_integral(family: str, m, x0, x1, y0, y1) -> Column:
    """Integral of a model over [x0, x1] x [y0, y1].

    x and y are measured along i and j from the centre of the model's cell; `m`
    is a struct column (or a dict of columns) with axis, params, value_up and
    value_down.
    """
    x0, x1, y0, y1 = map(lit, (x0, x1, y0, y1))
    p = m["params"]
    if family == "constant":
        return p[0] * (x1 - x0) * (y1 - y0)
    if family == "poly":
        return F.when(F.size(p) == 1, p[0] * (x1 - x0) * (y1 - y0)).otherwise(
            poly_area_any(p, x0, x1, y0, y1))
    first = m["axis"] == 0
    t0, t1 = F.when(first, x0).otherwise(y0), F.when(first, x1).otherwise(y1)
    s0 = F.when(first, y0).otherwise(x0) + 0.5
    h = F.when(first, y1 - y0).otherwise(x1 - x0)
    whole = (arc_width(p[0], p[2], t0, t1) if family == "arc" else (t1 - t0)) * h
    below = area_below(family, p, t0, t1, s0, h)
    return m["value_up"] * whole + (m["value_down"] - m["value_up"]) * below


def poly_area_any(p: Column, x0, x1, y0, y1) -> Column:
    """Tensor polynomial integral with the order read off the array's length; any order.

    Up to degree 2 the terms are written out; above, they are summed over the array.
    """
    x0, x1, y0, y1 = map(lit, (x0, x1, y0, y1))

    def term(k, n):
        a, b = F.floor(k / n) + 1, k % n + 1
        return F.get(p, k) * (F.pow(x1, a) - F.pow(x0, a)) / a * (F.pow(y1, b) - F.pow(y0, b)) / b

    out = _sum_over(p, term)
    for n in (3, 2):
        out = F.when(F.size(p) == n * n, poly2d_area(p, n, x0, x1, y0, y1)).otherwise(out)
    return out


def _sum_over(p: Column, term) -> Column:
    """Sum of term(k, order) over the coefficients of a tensor polynomial."""
    n = F.round(F.sqrt(F.size(p))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0.0), lambda acc, k: acc + term(k, n))


def _no_model(family: Column) -> Column:
    """NULL where there is no family; an error where it is none of those listed."""
    return F.when(family.isNotNull(), F.raise_error(F.concat(F.lit("family not listed: "), family)).cast("double"))


def model_integral(families, m, x0, x1, y0, y1) -> Column:
    """rectangle_integral for a column that mixes several families; one that is not listed is an error."""
    out = None
    for f in families:
        e = rectangle_integral(f, m, x0, x1, y0, y1)
        out = F.when(m["family"] == f, e) if out is None else out.when(m["family"] == f, e)
    return out.otherwise(_no_model(m["family"]))


def curve_height(family: str, p: Column, t: Column) -> Column:
    """f(t) of a curve family; NULL where it is undefined."""
    if family == "line":
        return p[0] + p[1] * t
    if family == "quadratic":
        return p[0] + t * (p[1] + t * p[2])
    if family == "curve_poly":
        return F.aggregate(F.reverse(p), F.lit(0.0), lambda acc, c: acc * t + c)
    if family == "arc":
        return arc_height(p[0], p[1], p[2], p[3], t)
    if family == "corner":
        return F.when(t < p[0], p[1] + p[2] * t).otherwise(p[3] + p[4] * t)
    raise ValueError(f"{family!r} is not the graph of a function")


def curve_eval(family: str, m: Column, t: Column, s: Column) -> Column:
    """value_up on and above the curve, value_down below, 0 where undefined."""
    p = m["params"]
    if family == "wedge":
        return _wedge_eval(m, t, s)
    y = curve_height(family, p, t)
    return F.when(y.isNull(), 0.0).when(s >= y, m["value_up"]).otherwise(m["value_down"])


def _wedge_eval(m: Column, t: Column, s: Column) -> Column:
    p = m["params"]
    right1, right2 = F.cos(p[2]) >= 0, F.cos(p[3]) >= 0
    y1, y2 = p[1] + F.tan(p[2]) * (t - p[0]), p[1] + F.tan(p[3]) * (t - p[0])
    here = t >= p[0]
    between = (right1 == here) & (s >= F.least(y1, y2)) & (s < F.greatest(y1, y2))
    first_above = (F.tan(p[2]) >= F.tan(p[3])) == right1
    y = F.when(right1 == here, y1).otherwise(y2)
    same = F.when(between == first_above, m["value_down"]).otherwise(m["value_up"])
    return F.when(right1 == right2, same).when(s >= y, m["value_up"]).otherwise(m["value_down"])


def model_eval(families, m: Column, x: Column, y: Column) -> Column:
    """Value of a model at (x, y), measured along i and j from its cell centre."""
    out = None
    first = m["axis"] == 0
    t, s = F.when(first, x).otherwise(y), F.when(first, y).otherwise(x) + 0.5
    for f in families:
        if f == "constant":
            e = m["params"][0]
        elif f == "poly":
            e = poly_eval_any(m["params"], x, y)
        else:
            e = curve_eval(f, m, t, s)
        out = F.when(m["family"] == f, e) if out is None else out.when(m["family"] == f, e)
    return out.otherwise(_no_model(m["family"]))


def poly_eval_any(p: Column, x: Column, y: Column) -> Column:
    """Value of a tensor polynomial of any order, read off the array's length."""
    out = _sum_over(p, lambda k, n: F.get(p, k) * F.pow(x, F.floor(k / n)) * F.pow(y, k % n))
    for n in (3, 2):
        out = F.when(F.size(p) == n * n, poly2d_eval(p, n, x, y)).otherwise(out)
    return F.when(F.size(p) == 1, p[0]).otherwise(out)


# ---------------------------------------------------------------- curve algebra

def line_from_angle(intercept, angle) -> Column:
    return F.array(lit(intercept), F.tan(lit(angle)))


def line_from_offset(r, angle, x0=0.0, y0=0.0) -> Column:
    """Line at signed distance r from (x0, y0) whose normal has the given angle."""
    r, angle, x0, y0 = map(lit, (r, angle, x0, y0))
    slope = -F.cos(angle) / F.sin(angle)
    return F.array(y0 + r / F.sin(angle) - slope * x0, slope)


def line_angle(slope: Column) -> Column:
    return F.atan(slope)


def quadratic_from_angle(c, angle, a) -> Column:
    return F.array(lit(c), F.tan(lit(angle)), lit(a))


def shift_curve(p: Column, degree: int, dx, dy) -> Column:
    """Coefficients of f(t - dx) + dy."""
    dx, dy = lit(dx), lit(dy)
    out = []
    for k in range(degree + 1):
        c = total(p[n] * F.lit(float(math.comb(n, k))) * F.pow(-dx, n - k) if n > k else p[n]
                  for n in range(k, degree + 1))
        out.append(c + dy if k == 0 else c)
    return F.array(*out)


def curve_slope(p: Column, degree: int, t: Column) -> Column:
    """Analytic derivative of a polynomial curve."""
    return total(F.lit(float(n)) * p[n] * (F.pow(t, n - 1) if n > 1 else F.lit(1.0))
                 for n in range(1, degree + 1))


def graph_slope(family: str, p: Column, t: Column) -> Column:
    """Derivative of curve_height at t; a corner has that of the line on t's side."""
    if family == "line":
        return p[1]
    if family == "quadratic":
        return p[1] + 2 * p[2] * t
    if family == "curve_poly":
        terms = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda c, n: c * (n + 1))
        return F.aggregate(F.reverse(terms), F.lit(0.0), lambda acc, c: acc * t + c)
    if family == "arc":
        gap = p[2] * p[2] - (t - p[0]) * (t - p[0])
        return F.when(gap > 0, p[3] * (p[0] - t) / F.sqrt(gap))
    if family == "corner":
        return F.when(t < p[0], p[2]).otherwise(p[4])
    raise ValueError(f"{family!r} is not the graph of a function")


def wedge_ray(p: Column, t: Column) -> tuple[Column, Column]:
    """Height and slope at t of the half-line on t's side; of the first one where both or none lie there."""
    here = t >= p[0]
    first = ((F.cos(p[2]) >= 0) == here) | ((F.cos(p[3]) >= 0) != here)
    slope = F.tan(F.when(first, p[2]).otherwise(p[3]))
    return p[1] + slope * (t - p[0]), slope


def circle_from_points(xs, ys) -> Column:
    """[xc, yc, r, side] of the circle through three points; NULL when collinear."""
    (x1, x2, x3), (y1, y2, y3) = [[lit(v) for v in vs] for vs in (xs, ys)]
    a11, a12, a21, a22 = x2 - x1, y2 - y1, x3 - x2, y3 - y2
    c1 = (x2 * x2 - x1 * x1 + y2 * y2 - y1 * y1) / 2
    c2 = (x3 * x3 - x2 * x2 + y3 * y3 - y2 * y2) / 2
    det = a11 * a22 - a12 * a21

    def build(d):
        xc, yc = (c1 * a22 - c2 * a12) / d, (a11 * c2 - a21 * c1) / d
        return let(F.struct(xc.alias("x"), yc.alias("y")), lambda o: F.array(
            o["x"], o["y"], F.sqrt((x1 - o["x"]) * (x1 - o["x"]) + (y1 - o["y"]) * (y1 - o["y"])),
            F.when((y3 - y2) * a11 > a12 * (x3 - x2), -1.0).otherwise(1.0)))

    return F.when(F.abs(det) > 1e-9, build(det))
