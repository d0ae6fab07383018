"""Curve proposals for cut cells, as Column expressions over windows.

A model is a `CurveModel`: a window size (kt along the independent axis, ks
along the dependent one) and a function from the column sums of the normalised
window to proposals.  Least squares on a fixed window is a literal matrix times
the sums, so nothing is solved at run time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from cellweave.functions.area import circle_from_points, quadratic_roots
from cellweave.functions.batches import above, as_known_lists, as_matrix, missing
from cellweave.functions.index import let, offsets, oriented, sub_window, total, weighted
from cellweave.schema import REGULAR, proposal

CENTER_WEIGHT = 100.0


# ---------------------------------------------------------------- side values

def levels_minmax(w: Column, wk: Column, size, axis: Column) -> Column:
    """Largest value above, smallest below."""
    return F.struct(F.array_min(w).alias("down"), F.array_max(w).alias("up"))


def levels_01(w: Column, wk: Column, size, axis: Column) -> Column:
    return F.struct(F.lit(0.0).alias("down"), F.lit(1.0).alias("up"))


def window_opposites(w: Column, wk: Column, size, axis: Column, k: int = 5) -> Column:
    """Regular cells of smallest and largest value in a k x k window.

    Returns struct(down, up) of struct(pos, di, dj, u), ordered along the
    dependent axis (pos is the offset along it), or NULL without a regular cell.
    Equal values are taken from the lowest position along the dependent axis,
    then along the other one.
    """
    masked = F.zip_with(sub_window(w, size, (k, k)), sub_window(wk, size, (k, k)),
                        lambda u, kind: F.when(kind == REGULAR, u))
    # positions along the dependent axis come first, so the first match is the lowest
    by_pos = let(masked, lambda x: F.when(axis == 0, sub_window(x, (k, k), (k, k), transposed=True)).otherwise(x))

    def cell(ms, value):
        n = (F.array_position(ms, value) - 1).cast("int")
        pos, other = F.floor(n / k).cast("int") - k // 2, F.pmod(n, F.lit(k)) - k // 2
        return F.struct(pos.alias("pos"), F.when(axis == 0, other).otherwise(pos).alias("di"),
                        F.when(axis == 0, pos).otherwise(other).alias("dj"), value.alias("u"))

    def pick(ms):
        ends = F.struct(cell(ms, F.array_min(ms)).alias("a"), cell(ms, F.array_max(ms)).alias("b"))
        return F.when(F.array_min(ms).isNotNull(), let(ends, lambda x: F.struct(
            F.when(x["b"]["pos"] < x["a"]["pos"], x["b"]).otherwise(x["a"]).alias("down"),
            F.when(x["b"]["pos"] < x["a"]["pos"], x["a"]).otherwise(x["b"]).alias("up"))))

    return let(by_pos, pick)


def levels_window(w: Column, wk: Column, size, axis: Column) -> Column:
    """Values of the pure cells on both sides, searched in the 5x5 window."""
    return let(window_opposites(w, wk, size, axis), lambda o: F.struct(
        o["down"]["u"].alias("down"), o["up"]["u"].alias("up")))


def levels_sided(w: Column, wk: Column, size, axis: Column, k: int = 5) -> Column:
    """Smallest and largest regular value of the k x k window, on the sides the data say.

    The upper half of the 3x3 neighbourhood (along the dependent axis) decides
    which of the two lies above; steep interfaces cannot swap the sides.
    """
    masked = F.zip_with(sub_window(w, size, (k, k)), sub_window(wk, size, (k, k)),
                        lambda u, kind: F.when(kind == REGULAR, u))
    near = sub_window(w, size, (3, 3))

    def rise(x):
        along_j = x[2] + x[5] + x[8] - x[0] - x[3] - x[6]
        along_i = x[6] + x[7] + x[8] - x[0] - x[1] - x[2]
        return F.when(axis == 0, along_j).otherwise(along_i)

    bound = F.struct(F.array_min(masked).alias("lo"), F.array_max(masked).alias("hi"), let(near, rise).alias("d"))
    return let(bound, lambda v: F.struct(F.when(v["d"] >= 0, v["lo"]).otherwise(v["hi"]).alias("down"),
                                         F.when(v["d"] >= 0, v["hi"]).otherwise(v["lo"]).alias("up")))


# ---------------------------------------------------------------- normalisation

def normalise(w: Column, wk: Column, up: Column, down: Column) -> Column:
    """Window values with 1 below the curve and 0 above it.

    Regular members snap to the nearer side value before scaling to [0, 1].
    """
    lo, hi, mid = F.least(up, down), F.greatest(up, down), (up + down) / 2
    span = F.when(hi == lo, 1.0).otherwise(hi - lo)

    def one(u, k):
        snapped = F.when((k == REGULAR) & (u < mid), lo).when((k == REGULAR) & (u > mid), hi).otherwise(u)
        x = (snapped - lo) / span
        return F.when(up > down, 1 - x).otherwise(x)

    return F.zip_with(w, wk, one)


def column_sums(norm: Column, kt: int, ks: int) -> Column:
    return F.array(*[total(norm[c * ks + s] for s in range(ks)) for c in range(kt)])


# ---------------------------------------------------------------- fits from sums

def poly_matrix(xs, degree: int, averages: bool) -> np.ndarray:
    x = np.asarray(xs, dtype=float)[:, None]
    p = np.arange(degree + 1)
    if averages:
        return ((x + .5) ** (p + 1) - (x - .5) ** (p + 1)) / (p + 1)
    return x ** p


def fit_matrix(xs, degree: int, averages: bool = True, weights=None) -> np.ndarray:
    """Rows give each coefficient as a linear combination of the column sums."""
    w = np.sqrt(np.ones(len(xs)) if weights is None else np.asarray(weights, dtype=float))
    return np.linalg.pinv(poly_matrix(xs, degree, averages) * w[:, None]) * w[None, :]


def apply_matrix(m: np.ndarray, sums, base: float) -> list:
    """Coefficients in cell coordinates; `base` is the lower edge of the window.  Sums are a column or a list of numbers."""
    out = [weighted(sums, row) for row in m]
    out[0] = out[0] + float(base)
    return out


@dataclass(frozen=True)
class CurveModel:
    """kt x ks window and a function sums -> list of params columns.

    `coefs`, where the parameters are plain sums and products, gives them as numbers for a list of numbers.
    """

    name: str
    kt: int
    ks: int
    family: str
    build: Callable[[Column], list[Column]]
    center_weight: float = 0.0
    coefs: Callable[[list], list[tuple]] | None = None

    @property
    def base(self) -> int:
        return -(self.ks // 2)


def _poly_family(degree: int) -> str:
    return {1: "line", 2: "quadratic"}.get(degree, "curve_poly")


def _plain(name: str, kt: int, ks: int, family: str, coefs: Callable[[list], list[tuple]]) -> CurveModel:
    return CurveModel(name, kt, ks, family, lambda s: [F.array(*p) for p in coefs(s)], coefs=coefs)


def lines_3slopes() -> CurveModel:
    """Lines through the middle sum with backward, forward and central slope."""
    def coefs(s):
        b = s[1] - 1
        return [(b, m) for m in (s[1] - s[0], s[2] - s[1], (s[2] - s[0]) / 2)]
    return _plain("lines_3slopes", 3, 3, "line", coefs)


def curve_averages(degree: int, kt: int | None = None, ks: int = 5, ccew: float = 0.0) -> CurveModel:
    """Polynomial whose column averages fit the sums, weighted towards the cell."""
    kt = kt or degree + 1
    xs = offsets(kt)
    w = np.exp(-np.square(np.asarray(xs, dtype=float)))
    w[kt // 2] += ccew
    m = fit_matrix(xs, degree, True, w)
    return _plain(f"curve_averages_{degree}", kt, ks, _poly_family(degree), lambda s: [apply_matrix(m, s, -(ks // 2))])


def curve_points(degree: int, kt: int | None = None, ks: int = 5, ccew: float = 0.0) -> CurveModel:
    """The same, with the sums taken as point values at the column centres."""
    kt = kt or degree + 1
    xs = offsets(kt)
    w = np.exp(-np.square(np.asarray(xs, dtype=float)))
    w[kt // 2] += ccew
    m = fit_matrix(xs, degree, False, w)
    return _plain(f"curve_points_{degree}", kt, ks, _poly_family(degree), lambda s: [apply_matrix(m, s, -(ks // 2))])


def line_consistent(kt: int = 3, ks: int = 5, ccew: float = CENTER_WEIGHT) -> CurveModel:
    """Weighted line, then moved so that the middle column is reproduced."""
    xs = offsets(kt)
    w = (np.abs(np.asarray(xs)) < 2).astype(float)
    w[kt // 2] += ccew
    m = fit_matrix(xs, 1, True, w)
    return _plain("line_consistent", kt, ks, "line", lambda s: [(s[kt // 2] - ks // 2, weighted(s, m[1]))])


def line_smoothed(averages: bool = False, kt: int = 3, ks: int = 5) -> CurveModel:
    """Line through the midpoints of neighbouring sums."""
    xs = np.asarray(offsets(kt), dtype=float)
    m = fit_matrix((xs[1:] + xs[:-1]) / 2, 1, averages)
    mid = (np.eye(kt)[1:] + np.eye(kt)[:-1]) / 2
    return _plain("line_smoothed", kt, ks, "line", lambda s: [apply_matrix(m @ mid, s, -(ks // 2))])


def circle_points(ks: int = 5) -> CurveModel:
    """Arc through three column sums."""
    base = -(ks // 2)
    return CurveModel("circle_points", 3, ks, "arc", lambda s: [
        circle_from_points((-1, 0, 1), [s[c] + F.lit(float(base)) for c in range(3)])])


def circle_taylor(ks: int = 5, ccew: float = 0.0, natural: bool = True) -> CurveModel:
    """Osculating circle of the fitted parabola at the middle.

    With natural=False the arc is taken through three of its own points, or
    through points of the parabola where the arc does not reach that far.
    """
    xs = offsets(3)
    w = np.exp(-np.square(np.asarray(xs, dtype=float)))
    w[1] += ccew
    m = fit_matrix(xs, 2, True, w)

    def build(s):
        c, b, a = apply_matrix(m, s, -(ks // 2))

        def arc(p):
            # the centre of curvature lies on the normal, 1 + b^2 over 2a above the curve
            c, b, a = p[0], p[1], p[2]
            above = (1 + b * b) / (2 * a)
            return F.when(F.abs(a) > 1e-9, F.array(-b * above, c + above, F.abs(above) * F.sqrt(1 + b * b), -F.signum(a)))

        coefs = F.array(c, b, a)
        if natural:
            return [let(coefs, arc)]

        def through(p, q):
            def y(t):
                gap = q[2] * q[2] - (t - q[0]) * (t - q[0])
                return q[1] + q[3] * F.sqrt(gap)

            def parabola(t):
                return p[0] + p[1] * t + p[2] * t * t

            reach = q[2] >= F.greatest(F.abs(-1 - q[0]), F.abs(1 - q[0]))
            return F.when(reach, circle_from_points((-1, 0, 1), [y(F.lit(t)) for t in (-1., 0., 1.)])).otherwise(
                circle_from_points((-1, 0, 1), [parabola(F.lit(t)) for t in (-1., 0., 1.)]))

        return [let(coefs, lambda p: let(arc(p), lambda q: through(p, q)))]

    return CurveModel("circle_taylor", 3, ks, "arc", build)


def start_curve(family: str) -> CurveModel:
    """Neutral curve through the middle of the cell, to start a refinement from."""
    flat = {"line": [.5, 0.], "quadratic": [.5, 0., 0.], "arc": [0., -.5, 1., 1.],
            "corner": [0., .5, 0., .5, 0.]}
    if family not in flat:
        raise ValueError(f"no start curve for {family!r}")
    return CurveModel(f"start_{family}", 1, 1, family,
                      lambda s: [F.array(*[F.lit(x) for x in flat[family]])], coefs=lambda s: [tuple(flat[family])])


def corner_4cols(ks: int = 7) -> CurveModel:
    """Two lines meeting above column 1 or 2 of four column sums (closed form).

    The outer columns beyond the vertex fix one line; the vertex solves
    B v^2 - 2 (A+B) v + (A+B) = 0 with the residuals A, B of the two columns on
    the other side.  The second position is the mirror image.
    """
    base = -(ks // 2)

    def one_side(s, mirrored):
        q = [s[c] for c in ((3, 2, 1, 0) if mirrored else (0, 1, 2, 3))]
        m = q[3] - q[2]
        b = q[3] - 3.5 * m
        A, B = q[1] - (1.5 * m + b), q[0] - (0.5 * m + b)

        def line(v):
            y = b + m * v
            left = m + B / (0.5 - v)
            # window coordinate x = t + 2.5; mirrored x -> 4 - x
            if not mirrored:
                p = [v - 2.5, y - left * v + left * 2.5 + base, left, b + m * 2.5 + base, m]
            else:
                p = [1.5 - v, b + m * 1.5 + base, -m, y - left * v + left * 1.5 + base, -left]
            return F.when((v >= 1) & (v <= 2), F.array(*p))

        roots = quadratic_roots(B, -2 * (A + B), A + B)
        return [F.when(F.abs(B) > 1e-10, let(v, line)) for v in roots]

    return CurveModel("corner_4cols", 4, ks, "corner",
                      lambda s: one_side(s, False) + one_side(s, True))


# ---------------------------------------------------------------- in batches

def _numbers(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(float, copy=False)


def turned(w: np.ndarray, size: tuple[int, int], kt: int, ks: int, first: np.ndarray) -> np.ndarray:
    """Rows of row-major windows cut to kt x ks and turned so that the independent axis, i where `first`, comes first."""
    w = w.reshape(len(w), *size)

    def part(a, b):
        at = [[n // 2 + d for d in offsets(k)] for n, k in zip(size, (a, b))]
        return w[:, at[0][0]:at[0][-1] + 1, at[1][0]:at[1][-1] + 1]

    return np.where(first[:, None, None], part(kt, ks), part(ks, kt).transpose(0, 2, 1))


def known_range(u: np.ndarray, gone: np.ndarray, kind: np.ndarray, size, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest regular value of the k x k middle of each window, and whether there is one."""
    cut = [(size[0] // 2 + a) * size[1] + size[1] // 2 + b for a in offsets(k) for b in offsets(k)]
    seen, known = ((kind == REGULAR) & ~gone)[:, cut], u[:, cut]
    with np.errstate(all="ignore"):
        lo = np.fmin.reduce(np.where(seen, known, np.nan), axis=1)
        hi = np.where(seen, known, -np.inf).max(axis=1)
    return lo, hi, seen.any(axis=1)


def sides_of(lo: np.ndarray, hi: np.ndarray, near: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values below and above, by the rise across turned 3 x 3 windows (`lost`: where they hold NULL)."""
    with np.errstate(all="ignore"):
        d = near[:, 0, 2] + near[:, 1, 2] + near[:, 2, 2] - near[:, 0, 0] - near[:, 1, 0] - near[:, 2, 0]
        rises = ~lost[:, :, [0, 2]].any(axis=(1, 2)) & ((d >= 0) | np.isnan(d))
    return np.where(rises, lo, hi), np.where(rises, hi, lo)


def sums_of(u: np.ndarray, lost: np.ndarray, regular: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column sums of turned windows after normalising them, and which of them are NULL."""
    out, unknown = np.empty(u.shape[:2]), lost.any(axis=2)
    with np.errstate(all="ignore"):
        lo, hi, mid = np.fmin(up, down), np.maximum(up, down), (up + down) / 2
        span = np.where((hi == lo) | (np.isnan(hi) & np.isnan(lo)), 1.0, hi - lo)
        falls = above(up, down)
        for c in range(u.shape[1]):
            total = None
            for s in range(u.shape[2]):
                v, r = u[:, c, s], regular[:, c, s]
                x = (np.where(r & above(mid, v), lo, np.where(r & above(v, mid), hi, v)) - lo) / span
                x = np.where(falls, 1 - x, x)
                total = x if total is None else total + x
            out[:, c] = total
    return out, unknown


def batched_levels_sided(w: Column, wk: Column, size, axis: Column, k: int = 5) -> Column:
    """levels_sided as array(down, up), evaluated in Arrow batches instead of row by row."""
    cells = size[0] * size[1]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def levels(w: pa.Array, wk: pa.Array, axis: pa.Array) -> pa.Array:
        u, gone, first = as_matrix(w, cells), missing(w, cells), _numbers(axis) == 0
        lo, hi, seen = known_range(u, gone, as_matrix(wk, cells), size, k)
        both = np.stack(sides_of(lo, hi, turned(u, size, 3, 3, first), turned(gone, size, 3, 3, first)), axis=1)
        return as_known_lists(both, np.repeat(~seen[:, None], 2, axis=1))

    return levels(w, wk, axis.cast("int"))


def batched_sums(w: Column, wk: Column, size, kt: int, ks: int, axis: Column, up: Column, down: Column) -> Column:
    """Column sums of the turned and normalised kt x ks window, evaluated in Arrow batches instead of row by row."""
    cells = size[0] * size[1]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def sums(w: pa.Array, wk: pa.Array, axis: pa.Array, up: pa.Array, down: pa.Array) -> pa.Array:
        first, parts = _numbers(axis) == 0, (as_matrix(w, cells), missing(w, cells), as_matrix(wk, cells) == REGULAR)
        return as_known_lists(*sums_of(*[turned(x, size, kt, ks, first) for x in parts], _numbers(up), _numbers(down)))

    return sums(w, wk, axis.cast("int"), up, down)


# ---------------------------------------------------------------- assembling

def proposals_of(model: CurveModel, model_idx: int, sums: Column, axis: Column, rank: Column, up: Column, down: Column) -> Column:
    """array<PROPOSAL> of one model whose column sums are known."""
    def made(s):
        return F.array(*[proposal(model_idx, rank, c, axis, model.family, p, up, down) for c, p in enumerate(model.build(s))])

    # the closed form of corners is too long for generated code
    return let(sums, made) if model.family == "corner" else made(sums)


def curve_proposals(model: CurveModel, model_idx: int, w: Column, wk: Column, size: tuple[int, int],
                    axis: Column, rank: Column, levels: Column) -> Column:
    """array<PROPOSAL> of one model for one axis; `levels` is struct(down, up)."""
    kt, ks = model.kt, model.ks
    norm = normalise(oriented(w, size, kt, ks, axis), oriented(wk, size, kt, ks, axis),
                     levels["up"], levels["down"])
    return let(norm, lambda n: let(column_sums(n, kt, ks), lambda s: F.array(*[
        proposal(model_idx, rank, c, axis, model.family, p, levels["up"], levels["down"])
        for c, p in enumerate(model.build(s))])))
