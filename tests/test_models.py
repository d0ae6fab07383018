"""Exactness of surface and curve models, transfer and resampling invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import area as A
from cellweave.functions.index import map_index
from cellweave.operators import curves as C
from cellweave.operators import surfaces as SF
from cellweave.operators import transfer as TR
from cellweave.operators.labels import label_piecewise
from cellweave.operators.resample import resample_average
from cellweave.plans.reconstruct import PRESETS, fit_cells
from cellweave.schema import CELLS, EXTEND, GRIDS, GridShape

RNG = np.random.default_rng(5)


def cell_means(c, n):
    """Averages of sum c[a, b] x^a y^b on an n x n grid, coordinates in cells."""
    x = np.arange(n + 1.0)
    out = np.zeros((n, n))
    for (a, b), v in np.ndenumerate(c):
        px, py = np.diff(x ** (a + 1)) / (a + 1), np.diff(x ** (b + 1)) / (b + 1)
        out += v * np.outer(px, py)
    return out


def table(spark, a, si=None):
    rows = [("g", int(i), int(j), float(v), float(si[i, j]) if si is not None else 0.0)
            for (i, j), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "grid_id string, i int, j int, u double, si double")


CONST, PLANE, BILINEAR = [[1.5]], [[1., -.3], [.7, 0.]], [[1., -.3], [.7, .4]]
QUAD = [[1., -.3, .2], [.7, .4, 0.], [-.1, 0., 0.]]
SYMMETRIC = [[1., -.3, .2], [.7, .4, 0.], [.2, 0., 0.]]
FULL = RNG.uniform(-.1, .1, (3, 3)).tolist()


@pytest.mark.parametrize("method,options,coefs", [
    ("mirror", {"k": 1}, CONST), ("poly", {"degree": 1}, PLANE), ("poly", {"degree": 2}, QUAD),
    ("poly", {"degree": 1, "full_rank": True}, BILINEAR), ("poly", {"degree": 2, "full_rank": True}, FULL),
    ("weighted", {"degree": 1, "weight": "center", "center_weight": 3.}, PLANE),
    ("weighted", {"degree": 1, "weight": "center_smooth", "center_weight": 3.}, PLANE),
    ("weighted", {"degree": 1, "weight": "distance"}, PLANE),
    ("weighted", {"degree": 1, "weight": "smoothness", "center_weight": 1.}, PLANE),
    ("weno2d", {"degree": 1}, BILINEAR), ("weno1d", {"coefs": 4}, BILINEAR)])
def test_surface_models_reproduce_their_polynomials(spark, method, options, coefs):
    n = 9
    c = np.array(coefs)
    si = RNG.uniform(0, 1, (n, n))
    fits = SF.surface_fits(table(spark, cell_means(c, n), si), GridShape(n, n, EXTEND, EXTEND), method,
                           **{"k": 3, **options}).filter("i between 2 and 6 and j between 2 and 6")
    x, y = .3, -.2
    v = fits.select("i", "j", A.poly_eval_any(F.col("params"), F.lit(x), F.lit(y)).alias("v")).collect()
    assert len(v) == 25
    for r in v:
        want = sum(k * (r.i + .5 + x) ** a * (r.j + .5 + y) ** b for (a, b), k in np.ndenumerate(c))
        assert r.v == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("method,options,coefs", [
    ("weno2d", {"degree": 2}, SYMMETRIC), ("weno1d", {"coefs": 5}, SYMMETRIC), ("weno1d", {"coefs": 9}, FULL),
    ("weno1d_points", {"coefs": 9}, FULL)])
def test_corner_models_of_second_order(spark, method, options, coefs):
    """Equal smoothness everywhere gives the linear weights, which are exact for quadratics."""
    n = 9
    c = np.array(coefs)
    fits = SF.surface_fits(table(spark, cell_means(c, n)), GridShape(n, n, EXTEND, EXTEND), method, **options)
    for r in fits.filter("i between 2 and 6 and j between 2 and 6").select(
            "i", "j", A.poly_eval_any(F.col("params"), F.lit(.1), F.lit(.4)).alias("v")).collect():
        want = sum(k * (r.i + .6) ** a * (r.j + .9) ** b for (a, b), k in np.ndenumerate(c))
        assert r.v == pytest.approx(want, abs=1e-7)


def test_index_maps(spark):
    cases = [("extend", 0, 2, 0), ("extend", -1, 2, 0), ("extend", 2, 2, 1), ("extend", 5, 5, 4),
             ("cyclic", -1, 2, 1), ("cyclic", -1, 5, 4), ("cyclic", 2, 2, 0), ("cyclic", 5, 5, 0), ("cyclic", 3, 2, 1),
             ("reflect", -2, 5, 2), ("reflect", 5, 5, 3), ("reflect", 4, 5, 4), ("reflect", 0, 1, 0)]
    df = spark.createDataFrame(cases, "mode string, i int, n int, want int")
    got = df.withColumn("got", map_index(F.col("i"), F.col("n"), F.col("mode"))).collect()
    assert all(r.got == r.want for r in got)
    with pytest.raises(ValueError):
        GridShape(2, 2, "mirror", "cyclic")


def sums_frame(spark, rows):
    return spark.createDataFrame([([float(x) for x in r],) for r in rows], "s array<double>")


def test_corner_closed_form_reintegrates(spark):
    """Column sums of random corners: one of the proposals gives the sums back."""
    base, rows, want = -3, [], []
    for _ in range(60):
        v, m1, m2, y = RNG.uniform(-1.4, -.6), RNG.uniform(-1, 1), RNG.uniform(-1, 1), RNG.uniform(0, 1)
        if RNG.random() < .5:
            v += 1
        if abs(m1 - m2) < .05:
            continue
        f = lambda t: np.where(t < v, y + m1 * (t - v), y + m2 * (t - v))
        rows.append([np.mean(f(c - .5 + (np.arange(20000) + .5) / 20000)) - base for c in (-2, -1, 0, 1)])
        want.append((v, y))
    model = C.corner_4cols()
    out = sums_frame(spark, rows).select(F.filter(F.array(*model.build(F.col("s"))), lambda p: p.isNotNull()).alias("p")).collect()
    for r, (v, y) in zip(out, want):
        assert any(abs(p[0] - v) < 1e-3 and abs(p[1] + p[2] * p[0] - y) < 1e-3 for p in r.p)


def test_circles_from_sums(spark):
    def averages(tc, sc, r):
        t = (np.arange(20000) + .5) / 20000
        return [np.mean(sc + np.sqrt(r * r - (c - .5 + t - tc) ** 2)) + 2 for c in (-1, 0, 1)]

    rows = [averages(.2, -8., 8.5), averages(-.4, -12., 12.3)]
    for r, (tc, sc, rad) in zip(sums_frame(spark, rows).select(
            C.circle_taylor().build(F.col("s"))[0].alias("a"),
            C.circle_taylor(natural=False).build(F.col("s"))[0].alias("b")).collect(),
            [(.2, -8., 8.5), (-.4, -12., 12.3)]):
        assert r.a == pytest.approx([tc, sc, rad, 1.], rel=.05, abs=.1)
        assert r.b == pytest.approx(r.a, rel=1e-6)


@pytest.mark.parametrize("velocity", [(0.3, 0.0), (0.0, -0.7), (0.25, 0.5), (-0.4, 0.2), (1.0, 1.0)])
def test_transfer_keeps_mass(spark, velocity):
    a = np.clip(RNG.uniform(-.5, 1.5, (10, 10)), 0, 1)
    cells = spark.createDataFrame([("g", int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(a)], CELLS)
    shape = GridShape(10, 10)
    fits = fit_cells(label_piecewise(cells), shape, PRESETS["constant"])
    out = TR.transfer_once(fits, shape, velocity, ("constant",))
    b = np.zeros_like(a)
    for r in out.collect():
        b[r.i, r.j] = r.u
    vi, vj = velocity
    want = np.zeros_like(a)
    for wi, di in ((1 - abs(vi), 0), (abs(vi), int(np.sign(vi)))):
        for wj, dj in ((1 - abs(vj), 0), (abs(vj), int(np.sign(vj)))):
            want += wi * wj * np.roll(a, (di, dj), (0, 1))
    assert np.allclose(b, want)
    if 0 in velocity:
        up = {(r.i, r.j): r.u for r in TR.upwind_once(cells, shape, velocity).collect()}
        assert all(abs(up[k] - b[k]) < 1e-12 for k in up)


def test_resampling_keeps_the_mean_of_polynomials(spark):
    n = 6
    cells = table(spark, cell_means(np.array(QUAD), n))
    fits = SF.surface_fits(cells, GridShape(n, n, EXTEND, EXTEND), "poly", 3, degree=2).withColumns(
        {"axis": F.lit(0), "value_up": F.lit(0.), "value_down": F.lit(0.)}).filter("i between 1 and 4 and j between 1 and 4")
    fine = resample_average(fits, 3, 2, families=("poly",))
    back = fine.groupBy(F.floor(F.col("i") / 3).alias("i"), F.floor(F.col("j") / 2).alias("j")).agg(F.avg("u").alias("v"))
    assert back.join(cells, ["i", "j"]).filter("abs(u - v) > 1e-9").count() == 0 and back.count() == 16


def test_same_fit_for_any_partitioning_and_for_a_grids_table(spark):
    a = np.clip(RNG.uniform(-.5, 1.5, (40, 10)), 0, 1)
    cells = label_piecewise(spark.createDataFrame(
        [("g", int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(a)], CELLS))
    grids = spark.createDataFrame([("g", 40, 10, "cyclic", "cyclic")], GRIDS)
    seen = []
    for parts, shape in ((1, GridShape(40, 10)), (7, GridShape(40, 10)), (3, grids)):
        fits = fit_cells(cells.repartition(parts), shape, PRESETS["elvira_w"])
        seen.append(sorted((r.i, r.j, r.family, r.cand, round(r.loss or 0, 12)) for r in fits.collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 400
