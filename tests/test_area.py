"""Closed-form areas against a fine midpoint rule."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import area as A

RNG = np.random.default_rng(7)
N = 60


def midpoint(f, t0, t1, s0, h, m=4000):
    t = t0 + (np.arange(m) + 0.5) * (t1 - t0) / m
    return np.nansum(np.clip(f(t) - s0, 0, h)) * (t1 - t0) / m


def boxes(n=N):
    t0, s0 = RNG.uniform(-1.5, 1, n), RNG.uniform(-1.5, 1, n)
    return np.stack([t0, t0 + RNG.uniform(.1, 1.2, n), s0, RNG.uniform(.1, 1.2, n)], 1)


def frame(spark, params, box):
    rows = [([float(x) for x in p], *[float(x) for x in b]) for p, b in zip(params, box)]
    return spark.createDataFrame(rows, "p array<double>, t0 double, t1 double, s0 double, h double")


CASES = {
    "line": (lambda n: RNG.uniform(-2, 2, (n, 2)), lambda p, t: p[0] + p[1] * t),
    "quadratic": (lambda n: RNG.uniform(-2, 2, (n, 3)), lambda p, t: p[0] + p[1] * t + p[2] * t * t),
    "curve_poly": (lambda n: RNG.uniform(-2, 2, (n, 5)), lambda p, t: sum(c * t ** k for k, c in enumerate(p))),
    "corner": (lambda n: RNG.uniform(-1, 1, (n, 5)),
               lambda p, t: np.where(t < p[0], p[1] + p[2] * t, p[3] + p[4] * t)),
}


@pytest.mark.parametrize("family", CASES)
def test_graph_areas(spark, family):
    make, f = CASES[family]
    params, box = make(N), boxes()
    out = frame(spark, params, box).select(
        A.area_below(family, F.col("p"), F.col("t0"), F.col("t1"), F.col("s0"), F.col("h")).alias("a")).collect()
    for p, b, r in zip(params, box, out):
        assert r.a == pytest.approx(midpoint(lambda t: f(p, t), *b), abs=2e-4)


def test_flat_and_steep_lines(spark):
    params = [[.3, 0.], [.3, 1e-9], [.3, 1e-6], [0., 1e8], [.5, -1e8]]
    box = [[-.5, .5, 0., 1.]] * len(params)
    out = [r.a for r in frame(spark, params, box).select(
        A.area_below("line", F.col("p"), F.col("t0"), F.col("t1"), F.col("s0"), F.col("h")).alias("a")).collect()]
    assert np.allclose(out, [.3, .3, .3, .5, .5], atol=1e-6)


def test_arc_and_disc(spark):
    params = np.stack([RNG.uniform(-1, 1, N), RNG.uniform(-1, 1, N), RNG.uniform(.2, 1.5, N),
                       RNG.choice([-1., 1.], N)], 1)
    box = boxes()
    p, args = F.col("p"), [F.col(c) for c in ("t0", "t1", "s0", "h")]
    out = frame(spark, params, box).select(
        A.area_below("arc", p, *args).alias("a"), A.area_disc(p[0], p[1], p[2], *args).alias("d"),
        A.arc_width(p[0], p[2], F.col("t0"), F.col("t1")).alias("w")).collect()

    def half(p, side):
        def f(t):
            with np.errstate(invalid="ignore"):
                return p[1] + side * np.sqrt(p[2] ** 2 - (t - p[0]) ** 2)
        return f

    for p, b, r in zip(params, box, out):
        assert r.a == pytest.approx(midpoint(half(p, p[3]), *b), abs=1e-3)
        assert r.d == pytest.approx(midpoint(half(p, 1), *b) - midpoint(half(p, -1), *b), abs=2e-3)
        assert 0 <= r.w <= b[1] - b[0] + 1e-12


def test_wedge_matches_pointwise_evaluation(spark):
    n = 40
    params = np.stack([RNG.uniform(-.4, .4, n), RNG.uniform(0, 1, n), RNG.uniform(-3, 3, n),
                       RNG.uniform(-3, 3, n)], 1)
    m = F.struct(F.lit(0).alias("axis"), F.lit("wedge").alias("family"), F.col("p").alias("params"),
                 F.lit(0.).alias("value_up"), F.lit(1.).alias("value_down"))
    k = 60
    df = frame(spark, params, [[-.5, .5, 0., 1.]] * n).withColumn("id", F.monotonically_increasing_id())
    exact = df.select("id", A.rectangle_integral("wedge", m, -.5, .5, -.5, .5).alias("a"))
    pts = (df.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
           .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
           .withColumn("v", A.curve_eval("wedge", m, (F.col("a") + .5) / k - .5, (F.col("b") + .5) / k))
           .groupBy("id").agg(F.avg("v").alias("v")))
    for r in exact.join(pts, "id").collect():
        assert r.a == pytest.approx(r.v, abs=.03)


def test_polynomial_surface(spark):
    c = [1., 2., 3., 4.]
    df = spark.createDataFrame([(c,)], "c array<double>")
    r = df.select(A.poly2d_area(F.col("c"), 2, 0, 1, 0, 1).alias("a"),
                  A.poly2d_eval(F.col("c"), 2, F.lit(2.), F.lit(3.)).alias("v")).first()
    assert r.a == pytest.approx(1 + 2 / 2 + 3 / 2 + 4 / 4) and r.v == pytest.approx(1 + 6 + 6 + 24)


def test_curve_algebra(spark):
    one = spark.range(1)
    r = one.select(
        A.line_from_offset(.25, math.pi / 3, .5, .5).alias("off"),
        A.line_from_angle(.2, math.pi / 4).alias("ang"),
        A.shift_curve(F.array(F.lit(1.), F.lit(2.), F.lit(3.)), 2, .5, 10).alias("sh"),
        A.curve_slope(F.array(F.lit(1.), F.lit(2.), F.lit(3.)), 2, F.lit(2.)).alias("sl"),
        A.circle_from_points((0., 1., 2.), (0., 1., 0.)).alias("cap"),
        A.circle_from_points((-1., 0., 1.), (0., -1., 0.)).alias("cup"),
        A.circle_from_points((0., 1., 2.), (0., 1., 2.)).alias("none")).first()
    m = -1 / math.tan(math.pi / 3)
    x, y = .5 + .25 * math.cos(math.pi / 3), .5 + .25 * math.sin(math.pi / 3)
    assert r.off == pytest.approx([y - m * x, m]) and r.ang == pytest.approx([.2, 1.])
    assert sum(v * 1.5 ** k for k, v in enumerate(r.sh)) == pytest.approx(10 + 1 + 2 + 3)
    assert r.sl == pytest.approx(14) and r.none is None
    assert r.cap == pytest.approx([1, 0, 1, 1]) and r.cup == pytest.approx([0, 0, 1, -1])


def test_polynomials_of_high_order(spark):
    """A cubic in both directions, and families that are not listed."""
    p = [float(k % 5 - 2) for k in range(16)]
    row = spark.range(1).select(
        A.poly_eval_any(F.array(*map(F.lit, p)), F.lit(.5), F.lit(-.3)).alias("v"),
        A.poly_area_any(F.array(*map(F.lit, p)), -.5, .5, 0., .4).alias("a")).first()
    assert row.v == pytest.approx(sum(p[a * 4 + b] * .5 ** a * (-.3) ** b for a in range(4) for b in range(4)))
    assert row.a == pytest.approx(sum(p[a * 4 + b] * (.5 ** (a + 1) - (-.5) ** (a + 1)) / (a + 1) * .4 ** (b + 1) / (b + 1)
                                      for a in range(4) for b in range(4)))
    m = {"axis": F.lit(0), "family": F.lit("arc"), "params": F.array(F.lit(1.0)), "value_up": F.lit(0.0), "value_down": F.lit(1.0)}
    with pytest.raises(Exception, match="family not listed"):
        spark.range(1).select(A.model_integral(("constant",), m, 0., 1., 0., 1.)).collect()
