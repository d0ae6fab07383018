"""Queries on areas, local models, scoring, selection, resampling and transfer."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cellweave.functions import area as A
from cellweave.operators import curves as C
from cellweave.operators import grid_ops as G
from cellweave.operators import resample as RS
from cellweave.operators import surfaces as SF
from cellweave.operators import transfer as TR
from cellweave.operators.scoring import winner_counts
from cellweave.plans.fixtures import (PATCH, PATCH_SQL, arc_area_sql, area_line_sql, column_sums_sql, labelled_patch, patch,
                                      sums_sql, table, window_sql)
from cellweave.plans.queries_grid import r6
from cellweave.plans.reconstruct import PRESETS, Preset, fit_cells, fit_sweep, proposal_arrays, scored_proposals
from cellweave.plans.registry import query, rounded
from cellweave.schema import CUT, KEY


# ---------------------------------------------------------------- areas on coefficients from the embeddings

def coefficients(spark, d):
    """vec_id, k and five coefficients in [-1, 1] from the vector's entries, five at a time; the last five overlap."""
    e = table(spark, d, "embeddings")
    n = F.size("embedding")
    first = F.least(F.col("k") * 5, n - 5)
    groups = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.floor((n + 4) / 5).cast("int") - 1)).alias("k"))
    return groups.select("vec_id", "k", *[(4 * F.get("embedding", first + i).cast("double")).alias(f"c{i}") for i in range(5)])


COEF_SQL = """coef AS MATERIALIZED (SELECT vec_id, k, """ + ", ".join(
    f"4 * CAST(embedding[least(k * 5, len(embedding) - 5) + {n + 1}] AS DOUBLE) AS c{n}" for n in range(5)) + """
FROM (SELECT vec_id, embedding, CAST(unnest(range((len(embedding) + 4) // 5)) AS INTEGER) AS k FROM embeddings))"""


def coef_query(name, columns, sql):
    """Register a per-row expression over the coefficients table."""
    @query(name, f"WITH {COEF_SQL} SELECT vec_id, k, {sql} FROM coef")
    def run(spark, d):
        return rounded(coefficients(spark, d).select("vec_id", "k", *columns()))
    return run


def c(n):
    return F.col(f"c{n}")


coef_query("poly2d_value_and_area", lambda: [
    A.poly2d_eval(F.array(c(0), c(1), c(2), c(3)), 2, F.lit(.3), F.lit(-.4)).alias("value"),
    A.poly2d_area(F.array(c(0), c(1), c(2), c(3)), 2, -.5, .25, -.5, .5).alias("area")],
    r6("c0 + c1 * -.4 + c2 * .3 + c3 * .3 * -.4", "value") + ", "
    + r6("0.75 * c0 + c2 * (.0625 - .25) / 2", "area"))

coef_query("area_line", lambda: [A.area_line(c(0), c(1), -.5, .5, 0, 1).alias("area")],
           r6(area_line_sql("c0", "c1", "-0.5", "0.5", "0.0"), "area"))


def above_sql(y):
    """Integral of max(f - y, 0) for f = c0 + c1 t + c2 t^2 on [-.5, .5]."""
    def prim(t):
        return f"((c0 - ({y})) * ({t}) + c1 * ({t}) * ({t}) / 2 + c2 * ({t}) * ({t}) * ({t}) / 3)"
    disc = f"(c1 * c1 - 4 * c2 * (c0 - ({y})))"
    ra, rb = f"((-c1 - sqrt({disc})) / (2 * c2))", f"((-c1 + sqrt({disc})) / (2 * c2))"
    lo = f"greatest(-.5, least(.5, least({ra}, {rb})))"
    hi = f"greatest(-.5, least(.5, greatest({ra}, {rb})))"
    whole = f"({prim('.5')} - {prim('-.5')})"
    return (f"(CASE WHEN {disc} <= 0 THEN CASE WHEN c2 > 0 THEN {whole} ELSE 0 END "
            f"WHEN c2 > 0 THEN {whole} - ({prim(hi)} - {prim(lo)}) ELSE {prim(hi)} - {prim(lo)} END)")


coef_query("area_quadratic", lambda: [A.area_quadratic(c(0), c(1), c(2), -.5, .5, 0, 1).alias("area")],
           r6(f"CASE WHEN abs(c2) < 1e-4 THEN NULL ELSE {above_sql('0')} - {above_sql('1')} END", "area"))
coef_query("curve_eval", lambda: [F.when(
    F.lit(.1) >= c(0) + c(1) * .2 + c(2) * .04, 2.0).otherwise(3.0).alias("plain"),
    A.curve_eval("quadratic", {"params": [c(0), c(1), c(2)], "value_up": F.lit(2.0), "value_down": F.lit(3.0)},
                 F.lit(.2), F.lit(.1)).alias("value")],
    "CAST(CASE WHEN .1 >= c0 + c1 * .2 + c2 * .04 THEN 2 ELSE 3 END AS DOUBLE) AS plain, "
    "CAST(CASE WHEN .1 >= c0 + c1 * .2 + c2 * .04 THEN 2 ELSE 3 END AS DOUBLE) AS value")
coef_query("line_parametrisations", lambda: [
    A.line_from_angle(c(0), c(1))[1].alias("slope"), A.line_angle(c(2)).alias("angle"),
    A.line_from_offset(c(0), c(1) + 1.6, .5, .5)[0].alias("off_b"),
    A.line_from_offset(c(0), c(1) + 1.6, .5, .5)[1].alias("off_m"),
    A.quadratic_from_angle(c(0), c(1), c(2))[1].alias("qa")],
    ", ".join([r6("tan(c1)", "slope"), r6("atan(c2)", "angle"),
               r6("0.5 + c0 * sin(c1 + 1.6) + 1 / tan(c1 + 1.6) * (0.5 + c0 * cos(c1 + 1.6))", "off_b"),
               r6("-1 / tan(c1 + 1.6)", "off_m"), r6("tan(c1)", "qa")]))
coef_query("shift_curve", lambda: [A.shift_curve(F.array(c(0), c(1), c(2)), 2, .5, 2)[n].alias(f"s{n}") for n in range(3)],
           ", ".join([r6("c0 - .5 * c1 + .25 * c2 + 2", "s0"), r6("c1 - c2", "s1"), r6("c2", "s2")]))
coef_query("curve_slope", lambda: [A.curve_slope([c(0), c(1), c(2), c(3)], 3, F.lit(.3)).alias("slope")],
           r6("c1 + 2 * c2 * .3 + 3 * c3 * .09", "slope"))

# circles through nearly collinear points have radii whose digits differ between engines, so all rows are compared by
# the curvature and by the heights at the given points
CURVATURE = "2 * d / sqrt((1 + pow(c1 - c0, 2)) * (1 + pow(c2 - c1, 2)) * (4 + pow(c2 - c0, 2)))"


@query("circle_from_points", f"""WITH {COEF_SQL}, q AS (SELECT *, c2 - 2 * c1 + c0 AS d FROM coef)
SELECT vec_id, k, round(CASE WHEN abs(d) > 1e-9 THEN {CURVATURE} ELSE 0 END, 6) + 0.0 AS curvature,
  CASE WHEN abs(d) > 1e-9 THEN round(c1, 4) + 0.0 END AS middle FROM q""")
def circle_from_points(spark, d):
    p = A.circle_from_points((-1, 0, 1), (c(0), c(1), c(2)))
    x = coefficients(spark, d).withColumn("p", p)
    p = F.col("p")
    # height over t = 0 on the side where the middle point lies; far centres cancel, so the root is taken of a product
    off = p[0] * p[0] / (p[2] + F.sqrt(F.greatest(p[2] * p[2] - p[0] * p[0], F.lit(0.0))))
    upper, lower = p[1] + p[2] - off, p[1] - p[2] + off
    middle = F.when(F.abs(upper - c(1)) <= F.abs(lower - c(1)), upper).otherwise(lower)
    return x.select("vec_id", "k", (F.round(F.coalesce(-p[3] / p[2], F.lit(0.0)), 6) + 0.0).alias("curvature"),
                    (F.round(middle, 4) + 0.0).alias("middle"))


def broken_sql(v, lines):
    """Area below two lines (b, m) that meet at t = v."""
    turn = f"greatest(-0.5, least(0.5, {v}))"
    return f"({area_line_sql(*lines[0], '-0.5', turn, '0.0')} + {area_line_sql(*lines[1], turn, '0.5', '0.0')})"


def wedge_sql(vt, vs, a1, a2):
    """Half-lines to both sides are a broken graph; to one side, a strip between two lines, which is up below the lower angle."""
    turn = f"greatest(-0.5, least(0.5, {vt}))"
    one, two = [(f"({vs} - tan({a}) * {vt})", f"tan({a})") for a in (a1, a2)]

    def part(line, right):
        return area_line_sql(*line, *((turn, "0.5") if right else ("-0.5", turn)), "0.0")
    return f"""(CASE WHEN cos({a1}) >= 0 AND cos({a2}) >= 0 THEN {part(one, 1)} - {part(two, 1)} + CASE WHEN tan({a1}) >= tan({a2}) THEN 0 ELSE 1 END
  WHEN cos({a1}) < 0 AND cos({a2}) < 0 THEN {part(one, 0)} - {part(two, 0)} + CASE WHEN tan({a1}) <= tan({a2}) THEN 0 ELSE 1 END
  WHEN cos({a1}) >= 0 THEN {part(two, 0)} + {part(one, 1)} ELSE {part(one, 0)} + {part(two, 1)} END)"""


ARC = ("c0", "c1", "(abs(c2) + 0.2)")
AREA_SQL = {"arc": arc_area_sql(*ARC, "c3"), "corner": broken_sql("c0 / 2", (("c1", "c2"), ("c3", "c4"))), "wedge": wedge_sql("(c0 / 2)", "c1", "(3 * c2)", "(3 * c3)")}
for fam, cols in {"curve_poly": lambda: F.array(*[c(n) for n in range(5)]),
                  "arc": lambda: F.array(c(0), c(1), F.abs(c(2)) + .2, F.signum(c(3))),
                  "corner": lambda: F.array(c(0) / 2, c(1), c(2), c(3), c(4)),
                  "wedge": lambda: F.array(c(0) / 2, c(1), 3 * c(2), 3 * c(3))}.items():
    @query(f"area_{fam}", f"WITH {COEF_SQL} SELECT vec_id, k, {r6(AREA_SQL[fam], 'area')} FROM coef" if fam in AREA_SQL else None)
    def family_area(spark, d, fam=fam, cols=cols):
        x = coefficients(spark, d).withColumn("p", cols())
        a = A.area_below(fam, F.col("p"), F.lit(-.5), F.lit(.5), F.lit(0.0), F.lit(1.0))
        return rounded(x.select("vec_id", "k", a.alias("area")))


@query("area_disc", f"WITH {COEF_SQL} SELECT vec_id, k, {r6(arc_area_sql(*ARC, '1') + ' - ' + arc_area_sql(*ARC, '-1'), 'area')} FROM coef")
def area_disc(spark, d):
    a = A.area_disc(c(0), c(1), F.abs(c(2)) + .2, -.5, .5, 0, 1)
    return rounded(coefficients(spark, d).select("vec_id", "k", a.alias("area")))


# ---------------------------------------------------------------- regular models

@query("fit_mirror", f"WITH {PATCH_SQL}, {window_sql(3, 'lab', False)} SELECT grid_id, i, j, {r6('avg(u)', 'c0')} FROM win GROUP BY 1, 2, 3")
def fit_mirror(spark, d):
    return rounded(SF.surface_fits(patch(spark, d), PATCH, "mirror", 3).select(*KEY, F.col("params")[0].alias("c0")))


@query("fit_two_level", f"""WITH {PATCH_SQL}, {window_sql(3, 'lab', False)}
SELECT grid_id, i, j, CAST(CASE WHEN avg(u) > 0.5 THEN 0.8 ELSE 0.2 END AS DOUBLE) AS c0 FROM win GROUP BY 1, 2, 3""")
def fit_two_level(spark, d):
    f = SF.surface_fits(patch(spark, d), PATCH, "two_level", 3, up=.8, down=.2)
    return f.select(*KEY, F.col("params")[0].alias("c0"))


@query("fit_poly_plane", f"""WITH {PATCH_SQL}, {window_sql(3, 'lab', False)}
SELECT grid_id, i, j, {r6('avg(u)', 'c0')}, {r6('sum(u * dj) / 6', 'cy')}, {r6('sum(u * di) / 6', 'cx')} FROM win GROUP BY 1, 2, 3""")
def fit_poly_plane(spark, d):
    f = SF.surface_fits(patch(spark, d), PATCH, "poly", 3, degree=1)
    p = F.col("params")
    return rounded(f.select(*KEY, p[0].alias("c0"), p[1].alias("cy"), p[2].alias("cx")))


@query("fit_poly_full", f"""WITH {PATCH_SQL}, {window_sql(3, 'lab', False)}
SELECT grid_id, i, j, {r6('sum(u * (1 - 1.5 * di * di + 13.0 / 12 * 0) * 0)', 'zero')},
  {r6('sum(u * di * dj) / 4', 'cxy')}, {r6('sum(u * (CASE WHEN di = 0 THEN -2 ELSE 1 END) * (CASE WHEN dj = 0 THEN -2 ELSE 1 END)) / 4', 'cxxyy')}
FROM win GROUP BY 1, 2, 3""")
def fit_poly_full(spark, d):
    f = SF.surface_fits(patch(spark, d), PATCH, "poly", 3, degree=2, full_rank=True)
    p = F.col("params")
    return rounded(f.select(*KEY, F.lit(0.0).alias("zero"), p[4].alias("cxy"), p[8].alias("cxxyy")))


for weight in ("center", "center_smooth", "distance", "smoothness"):
    @query(f"fit_poly_weighted_{weight}")
    def fit_weighted(spark, d, weight=weight):
        x = labelled_patch(spark, d)
        f = SF.surface_fits(x, PATCH, "weighted", 3, degree=1, weight=weight, center_weight=1.0)
        return rounded(f.select(*KEY, *[F.col("params")[n].alias(f"c{n}") for n in range(4)]), 5)


def corner_sql(i, j):
    """Corner value of the nine bilinear estimates, for pure averages of the labels as smoothness."""
    rows, gamma = SF.sub_estimates(4, 2, 2.0)
    num, den = [], []
    for a in range(3):
        for b in range(3):
            est = " + ".join(f"{rows[a, p] * rows[b, q]!r} * u[{(i + p) * 5 + j + q + 1}]"
                             for p in range(4) for q in range(4) if rows[a, p] * rows[b, q] != 0).replace("np.float64(", "").replace(")", "")
            mean = " + ".join(f"s[{(i + a + p) * 5 + j + b + q + 1}]" for p in range(2) for q in range(2))
            alpha = f"{float(gamma[a] * gamma[b])!r} / pow(1 + ({mean}) / 4.0, 2)"
            num.append(f"{alpha} * ({est})")
            den.append(alpha)
    return f"(({' + '.join(num)}) / ({' + '.join(den)}))"


@query("fit_weno2d", f"""WITH {PATCH_SQL}, {window_sql(5, 'lab', False)},
a AS (SELECT grid_id, i, j, list(u ORDER BY di, dj) AS u, list(kind ORDER BY di, dj) AS s FROM win GROUP BY 1, 2, 3),
e AS (SELECT grid_id, i, j, {corner_sql(0, 0)} AS e00, {corner_sql(0, 1)} AS e01, {corner_sql(1, 0)} AS e10, {corner_sql(1, 1)} AS e11 FROM a)
SELECT grid_id, i, j, {r6('(e00 + e01 + e10 + e11) / 4', 'c0')}, {r6('(e01 + e11 - e00 - e10) / 2', 'c1')},
  {r6('(e10 + e11 - e00 - e01) / 2', 'c2')}, {r6('e00 + e11 - e01 - e10', 'c3')} FROM e""")
def fit_weno2d(spark, d):
    f = SF.surface_fits(labelled_patch(spark, d), PATCH, "weno2d", degree=1)
    return rounded(f.select(*KEY, *[F.col("params")[n].alias(f"c{n}") for n in range(4)]))


for name, options in (("fit_weno2d_deg2", {"method": "weno2d", "degree": 2}), ("fit_weno1d_4", {"method": "weno1d", "coefs": 4}),
                      ("fit_weno1d_5", {"method": "weno1d", "coefs": 5}), ("fit_weno1d_9", {"method": "weno1d", "coefs": 9}),
                      ("fit_weno1d_points", {"method": "weno1d_points", "coefs": 9})):
    @query(name)
    def weno(spark, d, options=options):
        f = SF.surface_fits(labelled_patch(spark, d), PATCH, k=5, **options)
        return rounded(f.select(*KEY, *[F.col("params")[n].alias(f"c{n}") for n in range(4)]))


# ---------------------------------------------------------------- curve proposals

def proposals(spark, d, model, n_params, angle=0.0, digits=6):
    p = Preset("one", (model,), angle=angle)
    rows = proposal_arrays(labelled_patch(spark, d), PATCH, p).select(*KEY, F.inline("proposals"))
    out = rows.select(
        *KEY, "axis", "cand", *[F.col("params")[n].alias(f"p{n}") for n in range(n_params)], "value_up", "value_down")
    return rounded(out, digits)


def proposal_sql(kt, ks, cands, angle=0.0, digits=6, where="true"):
    """One SELECT per candidate, each a list of parameter expressions over s0, s1, ..."""
    parts = []
    for n, params in enumerate(cands):
        cols = ", ".join(f"round({e}, {digits}) + 0.0 AS p{m}" for m, e in enumerate(params))
        parts.append(f"SELECT grid_id, i, j, CAST(axis AS INTEGER) AS axis, CAST({n} AS INTEGER) AS cand, {cols}, "
                     f"round(up, {digits}) + 0.0 AS value_up, round(down, {digits}) + 0.0 AS value_down FROM sums WHERE {where}")
    return f"WITH {PATCH_SQL}, {sums_sql(kt, ks, angle, max(5, ks))} " + " UNION ALL ".join(parts)


def linear(rows, base):
    """SQL for matrix rows times the sums; the first gets the window base added."""
    out = []
    for n, row in enumerate(rows):
        e = " + ".join(f"{float(v)!r} * s{m}" for m, v in enumerate(row))
        out.append(f"({e} + {float(base)!r})" if n == 0 else f"({e})")
    return out


SLOPES = ("s1 - s0", "s2 - s1", "(s2 - s0) / 2")


@query("propose_lines_3slopes", proposal_sql(3, 3, [["s1 - 1", m] for m in SLOPES]))
def propose_lines_3slopes(spark, d):
    return proposals(spark, d, C.lines_3slopes(), 2)


# exact interpolation of three column averages: written out, not taken from the library
@query("fit_curve_averages_2", proposal_sql(3, 5, [["(26 * s1 - s0 - s2) / 24 - 2", "(s2 - s0) / 2", "(s0 - 2 * s1 + s2) / 2"]]))
def fit_curve_averages_2(spark, d):
    return proposals(spark, d, C.curve_averages(2), 3)


@query("fit_curve_points_2", proposal_sql(3, 5, [["s1 - 2", "(s2 - s0) / 2", "(s0 - 2 * s1 + s2) / 2"]]))
def fit_curve_points_2(spark, d):
    return proposals(spark, d, C.curve_points(2), 3)


@query("fit_line_consistent", proposal_sql(3, 5, [["s1 - 2", "(s2 - s0) / 2"]]))
def fit_line_consistent(spark, d):
    return proposals(spark, d, C.line_consistent(), 2)


@query("fit_line_smoothed", proposal_sql(3, 5, [["(s0 + 2 * s1 + s2) / 4 - 2", "(s2 - s0) / 2"]]))
def fit_line_smoothed(spark, d):
    return proposals(spark, d, C.line_smoothed(), 2)


W2 = "exp(-1)"


@query("fit_curve_averages_1", proposal_sql(3, 5, [[f"({W2} * s0 + s1 + {W2} * s2) / (1 + 2 * {W2}) - 2", "(s2 - s0) / 2"]]))
def fit_curve_averages_1(spark, d):
    return proposals(spark, d, C.curve_averages(1, 3), 2)


def arcs(spark, d, parabola, circle):
    """Every cell and axis with its column sums, as the heights y of three points, and its arc p or NULL where it is straight."""
    rows = proposal_arrays(labelled_patch(spark, d), PATCH, Preset("one", (parabola, circle), angle=0.0))
    of = {f: F.get(F.filter("proposals", lambda c: c["family"] == f), F.lit(0))["params"] for f in ("quadratic", "arc")}
    first = F.get("proposals", F.lit(0))
    g = rows.filter(F.size("proposals") > 0).select(
        *KEY, "axis", of["quadratic"].alias("q"), of["arc"].alias("p"), first["value_up"].alias("value_up"), first["value_down"].alias("value_down"))
    return g.withColumn("y", F.transform(F.array(*[F.lit(t) for t in (-1.0, 0.0, 1.0)]), lambda t: F.col("q")[0] + (F.col("q")[1] + F.col("q")[2] * t) * t))


# what an arc through three points must have: their curvature, and no distance from any of them
BEND = "(s0 - 2 * s1 + s2)"
MENGER = f"2 * {BEND} / sqrt((1 + pow(s1 - s0, 2)) * (1 + pow(s2 - s1, 2)) * (4 + pow(s2 - s0, 2)))"


def arc_sql(columns):
    return f"""WITH {PATCH_SQL}, {sums_sql(3, 5, 0.0, 5)} SELECT grid_id, i, j, CAST(axis AS INTEGER) AS axis, {columns},
  {r6('up', 'value_up')}, {r6('down', 'value_down')} FROM sums"""


@query("fit_circle_points", arc_sql(f"""round(CASE WHEN abs({BEND}) > 1e-9 THEN {MENGER} ELSE 0 END, 6) + 0.0 AS curvature,
  CAST(CASE WHEN abs({BEND}) > 1e-9 THEN 0 END AS DOUBLE) AS off"""))
def fit_circle_points(spark, d):
    x, p, y = arcs(spark, d, C.curve_points(2), C.circle_points()), F.col("p"), F.col("y")
    gaps = [F.abs(F.sqrt((p[0] - t) * (p[0] - t) + (p[1] - y[n]) * (p[1] - y[n])) - p[2]) for n, t in enumerate((-1.0, 0.0, 1.0))]
    return x.select(*KEY, "axis", (F.round(F.coalesce(-p[3] / p[2], F.lit(0.0)), 6) + 0.0).alias("curvature"),
                    (F.round(F.greatest(*gaps), 4) + 0.0).alias("off"), *[(F.round(v, 6) + 0.0).alias(v) for v in ("value_up", "value_down")])


# the osculating circle shares value, slope and curvature with the parabola at the middle
QA, QB, QC = f"({BEND} / 2)", "((s2 - s0) / 2)", "((26 * s1 - s0 - s2) / 24 - 2)"


@query("fit_circle_taylor", arc_sql(f"""CASE WHEN abs({QA}) > 1e-9 THEN round({QC}, 4) + 0.0 END AS height,
  CASE WHEN abs({QA}) > 1e-9 THEN round({QB}, 4) + 0.0 END AS slope,
  CASE WHEN abs({QA}) > 1e-9 THEN round(2 * {QA} / pow(1 + {QB} * {QB}, 1.5), 6) + 0.0 END AS curvature"""))
def fit_circle_taylor(spark, d):
    x, p = arcs(spark, d, C.curve_averages(2), C.circle_taylor()), F.col("p")
    rise = F.sqrt(p[2] * p[2] - p[0] * p[0])
    return x.select(*KEY, "axis", (F.round(p[1] + p[3] * rise, 4) + 0.0).alias("height"), (F.round(p[3] * p[0] / rise, 4) + 0.0).alias("slope"),
                    (F.round(-p[3] / p[2], 6) + 0.0).alias("curvature"), *[(F.round(v, 6) + 0.0).alias(v) for v in ("value_up", "value_down")])


for fam, n in (("line", 2), ("quadratic", 3), ("arc", 4), ("corner", 5)):
    flat = {"line": "0.5, 0", "quadratic": "0.5, 0, 0", "arc": "0, -0.5, 1, 1", "corner": "0, .5, 0, .5, 0"}[fam].split(",")

    @query(f"start_curve_{fam}", proposal_sql(1, 1, [[f"CAST({v} AS DOUBLE)" for v in flat]]))
    def start(spark, d, fam=fam, n=n):
        return proposals(spark, d, C.start_curve(fam), n)


@query("fit_corner_4cols")
def fit_corner_4cols(spark, d):
    return proposals(spark, d, C.corner_4cols(), 5)


@query("fit_curve_averages_4")
def fit_curve_averages_4(spark, d):
    return proposals(spark, d, C.curve_averages(4, ks=7), 5, digits=5)


# ---------------------------------------------------------------- scoring and selection

LINE_CANDS = " UNION ALL ".join(
    f"SELECT *, {n} AS cand, s1 - 1 AS b, {m} AS m FROM sums" for n, m in enumerate(SLOPES))


def score_sql(sources, cands, weight=101):
    """CTE loss: every candidate line b + m t of the CTEs in `sources` against its 3 x 3 window."""
    return f"""{PATCH_SQL}, {sources}, cand AS MATERIALIZED ({cands}),
near AS (SELECT c.*, w.di, w.dj, w.u, CAST(CASE WHEN axis = 0 THEN di ELSE dj END AS DOUBLE) AS t,
    CAST(CASE WHEN axis = 0 THEN dj ELSE di END AS DOUBLE) AS s
  FROM cand c JOIN win w USING (grid_id, i, j) WHERE abs(w.di) <= 1 AND abs(w.dj) <= 1),
gap AS (SELECT *, u - up - (down - up) * {area_line_sql('b', 'm', 't - 0.5', 't + 0.5', 's')} AS e FROM near),
loss AS MATERIALIZED (SELECT grid_id, i, j, axis_rank, axis, cand, b, m, up, down,
  sum(e * e * CASE WHEN di = 0 AND dj = 0 THEN {weight} ELSE 1 END) AS loss FROM gap GROUP BY ALL)"""


SCORE_SQL = score_sql(sums_sql(3, 3, 0.0, 5), LINE_CANDS)
BEST_SQL = f"""{SCORE_SQL}, best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grid_id, i, j
  ORDER BY round(loss, 9), axis_rank, cand) AS rn FROM loss),
win1 AS MATERIALIZED (SELECT * FROM best WHERE rn = 1)"""


@query("score_lines", f"""WITH {SCORE_SQL} SELECT grid_id, i, j, CAST(axis AS INTEGER) AS axis, CAST(cand AS INTEGER) AS cand,
{r6('loss')} FROM loss""")
def score_lines(spark, d):
    s = scored_proposals(labelled_patch(spark, d), PATCH, PRESETS["elvira_w"])
    return rounded(s.select(*KEY, "axis", "cand", "loss"))


@query("select_best", f"WITH {BEST_SQL} SELECT grid_id, i, j, {r6('loss')} FROM win1")
def select_best(spark, d):
    f = fit_cells(labelled_patch(spark, d), PATCH, PRESETS["elvira_w"])
    return rounded(f.filter("family = 'line'").select(*KEY, "loss"))


@query("order_by_error", f"WITH {BEST_SQL} SELECT grid_id, i, j, {r6('loss')} FROM win1 ORDER BY loss DESC, grid_id, i, j LIMIT 300")
def order_by_error(spark, d):
    """The worst fitted cut cells of all patches."""
    f = fit_cells(labelled_patch(spark, d), PATCH, PRESETS["elvira_w"]).filter("family = 'line'")
    return rounded(G.order_by_error(f, top=300).select(*KEY, "loss"))


@query("select_best_eps", f"""WITH RECURSIVE {SCORE_SQL},
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grid_id, i, j ORDER BY axis_rank, cand) AS n FROM loss),
fold AS (SELECT grid_id, i, j, n, loss FROM o WHERE n = 1
  UNION ALL SELECT o.grid_id, o.i, o.j, o.n, CASE WHEN o.loss + 0.05 < f.loss THEN o.loss ELSE f.loss END
  FROM fold f JOIN o ON o.grid_id = f.grid_id AND o.i = f.i AND o.j = f.j AND o.n = f.n + 1)
SELECT grid_id, i, j, round(arg_max(loss, n), 6) + 0.0 AS loss FROM fold GROUP BY 1, 2, 3""")
def select_best_eps(spark, d):
    f = fit_cells(labelled_patch(spark, d), PATCH, replace(PRESETS["elvira_w"], eps=0.05))
    return rounded(f.filter("family = 'line'").select(*KEY, "loss"))


@query("winner_counts", f"""WITH {SCORE_SQL}, w AS (SELECT DISTINCT grid_id, i, j FROM loss),
k AS (SELECT kind, CASE WHEN w.i IS NOT NULL THEN 'line' ELSE 'constant' END AS family FROM lab LEFT JOIN w USING (grid_id, i, j))
SELECT family, kind, CAST(count(*) AS INTEGER) AS n FROM k GROUP BY 1, 2""")
def winners(spark, d):
    return winner_counts(fit_cells(labelled_patch(spark, d), PATCH, PRESETS["elvira_w"]), ("family", "kind"))


# every tenth cell stays constant, others go to the three slopes, the consistent line, or both, by their place
ROUTE = "CASE (i + 3 * j) % 10 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 1 + j % 2 END"
ROUTED = Preset("routed", (C.lines_3slopes(), C.line_consistent()), angle=0.0, center_weight=C.CENTER_WEIGHT)
CONSISTENT = "SELECT *, 10 AS cand, s1 - 2 AS b, (s2 - s0) / 2 AS m FROM"
ROUTED_CANDS = f"""SELECT * FROM ({LINE_CANDS.replace("FROM sums", "FROM narrow")}) WHERE {ROUTE} IN (1, 3)
  UNION ALL {CONSISTENT} wide WHERE {ROUTE} IN (2, 3)"""


@query("fit_routed", f"""WITH {score_sql(sums_sql(3, 3, 0.0, 5, "narrow") + ", " + column_sums_sql(3, 5, "wide"), ROUTED_CANDS)},
best AS (SELECT *, row_number() OVER (PARTITION BY grid_id, i, j ORDER BY round(loss, 9), cand // 10, axis_rank, cand) AS rn FROM loss)
SELECT l.grid_id, l.i, l.j, CASE WHEN b.loss IS NULL THEN 'constant' ELSE 'line' END AS family, {r6('b.loss', 'loss')}
FROM lab l LEFT JOIN best b ON b.grid_id = l.grid_id AND b.i = l.i AND b.j = l.j AND b.rn = 1""")
def fit_routed(spark, d):
    code = F.expr(ROUTE)
    models = F.filter(F.array(*[F.lit(m) for m in range(3)]), lambda m: (m == 0) | (code.bitwiseAND(m) != 0))
    return rounded(fit_cells(labelled_patch(spark, d).withColumn("route", models), PATCH, ROUTED).select(*KEY, "family", "loss"))


def preset_sql(sources, cands, weight):
    """Cells and summed losses by grid and label; the best candidate of a cell counts."""
    return f"""WITH {score_sql(sources, cands, weight)}, best AS (SELECT grid_id, i, j, min(loss) AS loss FROM loss GROUP BY 1, 2, 3)
SELECT grid_id, kind, CAST(count(*) AS INTEGER) AS n, round(sum(loss), 4) + 0.0 AS loss FROM lab LEFT JOIN best USING (grid_id, i, j) GROUP BY 1, 2"""


# parabolas b + m t + q t^2; nearly straight ones are taken as lines, since their roots run away
NARROW_AND_WIDE = sums_sql(3, 3, 0.0, 5, "narrow") + ", " + column_sums_sql(3, 5, "wide")
PARABOLA = f"SELECT *, 20 AS cand, {QC} AS b, {QB} AS m, {QA} AS q FROM wide"


def parabola_preset_sql(*cands):
    """preset_sql for lines and parabolas; the area below a curve in a window's cell is taken in that cell's coordinates."""
    loss = score_sql(NARROW_AND_WIDE, " UNION ALL ".join(cands)).split("gap AS (")[0]
    area = f"CASE WHEN abs(c2) < 1e-6 THEN {area_line_sql('c0', 'c1', '-0.5', '0.5', '0.0')} ELSE {above_sql('0')} - {above_sql('1')} END"
    return f"""WITH {loss} own AS (SELECT *, b + m * t + q * t * t - s AS c0, m + 2 * q * t AS c1, q AS c2 FROM near),
gap AS (SELECT *, u - up - (down - up) * {area} AS e FROM own),
loss AS (SELECT grid_id, i, j, axis, cand, sum(e * e * CASE WHEN di = 0 AND dj = 0 THEN 101 ELSE 1 END) AS loss FROM gap GROUP BY ALL),
best AS (SELECT grid_id, i, j, min(loss) AS loss FROM loss GROUP BY 1, 2, 3)
SELECT grid_id, kind, CAST(count(*) AS INTEGER) AS n, round(sum(loss), 4) + 0.0 AS loss FROM lab LEFT JOIN best USING (grid_id, i, j) GROUP BY 1, 2"""


#: Presets of one sweep over the patches.
SWEEP = ("constant", "elvira", "elvira_w", "aero_linear")
PRESET_SQL = {
    "constant": f"WITH {PATCH_SQL} SELECT grid_id, kind, CAST(count(*) AS INTEGER) AS n, CAST(NULL AS DOUBLE) AS loss FROM lab GROUP BY 1, 2",
    "elvira": preset_sql(sums_sql(3, 3, 0.0, 5), LINE_CANDS, 1),
    "elvira_w": preset_sql(sums_sql(3, 3, 0.0, 5), LINE_CANDS, 101),
    "aero_linear": preset_sql(sums_sql(3, 5, 45.0, 5), f"{CONSISTENT} sums", 101),
    "aero_quadratic": parabola_preset_sql(PARABOLA),
    "elvira+aero_quadratic": parabola_preset_sql(f"SELECT *, 0.0 AS q FROM ({LINE_CANDS.replace('FROM sums', 'FROM narrow')})", PARABOLA),
    "aero_linear+quadratic": parabola_preset_sql(f"SELECT *, 0.0 AS q FROM ({CONSISTENT} wide)", PARABOLA),
}
SWEEP_SQL = " UNION ALL ".join(f"SELECT '{n}' AS preset, * FROM ({PRESET_SQL[n]})" for n in SWEEP)


@query("fit_sweep", SWEEP_SQL)
def sweep_losses(spark, d):
    """Four presets in one plan with one shuffle of the cells."""
    f = fit_sweep(labelled_patch(spark, d), PATCH, [PRESETS[n] for n in SWEEP])
    return rounded(f.groupBy("preset", "grid_id", "kind").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("loss").alias("loss")), 4)


for name in PRESETS:
    @query(f"fit_preset_{name.replace('+', '_')}", PRESET_SQL.get(name))
    def preset_losses(spark, d, name=name):
        f = fit_cells(labelled_patch(spark, d), PATCH, PRESETS[name])
        return rounded(f.groupBy("grid_id", "kind").agg(
            F.count(F.lit(1)).cast("int").alias("n"), F.sum("loss").alias("loss")), 4)


# ---------------------------------------------------------------- resampling

SUB_SQL = f"""{PATCH_SQL}, {window_sql(3)},
lev AS MATERIALIZED (SELECT grid_id, i, j, min(u) AS lo, max(u) AS hi,
  sum(CASE WHEN di = -1 THEN u END) AS s0, sum(CASE WHEN di = 0 THEN u END) AS s1, sum(CASE WHEN di = 1 THEN u END) AS s2 FROM win GROUP BY 1, 2, 3),
fit AS MATERIALIZED (SELECT grid_id, i, j, s1 - 1 AS b, (s2 - s0) / 2 AS m FROM lev)"""


def central_lines(spark, d):
    """A simple table of fits: central-slope lines over axis 0 with content below them."""
    from cellweave.functions.index import weighted
    from cellweave.operators.windows import with_windows
    w = with_windows(labelled_patch(spark, d), PATCH, 3, 3, ["u", "kind"])
    s = [weighted(F.col("w_u"), [1.0 if p // 3 == r else 0.0 for p in range(9)]) for r in range(3)]
    cut = F.col("kind") == CUT
    return w.select(*KEY, "u", "kind", F.lit(0).alias("axis"),
                    F.when(cut, "line").otherwise("constant").alias("family"),
                    F.when(cut, F.array(s[1] - 1, (s[2] - s[0]) / 2)).otherwise(F.array("u")).alias("params"),
                    F.lit(0.0).alias("value_up"), F.lit(1.0).alias("value_down"))


def sub_area_sql(f):
    """Area below the line in part (p, q): difference of clipped areas of two heights."""
    def below(top):
        return area_line_sql("b * " + f"{f}.0 - {top}", f"m * {f}.0", f"a.p / {f}.0 - 0.5", f"(a.p + 1) / {f}.0 - 0.5", "0.0")
    return below("q.q")


FINE_SQL = "SELECT grid_id, CAST(i * 2 + a.p AS INTEGER) AS i, CAST(j * 2 + q.q AS INTEGER) AS j, round({u}, 6) + 0.0 AS u"
RESAMPLE_SQL = f"""WITH {SUB_SQL}
{FINE_SQL.format(u=f'2 * {sub_area_sql(2)}')} FROM fit, range(2) a(p), range(2) q(q)
UNION ALL {FINE_SQL.format(u='u')} FROM lab, range(2) a(p), range(2) q(q) WHERE kind = 0"""


@query("resample_average", RESAMPLE_SQL)
def resample_average(spark, d):
    return rounded(RS.resample_average(central_lines(spark, d), 2, families=("constant", "line")))


@query("resample_interface_only", RESAMPLE_SQL)
def resample_interface_only(spark, d):
    return rounded(RS.resample_interface_only(central_lines(spark, d), 2, ("constant", "line")))


@query("resample_points", f"""WITH {SUB_SQL}, pts AS (SELECT a.p, q.q, CAST(floor(a.p * 8 / 12.0) AS INTEGER) AS i, CAST(floor(q.q * 8 / 20.0) AS INTEGER) AS j,
  a.p * 8 / 12.0 AS x, q.q * 8 / 20.0 AS y FROM range(12) a(p), range(20) q(q))
SELECT l.grid_id, CAST(p AS INTEGER) AS i, CAST(q AS INTEGER) AS j, CAST(CASE WHEN f.b IS NULL THEN l.u
  WHEN y - l.j >= b + m * (x - l.i - 0.5) THEN 0 ELSE 1 END AS DOUBLE) AS u
FROM pts JOIN lab l USING (i, j) LEFT JOIN fit f ON f.grid_id = l.grid_id AND f.i = l.i AND f.j = l.j""".replace(
    "CASE WHEN f.b IS NULL THEN l.u", "CASE WHEN f.b IS NULL THEN round(l.u, 6)"))
def resample_points(spark, d):
    return rounded(RS.resample_points(central_lines(spark, d), PATCH, (12, 20), ("constant", "line")))


@query("curve_polyline", f"""WITH {SUB_SQL}, p AS (SELECT *, a.p AS point, a.p / 8.0 - 0.5 AS t FROM fit, range(9) a(p))
SELECT grid_id, i, j, CAST(point AS INTEGER) AS point, {r6('i + t + 0.5', 'x')}, {r6('j + b + m * t', 'y')} FROM p WHERE b + m * t BETWEEN 0 AND 1""")
def curve_polyline(spark, d):
    return rounded(RS.curve_polyline(central_lines(spark, d), 9))


# ---------------------------------------------------------------- transfer

@query("transfer_rectangles", """WITH v AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 7 - 3) / 4.0 AS vi, (l_linenumber % 3 - 1) / 2.0 AS vj FROM lineitem),
p AS (SELECT *, mi, mj FROM v, (VALUES (1, 0), (1, 1), (0, 1)) m(mi, mj)
  WHERE (mi = 0 OR vi <> 0) AND (mj = 0 OR vj <> 0)
    AND (mi = 1 OR vi <> 0 OR vj <> 0) AND NOT (mi = 1 AND mj = 1 AND (vi = 0 OR vj = 0)))
SELECT l_orderkey, l_linenumber, CAST(mi * sign(vi) AS INTEGER) AS di, CAST(mj * sign(vj) AS INTEGER) AS dj,
  round((CASE WHEN mi = 1 THEN abs(vi) ELSE 1 - abs(vi) END) * (CASE WHEN mj = 1 THEN abs(vj) ELSE 1 - abs(vj) END), 6) + 0.0 AS part FROM p""")
def transfer_rectangles(spark, d):
    v = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", ((F.col("l_orderkey") % 7 - 3) / 4.0).alias("vi"),
        ((F.col("l_linenumber") % 3 - 1) / 2.0).alias("vj"))
    t = TR.transfer_rectangles(v)
    part = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return rounded(t.select("l_orderkey", "l_linenumber", "di", "dj", part.alias("part")))


def slab_sql(v):
    """Content of the slab of width v at the upper end of axis 0 (line) or a constant's share."""
    return area_line_sql("b", "m", f"0.5 - {v}", "0.5", "0.0")


@query("transfer_once", f"""WITH {SUB_SQL}, q AS (
  SELECT l.grid_id, l.i, l.j, l.u, CASE WHEN f.b IS NULL THEN 0.3 * l.u ELSE {slab_sql(0.3)} END AS q
  FROM lab l LEFT JOIN fit f ON f.grid_id = l.grid_id AND f.i = l.i AND f.j = l.j)
SELECT a.grid_id, a.i, a.j, {r6('greatest(0, least(1, a.u - a.q + b.q))', 'u')} FROM q a JOIN q b ON a.grid_id = b.grid_id AND a.j = b.j AND b.i = (a.i + 7) % 8""")
def transfer_once(spark, d):
    return rounded(TR.transfer_once(central_lines(spark, d), PATCH, (0.3, 0.0), ("constant", "line"), 0.0, 1.0))


@query("transfer_diagonal")
def transfer_diagonal(spark, d):
    fits = fit_cells(labelled_patch(spark, d), PATCH, PRESETS["elvira_w"])
    return rounded(TR.transfer_once(fits, PATCH, (0.25, -0.5), PRESETS["elvira_w"].families))


@query("upwind_once", f"""WITH {PATCH_SQL} SELECT a.grid_id, a.i, a.j, {r6('0.6 * a.u + 0.4 * b.u', 'u')}
FROM cells a JOIN cells b ON a.grid_id = b.grid_id AND a.i = b.i AND b.j = (a.j + 1) % 8""")
def upwind_once(spark, d):
    return rounded(TR.upwind_once(patch(spark, d), PATCH, (0.0, -0.4)))
