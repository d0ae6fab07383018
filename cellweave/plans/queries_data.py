"""Queries on samples, learning, errors and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import analytics as Q
from cellweave.operators import curves as C
from cellweave.operators import grid_ops as G
from cellweave.operators import learning as ML
from cellweave.operators.labels import label_piecewise
from cellweave.operators.windows import heavy_width, with_windows
from cellweave.plans.fixtures import PATCH, PATCH_SQL, labelled_patch, patch, table
from cellweave.plans.queries_grid import r6
from cellweave.plans.reconstruct import PRESETS, fit_cells, run_sweep
from cellweave.plans.registry import query, rounded
from cellweave.schema import KEY
from cellweave.sources import samples as D
from cellweave.sources.binning import coarsen
from cellweave.sources.shapes import rasterize_shapes, true_fine_grid

COARSE_SQL = f"""{PATCH_SQL}, coarse AS MATERIALIZED (SELECT grid_id, i // 2 AS ci, j // 2 AS cj, avg(u) AS v FROM cells GROUP BY 1, 2, 3),
both_ AS MATERIALIZED (SELECT c.*, v FROM cells c JOIN coarse k ON c.grid_id = k.grid_id AND c.i // 2 = k.ci AND c.j // 2 = k.cj)"""


def blocks(spark, d):
    return G.repeat_cells(coarsen(patch(spark, d), 2, 2), 2, 2)


@query("error_norms", f"""WITH {COARSE_SQL} SELECT grid_id, {r6('avg(abs(u - v))', 'error_l1')}, {r6('max(abs(u - v))', 'error_linf')},
{r6('pow(avg(pow(abs(u - v), 3)), 1 / 3.0)', 'error_lp')} FROM both_ GROUP BY 1""")
def error_norms(spark, d):
    return rounded(Q.error_norms(patch(spark, d), blocks(spark, d), 3.0))


@query("error_downsampled", f"""WITH {COARSE_SQL}, t AS (SELECT grid_id, ci, cj, CASE WHEN v < 0.5 THEN 0 ELSE 1 END AS b, v FROM coarse)
SELECT grid_id, {r6('avg(abs(b - v))', 'error_l1')}, {r6('max(abs(b - v))', 'error_linf')} FROM t GROUP BY 1""")
def error_downsampled(spark, d):
    return rounded(Q.error_downsampled(G.threshold(coarsen(patch(spark, d), 2, 2)), patch(spark, d), 2))


for keep in (True, False):
    @query(f"error_{'on' if keep else 'off'}_interface", f"""WITH {COARSE_SQL}
SELECT grid_id, {r6('avg(abs(u - v))', 'error_l1') if keep else r6('sqrt(avg((u - v) * (u - v)))', 'error_rmse')}
FROM both_ WHERE {'' if keep else 'NOT'} (u > 0 AND u < 1) GROUP BY 1""")
    def masked(spark, d, keep=keep):
        p = patch(spark, d)
        return rounded(Q.error_masked(p, blocks(spark, d), p.filter("u > 0 AND u < 1"), keep, rmse=not keep))


@query("error_per_interface_cell", f"""WITH {COARSE_SQL} SELECT grid_id, CAST(i // 2 AS INTEGER) AS i, CAST(j // 2 AS INTEGER) AS j,
{r6('avg(abs(u - v)) / 16', 'error')} FROM both_ WHERE v > 0 AND v < 1 GROUP BY 1, 2, 3""")
def error_per_interface_cell(spark, d):
    p = patch(spark, d)
    return rounded(Q.error_per_interface_cell(p, blocks(spark, d), coarsen(p, 2, 2), 2, 4))


@query("error_over_steps", f"""WITH {PATCH_SQL} SELECT CAST(s.s AS INTEGER) AS step, {r6('avg(abs(u - u * (1 - 0.125 * s.s)))', 'error_l1')}
FROM cells, range(4) s(s) GROUP BY 1""")
def error_over_steps(spark, d):
    a = Q.param_grid(patch(spark, d), step=[0, 1, 2, 3])
    return rounded(Q.error_over_steps(a, a.withColumn("u", F.col("u") * (1 - 0.125 * F.col("step")))))


@query("convergence_rate", """WITH r AS (SELECT l_returnflag AS model, l_quantity AS n, avg(l_discount) + 1 / l_quantity AS e FROM lineitem GROUP BY 1, 2)
SELECT model, round(regr_slope(ln(e), ln(n)), 6) + 0.0 AS rate, round(regr_intercept(ln(e), ln(n)), 6) + 0.0 AS origin FROM r WHERE n > 10 GROUP BY 1""")
def convergence_rate(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("n")).agg(
        (F.avg("l_discount") + 1 / F.first("l_quantity")).alias("error_l1"))
    return rounded(Q.convergence_rate(r, 10))


@query("duration_stats", """SELECT event_type AS model, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1""")
def duration_stats(spark, d):
    return rounded(Q.duration_stats(table(spark, d, "events").withColumnRenamed("event_type", "model"), "value"))


@query("per_step_cost", "SELECT event_type AS model, round(avg(value) / 120, 6) + 0.0 AS per_step FROM events GROUP BY 1")
def per_step_cost(spark, d):
    return rounded(Q.per_step_cost(table(spark, d, "events").withColumnRenamed("event_type", "model"), 120, "value"))


@query("param_grid", """SELECT s_suppkey, CAST(n.n AS INTEGER) AS n, m.m AS model FROM supplier, (VALUES (20), (30), (40)) n(n), (VALUES ('line'), ('quadratic')) m(m)""")
def param_grid(spark, d):
    return Q.param_grid(table(spark, d, "supplier").select("s_suppkey"), n=[20, 30, 40], model=["line", "quadratic"])


@query("select_results", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority = '1-URGENT'")
def select_results(spark, d):
    return Q.select_results(table(spark, d, "orders"), o_orderstatus=["O", "F"], o_orderpriority="1-URGENT").select("o_orderkey")


@query("log_spaced", """SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS grid_id,
CAST(floor(exp(ln(10.0) + p.p * (ln(100.0 + s_suppkey) - ln(10.0)) / 19) + 1e-9) AS INTEGER) AS n FROM supplier, range(20) p(p)""")
def log_spaced(spark, d):
    s = table(spark, d, "supplier").withColumn("grid_id", F.col("s_suppkey").cast("string"))
    return Q.log_spaced_per_row(s, F.lit(10.0), F.lit(100.0) + F.col("s_suppkey"), 20)


@query("disc_sweep")
def disc_sweep(spark, d):
    """One disc per supplier and grid size; all grids and models are fitted in one plan, then rates per model."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey"), (0.2 + (F.col("s_suppkey") % 50) / 500.0).alias("r"))
    shapes = Q.param_grid(s, n=[10, 14, 20]).select(
        F.concat_ws("-", "s_suppkey", "n").alias("grid_id"), "n", F.col("n").alias("ni"), F.col("n").alias("nj"),
        F.lit(0).alias("axis"), F.array(F.lit(.511), F.lit(.486), F.col("r")).alias("params"),
        F.lit(0.0).alias("value_up"), F.lit(1.0).alias("value_down"))
    grids = shapes.select("grid_id", "ni", "nj", F.lit("cyclic").alias("mode_i"), F.lit("cyclic").alias("mode_j"))
    # fits, regular cells and the truth read the cells, whose areas are dearer to find than to pass on: they share one shuffle
    # by grid (of a few hundred cells), and the generator keeps their filters above it
    cells = rasterize_shapes(shapes, "disc").repartition(heavy_width(s), "grid_id").select(F.inline(F.array(F.struct(*KEY, "u"))))
    truth = true_fine_grid(shapes, "disc", cells, 4, packed=True)
    err = run_sweep(cells, truth, grids, [PRESETS["constant"], PRESETS["elvira_w"], PRESETS["aero_linear"]], 4)
    out = err.join(shapes.select("grid_id", "n"), "grid_id").withColumnRenamed("preset", "model")
    return rounded(Q.convergence_rate(out.groupBy("model", "n").agg(F.avg("error_l1").alias("error_l1"))), 5)


# ---------------------------------------------------------------- samples and learning

def spine(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"))


CURVES = {
    "lines": lambda: D.sample_lines(1),
    "points": lambda: D.sample_points(2, D.points_x(3)),
    "points_chebyshev": lambda: D.sample_points(3, D.points_x(4, "chebyshev", 2.0), 1.5),
    "circles": lambda: D.sample_points(4, D.points_x(3), (0.3, 0.6, 0.3), "arc"),
    "corners": lambda: D.sample_corners(5),
}
for name, curve in CURVES.items():
    @query(f"samples_{name}")
    def samples(spark, d, curve=curve):
        s = D.generate_samples(spine(spark, d), curve())
        return rounded(s.select("sample_id", "singular", "flux", *[F.get("kernel", F.lit(n)).alias(f"k{n}") for n in (0, 4, 8)]))


@query("training_view", """SELECT o_orderkey AS sample_id, row_number() OVER (ORDER BY o_orderkey) <= 1000 AS is_train FROM orders""")
def training_view(spark, d):
    s = D.generate_samples(spine(spark, d), D.sample_lines(1))
    return D.training_view(s, "classification", 1000).select("sample_id", "is_train")


@query("training_share", """SELECT o_orderkey AS sample_id, ((o_orderkey % 2147483648) * 2654435761) % 4294967296 < 858993459 AS is_train FROM orders""")
def training_share(spark, d):
    s = D.generate_samples(spine(spark, d), D.sample_lines(1))
    return D.training_view(s, "classification", share=0.2).select("sample_id", "is_train")


@query("concat_samples", """SELECT CAST(c.c AS INTEGER) AS class_id, CAST(2 * count(*) AS INTEGER) AS n FROM orders, (VALUES (0)) c(c) GROUP BY 1
UNION ALL SELECT CAST(1 AS INTEGER), CAST(count(*) AS INTEGER) FROM orders""")
def concat_samples(spark, d):
    parts = [D.generate_samples(spine(spark, d), CURVES[n]()) for n in ("lines", "points", "corners")]
    return D.concat_samples(parts, [0, 0, 1]).groupBy("class_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("wrap_angle", "SELECT c_custkey, round(c_acctbal - 2 * pi() * floor(c_acctbal / (2 * pi())), 6) + 0.0 AS angle FROM customer")
def wrap_angle(spark, d):
    return rounded(table(spark, d, "customer").select("c_custkey", D.wrap_angle(F.col("c_acctbal")).alias("angle")))


@query("curve_targets")
def curve_targets(spark, d):
    s = D.curve_targets(D.generate_samples(spine(spark, d), D.sample_lines(1, (-.25, .25))), "slope")
    return rounded(s.select("sample_id", F.col("target")[0].alias("t0"), F.col("target")[1].alias("t1")))


def slope_view(spark, d, problem="curve", share=0.2):
    """All orders as samples; a fifth of them, by a hash of their ids, teaches."""
    s = D.generate_samples(spine(spark, d), D.sample_lines(1, (-.25, .25), 0.5), random_sides=False)
    return D.training_view(D.curve_targets(s, "slope"), problem, share=share)


@query("learned_curve_errors")
def learned_curve_errors(spark, d):
    v = slope_view(spark, d)
    return rounded(ML.model_errors(ML.fit_model(v, "tree", 2).transform(v)), 4)


@query("learned_cut_flag_errors")
def learned_cut_flag_errors(spark, d):
    v = slope_view(spark, d, "classification")
    m = ML.fit_model(v, "logistic", 1, 9, 2, {0: 0.5}, noise=1e-5)
    return rounded(ML.model_errors(m.transform(v)), 4)


@query("learned_curve_proposals")
def learned_curve_proposals(spark, d):
    m = ML.fit_model(slope_view(spark, d), "linear", 2)
    p = ML.propose_learned_curve(labelled_patch(spark, d), PATCH, m, "line", C.levels_sided)
    inverse = ML.fit_model(slope_view(spark, d, "averages"), "linear", 9)
    return rounded(ML.score_learned(p, inverse).select(*KEY, "loss"), 4)


@query("learned_transfer")
def learned_transfer(spark, d):
    m = ML.fit_model(slope_view(spark, d, "flux"), "linear", 1)
    return rounded(ML.predict_transfer(labelled_patch(spark, d), PATCH, m, 0.5, C.levels_sided), 4)


def class_model(spark, d):
    parts = [D.generate_samples(spine(spark, d), c) for c in (
        D.sample_lines(1, (-.25, .25), .5), D.sample_points(2, D.points_x(3), .5), D.sample_corners(5, radius=.5))]
    v = D.concat_samples(parts).select("sample_id", F.col("kernel").alias("x"), F.array(F.col("class_id")).alias("y"),
                                       F.lit(True).alias("is_train"))
    return ML.fit_model(v, "tree", 1, 9, 3)


@query("route_by_model")
def route_by_model(spark, d):
    r = ML.route_by_model(labelled_patch(spark, d), PATCH, class_model(spark, d))
    return r.select(*KEY, F.explode("route").alias("model")).groupBy("grid_id", "model").agg(F.count(F.lit(1)).alias("n"))


@query("fit_routed_by_model")
def fit_routed_by_model(spark, d):
    """Cells routed by a learned class (line, parabola, corner) and fitted with their routed models only."""
    r = ML.route_by_model(labelled_patch(spark, d), PATCH, class_model(spark, d))
    fits = fit_cells(r, PATCH, PRESETS["corner_4cols"])
    return rounded(fits.groupBy("grid_id", "model_idx").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("loss").alias("loss")), 4)


@query("tune_class_weight")
def tune_class_weight(spark, d):
    """Weight of the corner class at which it wins about a twentieth of all cut cells."""
    w = with_windows(labelled_patch(spark, d), PATCH, 3, 3, ["u", "kind"], where=F.col("kind") == 1).withColumnRenamed("w_u", "x")
    p = class_model(spark, d).transform(w).select("probability")
    n = w.count()
    weight, won = ML.tune_class_weight(p, 2, (n // 25, n // 15))
    return spark.range(1).select(F.lit(2).alias("class_id"), F.round(F.lit(weight), 6).alias("weight"), F.lit(won).alias("n"))
