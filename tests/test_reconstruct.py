"""Exactness on the models' own shapes and the convergence of the whole chain."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators.labels import label_piecewise
from cellweave.operators.resample import (curve_polyline, resample_average, resample_interface_only,
                                          resample_points)
from cellweave.operators.scoring import winner_counts
from cellweave.plans.reconstruct import PRESETS, fit_cells, fit_sweep, reconstruct, run_sweep, scored_proposals
from cellweave.schema import EXTEND, GridShape
from cellweave.sources.shapes import rasterize_shapes, true_fine_grid

DISC = "grid_id string, ni int, nj int, axis int, params array<double>, value_up double, value_down double"


def discs(spark, sizes, f=1):
    return spark.createDataFrame([(str(n), n * f, n * f, 0, [.511, .486, .232], 0., 1.) for n in sizes], DISC)


def straight(spark, n, slope=.37, icept=.3):
    shapes = spark.createDataFrame([("line", n, n, 0, [icept, slope], 0., 1.)], DISC)
    return shapes, rasterize_shapes(shapes, "line")


@pytest.mark.parametrize("name", ["elvira", "aero_linear", "aero_quadratic", "aero_cubic",
                                  "elvira+aero_quadratic"])
def test_straight_interface_is_exact(spark, name):
    n = 12
    shapes, cells = straight(spark, n)
    fits = fit_cells(label_piecewise(cells), GridShape(n, n, EXTEND, EXTEND), PRESETS[name])
    inner = fits.filter("i between 3 and 8")
    fam = PRESETS[name].families
    fine = resample_average(inner, 4, families=fam)
    truth = rasterize_shapes(shapes.withColumns({"ni": F.lit(n * 4), "nj": F.lit(n * 4)}), "line")
    worst = fine.withColumnRenamed("u", "v").join(truth, ["grid_id", "i", "j"]).agg(
        F.max(F.abs(F.col("u") - F.col("v")))).first()[0]
    assert worst < 1e-6


def test_disc_mass_and_rates(spark):
    """All grid sizes of the sweep are one job per model."""
    sizes = [20, 30, 40]
    shapes = discs(spark, sizes)
    grids = shapes.select("grid_id", "ni", "nj", F.lit("cyclic").alias("mode_i"), F.lit("cyclic").alias("mode_j"))
    cells = rasterize_shapes(shapes, "disc").cache()
    for r in cells.groupBy("grid_id").agg(F.avg("u").alias("m")).collect():
        assert r.m == pytest.approx(math.pi * .232 ** 2, abs=1e-9)
    truth = true_fine_grid(shapes, "disc", cells, 8).cache()
    rates = {}
    for name in ("constant", "elvira_w", "aero_quadratic"):
        fits = fit_cells(label_piecewise(cells), grids, PRESETS[name])
        fine = resample_interface_only(fits, 8, PRESETS[name].families)
        err = fine.withColumnRenamed("u", "v").join(truth, ["grid_id", "i", "j"]).groupBy("grid_id").agg(
            F.avg(F.abs(F.col("u") - F.col("v"))).alias("e")).collect()
        e = {int(r.grid_id): r.e for r in err}
        rates[name] = np.polyfit(np.log(sizes), np.log([e[n] for n in sizes]), 1)[0]
    assert rates["constant"] == pytest.approx(-1, abs=.2)
    assert -2.6 < rates["elvira_w"] < -1.5
    assert -4 < rates["aero_quadratic"] < -2.4
    cells.unpersist(), truth.unpersist()


def test_selection_never_worse_than_a_single_model(spark):
    n = 20
    cells = label_piecewise(rasterize_shapes(discs(spark, [n]), "disc"))
    shape = GridShape(n, n)
    both = fit_cells(cells, shape, PRESETS["elvira+aero_quadratic"])
    lines = fit_cells(cells, shape, PRESETS["elvira_w"]).select("i", "j", F.col("loss").alias("one"))
    assert both.join(lines, ["i", "j"]).filter("loss > one + 1e-12").count() == 0
    every = scored_proposals(cells, shape, PRESETS["elvira+aero_quadratic"]).groupBy("i", "j").agg(
        F.min("loss").alias("least"))
    assert both.join(every, ["i", "j"]).filter("abs(loss - least) > 1e-12").count() == 0
    assert winner_counts(both).agg(F.sum("n")).first()[0] == n * n


def test_points_and_polyline(spark):
    n = 12
    _, cells = straight(spark, n)
    fits = fit_cells(label_piecewise(cells), GridShape(n, n, EXTEND, EXTEND), PRESETS["elvira"])
    pts = resample_points(fits, GridShape(n, n), (30, 18), PRESETS["elvira"].families)
    assert pts.count() == 30 * 18 and pts.select("i", "j").distinct().count() == 30 * 18
    line = curve_polyline(fits.filter("i between 2 and 9"), 9)
    assert line.count() > 0
    off = line.select(F.max(F.abs(F.col("y") / n - (.3 + .37 * F.col("x") / n)))).first()[0]
    assert off < 1e-9


def test_refinement_passes(spark, tmp_path):
    n = 12
    cells = rasterize_shapes(discs(spark, [n]), "disc")
    fits, shape = reconstruct(cells, GridShape(n, n), PRESETS["elvira_w"], refinement=2)
    assert shape.ni == 2 * n and fits.count() == 4 * n * n
    total = resample_average(fits, 1, families=PRESETS["elvira_w"].families).agg(F.avg("u")).first()[0]
    assert total == pytest.approx(math.pi * .232 ** 2, abs=2e-3)


def test_sweep_equals_single_fits_and_needs_one_shuffle_of_the_cells(spark):
    shapes = discs(spark, [12, 17])
    grids = shapes.select("grid_id", "ni", "nj", F.lit("cyclic").alias("mode_i"), F.lit("cyclic").alias("mode_j"))
    cells = label_piecewise(rasterize_shapes(shapes, "disc")).cache()
    presets = [PRESETS[n] for n in ("constant", "elvira_w", "aero_quadratic", "aero_cubic", "circle")]
    key = ["grid_id", "i", "j"]
    sweep = {(r.preset, r.grid_id, r.i, r.j): r for r in fit_sweep(cells, grids, presets).collect()}
    assert len(sweep) == len(presets) * (144 + 289)
    for p in presets:
        for r in fit_cells(cells, grids, p).collect():
            got = sweep[p.name, r.grid_id, r.i, r.j]
            assert (got.family, got.kind, got.cand, got.axis) == (r.family, r.kind, r.cand, r.axis)
            assert np.allclose(got.params, r.params) and (got.loss is None) == (r.loss is None)
    one = fit_sweep(cells, grids, presets)._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("RepartitionByExpression") == 1
    with pytest.raises(ValueError):
        fit_sweep(cells, grids, [presets[0], replace(presets[1], p=1.0)])
    truth = true_fine_grid(shapes, "disc", cells.select(*key, "u"), 4)
    err = {(r.grid_id, r.preset): r.error_l1 for r in run_sweep(cells.select(*key, "u"), truth, grids, presets, 4).collect()}
    assert len(err) == 10 and err["17", "aero_quadratic"] < err["17", "elvira_w"] < err["17", "constant"]


def test_passes_on_grids_of_different_sizes(spark):
    shapes = discs(spark, [10, 14])
    grids = shapes.select("grid_id", "ni", "nj", F.lit("cyclic").alias("mode_i"), F.lit("cyclic").alias("mode_j"))
    fits, finer = reconstruct(rasterize_shapes(shapes, "disc"), grids, PRESETS["elvira_w"], refinement=2)
    assert {(r.grid_id, r.ni, r.nj) for r in finer.collect()} == {("10", 20, 20), ("14", 28, 28)}
    both = {r.grid_id: r.n for r in fits.groupBy("grid_id").agg(F.count("*").alias("n")).collect()}
    assert both == {"10": 400, "14": 784}
    alone, _ = reconstruct(rasterize_shapes(discs(spark, [14]), "disc"), GridShape(14, 14), PRESETS["elvira_w"], refinement=2)
    a = {(r.i, r.j): r.loss for r in alone.collect()}
    assert all((a[r.i, r.j] is None) == (r.loss is None) and (r.loss is None or abs(a[r.i, r.j] - r.loss) < 1e-9)
               for r in fits.filter("grid_id = '14'").collect())
