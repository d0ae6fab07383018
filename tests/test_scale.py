"""Plans and results that have to hold at size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import neighbours as N
from cellweave.schema import CELLS, GridShape


def table(spark, a, gid="g"):
    return spark.createDataFrame([(gid, i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], CELLS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_broadcast_no_cells(spark):
    """A packed row is a whole grid, so the estimated size of its cells says nothing."""
    packed = spark.createDataFrame([("a", [0.0, 1.0, 2.0, 3.0])], "grid_id string, v array<double>")
    cells = packed.select("grid_id", F.posexplode("v").alias("p", "u")).select(
        "grid_id", F.floor(F.col("p") / 2).cast("int").alias("i"), (F.col("p") % 2).cast("int").alias("j"), "u")
    found = N.gather(N.ring(cells, GridShape(2, 2), 8), cells, ["u"])
    assert "Broadcast" not in plan(found)
    assert sorted(r.t_u for r in found.filter("i = 0 AND j = 0").collect()) == [1.0, 1.0, 2.0, 2.0, 3.0, 3.0, 3.0, 3.0]


def test_dimensionwise_fits_run_in_batches(spark):
    """Every cell of a plane has its plane; no expression of the fit is interpreted row by row."""
    from cellweave.operators.surfaces import surface_fits
    from cellweave.schema import EXTEND

    a = np.add.outer(0.5 * np.arange(9), 0.25 * np.arange(9))
    cells = table(spark, a).withColumn("si", F.lit(0))
    for method, coefs in (("weno1d", 4), ("weno1d", 9), ("weno1d_points", 9)):
        fits = surface_fits(cells, GridShape(9, 9, EXTEND, EXTEND), method, coefs=coefs)
        assert "ArrowEvalPython" in plan(fits)
        middle = fits.filter("i = 4 AND j = 4").first().params
        n = 2 if coefs == 4 else 3
        assert np.allclose([middle[0], middle[1], middle[n]], [a[4, 4], 0.25, 0.5])


def test_disc_areas_run_in_batches(spark):
    from cellweave.functions.area import area_disc

    x = spark.createDataFrame([(0.0, 0.0, 1.0), (5.0, 5.0, 1.0), (None, 0.0, 1.0)], "a double, b double, r double")
    out = x.select(area_disc(F.col("a"), F.col("b"), F.col("r"), -2, 2, -2, 4).alias("area"))
    assert "ArrowEvalPython" in plan(out)
    got = [r.area for r in out.collect()]
    assert np.allclose(got[:2], [np.pi, 0.0]) and got[2] is None


def test_sweep_packs_fine_cells(spark):
    """Errors equal those of a join of all fine cells, whose rows are not what is shuffled."""
    from cellweave.plans.reconstruct import PRESETS, fit_sweep, run_sweep
    from cellweave.operators.labels import label_piecewise
    from cellweave.operators.resample import resample_interface_only

    rng = np.random.default_rng(5)
    cells = table(spark, np.clip(rng.uniform(-0.5, 1.5, (6, 6)), 0, 1))
    truth = table(spark, np.clip(rng.uniform(-0.5, 1.5, (12, 12)), 0, 1))
    shape, presets = GridShape(6, 6), [PRESETS[n] for n in ("constant", "elvira_w")]
    swept = run_sweep(cells, truth, shape, presets, 2)
    got = {r.preset: (r.error_l1, r.error_linf) for r in swept.collect()}
    fits = fit_sweep(label_piecewise(cells), shape, presets)
    for x in presets:
        fine = resample_interface_only(fits.filter(F.col("preset") == x.name), 2, ("constant", "line")).withColumnRenamed("u", "v")
        gap = F.abs(F.col("v") - F.col("u"))
        assert np.allclose(got[x.name], fine.join(truth, ["grid_id", "i", "j"]).agg(F.avg(gap), F.max(gap)).first())
    merged = [line for line in plan(swept).split("\n") if "SortMergeJoin" in line]
    assert merged and "hashpartitioning(grid_id" in plan(swept) and "max(CASE" in plan(swept)


def odd_cells(spark):
    """A noisy grid with pure cells, and one cell without a value."""
    from cellweave.operators.labels import label_piecewise

    rng = np.random.default_rng(11)
    cells = table(spark, np.clip(rng.uniform(-0.5, 1.5, (9, 9)), 0, 1))
    return label_piecewise(cells.withColumn("u", F.when((F.col("i") != 4) | (F.col("j") != 4), F.col("u"))))


def test_column_sums_run_in_batches(spark):
    """Proposals equal those of the expressions; windows are not normalised row by row (F14, F16, F20)."""
    from cellweave.operators import curves as C
    from cellweave.plans.reconstruct import Preset, proposal_arrays, proposal_rows

    cells, shape, names = odd_cells(spark), GridShape(9, 9), ["i", "j", "axis", "axis_rank", "cand", "model_idx", "family", "value_up", "value_down"]
    for models in ((C.curve_averages(4, ks=7),), (C.curve_points(2), C.circle_points()), (C.curve_averages(2), C.circle_taylor()), (C.corner_4cols(),)):
        for levels in (C.levels_sided, C.levels_window):
            p = Preset("one", models, angle=0.0, levels=levels)
            made = proposal_arrays(cells, shape, p).select("i", "j", F.inline("proposals"))
            text = plan(made)
            assert "ArrowEvalPython" in text and ("zip_with" not in text or levels is C.levels_window)
            rows, _ = proposal_rows(cells, shape, p)
            got, want = ([([r[n] for n in names], r.params) for r in x.orderBy(*names, "params").collect()]
                         for x in (made, rows.filter("family <> 'constant'")))
            assert len(got) == len(want) > 10
            for (a, x), (b, y) in zip(got, want):
                assert a == b and len(x) == len(y) and all(v == w or abs(v - w) < 1e-9 for v, w in zip(x, y))


def test_lines_are_chosen_without_grouping(spark):
    """Winners equal those of scored rows; after the tiles nothing is shuffled, exploded by member or grouped (F6, F15, F18)."""
    from dataclasses import replace

    from cellweave.operators.scoring import score_rows, select_best
    from cellweave.plans.reconstruct import PRESETS, fit_cells, fit_sweep, proposal_rows

    cells, shape = odd_cells(spark), GridShape(9, 9)
    one = PRESETS["elvira_w"]
    for x in (one, PRESETS["aero_linear"], replace(one, p=1.0), replace(one, eps=0.05), replace(one, score_cut_only=True), replace(one, axis=1)):
        rows, key = proposal_rows(cells, shape, x)
        scored = score_rows(rows, key, x.families, (x.window, x.window), 3, x.p, x.center_weight, x.score_cut_only)
        want = {(r.i, r.j): r for r in select_best(scored, x.eps, key).collect()}
        fits = fit_cells(cells, shape, x).filter("kind = 1")
        got = {(r.i, r.j): r for r in fits.collect()}
        assert got.keys() == want.keys() and any(r.family == "line" for r in got.values())
        for at, r in got.items():
            w = want[at]
            assert (r.family, r.axis, r.cand, r.params, r.value_up) == (w.family, w.axis, w.cand, w.params, w.value_up)
            assert r.loss == w.loss or r.loss is None and w.loss == float("inf") or abs(r.loss - w.loss) < 1e-12
    for fits in (fit_cells(cells, shape, one), fit_sweep(cells, shape, [PRESETS[n] for n in ("constant", "elvira", "elvira_w", "aero_linear")])):
        text = plan(fits)
        assert text.count("Exchange") == 1 and "SortAggregate" not in text and " HashAggregate" not in text and "ArrowEvalPython" in text


@pytest.mark.parametrize("modes", [("cyclic", "extend"), ("reflect", "cyclic")])
def test_batched_windows_equal_windows(spark, modes):
    """Small and large grids, one with a NULL, next to each other; a missing cell is an error (F1, F2)."""
    from cellweave.operators.windows import batched_windows, with_windows

    rng = np.random.default_rng(4)
    sizes = {"a": (3, 5), "b": (37, 6), "c": (34, 33), "d": (3, 5)}
    cells = None
    for name, size in sizes.items():
        part = table(spark, rng.uniform(0, 1, size)).withColumn("grid_id", F.lit(name))
        cells = part if cells is None else cells.unionByName(part)
    cells = cells.withColumn("u", F.when((F.col("i") != 1) | (F.col("j") != 2), F.col("u"))).withColumn("kind", (F.col("u") > .4).cast("int"))
    grids = spark.createDataFrame([(n, *s, *modes) for n, s in sizes.items()], "grid_id string, ni int, nj int, mode_i string, mode_j string")
    cases = [(cells, grids), (cells.filter("grid_id = 'c'"), GridShape(34, 33, *modes)), (cells.filter("grid_id = 'a'"), GridShape(3, 5, *modes))]
    for c, shape in cases:
        for where in (None, F.col("kind") == 1):
            want, got = ({(r.grid_id, r.i, r.j): (r.u, r.w_u, [x if x is None else float(x) for x in r.w_kind]) for r in x.collect()} for x in (
                with_windows(c, shape, 5, 5, ["u", "kind"], where), batched_windows(c, shape, 5, ["u", "kind"], where, ("u",))))
            assert want == got and want
    with pytest.raises(Exception, match="not dense"):
        batched_windows(cells.filter("i + j > 0"), grids, 3, ["u"]).collect()


def test_wedges_are_scored_in_batches(spark):
    """Losses equal those of score_rows, also with NULLs and repeated rows; no row a member is made (F2)."""
    from cellweave.operators.scoring import FIELDS, score_rows, score_table
    from cellweave.operators.windows import with_windows
    from cellweave.schema import KEY

    rng, cells = np.random.default_rng(6), odd_cells(spark)
    rows = []
    for n in range(400):
        p = [*rng.uniform(-1, 1.5, 2), *rng.choice([-3., -2.2, -.6, 0., .7, 1.4, 2.9, np.pi], 2)]
        p = [None if rng.random() < .04 else float(x) for x in p]
        up, down = (None if rng.random() < .03 else float(x) for x in rng.uniform(0, 1, 2))
        rows.append(("g", n % 9, n // 9 % 9, 9, 0, n // 81, n % 2, "wedge", p, up, down))
    made = spark.createDataFrame(rows + rows[:3], "grid_id string, i int, j int, model_idx int, axis_rank int, cand int, axis int, "
                                 "family string, params array<double>, value_up double, value_down double")
    made = made.withColumn("grid_id", F.lit(cells.first().grid_id))
    w = with_windows(cells, GridShape(9, 9), 3, 3)
    for proposals, windows, once in ((made, w.unionByName(w.filter("i < 2")), False), (made.distinct(), w, True)):
        table_ = score_table(proposals, windows, ("wedge",), center_weight=100.0, once=once)
        got, want = ({tuple(map(str, [r[f] for f in [*KEY, *FIELDS]])): r.loss for r in x.collect()} for x in (
            table_, score_rows(proposals.join(windows.select(*KEY, "w_u"), KEY), KEY, ("wedge",), (3, 3), center_weight=100.0)))
        assert got.keys() == want.keys() and len(got) == 400 and sum(x is not None for x in got.values()) > 300
        for at, x in want.items():
            assert (got[at] is None) == (x is None) and (x is None or abs(got[at] - x) <= 1e-9 * max(1, abs(x)))
        assert "ArrowEvalPython" in plan(table_) and "explode(sequence(0, 8" not in table_._jdf.queryExecution().optimizedPlan().toString()


def test_sweep_meets_packed_rows(spark):
    """Fits and truth of a sweep are one row a coarse cell from the start, with the errors of fine rows (F1)."""
    from cellweave.operators.resample import packed_interface_only, resample_interface_only
    from cellweave.plans.catalog import queries
    from cellweave.plans.reconstruct import PRESETS, fit_sweep, run_sweep
    from cellweave.sources.shapes import rasterize_shapes, true_fine_grid

    shapes = spark.createDataFrame([(str(n), n, n, 0, [.511, .486, .3], 0., 1.) for n in (6, 9)],
                                   "grid_id string, ni int, nj int, axis int, params array<double>, value_up double, value_down double")
    grids = shapes.select("grid_id", "ni", "nj", F.lit("cyclic").alias("mode_i"), F.lit("cyclic").alias("mode_j"))
    cells, presets, f = rasterize_shapes(shapes, "disc").cache(), [PRESETS[n] for n in ("constant", "elvira_w", "aero_linear")], 3

    def spread(packed, *by):
        return {(r.grid_id, f * r.i + n // f, f * r.j + n % f, *[r[b] for b in by]): r.fine[n if len(r.fine) > 1 else 0]
                for r in packed.collect() for n in range(f * f)}

    rows, packed = true_fine_grid(shapes, "disc", cells, f), true_fine_grid(shapes, "disc", cells, f, packed=True)
    want, got = {(r.grid_id, r.i, r.j): r.u for r in rows.collect()}, spread(packed)
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-12 for k in want)
    from cellweave.operators.labels import label_piecewise
    for preset in ("constant", "elvira_w"):
        # also a line whose parts are NULL
        fits = fit_sweep(label_piecewise(cells), grids, presets).filter(F.col("preset") == preset)
        fits = fits.withColumn("params", F.when((F.col("family") == "line") & (F.col("i") < 3), F.array(F.lit(None).cast("double"), F.col("params")[1])).otherwise(F.col("params")))
        want = {(r.grid_id, r.i, r.j): r.u for r in resample_interface_only(fits, f, ("constant", "line")).collect()}
        for families in (("constant", "line"), ("constant",)) if preset == "constant" else (("constant", "line"),):
            got = spread(packed_interface_only(fits, f, families))
            assert want.keys() == got.keys() and all(got[k] is None if want[k] is None else abs(want[k] - got[k]) < 1e-12 for k in want)
    with pytest.raises(Exception, match="family not listed"):
        packed_interface_only(fits.withColumn("family", F.lit("arc")), f).collect()
    one, two = ({(r.grid_id, r.preset): (r.error_l1, r.error_linf) for r in run_sweep(cells, t, grids, presets, f).collect()} for t in (rows, packed))
    assert one.keys() == two.keys() and len(one) == 6 and all(np.allclose(one[k], two[k], atol=1e-12) for k in one)
    text = plan(queries()["disc_sweep"](spark, "/root/testdata/sf0.001"))
    assert "max(CASE" not in text and "SortMergeJoin" in text
    cells.unpersist()
