"""Sources, samples and learning."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import analytics as Q
from cellweave.operators import grid_ops as G
from cellweave.operators import learning as ML
from cellweave.plans.reconstruct import PRESETS, fit_cells
from cellweave.schema import CELLS, GridShape
from cellweave.sources import binning as B
from cellweave.sources import samples as D
from cellweave.sources.images import read_images
from cellweave.sources.shapes import add_uniform_noise
from cellweave.sources.tables import read_table, write_table


def bmp(path, pixels):
    """A 24-bit bitmap, rows stored bottom-up."""
    h, w, _ = pixels.shape
    pad = (-3 * w) % 4
    rows = b"".join(pixels[r, :, ::-1].tobytes() + b"\0" * pad for r in range(h - 1, -1, -1))
    head = struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack(
        "<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0)
    path.write_bytes(head + rows)


def test_images_become_pixel_tables(spark, tmp_path):
    rng = np.random.default_rng(0)
    px = rng.integers(0, 255, (6, 5, 3), dtype=np.uint8)
    bmp(tmp_path / "a.bmp", px)
    out = read_images(spark, str(tmp_path), normalize=False).collect()
    got = np.zeros((6, 5))
    for r in out:
        got[r.i, r.j] = r.u
    assert len(out) == 30 and np.allclose(got, px.mean(axis=2))
    lo, hi = read_images(spark, str(tmp_path)).agg(F.min("u"), F.max("u")).first()
    assert (lo, hi) == (0.0, 1.0)


def test_tables_are_written_once_and_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    cells = spark.createDataFrame([(f"g{k}", 0, 0, float(k)) for k in range(50)], CELLS)
    write_table(cells, path, buckets=8)
    write_table(cells.limit(0), path, buckets=8)
    assert read_table(spark, path).count() == 50
    one = read_table(spark, path, key=("grid_id", "g7"), buckets=8)
    assert [r.u for r in one.collect()] == [7.0]
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    csv = str(tmp_path / "c")
    write_table(cells, csv, fmt="csv")
    assert read_table(spark, csv, CELLS, "csv", first_n=3, order_by="u").agg(F.sum("u")).first()[0] == 3.0


def test_binning_keeps_mass_and_densify_fills(spark):
    cells = spark.range(60).select(F.lit("g").alias("grid_id"), (F.col("id") / 10).cast("int").alias("i"),
                                   (F.col("id") % 10).cast("int").alias("j"), F.col("id").cast("double").alias("u"))
    c = B.coarsen(cells, 2, 5)
    assert c.agg(F.sum("u")).first()[0] * 10 == cells.agg(F.sum("u")).first()[0]
    full = B.densify(cells.filter("j > 3"), B.grids_of(cells, GridShape(6, 10)), -1.0)
    assert full.count() == 60 and full.filter("u = -1").count() == 24


def test_noise_does_not_depend_on_partitions(spark):
    cells = spark.range(200).select(F.lit("g").alias("grid_id"), F.col("id").cast("int").alias("i"), F.lit(0).alias("j"), F.lit(0.).alias("u"))
    runs = [sorted((r.i, r.u) for r in add_uniform_noise(cells.repartition(p), .1).collect()) for p in (1, 4, 16)]
    assert runs[0] == runs[1] == runs[2] and max(abs(u) for _, u in runs[0]) <= .1 and len({u for _, u in runs[0]}) == 200


def test_rank_in_grid(spark):
    cells = spark.range(500).select((F.col("id") % 2).cast("string").alias("grid_id"), F.col("id").cast("int").alias("i"),
                                    F.lit(0).alias("j"), ((F.col("id") * 37) % 101).cast("double").alias("u"))
    got = {(r.grid_id, r["rank"]): (r.u, r.i) for r in G.rank_in_grid(cells, "u", 4).collect()}
    for g in "01":
        want = sorted([(-((k * 37) % 101), k) for k in range(500) if str(k % 2) == g])[:4]
        assert [got[g, n + 1] for n in range(4)] == [(-float(u), k) for u, k in want]


def brute_kernel(f, up, down, m=300):
    t = (np.arange(m) + .5) / m
    out = []
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            x, y = a - .5 + t[:, None], b - .5 + t[None, :]
            out.append(np.where(y >= f(x), up, down).mean())
    return out


def test_line_samples_match_pixel_counts(spark):
    s = D.generate_samples(D.sample_spine(spark, 40), D.sample_lines(1, (-.3, .3), .5)).collect()
    for r in s:
        f = lambda x: r.curve[1] + np.tan(r.curve[0]) * x
        errs = [np.abs(np.array(r.kernel) - brute_kernel(f, *ud)).max() for ud in ((0., 1.), (1., 0.))]
        assert min(errs) < .02 and r.singular == (1e-9 < r.kernel[4] < 1 - 1e-9)
        assert -1e-12 <= r.flux <= r.velocity[0] + 1e-12
    again = D.generate_samples(D.sample_spine(spark, 40).repartition(7), D.sample_lines(1, (-.3, .3), .5)).orderBy("sample_id").collect()
    assert [r.kernel for r in s] == [r.kernel for r in again]


def test_other_samplers(spark):
    spine = D.sample_spine(spark, 60)
    for curve in (D.sample_points(2, D.points_x(3)), D.sample_points(2, D.points_x(5, "quadratic", 2.)),
                  D.sample_points(4, D.points_x(3), (.3, .6, .3), "arc"), D.sample_corners(5), D.sample_corners(6, relative=False)):
        out = D.generate_samples(spine, curve, (3, 5), velocity=[0.25, -0.5]).collect()
        assert out and all(len(r.kernel) == 15 and -1e-9 <= min(r.kernel) and max(r.kernel) <= 1 + 1e-9 for r in out)
        assert {r.velocity[0] for r in out} == {0.25, -0.5}
    t = D.transpose_samples(D.generate_samples(spine, D.sample_lines(1), (3, 5)), (3, 5))
    assert t.first().kernel[1] == D.generate_samples(spine, D.sample_lines(1), (3, 5)).first().kernel[5]


def test_views_ranks_and_unions(spark):
    ids = spark.range(1000).select((F.col("id") * 977).alias("sample_id"), F.array(F.lit(0.)).alias("kernel"), F.lit(True).alias("singular"))
    v = D.training_view(ids, "classification", 300, 800)
    assert v.count() == 800 and v.filter("is_train").agg(F.max("sample_id")).first()[0] == 299 * 977
    spine = D.sample_spine(spark, 10)
    parts = [D.generate_samples(spine, D.sample_lines(n)) for n in range(3)]
    c = D.concat_samples(parts, [0, 1, 1], 9)
    assert c.filter("class_id = 1").count() == 20 and c.filter("class_id = 1").first().one_hot == [0., 1.]
    with pytest.raises(Exception, match="differ in kernel"):
        D.concat_samples([parts[0], D.generate_samples(spine, D.sample_lines(1), (5, 5))], None, 9).collect()


def test_models_learn_and_are_reused(spark, tmp_path):
    s = D.generate_samples(D.sample_spine(spark, 1500), D.sample_lines(1, (-.25, .25), .5), random_sides=False)
    v = D.training_view(D.curve_targets(s, "slope"), "curve", 1000).cache()
    path = str(tmp_path / "m")
    m = ML.fit_or_load(spark, path, v, "linear", 2)
    again = ML.fit_or_load(spark, path, v.limit(0), "linear", 2)
    e = {r.is_train: r for r in ML.model_errors(again.transform(v)).collect()}
    assert e[False].error_l1 < .1 and e[True].error_l1 == pytest.approx(ML.model_errors(m.transform(v)).filter("is_train").first().error_l1)
    taught = v.filter("is_train").collect()
    x = np.array([[1.0, *r.x] for r in taught])
    want = np.linalg.lstsq(x, np.array([r.y for r in taught]), rcond=None)[0]
    assert np.allclose(x @ np.array(m.coefficients).T, x @ want, atol=1e-6)
    v.unpersist()


def test_shares_and_class_weights(spark):
    ids = spark.range(20_000).select((F.col("id") * 31).alias("sample_id"), F.array(F.lit(0.)).alias("kernel"), F.lit(True).alias("singular"))
    v = D.training_view(ids, "classification", share=0.25)
    assert v.count() == 20_000 and abs(v.filter("is_train").count() - 5000) < 300
    with pytest.raises(ValueError):
        D.training_view(ids, "classification")
    rng = np.random.default_rng(6)
    raw = rng.dirichlet((4., 3., .3), 4000)
    p = spark.createDataFrame([(r.tolist(),) for r in raw], "probability array<double>")
    weight, n = ML.tune_class_weight(p, 2, (700, 720))
    won = int((raw[:, 2] * weight > raw[:, :2].max(axis=1)).sum())
    assert 700 <= n <= 720 and won == n
    # many rows of one critical weight: the band cannot be met, the number just below it comes back
    same = spark.createDataFrame([([.5, .4, .1],)] * 50 + [([.2, .2, .6],)] * 10, "probability array<double>")
    weight, n = ML.tune_class_weight(same, 2, (20, 30))
    assert n == 10 and weight == pytest.approx(5.0, rel=1e-6)


def test_routed_fits_use_routed_models_only(spark):
    rng = np.random.default_rng(4)
    rows = [("g", i, j, float(u), int(0 < u < 1)) for i in range(10) for j in range(10) for u in [float(np.clip(rng.uniform(-.6, 1.6), 0, 1))]]
    cells = spark.createDataFrame(rows, "grid_id string, i int, j int, u double, kind int")
    routes = {0: [0], 1: [0, 1], 2: [0, 2], 3: [0, 1, 2, 3], 4: [3]}
    route = F.element_at(F.create_map(*[F.lit(x) for k, v in routes.items() for x in (k, list(v))]), F.pmod(F.col("i") + F.col("j"), F.lit(5)))
    shape, preset = GridShape(10, 10), PRESETS["corner_4cols"]
    fits = fit_cells(cells.withColumn("route", route), shape, preset).collect()
    free = {(r.i, r.j): r for r in fit_cells(cells, shape, preset).collect()}
    assert len(fits) == 100
    for r in fits:
        allowed = routes[(r.i + r.j) % 5] if r.kind == 1 else [0]
        assert r.model_idx in {0, *allowed}
        if (r.i + r.j) % 5 == 3:
            assert r.model_idx == free[r.i, r.j].model_idx and r.params == free[r.i, r.j].params
    assert {r.model_idx for r in fits} >= {0, 1, 2}


def test_rates_and_quantiles(spark):
    r = spark.createDataFrame([("m", n, 3. * n ** -2) for n in (10, 20, 40, 80)], "model string, n int, error_l1 double")
    x = Q.convergence_rate(r, 15).first()
    assert x.rate == pytest.approx(-2) and np.exp(x.origin) == pytest.approx(3)
    d = spark.createDataFrame([("m", float(k)) for k in range(101)] + [("m", float("nan"))], "model string, seconds double")
    q = Q.duration_stats(d).first()
    assert (q.q05, q.q50, q.q95, q["mean"]) == (5., 50., 95., 50.)
    rng = np.random.default_rng(2)
    groups = {"narrow": np.append(5 + rng.random(3000) * 1e-7, [1e12, -1e9]), "equal": np.full(3000, 2.5), "wide": 10.0 ** rng.uniform(-12, 12, 3000),
              "signs": np.concatenate([rng.normal(size=2000), np.zeros(1500)]), "one": np.array([7.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "model string, seconds double")
    probs = [0.0, .05, .5, .93, 1.0]
    for r in Q.exact_quantiles(rows, ["model"], "seconds", probs, sorted_rows=20).collect():
        assert r.quantile == pytest.approx(np.quantile(groups[r.model], r.prob), rel=1e-12, abs=1e-300)
    assert sorted(x.n for x in Q.log_spaced(spark, 10, 1000, 3).collect()) == [10, 100, 1000]
