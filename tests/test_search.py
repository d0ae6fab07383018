"""Walks, regions, adaptive windows, corners and refinement against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions.area import curve_height, graph_slope
from cellweave.operators import adaptive as AD
from cellweave.operators import walks as W
from cellweave.operators import corners as K
from cellweave.operators import neighbours as N
from cellweave.operators import sides as S
from cellweave.operators.curves import lines_3slopes
from cellweave.operators.labels import gradient, gradient_sparse, label_piecewise
from cellweave.operators.refine import refine_candidates
from cellweave.operators.scoring import score_table, select_best
from cellweave.operators.windows import with_windows
from cellweave.plans.reconstruct import PRESETS, Preset, fit_cells, proposal_rows, scored_proposals
from cellweave.schema import CELLS, CYCLIC, EXTEND, GridShape
from cellweave.sources.shapes import rasterize_shapes

DISC = "grid_id string, ni int, nj int, axis int, params array<double>, value_up double, value_down double"
RNG = np.random.default_rng(3)


def table(spark, a, gid="g"):
    return spark.createDataFrame([(gid, int(i), int(j), float(a[i, j])) for i in range(a.shape[0])
                                  for j in range(a.shape[1])], CELLS)


def random_cells(spark, n, m):
    a = np.clip(RNG.uniform(-.6, 1.6, (n, m)), 0, 1)
    return a, label_piecewise(table(spark, a))


@pytest.mark.parametrize("mode", ["cyclic", EXTEND, "reflect"])
@pytest.mark.parametrize("start", [1, 2])
def test_column_walk(spark, mode, start):
    n = 11
    a, cells = random_cells(spark, n, n)
    shape = GridShape(n, n, mode, mode)
    runs = S.column_runs(cells, shape, 0, F.col("kind") == 0, block=4)
    plain = {(r.i, r.j): (r.prev, r.next) for r in runs.collect()}
    assert plain == {(r.i, r.j): (r.prev, r.next) for r in S.column_runs(cells, shape, 0, F.col("kind") == 0).collect()}
    out = {(r.i, r.j): r for r in S.opposite_by_direction(cells, shape, 0, start).collect()}
    cut = (a > 1e-10) & (a < 1 - 1e-10)
    assert len(plain) == n * n and set(out) == {tuple(map(int, x)) for x in np.argwhere(cut)}
    for (i, j), r in out.items():
        for sign, got in ((-1, r.down_pos), (1, r.up_pos)):
            want = None
            for k in range(start, n):
                p = j + sign * k
                q = fold(p, n, mode)
                if not cut[i, q]:
                    want = p if mode != EXTEND else q
                    break
            if mode != EXTEND:
                assert got == want
            elif want is not None and 0 <= j + sign * start < n:
                assert got == want


def test_nearest_interface(spark):
    n = 9
    a, cells = random_cells(spark, n, n)
    cut = (a > 1e-10) & (a < 1 - 1e-10)
    for r in S.nearest_interface(cells, GridShape(n, n), 0).collect():
        want = None
        for k in range(n):
            for s in (1, -1):
                if want is None and cut[r.i, (r.j + s * k) % n]:
                    want = r.j + s * k
        assert r.near_pos == want


def test_minmax_walk_ends_in_regular_cells(spark):
    n = 14
    shapes = spark.createDataFrame([("d", n, n, 0, [.511, .486, .3], 0., 1.)], DISC)
    cells = label_piecewise(rasterize_shapes(shapes, "disc"))
    out = S.opposite_by_minmax(cells, GridShape(n, n), 0, 5).collect()
    assert len(out) == cells.filter("kind = 1").count()
    assert all({r.down_u, r.up_u} <= {0.0, 1.0} or abs(r.down_u - r.up_u) > .99 for r in out)


def test_minmax_walks_are_followed_to_their_end(spark):
    ring = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    n, m = 4, 7
    a = np.random.default_rng(3).permutation(n * m).reshape(n, m) / (n * m + 1) + 0.01
    a[2, 3], a[0, 5] = 1.0, 0.0
    cells = label_piecewise(table(spark, a))
    pure = {(r.i, r.j) for r in cells.filter("kind = 0").collect()}

    def walk(i, j, side):
        cur, steps = (i, j + side), 0
        seen = [(i, j), cur, (i, j - side)]
        while steps < 400:
            steps += 1
            free = [(x, y) for x, y in ((cur[0] + p, cur[1] + q) for p, q in ring) if (x, y) not in seen]
            if not free:
                return None, steps
            cur = min(free, key=lambda t: -side * a[t[0] % n, t[1] % m] - 1e-5 * abs(t[1] - j))
            if (cur[0] % n, cur[1] % m) in pure:
                return cur, steps
            seen.append(cur)
        return None, steps

    got = {(r.i, r.j): r for r in S.opposite_by_minmax(cells, GridShape(n, m), 0).collect()}
    cut = [(i, j) for i in range(n) for j in range(m) if (i, j) not in pure]
    assert len(got) == len(cut)
    longest = 0
    for i, j in cut:
        ends = [walk(i, j, side) for side in (1, -1)]
        r = got[i, j]
        ended = [e[0] for e in ends if e[0]]
        longest = max([longest, *[e[1] for e in ends if e[0]]])
        assert {x for x in ((r.down_i, r.down_j), (r.up_i, r.up_j)) if x[0] is not None} == set(ended)
    assert longest > 8


def fold(p, n, mode):
    turned = p % max(2 * (n - 1), 1)
    return {"cyclic": p % n, "extend": min(max(p, 0), n - 1)}.get(mode, min(turned, 2 * (n - 1) - turned))


@pytest.mark.parametrize("axis,modes", [(0, ("cyclic", "extend")), (1, ("reflect", "cyclic"))])
def test_walks_across_tiles(spark, axis, modes):
    """Long greedy walks and rays on a grid of several tiles, over every kind of edge, against a walk cell by cell."""
    n, m = 70, 40
    rng = np.random.default_rng(8)
    x, y = np.meshgrid(np.arange(n), np.arange(m), indexing="ij")
    a = 0.1 + 0.8 * x / n + rng.uniform(-.002, .002, (n, m))
    a[66, ::2], a[2, 1::3], a[20:24, 30:34] = 1.0, 0.0, .5
    cells = label_piecewise(table(spark, a)).cache()
    shape = GridShape(n, m, *modes)
    pure = {tuple(map(int, p)) for p in np.argwhere((a == 0) | (a == 1))}

    def at(p):
        return fold(p[0], n, modes[0]), fold(p[1], m, modes[1])

    def climb(i, j, side, limit):
        d = (0, side) if axis == 0 else (side, 0)
        cur = (i + d[0], j + d[1])
        seen = {(i, j), cur, (i - d[0], j - d[1])}
        for _ in range(limit):
            free = [(cur[0] + p, cur[1] + q) for p, q in N.RING_8 if (cur[0] + p, cur[1] + q) not in seen]
            if not free:
                return None
            cur = min(free, key=lambda t: -side * a[at(t)] - 1e-5 * (abs(t[1] - j) if axis == 0 else abs(t[0] - i)))
            if at(cur) in pure:
                return cur
            seen.add(cur)
        return None

    def check(rows, walk, own):
        longest = 0
        for i, j in own:
            ends = sorted([(*((p[1], s, p[0]) if axis == 0 else (p[0], s, p[1])), p) for s in (-1, 1) for p in [walk(i, j, s)] if p])
            r, pos = rows[i, j], j if axis == 0 else i
            down = ends[0] if len(ends) == 2 or (ends and (ends[0][0] < pos or (ends[0][0] == pos and ends[0][1] < 0))) else None
            up = ends[-1] if ends and (len(ends) == 2 or down is None) else None
            assert ((r.down_i, r.down_j), (r.up_i, r.up_j)) == (down[3] if down else (None, None), up[3] if up else (None, None))
            assert r.down_u == (a[at(down[3])] if down else None) and r.up_u == (a[at(up[3])] if up else None)
            longest = max([longest, *[max(abs(e[3][0] - i), abs(e[3][1] - j)) for e in ends]])
        return longest

    cut = [(i, j) for i in range(n) for j in range(m) if (i, j) not in pure]
    got = {(r.i, r.j): r for r in S.opposite_by_minmax(cells, shape, axis, 60).collect()}
    assert len(got) == len(cut) and check(got, lambda i, j, s: climb(i, j, s, 60), cut) > 16
    # rays: only few cells are cut here, so that rays are long
    b = np.zeros((n, m))
    b[20:23, 10:13], b[50, 30] = rng.uniform(.2, .8, (3, 3)), .5
    b[(x + y) % 9 == 0] = np.where(b == 0, .3, b)[(x + y) % 9 == 0]
    cells = label_piecewise(table(spark, b)).withColumn("si", F.lit(1.0) + F.col("j") % 5).cache()
    rows = S.opposite_by_gradient(cells, shape, axis, 2, ratio=0.6).collect()
    gx = {(r.i, r.j): (r.gx, r.gy) for r in gradient(cells, shape, "scharr").collect()}

    def shoot(i, j, side):
        g = np.array(gx[i, j])
        g = g / np.hypot(*g) if g[0] != 0 and g[1] != 0 else g
        for k in range(2, n):
            p = (int(np.floor(i + .5 + k * side * g[0])), int(np.floor(j + .5 + k * side * g[1])))
            q = at(p)
            if b[q] in (0, 1) and max(abs(p[0] - i), abs(p[1] - j)) > 2 and 1 + q[1] % 5 < 0.6 * (1 + j % 5):
                return p
        return None
    a = b
    cut = [(i, j) for i in range(n) for j in range(m) if 0 < b[i, j] < 1]
    assert len(rows) == len(cut)
    check({(r.i, r.j): r for r in rows}, shoot, cut)


def test_endless_walks():
    line = [(0, 0), (0, 1), (0, -1)] + [(0, j) for j in range(2, 30)]
    assert W.endless(line, (4, 5), ("cyclic", "extend"), 0) and not W.endless(line[:8], (4, 5), ("cyclic", "cyclic"), 0)
    assert W.endless(line, (4, 5), ("cyclic", "cyclic"), 0) and not W.endless(line, (4, 40), ("cyclic", "extend"), 0)


def test_region_stencil(spark):
    n = 8
    a, cells = random_cells(spark, n, n)
    cut = (a > 1e-10) & (a < 1 - 1e-10)
    m = 6
    for r in N.same_region_stencil(cells, GridShape(n, n), m).collect():
        region, front = {(r.i, r.j)}, [(r.i, r.j)]
        while front:
            x, y = front.pop()
            for di in (-1, 0, 1):
                for dj in (-1, 0, 1):
                    q = ((x + di) % n, (y + dj) % n)
                    if q not in region and cut[q] == cut[r.i, r.j]:
                        region.add(q), front.append(q)
        got = [(x.i, x.j) for x in r.members]
        assert got[0] == (r.i, r.j) and len(set(got)) == len(got) == min(m, len(region)) and set(got) <= region


def test_scatter_equals_tiles(spark):
    a, cells = random_cells(spark, 9, 7)
    shape = GridShape(9, 7)
    x = {(r.i, r.j): (r.gx, r.gy) for r in gradient(cells, shape, "scharr").collect()}
    y = {(r.i, r.j): (r.gx, r.gy) for r in gradient_sparse(cells, shape, "scharr").collect()}
    assert all(np.allclose(x[k], y[k]) for k in x) and len(x) == len(y) == 63


def test_missing_cells_are_an_error(spark):
    _, cells = random_cells(spark, 4, 4)
    with pytest.raises(Exception, match="not dense"):
        with_windows(cells.filter("i + j > 0"), GridShape(4, 4), 3, 3).collect()


@pytest.mark.parametrize("axis,mode,k", [(0, "cyclic", 3), (1, "cyclic", 5), (0, "reflect", 3), (1, "extend", 5)])
def test_adaptive_window(spark, axis, mode, k):
    n = 16
    shapes = spark.createDataFrame([("d", n, n, 0, [.511, .486, .31], 0., 1.)], DISC)
    cells = label_piecewise(rasterize_shapes(shapes, "disc"))
    # a column without a regular cell, runs at the edges, and a cut corner
    spots = ((F.col("i") == 2) | (F.col("j") == 13) | ((F.col("i") >= 14) & (F.col("j") <= 1)) | ((F.col("i") == 0) & (F.col("j") > 8)))
    cells = cells.withColumn("kind", F.when(spots, 1).otherwise(F.col("kind"))).cache()
    cut = np.zeros((n, n), bool)
    for r in cells.collect():
        cut[r.i, r.j] = r.kind == 1
    g = cut if axis == 0 else cut.T

    def bounds(c, p):
        out = []
        for s in (-1, 1):
            q = next((p + s * d for d in range(1, 3 * n) if not g[c, fold(p + s * d, n, mode)]), None)
            out.append(q)
        return None if None in out else tuple(out)

    def near(c, p):
        free = (p + s * d for d in range(n) for s in (1, -1))
        return next((q for q in free if (mode == "cyclic" or 0 <= q < n) and g[c, fold(q, n, mode)]), None)

    rows = AD.adaptive_stencil(cells, GridShape(n, n, mode, mode), axis, k).collect()
    assert len(rows) == cut.sum()
    followed = 0
    for r in rows:
        c, p = (r.i, r.j) if axis == 0 else (r.j, r.i)
        cols = {0: bounds(c, p)}
        for s in (1, -1):
            q, at, way = p, c, s
            for d in range(1, k):
                at += way
                if not 0 <= at < n and mode == "reflect":
                    way = -way
                at = fold(at, n, mode)
                q = near(at, q)
                if q is None or bounds(at, q) is None:
                    break
                cols[s * d] = bounds(at, q)
        options = []
        for w in range(k):
            part = [cols.get(w - k + 1 + x) for x in range(k)]
            if all(x is not None for x in part):
                lo, hi = min(x[0] for x in part), max(x[1] for x in part)
                options.append((hi - lo + 2.1 * abs(w - k // 2), w, lo, hi))
        _, w, lo, hi = min(options) if options else (0, k // 2, p - k // 2, p + k // 2)
        followed += bool(options)
        assert (r.c0 - c, r.s0, r.s1) == (w - k + 1, lo, hi)
    assert 0 < followed < len(rows)


def test_adaptive_fit_is_exact_on_a_line(spark):
    n = 16
    # a band: two straight, parallel interfaces, so that the grid is cyclic along i
    a = np.zeros((n, n))
    a[:, 5:10] = 1
    a[:, 10], a[:, 4] = .4, .7
    cells = label_piecewise(table(spark, a))
    shape = GridShape(n, n)
    w = AD.adaptive_stencil(cells, shape, 0)
    lv = S.opposite_by_direction(cells, shape, 0).select("grid_id", "i", "j", F.col("down_u").alias("value_down"),
                                                         F.col("up_u").alias("value_up"))
    sums = AD.adaptive_sums(w, lv, cells, shape, 0)
    for consistent, degree in ((False, 2), (True, 1)):
        for r in AD.propose_adaptive(sums, 0, degree, consistent=consistent).collect():
            assert r.params[0] == pytest.approx(.4 if r.j == 10 else .3) and abs(r.params[1]) < 1e-9


def test_adaptive_sums_meet_columns_in_pieces(spark):
    """Windows across the ends of pieces and around the edge, against sums cell by cell; a window's cells make no rows."""
    ni, nj = 5, 70
    a = np.random.default_rng(8).choice([0., 1., .2, .6], (ni, nj))
    cells = label_piecewise(table(spark, a))
    windows = [(i, j, i - 1, i + 1, j - low, j + high) for i in range(ni) for j, low, high in ((0, 3, 2), (31, 2, 40), (63, 35, 4), (69, 1, 6))]
    w = spark.createDataFrame([("a", *x) for x in windows], "grid_id string, i int, j int, c0 int, c1 int, s0 int, s1 int")
    name = cells.first().grid_id
    w = w.withColumn("grid_id", F.lit(name))
    lv = w.select("grid_id", "i", "j", F.when(F.col("i") % 2 == 0, .9).otherwise(.1).alias("value_up"), F.lit(.3).alias("value_down"))
    for modes in ((CYCLIC, CYCLIC), (EXTEND, EXTEND)):
        sums = AD.adaptive_sums(w, lv, cells, GridShape(ni, nj, *modes), 0)
        assert "explode(sequence(s0" not in sums._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.i, r.j): r for r in sums.collect()}
        assert len(got) == len(windows)
        for i, j, c0, c1, s0, s1 in windows:
            up, down = (.9 if i % 2 == 0 else .1), .3
            lo, hi = min(up, down), max(up, down)
            want = []
            for c in range(c0, c1 + 1):
                total = 0.
                for p in range(s0, s1 + 1):
                    ci, cj = (c % ni, p % nj) if modes[0] == CYCLIC else (min(max(c, 0), ni - 1), min(max(p, 0), nj - 1))
                    u = a[ci, cj]
                    if u in (0., 1.):
                        u = lo if u < (lo + hi) / 2 else hi
                    x = (u - lo) / (hi - lo)
                    total += 1 - x if up > down else x
                want.append(total)
            assert got[i, j].sums == pytest.approx(want) and (got[i, j].shift, got[i, j].base) == (i - c0, s0 - j)


def test_corner_query_makes_its_fits_once(spark):
    from cellweave.plans.catalog import queries

    plan = queries()["fit_corner_from_neighbours"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1  # the windows that the wedges are scored on; all else reads the fits


def test_refinement_never_hurts(spark):
    n = 14
    shapes = spark.createDataFrame([("d", n, n, 0, [.511, .486, .3], 0., 1.)], DISC)
    cells = label_piecewise(rasterize_shapes(shapes, "disc"))
    p = Preset("one", (lines_3slopes(),), axis=0)
    rows, key = proposal_rows(cells, GridShape(n, n), p)
    before = scored_proposals(cells, GridShape(n, n), p).select("i", "j", "cand", F.col("loss").alias("old"))
    after = refine_candidates(rows, key, p.families, (p.window, p.window), 3)
    both = after.join(before, ["i", "j", "cand"]).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("loss") - F.col("old")).alias("worse"),
        F.sum(F.col("old") - F.col("loss")).alias("gain")).first()
    assert both.n == before.count() and both.worse <= 1e-12 and both.gain > 0


def test_corner_from_neighbours(spark):
    """Two lines meeting inside a cell: the corner proposal beats any single line there."""
    n = 12
    shapes = spark.createDataFrame([("c", n, n, 0, [.54, .30, .35, .85, -.67], 0., 1.)], DISC)
    shapes = shapes.withColumn("params", F.array(*[F.lit(x) for x in (.54, .30, .35, .30 + .54 * 1.02, -.67)]))
    cells = label_piecewise(rasterize_shapes(shapes, "corner"))
    shape = GridShape(n, n, EXTEND, EXTEND)
    fits = fit_cells(cells, shape, PRESETS["elvira_w"]).cache()
    lv = fits.filter("family = 'line'").select("grid_id", "i", "j", F.lit(0.).alias("value_up"), F.lit(1.).alias("value_down"))
    made = K.corner_from_neighbours(fits, lv, shape)
    assert made.count() > 0
    w = with_windows(cells, shape, 3, 3)
    scored = score_table(made, w, ("wedge",), center_weight=100.0)
    best = {(r.i, r.j): r for r in select_best(scored).collect()}
    lines = {(r.i, r.j): r.loss for r in fits.filter("family = 'line'").collect()}
    at = (int(.54 * n), int((.30 + .35 * .54) * n))
    assert at in best and best[at].loss < 1e-6 < lines[at]
    wider = K.branch_ends(fits, shape, 2)
    assert all(max(abs(r.n1.di), abs(r.n1.dj)) > 2 and max(abs(r.n2.di), abs(r.n2.dj)) > 2 for r in wider.collect())


def test_branches_against_a_plain_search():
    rng = np.random.default_rng(5)
    flags = rng.random((300, 9, 9)) < .45
    flags[:, 4, 4] = True
    both, one, two = K.first_and_far(flags)
    for radius in (2, 3):
        found, at = K.follow(flags[both], one[both], two[both], radius)
        assert 0 < found.sum() < len(found)
        for f, start, other, ok, end in zip(flags[both], one[both], two[both], found, at):
            front, want = [tuple(start)], None
            seen = {(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)} | {tuple(start), tuple(other)}
            while front and want is None:
                reached = {}
                for r, (a, b) in enumerate(N.RING_8):
                    for x, y in front:
                        p = (x + a, y + b)
                        if max(map(abs, p)) <= 4 and f[p[0] + 4, p[1] + 4] and p not in seen:
                            reached.setdefault(p, r)
                want = min(((r, p) for p, r in reached.items() if max(map(abs, p)) > radius), default=(0, None))[1]
                seen |= set(reached)
                front = list(reached)
            assert ok == (want is not None) and (want is None or tuple(end) == want)


@pytest.mark.parametrize("family,params", [("line", [.2, -.5]), ("quadratic", [.1, .4, -.7]), ("curve_poly", [.3, .1, -.2, .5, .25]),
                                           ("arc", [.1, -.4, 1.3, 1.]), ("arc", [-.2, 1.6, 1.1, -1.]), ("corner", [.1, .5, 1., .6, -.3])])
def test_slopes_of_graphs(spark, family, params):
    x = spark.range(9).select((F.col("id") / 8 - .5 + 1e-3).alias("t"), F.array(*[F.lit(v) for v in params]).alias("p"))
    h = 1e-5
    rise = (curve_height(family, F.col("p"), F.col("t") + h) - curve_height(family, F.col("p"), F.col("t") - h)) / (2 * h)
    for r in x.select(graph_slope(family, F.col("p"), F.col("t")).alias("s"), rise.alias("d")).collect():
        assert r.s == pytest.approx(r.d, abs=1e-6)


def test_region_stencil_is_the_same_across_the_seam(spark):
    n, rows = 8, [("g", i, j, 0.0, 0) for i in range(8) for j in range(8)]
    cells = spark.createDataFrame(rows, "grid_id string, i int, j int, u double, kind int")
    got = {(r.i, r.j): [((x.i - r.i) % n, (x.j - r.j) % n) for x in r.members]
           for r in N.same_region_stencil(cells, GridShape(n, n), 5).collect()}
    assert set(got[0, 0]) == {(0, 0), (0, 1), (1, 0), (0, n - 1), (n - 1, 0)} == set(got[4, 4])


@pytest.mark.parametrize("modes", [("cyclic", "reflect"), ("extend", "cyclic")])
def test_region_stencil_on_sparse_grids_with_one_shuffle(spark, modes):
    """Missing cells, repeated ones and one without a grid; regions grow inside tiles, without a join a round."""
    shape, m, rng = GridShape(35, 6, *modes), 7, np.random.default_rng(8)
    a = {(i, j): float(np.clip(rng.normal(.5, .5), 0, 1)) for i in range(shape.ni) for j in range(shape.nj) if rng.random() < .9}
    rows = [("g", i, j, u) for (i, j), u in a.items()]
    cells = label_piecewise(spark.createDataFrame(rows + rows[5:7] + [(None, 1, 1, .5)], "grid_id string, i int, j int, u double"))
    found = N.same_region_stencil(cells, shape, m)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
    got = found.collect()
    assert len(got) == len(rows) + 3 and [[tuple(x) for x in r.members] for r in got if r.grid_id is None] == [[(1, 1, .5)]]

    def fold(p, n, mode):
        turned = p % (2 * (n - 1))
        return {"cyclic": p % n, "extend": min(max(p, 0), n - 1), "reflect": min(turned, 2 * (n - 1) - turned)}[mode]

    kind = {q: 0 < u < 1 for q, u in a.items()}
    for r in got:
        if r.grid_id is None:
            continue
        members, front = [(r.i, r.j)], [(r.i, r.j, 0, 0)]
        while front and len(members) < m:
            steps = [(x + di, y + dj, p + di, q + dj) for x, y, p, q in front for di in (-1, 0, 1) for dj in (-1, 0, 1) if di or dj]
            near = sorted((p * p + q * q, fold(x, shape.ni, modes[0]), fold(y, shape.nj, modes[1]), p, q) for x, y, p, q in steps)
            front = []
            for _, x, y, p, q in near:
                if (x, y) not in members and kind.get((x, y)) == kind[r.i, r.j]:
                    members.append((x, y))
                    front.append((x, y, p, q))
        assert [(x.i, x.j, x.u) for x in r.members] == [(*q, a[q]) for q in members[:m]]
