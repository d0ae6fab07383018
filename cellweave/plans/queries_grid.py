"""Queries on sources, projections, neighbours, labels and sides."""

from __future__ import annotations


from pyspark.sql import functions as F

from cellweave.functions.index import map_index
from cellweave.operators import grid_ops as G
from cellweave.operators import labels as L
from cellweave.operators import neighbours as N
from cellweave.operators import sides as S
from cellweave.operators.curves import levels_01, levels_minmax
from cellweave.operators.neighbours import RING_8
from cellweave.operators.surfaces import surface_fits
from cellweave.operators.windows import with_windows
from cellweave.plans.fixtures import (ACTIVITY_SQL, PATCH, PATCH_SQL, PRICE, PRICE_SQL, activity,
                                      activity_sparse, arc_area_sql, kernel_sum_sql, labelled_patch, patch, price, raw_patch,
                                      table, window_sql)
from cellweave.plans.registry import SQL, query, rounded
from cellweave.schema import KEY
from cellweave.sources import binning as B
from cellweave.sources import shapes as SH
from cellweave.sources.tables import read_table


def r6(c, alias=None):
    return f"round({c}, 6) + 0.0 AS {alias or c}"


# ---------------------------------------------------------------- sources

@query("bin_price_grid", f"WITH {PRICE_SQL} SELECT grid_id, i, j, {r6('u')} FROM price")
def bin_price_grid(spark, d):
    return rounded(price(spark, d))


@query("bin_activity_grid", f"WITH {ACTIVITY_SQL} SELECT grid_id, i, j, {r6('u')} FROM sparse")
def bin_activity_grid(spark, d):
    return rounded(activity_sparse(spark, d))


@query("coarsen_patches", f"""WITH {PATCH_SQL}
SELECT grid_id, CAST(i // 2 AS INTEGER) AS i, CAST(j // 4 AS INTEGER) AS j, {r6('avg(u)', 'u')} FROM cells GROUP BY 1, 2, 3""")
def coarsen_patches(spark, d):
    return rounded(B.coarsen(patch(spark, d), 2, 4))


@query("normalize_patches", f"""WITH {PATCH_SQL}
SELECT grid_id, i, j, {r6('(u - min(u) OVER g) / (max(u) OVER g - min(u) OVER g)', 'u')}
FROM raw WINDOW g AS (PARTITION BY grid_id)""")
def normalize_patches(spark, d):
    return rounded(B.normalize_grid(raw_patch(spark, d))).select(*KEY, "u")


@query("densify_activity_grid", f"WITH {ACTIVITY_SQL} SELECT grid_id, i, j, {r6('u')} FROM activity")
def densify_activity_grid(spark, d):
    return rounded(activity(spark, d))


@query("notched_discs", """WITH g AS (SELECT CAST(s_suppkey AS VARCHAR) AS grid_id, 20 + s_suppkey % 21 AS n FROM supplier),
px AS (SELECT grid_id, n, a.i, b.j, n / 3.0 AS r, floor(n / 2.0) AS c, n / 9.0 AS w
       FROM g, range(60) a(i), range(60) b(j) WHERE a.i < n AND b.j < n)
SELECT grid_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
  CAST(CASE WHEN (i - c) * (i - c) + (j - c) * (j - c) <= r * r AND NOT (
    j > c - floor(w / 2) AND j < c + floor(w / 2) AND i > c - (floor(w * 4 / 2) - w) AND i < c + floor(w * 4 / 2) + w)
  THEN 1 ELSE 0 END AS DOUBLE) AS u FROM px""")
def notched_discs(spark, d):
    n = (F.lit(20) + F.col("s_suppkey") % 21).cast("int")
    g = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("grid_id"),
                                           n.alias("ni"), n.alias("nj"))
    # a disc of a third of the grid, with a slot of a third of its radius that is cut from above the centre
    n, radius = F.col("ni"), F.col("ni") / 3.0
    centre, width = F.floor(n / 2), radius / 3
    long, half = F.floor(2 * width), F.floor(width / 2)
    rows, columns = (centre - long + width, centre + long + width), (centre - half, centre + half)
    return SH.rasterize_predicate(g, SH.disc_without_rectangle(centre, radius, rows, columns))


for kind, expr in {
    "trigonometric": "(CASE WHEN u >= .5 THEN cos(2*pi()*i*2/8) ELSE 0 END) + (CASE WHEN u <= .5 THEN sin(2*pi()*d*2/8) ELSE 0 END)",
    "parabola": "(CASE WHEN u >= .5 THEN 1 - 0.5*pow(2*pi()*i*2/8, 2) ELSE 0 END) + (CASE WHEN u <= .5 THEN pow(2*pi()*d*2/8, 2) ELSE 0 END)",
    "radial": "(CASE WHEN u <= .5 THEN sin(2*pi()*d*2/8) ELSE 0 END)",
    "traversal": "(CASE WHEN u > .5 THEN cos(2*pi()*i*2/8) ELSE 0 END)",
}.items():
    @query(f"texture_{kind}", f"""WITH {PATCH_SQL}, p AS (SELECT *, sqrt((i-4)*(i-4) + (j-4)*(j-4)) AS d FROM cells)
SELECT grid_id, i, j, {r6(f'u + 0.1 * ({expr})', 'u')} FROM p""")
    def texture(spark, d, kind=kind):
        return rounded(SH.add_texture(patch(spark, d), 8, 8, kind, 0.1, 2))


@query("uniform_noise")
def uniform_noise(spark, d):
    return SH.add_uniform_noise(patch(spark, d), 0.05)


# in units of a cell, measured from the middle of its lower edge
DISC_IN_CELL = ("(5.11 - i - 0.5)", "(4.86 - j)", "(1 + p_size / 20.0)")


@query("rasterized_discs", f"""SELECT CAST(p_partkey AS VARCHAR) AS grid_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
  {r6(arc_area_sql(*DISC_IN_CELL, '1') + ' - ' + arc_area_sql(*DISC_IN_CELL, '-1'), 'u')} FROM part, range(10) a(i), range(10) b(j)""")
def rasterized_discs(spark, d):
    """One disc per part: the radius grows with the size."""
    p = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("grid_id"), F.lit(10).alias("ni"), F.lit(10).alias("nj"),
        F.lit(0).alias("axis"), F.array(F.lit(.511), F.lit(.486), 0.1 + F.col("p_size") / 200.0).alias("params"),
        F.lit(0.0).alias("value_up"), F.lit(1.0).alias("value_down"))
    return rounded(SH.rasterize_shapes(p, "disc"))


@query("first_orders", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500")
def first_orders(spark, d):
    return read_table(spark, f"{d}/orders.parquet", first_n=500, order_by="o_orderkey").select("o_orderkey", "o_custkey")


# ---------------------------------------------------------------- projections

@query("all_cells", f"WITH {PATCH_SQL} SELECT grid_id, i, j, {r6('u')} FROM cells")
def all_cells(spark, d):
    return rounded(G.all_cells(patch(spark, d)))


@query("cut_cells", f"WITH {PATCH_SQL} SELECT grid_id, i, j, {r6('u')} FROM lab WHERE kind >= 1")
def cut_cells(spark, d):
    return rounded(G.filter_kind(labelled_patch(spark, d)).select(*KEY, "u"))


@query("smoothest_last", f"WITH {PATCH_SQL} SELECT grid_id, i, j, {r6('u')} FROM cells ORDER BY u DESC, grid_id, i, j LIMIT 200")
def smoothest_last(spark, d):
    return rounded(G.ordered(patch(spark, d), "u", True, 200))


@query("worst_cells_per_grid", f"""WITH {PATCH_SQL} SELECT grid_id, i, j, {r6('u')}, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY u DESC, i, j) AS r FROM raw) WHERE r <= 3""")
def worst_cells_per_grid(spark, d):
    return rounded(G.rank_in_grid(raw_patch(spark, d), "u", 3))


@query("interface_mask", f"WITH {PATCH_SQL} SELECT grid_id, i, j, {r6('u')}, u > 0 AND u < 1 AS is_cut FROM cells")
def interface_mask(spark, d):
    return rounded(G.interface_mask(patch(spark, d)))


@query("upsample_repeat", f"""WITH {PATCH_SQL}
SELECT grid_id, CAST(i * 2 + a.p AS INTEGER) AS i, CAST(j * 3 + b.q AS INTEGER) AS j, {r6('u')}
FROM cells, range(2) a(p), range(3) b(q)""")
def upsample_repeat(spark, d):
    return rounded(G.repeat_cells(patch(spark, d), 2, 3))


@query("edge_mask_highres", f"""WITH {PATCH_SQL}
SELECT grid_id, CAST(i * 2 + a.p AS INTEGER) AS i, CAST(j * 2 + b.q AS INTEGER) AS j, u > 0 AND u < 1 AS is_cut
FROM cells, range(2) a(p), range(2) b(q)""")
def edge_mask_highres(spark, d):
    return G.edge_mask_highres(patch(spark, d), 2).drop("u")


@query("grid_shift", f"""WITH {PATCH_SQL}
SELECT grid_id, CAST((i + 3) % 8 AS INTEGER) AS i, CAST((j + 6) % 8 AS INTEGER) AS j, {r6('u')} FROM cells""")
def grid_shift(spark, d):
    return rounded(G.grid_shift(patch(spark, d), PATCH, 3, -2))


@query("threshold", f"WITH {PATCH_SQL} SELECT grid_id, i, j, CAST(CASE WHEN u < 0.5 THEN 0 ELSE 1 END AS DOUBLE) AS u FROM cells")
def threshold(spark, d):
    return G.threshold(patch(spark, d))


@query("clamp", f"WITH {PATCH_SQL} SELECT grid_id, i, j, {r6('greatest(0.25, least(0.75, u))', 'u')} FROM raw")
def clamp(spark, d):
    return rounded(G.clamp(raw_patch(spark, d), 0.25, 0.75))


@query("transpose_grid", f"WITH {PRICE_SQL} SELECT grid_id, j AS i, i AS j, {r6('u')} FROM price")
def transpose_grid(spark, d):
    return rounded(G.transpose_grid(price(spark, d)))


@query("rotation_field", f"""WITH {PATCH_SQL}, r AS (SELECT *, (i + .5) / 8 - .5 AS rx, (j + .5) / 8 - .5 AS ry FROM cells)
SELECT grid_id, i, j, {r6('0.1 - ry * 0.3 / m', 'vi')}, {r6('rx * 0.3 / m', 'vj')}
FROM (SELECT *, max(greatest(abs(rx), abs(ry))) OVER (PARTITION BY grid_id) AS m FROM r)""")
def rotation_field(spark, d):
    return rounded(G.rotation_field(patch(spark, d), PATCH, 0.3, (0.1, 0.0))).drop("u")


# ---------------------------------------------------------------- neighbours

for mode, expr in {
    "cyclic": "(e % n + n) % n", "extend": "greatest(0, least(e, n - 1))",
    "reflect": "least((e % (2*n-2) + 2*n-2) % (2*n-2), 2*n-2 - (e % (2*n-2) + 2*n-2) % (2*n-2))",
}.items():
    @query(f"map_index_{mode}", f"""SELECT l_orderkey, l_linenumber, CAST({expr} AS INTEGER) AS idx
FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 41 - 20 AS e, 5 + l_linenumber AS n FROM lineitem)""")
    def mapped(spark, d, mode=mode):
        li = table(spark, d, "lineitem")
        e = (F.col("l_orderkey") % 41 - 20).cast("int")
        n = (F.lit(5) + F.col("l_linenumber")).cast("int")
        return li.select("l_orderkey", "l_linenumber", map_index(e, n, mode).alias("idx"))


@query("stencil_3x5", f"""WITH {PATCH_SQL}, offs AS (SELECT x.d - 1 AS di, y.d - 2 AS dj, x.d * 5 + y.d AS pos FROM range(3) x(d), range(5) y(d))
SELECT a.grid_id, a.i, a.j, CAST(o.pos AS INTEGER) AS pos, {r6('b.u', 'u')} FROM cells a, offs o JOIN cells b
ON b.grid_id = a.grid_id AND b.i = (a.i + o.di + 8) % 8 AND b.j = (a.j + o.dj + 8) % 8""")
def stencil_3x5(spark, d):
    w = with_windows(patch(spark, d), PATCH, 3, 5)
    return rounded(w.select(*KEY, F.posexplode("w_u").alias("pos", "u")))


@query("stencil_even_extend", f"""WITH {PRICE_SQL},
full_ AS (SELECT g.grid_id, a.i, b.j, coalesce(p.u, 0) AS u FROM (SELECT DISTINCT grid_id FROM price) g, range(50) a(i), range(11) b(j)
  LEFT JOIN price p ON p.grid_id = g.grid_id AND p.i = a.i AND p.j = b.j),
offs AS (SELECT x.d - 2 AS di, y.d - 2 AS dj, x.d * 4 + y.d AS pos FROM range(4) x(d), range(4) y(d))
SELECT a.grid_id, CAST(a.i AS INTEGER) AS i, CAST(a.j AS INTEGER) AS j, round(sum(b.u * (o.pos + 1)), 2) + 0.0 AS s FROM full_ a, offs o JOIN full_ b
ON b.grid_id = a.grid_id AND b.i = greatest(0, least(49, a.i + o.di)) AND b.j = greatest(0, least(10, a.j + o.dj)) GROUP BY 1, 2, 3""")
def stencil_even_extend(spark, d):
    p = price(spark, d)
    w = with_windows(B.densify(p, B.grids_of(p, PRICE)), PRICE, 4, 4)
    weights = F.array(*[F.lit(float(n + 1)) for n in range(16)])
    s = F.aggregate(F.zip_with("w_u", weights, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return rounded(w.select(*KEY, s.alias("s")), 2)


@query("neighbours_sorted", f"""WITH {PATCH_SQL}, offs AS (SELECT x.d - 2 AS di, y.d - 2 AS dj FROM range(5) x(d), range(5) y(d)),
n AS (SELECT grid_id, i, j, (i + di + 8) % 8 AS ti, (j + dj + 8) % 8 AS tj, min(di*di + dj*dj) AS dist2 FROM cells, offs GROUP BY ALL)
SELECT grid_id, i, j, CAST(ti AS INTEGER) AS ti, CAST(tj AS INTEGER) AS tj, CAST(dist2 AS INTEGER) AS dist2 FROM n WHERE dist2 > 0""")
def neighbours_sorted(spark, d):
    return N.neighbours_sorted(patch(spark, d), PATCH, 2).drop("rank")


for size, steps in (("8", N.RING_8), ("16", N.RING_16)):
    values = ", ".join(f"({n}, {a}, {b})" for n, (a, b) in enumerate(steps))

    @query(f"ring_{size}", f"""WITH {PATCH_SQL}, offs(rank, di, dj) AS (VALUES {values})
SELECT c.grid_id, c.i, c.j, CAST(rank AS INTEGER) AS rank, {r6('t.u', 't_u')} FROM cells c, offs o
JOIN cells t ON t.grid_id = c.grid_id AND t.i = (c.i + di + 8) % 8 AND t.j = (c.j + dj + 8) % 8""")
    def ring(spark, d, size=int(size)):
        c = patch(spark, d)
        return rounded(N.gather(N.ring(c, PATCH, size), c, ["u"]).select(*KEY, "rank", "t_u"))


@query("kept_stencil_cells", f"""WITH {PATCH_SQL}, {window_sql(3)}
SELECT grid_id, i, j, CAST(count(*) AS INTEGER) AS n, {r6('sum(u)', 's')} FROM win WHERE kind = 1 GROUP BY 1, 2, 3""")
def kept_stencil_cells(spark, d):
    w = N.keep_stencil_cells(with_windows(labelled_patch(spark, d), PATCH, 3, 3, ["u", "kind"], F.col("kind") == 1))
    return rounded(w.select(*KEY, F.size("w_u").alias("n"), F.aggregate(
        "w_u", F.lit(0.0), lambda a, x: a + x).alias("s")))


@query("smooth_shifted_stencil", f"""WITH {PATCH_SQL}, {window_sql(5, 'lab', False)},
g AS (SELECT grid_id, i, j, any_value(own) AS u, {kernel_sum_sql(L.OPTIM5)} AS gx, {kernel_sum_sql(L.OPTIM5, True)} AS gy FROM win GROUP BY 1, 2, 3),
s AS MATERIALIZED (SELECT grid_id, i, j, u, sqrt(gx * gx + gy * gy) AS si FROM g),
o AS (SELECT a.d - 1 AS di, b.d - 1 AS dj FROM range(3) a(d), range(3) b(d)),
n AS MATERIALIZED (SELECT a.grid_id, a.i, a.j, di, dj, a.si, b.si AS nsi, b.u AS nu FROM s a, o JOIN s b
  ON b.grid_id = a.grid_id AND b.i = (a.i + di + 8) % 8 AND b.j = (a.j + dj + 8) % 8),
c AS (SELECT *, row_number() OVER (PARTITION BY grid_id, i, j ORDER BY 0.5 * sqrt(di*di + dj*dj) / sqrt(2) + nsi / si, di*di + dj*dj, di, dj) AS rn FROM n),
top AS (SELECT grid_id, i, j, max(nu) AS top FROM n GROUP BY 1, 2, 3)
SELECT c.grid_id, c.i, c.j, CAST(di AS INTEGER) AS di, CAST(dj AS INTEGER) AS dj, {r6('t.top', 'top')}
FROM c JOIN top t ON t.grid_id = c.grid_id AND t.i = (c.i + di + 8) % 8 AND t.j = (c.j + dj + 8) % 8 WHERE rn = 1""")
def smooth_shifted_stencil(spark, d):
    c = L.gradient_magnitude(patch(spark, d), PATCH)
    return rounded(N.smooth_shifted_stencil(c, PATCH, 3).select(*KEY, "di", "dj", F.array_max("w_u").alias("top")))


@query("same_region_stencil")
def same_region_stencil(spark, d):
    c = labelled_patch(spark, d)
    s = N.same_region_stencil(c, PATCH, 5)
    return rounded(s.select(*KEY, F.size("members").alias("n"), F.aggregate(
        "members", F.lit(0.0), lambda a, x: a + x["u"]).alias("s")))


# ---------------------------------------------------------------- labels

@query("label_constant", f"WITH {PATCH_SQL} SELECT grid_id, i, j, CAST(0 AS INTEGER) AS kind FROM cells")
def label_constant(spark, d):
    return L.label_constant(patch(spark, d)).select(*KEY, "kind")


@query("label_piecewise", f"WITH {PATCH_SQL} SELECT grid_id, i, j, kind FROM lab")
def label_piecewise(spark, d):
    return labelled_patch(spark, d).select(*KEY, "kind")


@query("label_from_mask", f"""WITH {PATCH_SQL} SELECT a.grid_id, a.i, a.j, CAST(CASE WHEN b.u > 0.9 THEN 1 ELSE 0 END AS INTEGER) AS kind
FROM cells a JOIN cells b ON a.grid_id = b.grid_id AND a.i = b.j AND a.j = b.i""")
def label_from_mask(spark, d):
    mask = G.transpose_grid(patch(spark, d)).filter("u > 0.9").select(*KEY, F.lit(1).alias("si"))
    return L.label_from_mask(patch(spark, d), mask).select(*KEY, "kind")


@query("gradient_magnitude", f"""WITH {PATCH_SQL}, {window_sql(5, 'lab', False)},
g AS (SELECT grid_id, i, j, {kernel_sum_sql(L.OPTIM5)} AS gx, {kernel_sum_sql(L.OPTIM5, True)} AS gy FROM win GROUP BY 1, 2, 3)
SELECT grid_id, i, j, round(sqrt(gx * gx + gy * gy), 4) + 0.0 AS si FROM g""")
def gradient_magnitude(spark, d):
    return rounded(L.gradient_magnitude(patch(spark, d), PATCH).select(*KEY, "si"), 4)


for method, k in (("sobel", 3), ("scharr", 3), ("optim", 3), ("optim", 5)):
    kern = L.kernel_pair(method, k)[0]

    @query(f"gradient_{method}_{k}x{k}", f"""WITH {PATCH_SQL}, {window_sql(k, 'lab', False)}
SELECT grid_id, i, j, round({kernel_sum_sql(kern)}, 5) + 0.0 AS gx, round({kernel_sum_sql(kern, True)}, 5) + 0.0 AS gy FROM win GROUP BY 1, 2, 3""")
    def grad(spark, d, method=method, k=k):
        return rounded(L.gradient(patch(spark, d), PATCH, method, k).drop("u"), 5)


@query("gradient_scattered", f"""WITH {PATCH_SQL}, {window_sql(3, 'lab', False)}
SELECT grid_id, i, j, round({kernel_sum_sql(L.SOBEL)}, 5) + 0.0 AS gx, round({kernel_sum_sql(L.SOBEL, True)}, 5) + 0.0 AS gy FROM win GROUP BY 1, 2, 3""")
def gradient_scattered(spark, d):
    return rounded(L.gradient_sparse(patch(spark, d), PATCH, "sobel"), 5)


def axes_sql(kernel, k, angle):
    return f"""{window_sql(k, 'lab', False)},
g AS (SELECT grid_id, i, j, any_value(own) AS u, {kernel_sum_sql(kernel)} AS gx, {kernel_sum_sql(kernel, True)} AS gy FROM win GROUP BY 1, 2, 3),
ax AS (SELECT *, CASE WHEN abs(gx) >= abs(gy) THEN 1 ELSE 0 END AS first,
  atan(least(abs(gx), abs(gy)) / (greatest(abs(gx), abs(gy)) + 1e-15)) > {angle} * pi() / 180 AS both_ FROM g)"""


@query("orient_fixed", f"WITH {PATCH_SQL} SELECT grid_id, i, j, CAST(1 AS INTEGER) AS axis FROM cells")
def orient_fixed(spark, d):
    return patch(spark, d).select(*KEY, F.explode(L.fixed_axes(1)).alias("axis"))


@query("orient_by_gradient", f"""WITH {PATCH_SQL}, {axes_sql(L.SOBEL, 3, 30)}
SELECT grid_id, i, j, CAST(0 AS INTEGER) AS axis_rank, CAST(first AS INTEGER) AS axis FROM ax
UNION ALL SELECT grid_id, i, j, 1, CAST(1 - first AS INTEGER) FROM ax WHERE both_""")
def orient_by_gradient(spark, d):
    return L.orient_by_gradient(patch(spark, d), PATCH, method="sobel", angle=30.0).select(*KEY, "axis_rank", "axis")


@query("orientation_counts", f"""WITH {PATCH_SQL}, {axes_sql(L.OPTIM5, 5, 30)}
SELECT grid_id, CAST(CASE WHEN both_ THEN 3 ELSE 1 + first END AS INTEGER) AS code, CAST(count(*) AS INTEGER) AS n
FROM ax WHERE u > 0 AND u < 1 GROUP BY 1, 2""")
def orientation_counts(spark, d):
    return L.orientation_counts(patch(spark, d), PATCH, angle=30.0)


@query("route_all", f"WITH {PATCH_SQL} SELECT grid_id, i, j, CAST(m.m AS INTEGER) AS model FROM cells, range(3) m(m)")
def route_all(spark, d):
    return patch(spark, d).select(*KEY, F.explode(L.route_all(3)).alias("model"))


@query("route_by_label", f"""WITH {PATCH_SQL} SELECT grid_id, i, j, CAST(m.m AS INTEGER) AS model FROM lab, range(3) m(m)
WHERE (kind = 1 AND m.m > 0) OR (kind = 0 AND m.m = 0)""")
def route_by_label(spark, d):
    return labelled_patch(spark, d).select(*KEY, F.explode(L.route_by_label(F.col("kind"), 3)).alias("model"))


@query("class_histogram", f"""WITH {PATCH_SQL} SELECT grid_id, CAST(count(*) FILTER (kind = 0) AS INTEGER) AS n_0,
CAST(count(*) FILTER (kind = 1) AS INTEGER) AS n_1 FROM lab GROUP BY 1""")
def class_histogram(spark, d):
    return L.class_histogram(labelled_patch(spark, d), "kind", [0, 1])


# ---------------------------------------------------------------- sides

WALK_SQL = """{patch}, tri AS MATERIALIZED (SELECT grid_id, i, j + 8 * s.s AS p, u, kind FROM lab, (VALUES (-1), (0), (1)) s(s)),
hit AS (SELECT a.grid_id, a.i, a.j, b.p, b.u FROM lab a JOIN tri b ON a.grid_id = b.grid_id AND a.i = b.i
        AND abs(b.p - a.j) BETWEEN {start} AND 7 WHERE a.kind = 1 AND b.kind = 0),
side AS (SELECT grid_id, i, j, max(p) FILTER (p < j) AS down_pos, arg_max(u, p) FILTER (p < j) AS down_u,
  min(p) FILTER (p > j) AS up_pos, arg_min(u, p) FILTER (p > j) AS up_u FROM hit GROUP BY 1, 2, 3)
SELECT l.grid_id, l.i, l.j, CAST(down_pos AS INTEGER) AS down_pos, round(down_u, 6) + 0.0 AS down_u,
  CAST(up_pos AS INTEGER) AS up_pos, round(up_u, 6) + 0.0 AS up_u
FROM (SELECT * FROM lab WHERE kind = 1) l LEFT JOIN side s USING (grid_id, i, j)"""


@query("opposite_by_direction", "WITH " + WALK_SQL.format(patch=PATCH_SQL, start=1))
def opposite_by_direction(spark, d):
    return rounded(S.opposite_by_direction(labelled_patch(spark, d), PATCH, 0))


@query("opposite_by_threshold", "WITH " + WALK_SQL.format(patch=PATCH_SQL, start=2))
def opposite_by_threshold(spark, d):
    return rounded(S.opposite_by_threshold(labelled_patch(spark, d), PATCH, 0))


@query("opposite_by_relative", f"""WITH {PATCH_SQL}, v AS (SELECT *, abs(u - 0.5) AS si FROM lab),
tri AS MATERIALIZED (SELECT grid_id, i + 8 * s.s AS p, j, u, kind, si FROM v, (VALUES (-1), (0), (1)) s(s)),
hit AS (SELECT a.grid_id, a.i, a.j, b.p, b.u FROM v a LEFT JOIN tri b ON a.grid_id = b.grid_id AND a.j = b.j
        AND abs(b.p - a.i) BETWEEN 2 AND 7 AND b.kind = 0 AND b.si <= 4 * a.si WHERE a.kind = 1)
SELECT grid_id, i, j, CAST(max(p) FILTER (p < i) AS INTEGER) AS down_i, round(arg_max(u, p) FILTER (p < i), 6) + 0.0 AS down_u,
  CAST(min(p) FILTER (p > i) AS INTEGER) AS up_i, round(arg_min(u, p) FILTER (p > i), 6) + 0.0 AS up_u FROM hit GROUP BY 1, 2, 3""")
def opposite_by_relative(spark, d):
    c = labelled_patch(spark, d).withColumn("si", F.abs(F.col("u") - 0.5))
    return rounded(S.opposite_by_relative(c, PATCH, 1, 4.0).drop("down_j", "up_j"))


# two sides of a cell in order of position, then side; a single one goes where it lies
BOTH_SIDES = """SELECT c.grid_id, c.i, c.j, {} FROM (SELECT grid_id, i, j, arg_min(f, (pj, side)) AS a, arg_max(f, (pj, side)) AS b, count(*) AS n
  FROM f GROUP BY grid_id, i, j) g RIGHT JOIN (SELECT * FROM lab WHERE kind = 1) c ON c.grid_id = g.grid_id AND c.i = g.i AND c.j = g.j""".format(", ".join(
    f"CASE WHEN {when} THEN {value} END AS {name}_{col}" for name, row, when in (
        ("down", "a", "n = 2 OR a.pj < c.j OR (a.pj = c.j AND a.side < 0)"), ("up", "b", "n = 2 OR NOT (b.pj < c.j OR (b.pj = c.j AND b.side < 0))"))
    for col, value in (("i", f"{row}.pi_"), ("j", f"{row}.pj"), ("u", f"round({row}.u, 6) + 0.0"))))


@query("opposite_by_window", f"""WITH {PATCH_SQL}, {window_sql(5)},
r AS (SELECT * FROM win WHERE kind = 0),
lo AS (SELECT *, row_number() OVER (PARTITION BY grid_id, i, j ORDER BY u, dj, di) AS rn FROM r),
hi AS (SELECT *, row_number() OVER (PARTITION BY grid_id, i, j ORDER BY u DESC, dj, di) AS rn FROM r)
SELECT c.grid_id, c.i, c.j, CASE WHEN b.dj < a.dj THEN b.di ELSE a.di END AS down_di,
  CASE WHEN b.dj < a.dj THEN b.dj ELSE a.dj END AS down_dj, round(CASE WHEN b.dj < a.dj THEN b.u ELSE a.u END, 6) + 0.0 AS down_u,
  CASE WHEN b.dj < a.dj THEN a.di ELSE b.di END AS up_di,
  CASE WHEN b.dj < a.dj THEN a.dj ELSE b.dj END AS up_dj, round(CASE WHEN b.dj < a.dj THEN a.u ELSE b.u END, 6) + 0.0 AS up_u
FROM lab c LEFT JOIN lo a ON a.grid_id = c.grid_id AND a.i = c.i AND a.j = c.j AND a.rn = 1
LEFT JOIN hi b ON b.grid_id = c.grid_id AND b.i = c.i AND b.j = c.j AND b.rn = 1 WHERE c.kind = 1""")
def opposite_by_window(spark, d):
    return rounded(S.opposite_by_window(labelled_patch(spark, d), PATCH, 0))


@query("nearest_interface", f"""WITH {PATCH_SQL}, tri AS MATERIALIZED (SELECT grid_id, i, j + 8 * s.s AS p, kind FROM lab, (VALUES (-1), (0), (1)) s(s))
SELECT a.grid_id, a.i, a.j, CAST(arg_min(b.p, abs(b.p - a.j) * 2 + CASE WHEN b.p < a.j THEN 1 ELSE 0 END) AS INTEGER) AS near_pos
FROM lab a LEFT JOIN tri b ON a.grid_id = b.grid_id AND a.i = b.i AND b.kind = 1 AND abs(b.p - a.j) < 8 GROUP BY 1, 2, 3""")
def nearest_interface(spark, d):
    return S.nearest_interface(labelled_patch(spark, d), PATCH, 0)


@query("opposite_by_gradient", f"""WITH {PATCH_SQL}, {window_sql(3)},
g AS (SELECT grid_id, i, j, {kernel_sum_sql(L.SCHARR)} AS gx, {kernel_sum_sql(L.SCHARR, True)} AS gy FROM win GROUP BY 1, 2, 3),
v AS (SELECT *, CASE WHEN gx <> 0 AND gy <> 0 THEN sqrt(gx * gx + gy * gy) ELSE 1 END AS l FROM g),
p AS (SELECT grid_id, i, j, s.s AS side, k.k, CAST(floor(i + 0.5 + k.k * s.s * (gx / l)) AS INTEGER) AS pi_,
    CAST(floor(j + 0.5 + k.k * s.s * (gy / l)) AS INTEGER) AS pj FROM v, (VALUES (-1), (1)) s(s), range(2, 8) k(k)),
h AS (SELECT p.*, t.u, row_number() OVER (PARTITION BY p.grid_id, p.i, p.j, side ORDER BY k) AS rn FROM p JOIN lab t ON t.grid_id = p.grid_id
  AND t.i = ((pi_ % 8) + 8) % 8 AND t.j = ((pj % 8) + 8) % 8 WHERE t.kind = 0 AND (pi_ <> p.i OR pj <> p.j)),
f AS (SELECT grid_id, i, j, side, pi_, pj, u FROM h WHERE rn = 1)
{BOTH_SIDES}""")
def opposite_by_gradient(spark, d):
    return rounded(S.opposite_by_gradient(labelled_patch(spark, d), PATCH, 0))


# every step of every open walk at once; positions are numbers, so that a path is a list.  The longest walk that ends takes
# far fewer steps than the limit; the others go round for ever.
@query("opposite_by_minmax", f"""WITH RECURSIVE {PATCH_SQL},
ring(r, di, dj) AS (VALUES {", ".join(f"({r}, {di}, {dj})" for r, (di, dj) in enumerate(RING_8))}),
walk(grid_id, i, j, side, k, pi_, pj, seen, kind, u) AS (
  SELECT grid_id, i, j, s.s, 0, i, j + s.s, [(i + 5000) * 10000 + j + 5000, (i + 5000) * 10000 + j + s.s + 5000, (i + 5000) * 10000 + j - s.s + 5000],
    1, CAST(NULL AS DOUBLE) FROM lab, (VALUES (-1), (1)) s(s) WHERE kind = 1
  UNION ALL
  SELECT grid_id, i, j, side, k + 1, b.pi_, b.pj, list_append(seen, (b.pi_ + 5000) * 10000 + b.pj + 5000), b.kind, b.u FROM (
    SELECT w.grid_id, w.i, w.j, w.side, w.k, any_value(w.seen) AS seen,
      arg_min({{'pi_': w.pi_ + o.di, 'pj': w.pj + o.dj, 'kind': t.kind, 'u': t.u}}, (-w.side * t.u - 1e-5 * abs(w.pj + o.dj - w.j), o.r)) AS b
    FROM walk w, ring o JOIN lab t ON t.grid_id = w.grid_id AND t.i = ((w.pi_ + o.di) % 8 + 8) % 8 AND t.j = ((w.pj + o.dj) % 8 + 8) % 8
    WHERE w.kind = 1 AND w.k < 400 AND NOT list_contains(w.seen, (w.pi_ + o.di + 5000) * 10000 + w.pj + o.dj + 5000)
    GROUP BY w.grid_id, w.i, w.j, w.side, w.k)),
f AS (SELECT grid_id, i, j, side, pi_, pj, u FROM walk WHERE kind = 0 AND k > 0)
{BOTH_SIDES}""")
def opposite_by_minmax(spark, d):
    return rounded(S.opposite_by_minmax(labelled_patch(spark, d), PATCH, 0))


@query("side_values_minmax", f"""WITH {PATCH_SQL}, {window_sql(3)}
SELECT grid_id, i, j, {r6('min(u)', 'value_down')}, {r6('max(u)', 'value_up')} FROM win GROUP BY 1, 2, 3""")
def side_values_minmax(spark, d):
    w = with_windows(labelled_patch(spark, d), PATCH, 3, 3, ["u", "kind"], F.col("kind") == 1)
    lv = levels_minmax(F.col("w_u"), F.col("w_kind"), (3, 3), F.lit(0))
    return rounded(w.select(*KEY, lv["down"].alias("value_down"), lv["up"].alias("value_up")))


@query("side_values_01", f"WITH {PATCH_SQL} SELECT grid_id, i, j, CAST(0 AS DOUBLE) AS value_down, CAST(1 AS DOUBLE) AS value_up FROM lab WHERE kind = 1")
def side_values_01(spark, d):
    lv = levels_01(None, None, None, None)
    return labelled_patch(spark, d).filter("kind = 1").select(*KEY, lv["down"].alias("value_down"), lv["up"].alias("value_up"))


OPPOSITE_SQL = SQL["opposite_by_window"].split("SELECT c.grid_id, c.i, c.j, CASE")[0].rstrip()


# quadratic surfaces through the averages of 3 x 3 cells: weights of the three averages of an axis at a distance x from the
# middle, for a value (eval) or the average over a cell there (avg)
def weight_sql(d, x, kind):
    square = f"({x} * {x}{' - 1 / 12.0' if kind == 'eval' else ''})"
    return f"(CASE {d} WHEN -1 THEN ({square} - {x}) / 2 WHEN 0 THEN 1 - {square} ELSE ({square} + {x}) / 2 END)"


def side_sql(how):
    kind, place = how.split("_")
    x, y = ("(-e.di)", "(-e.dj)") if place == "here" else ("0", "0")
    return f"""{OPPOSITE_SQL}, opp AS (SELECT c.grid_id, c.i, c.j,
  CASE WHEN b.dj < a.dj THEN b.di ELSE a.di END AS ddi, CASE WHEN b.dj < a.dj THEN b.dj ELSE a.dj END AS ddj,
  CASE WHEN b.dj < a.dj THEN a.di ELSE b.di END AS udi, CASE WHEN b.dj < a.dj THEN a.dj ELSE b.dj END AS udj
  FROM lab c LEFT JOIN lo a ON a.grid_id = c.grid_id AND a.i = c.i AND a.j = c.j AND a.rn = 1
  LEFT JOIN hi b ON b.grid_id = c.grid_id AND b.i = c.i AND b.j = c.j AND b.rn = 1 WHERE c.kind = 1),
{window_sql(3, "lab", False, "pw")},
side AS (SELECT grid_id, i, j, 0 AS up, ddi AS di, ddj AS dj FROM opp UNION ALL SELECT grid_id, i, j, 1, udi, udj FROM opp),
val AS (SELECT e.grid_id, e.i, e.j, e.up, sum(w.u * {weight_sql('w.di', x, kind)} * {weight_sql('w.dj', y, kind)}) AS v
  FROM side e JOIN pw w ON w.grid_id = e.grid_id AND w.i = (e.i + e.di + 8) % 8 AND w.j = (e.j + e.dj + 8) % 8 GROUP BY 1, 2, 3, 4)
SELECT o.grid_id, o.i, o.j, {r6('d.v', 'value_down')}, {r6('u.v', 'value_up')} FROM opp o
LEFT JOIN val d ON d.grid_id = o.grid_id AND d.i = o.i AND d.j = o.j AND d.up = 0
LEFT JOIN val u ON u.grid_id = o.grid_id AND u.i = o.i AND u.j = o.j AND u.up = 1"""


for how in ("eval_here", "avg_here", "eval_there", "avg_there"):
    @query(f"side_values_{how}", side_sql(how))
    def sides(spark, d, how=how):
        c = labelled_patch(spark, d)
        fits = surface_fits(c, PATCH, "poly", 3, degree=2, full_rank=True)
        return rounded(S.side_values(S.opposite_by_window(c, PATCH, 0), fits, PATCH, how))
