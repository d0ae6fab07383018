"""Queries on adaptive windows, corners, refinement and repeated passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import adaptive as AD
from cellweave.operators import corners as K
from cellweave.operators.curves import lines_3slopes
from cellweave.operators.neighbours import RING_8, RING_16
from cellweave.operators.refine import refine_candidates
from cellweave.operators.scoring import score_table, select_best
from cellweave.operators.sides import opposite_by_direction, opposite_by_window
from cellweave.operators.windows import batched_windows, with_windows
from cellweave.plans.fixtures import PATCH, PATCH_SQL, labelled_patch, patch
from cellweave.plans.lineage import cut_lineage
from cellweave.plans.queries_fit import central_lines
from cellweave.plans.reconstruct import PRESETS, Preset, fit_cells, proposal_rows, reconstruct
from cellweave.plans.registry import query, rounded
from cellweave.schema import KEY


def follow_sql(step: str, source: str) -> str:
    """One more column along the interface on both sides: nearest cut run in the next column."""
    return f"""SELECT s.grid_id, s.i, s.j, s.side, s.d + 1 AS d, n.q + (s.q - (s.q + 80) % 8) AS q,
    n.lo + (s.q - (s.q + 80) % 8) AS lo, n.hi + (s.q - (s.q + 80) % 8) AS hi
  FROM {source} s JOIN near n ON n.grid_id = s.grid_id AND n.c = (s.i + s.side * {step} + 80) % 8 AND n.p = (s.q + 80) % 8"""


@query("adaptive_stencil", f"""WITH {PATCH_SQL},
tri AS MATERIALIZED (SELECT grid_id, i, j + 8 * s.s AS p, kind FROM lab, (VALUES (-1), (0), (1)) s(s)),
reg AS MATERIALIZED (SELECT a.grid_id, a.i, a.j, a.kind, max(b.p) FILTER (b.p <= a.j) AS lo, min(b.p) FILTER (b.p >= a.j) AS hi
  FROM lab a LEFT JOIN tri b ON a.grid_id = b.grid_id AND a.i = b.i AND b.kind = 0 AND abs(b.p - a.j) <= 8 GROUP BY ALL),
cutp AS MATERIALIZED (SELECT grid_id, i, j + 8 * s.s AS p, lo + 8 * s.s AS lo, hi + 8 * s.s AS hi FROM reg, (VALUES (-1), (0), (1)) s(s) WHERE kind = 1),
near AS MATERIALIZED (SELECT * FROM (SELECT a.grid_id, a.i AS c, a.j AS p, b.p AS q, b.lo, b.hi,
    row_number() OVER (PARTITION BY a.grid_id, a.i, a.j ORDER BY abs(b.p - a.j), b.p DESC) AS rn
  FROM lab a JOIN cutp b ON a.grid_id = b.grid_id AND a.i = b.i) WHERE rn = 1 AND lo IS NOT NULL AND hi IS NOT NULL),
st0 AS MATERIALIZED (SELECT grid_id, i, j, s.s AS side, 0 AS d, j AS q, lo, hi FROM reg, (VALUES (-1), (1)) s(s)
  WHERE kind = 1 AND lo IS NOT NULL AND hi IS NOT NULL),
st1 AS MATERIALIZED ({follow_sql('1', 'st0')}),
st2 AS MATERIALIZED ({follow_sql('2', 'st1')}),
cols AS MATERIALIZED (SELECT DISTINCT grid_id, i, j, side * d AS d, lo, hi FROM (FROM st0 UNION ALL FROM st1 UNION ALL FROM st2)),
opt AS (SELECT grid_id, i, j, w.w AS first, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM cols, (VALUES (-2), (-1), (0)) w(w)
  WHERE d BETWEEN w.w AND w.w + 2 GROUP BY 1, 2, 3, 4),
best AS (SELECT *, row_number() OVER (PARTITION BY grid_id, i, j ORDER BY hi - lo + 2.1 * abs(first + 1), first) AS rn FROM opt WHERE n = 3)
SELECT o.grid_id, o.i, o.j, CAST(o.i + coalesce(first, -1) AS INTEGER) AS c0, CAST(o.i + coalesce(first, -1) + 2 AS INTEGER) AS c1,
  CAST(coalesce(b.lo, o.j - 1) AS INTEGER) AS s0, CAST(coalesce(b.hi, o.j + 1) AS INTEGER) AS s1
FROM (SELECT grid_id, i, j FROM lab WHERE kind = 1) o LEFT JOIN best b ON o.grid_id = b.grid_id AND o.i = b.i AND o.j = b.j AND b.rn = 1""")
def adaptive_stencil(spark, d):
    return AD.adaptive_stencil(labelled_patch(spark, d), PATCH, 0)


@query("fit_adaptive_quadratic")
def fit_adaptive_quadratic(spark, d):
    """Adaptive windows, side values by column walks, parabolas, scores: losses per cell."""
    c = labelled_patch(spark, d)
    w = AD.adaptive_stencil(c, PATCH, 0)
    lv = opposite_by_direction(c, PATCH, 0).join(opposite_by_window(c, PATCH, 0).select(
        *KEY, F.col("down_u").alias("down_w"), F.col("up_u").alias("up_w")), KEY)
    both = F.col("down_u").isNotNull() & F.col("up_u").isNotNull()
    # a column without a regular cell takes its values from the window, one without any there 0 and 1
    lv = lv.select(*KEY, F.coalesce(F.when(both, F.col("down_u")), "down_w", F.lit(0.0)).alias("value_down"),
                   F.coalesce(F.when(both, F.col("up_u")), "up_w", F.lit(1.0)).alias("value_up"))
    made = AD.propose_adaptive(AD.adaptive_sums(w, lv, c, PATCH, 0), 0, 2)
    best = select_best(score_table(made, with_windows(c, PATCH, 3, 3), ("quadratic",), center_weight=100.0))
    return rounded(best.select(*KEY, "loss"), 4)


def listed(ring):
    return ", ".join(f"({r}, {di}, {dj})" for r, (di, dj) in enumerate(ring))


# places beside a cell are numbers 100 * (di + 8) + dj + 8; a round of a branch is a row with its front and all it has seen
@query("corner_branches", f"""WITH RECURSIVE {PATCH_SQL}, cut AS MATERIALIZED (SELECT grid_id, i, j FROM lab WHERE kind = 1),
ring16(r, di, dj) AS (VALUES {listed(RING_16)}), ring8(r, di, dj) AS (VALUES {listed(RING_8)}),
near AS MATERIALIZED (SELECT c.*, o.* FROM cut c, ring16 o JOIN cut t ON t.grid_id = c.grid_id AND t.i = (c.i + o.di + 8) % 8 AND t.j = (c.j + o.dj + 8) % 8),
one AS (SELECT grid_id, i, j, min(r) AS r, arg_min(di, r) AS di, arg_min(dj, r) AS dj FROM near GROUP BY 1, 2, 3),
two AS (SELECT o.*, arg_max(n.di, (abs(n.di - o.di) + abs(n.dj - o.dj), n.r)) AS di2, arg_max(n.dj, (abs(n.di - o.di) + abs(n.dj - o.dj), n.r)) AS dj2
  FROM one o JOIN near n USING (grid_id, i, j) WHERE n.r <> o.r GROUP BY ALL),
ends AS (SELECT grid_id, i, j, 1 AS b, di, dj, di2 AS xi, dj2 AS xj FROM two UNION ALL SELECT grid_id, i, j, 2, di2, dj2, di, dj FROM two),
walk(grid_id, i, j, b, front, seen, hit) AS (
  SELECT grid_id, i, j, b, [(di + 8) * 100 + dj + 8], [(di + 8) * 100 + dj + 8, (xi + 8) * 100 + xj + 8, 808, 908, 708, 809, 807, 909, 907, 709, 707],
    CASE WHEN greatest(abs(di), abs(dj)) > 2 THEN (di + 8) * 100 + dj + 8 END FROM ends
  UNION ALL
  SELECT grid_id, i, j, b, list(place), list_concat(any_value(seen), list(place)),
    arg_min(place, (r, place)) FILTER (greatest(abs(place // 100 - 8), abs(place % 100 - 8)) > 2) FROM (
    SELECT w.grid_id, w.i, w.j, w.b, any_value(w.seen) AS seen, w.f + 100 * o.di + o.dj AS place, min(o.r) AS r
    FROM (SELECT *, unnest(front) AS f FROM walk WHERE hit IS NULL) w, ring8 o
    JOIN cut t ON t.grid_id = w.grid_id AND t.i = (w.i + w.f // 100 - 8 + o.di + 16) % 8 AND t.j = (w.j + w.f % 100 - 8 + o.dj + 16) % 8
    WHERE NOT list_contains(w.seen, w.f + 100 * o.di + o.dj)
    GROUP BY w.grid_id, w.i, w.j, w.b, w.f + 100 * o.di + o.dj) GROUP BY 1, 2, 3, 4),
done AS (SELECT grid_id, i, j, b, hit FROM walk WHERE hit IS NOT NULL)
SELECT a.grid_id, a.i, a.j, CAST(a.hit // 100 - 8 AS INTEGER) AS di1, CAST(a.hit % 100 - 8 AS INTEGER) AS dj1,
  CAST(c.hit // 100 - 8 AS INTEGER) AS di2, CAST(c.hit % 100 - 8 AS INTEGER) AS dj2
FROM done a JOIN done c USING (grid_id, i, j) WHERE a.b = 1 AND c.b = 2""")
def corner_branches(spark, d):
    """The neighbours, beyond a radius of two, on which a corner in each cut cell would rest."""
    e = K.branch_ends(central_lines(spark, d), PATCH, 2)
    return e.select(*KEY, *[F.col(f"n{n}")[c].alias(f"{c}{n}") for n in (1, 2) for c in ("di", "dj")])


@query("fit_corner_from_neighbours")
def fit_corner_from_neighbours(spark, d):
    c = labelled_patch(spark, d)
    # flags, both ends, targets and levels read the fits, which are far dearer to make than to keep
    fits = cut_lineage(fit_cells(c, PATCH, PRESETS["elvira_w"]).select(*KEY, "axis", "family", "params", "value_up", "value_down"))
    lv = fits.filter("family = 'line'").select(*KEY, "value_up", "value_down")
    made = K.corner_from_neighbours(fits, lv, PATCH)
    best = select_best(score_table(made, batched_windows(c, PATCH, 3, ["u"]), ("wedge",), center_weight=100.0, once=True))
    return rounded(best.select(*KEY, "cand", "loss"), 4)


@query("refine_candidates")
def refined(spark, d):
    p = Preset("one", (lines_3slopes(),), axis=0)
    rows, key = proposal_rows(labelled_patch(spark, d), PATCH, p)
    return rounded(refine_candidates(rows, key, p.families, (p.window, p.window), 2).select(*KEY, "cand", "loss"), 4)


@query("reconstruct_two_passes")
def reconstruct_two_passes(spark, d):
    fits, _ = reconstruct(patch(spark, d), PATCH, PRESETS["elvira_w"], refinement=2)
    return rounded(fits.groupBy("grid_id", "family").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("loss").alias("loss")), 3)
