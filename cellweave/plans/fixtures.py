"""Grids made of the common tables, in Spark and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.operators.labels import label_piecewise
from cellweave.schema import CYCLIC, EXTEND, GridShape
from cellweave.sources.binning import bin_to_cells, densify, grids_of

PATCH = GridShape(8, 8, CYCLIC, CYCLIC)
PRICE = GridShape(50, 11, EXTEND, EXTEND)
ACTIVITY = GridShape(30, 24, EXTEND, CYCLIC)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw_patch(spark: SparkSession, d: str) -> DataFrame:
    """Embedding vectors of 64 values as 8x8 grids."""
    e = table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("grid_id"), F.posexplode("embedding").alias("p", "v"))
    return e.select("grid_id", F.floor(F.col("p") / 8).cast("int").alias("i"),
                    F.pmod("p", F.lit(8)).cast("int").alias("j"), (0.5 + 4 * F.col("v").cast("double")).alias("u"))


def patch(spark: SparkSession, d: str) -> DataFrame:
    """The same clamped to [0, 1]: pure cells next to fractional ones."""
    return raw_patch(spark, d).withColumn("u", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("u"))))


def labelled_patch(spark: SparkSession, d: str) -> DataFrame:
    return label_piecewise(patch(spark, d))


def price(spark: SparkSession, d: str) -> DataFrame:
    """Average extended price by quantity and discount, per return flag and status."""
    li = table(spark, d, "lineitem")
    return bin_to_cells(li, F.col("l_quantity") - 1, F.round(F.col("l_discount") * 100), F.col("l_extendedprice"),
                        F.concat("l_returnflag", "l_linestatus"))


def activity_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Average event value by day and hour, per event type."""
    ev = table(spark, d, "events")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    return bin_to_cells(ev, day, F.hour("ts"), F.col("value"), F.col("event_type"))


def activity(spark: SparkSession, d: str) -> DataFrame:
    sparse = activity_sparse(spark, d)
    inside = sparse.filter("i >= 0 AND i < 30 AND j >= 0 AND j < 24")
    return densify(inside, grids_of(sparse, ACTIVITY))


# ---------------------------------------------------------------- the same in SQL

PATCH_SQL = """raw AS MATERIALIZED (
  SELECT CAST(vec_id AS VARCHAR) AS grid_id, CAST((p - 1) // 8 AS INTEGER) AS i, CAST((p - 1) % 8 AS INTEGER) AS j,
         0.5 + 4 * CAST(v AS DOUBLE) AS u
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings)),
cells AS MATERIALIZED (SELECT grid_id, i, j, CAST(greatest(0, least(1, u)) AS DOUBLE) AS u FROM raw),
lab AS MATERIALIZED (SELECT *, CAST(CASE WHEN u > 1e-10 AND u < 1 - 1e-10 THEN 1 ELSE 0 END AS INTEGER) AS kind FROM cells)"""

PRICE_SQL = """price AS MATERIALIZED (
  SELECT l_returnflag || l_linestatus AS grid_id, CAST(floor(l_quantity - 1) AS INTEGER) AS i,
         CAST(floor(round(l_discount * 100)) AS INTEGER) AS j, avg(l_extendedprice) AS u
  FROM lineitem GROUP BY 1, 2, 3)"""

ACTIVITY_SQL = """sparse AS MATERIALIZED (
  SELECT event_type AS grid_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS i,
         CAST(hour(ts) AS INTEGER) AS j, avg(value) AS u
  FROM events GROUP BY 1, 2, 3),
activity AS MATERIALIZED (
  SELECT g.grid_id, CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, coalesce(s.u, 0) AS u
  FROM (SELECT DISTINCT grid_id FROM sparse) g, range(30) a(i), range(24) b(j)
  LEFT JOIN sparse s ON s.grid_id = g.grid_id AND s.i = a.i AND s.j = b.j)"""


def window_sql(k: int, source: str = "lab", cut_only: bool = True, name: str = "win") -> str:
    """Neighbours of (cut) cells on cyclic 8x8 grids: di, dj, u, kind."""
    h = k // 2
    where = "WHERE a.kind = 1" if cut_only else ""
    return f"""{name} AS MATERIALIZED (
  SELECT a.grid_id, a.i, a.j, a.u AS own, x.d AS di, y.d AS dj, b.u, b.kind
  FROM {source} a, (SELECT CAST(d - {h} AS INTEGER) AS d FROM range({k}) t(d)) x,
       (SELECT CAST(d - {h} AS INTEGER) AS d FROM range({k}) t(d)) y
  JOIN {source} b ON b.grid_id = a.grid_id AND b.i = (a.i + x.d + 16) % 8 AND b.j = (a.j + y.d + 16) % 8 {where})"""


def kernel_sum_sql(kernel, transposed: bool = False) -> str:
    """SUM over a window of a kernel's weights times u (columns di, dj, u)."""
    k = len(kernel)
    terms = []
    for a in range(k):
        for b in range(k):
            v = kernel[b][a] if transposed else kernel[a][b]
            if v:
                terms.append(f"WHEN di = {a - k // 2} AND dj = {b - k // 2} THEN {float(v)}")
    return f"sum(u * CAST(CASE {' '.join(terms)} ELSE 0 END AS DOUBLE))"


def area_line_sql(b: str, m: str, t0: str, t1: str, s0: str) -> str:
    """Area below b + m t in a box of height 1, in closed form."""
    def g(t):
        y = f"(({b}) + ({m}) * ({t}) - ({s0}))"
        return f"(CASE WHEN {y} <= 0 THEN 0 WHEN {y} <= 1 THEN {y} * {y} / 2 ELSE {y} - 0.5 END)"
    flat = f"greatest(0, least(1, ({b}) + ({m}) * (({t0}) + ({t1})) / 2 - ({s0}))) * (({t1}) - ({t0}))"
    return f"(CASE WHEN abs({m}) < 1e-7 THEN {flat} ELSE ({g(t1)} - {g(t0)}) / ({m}) END)"


def arc_area_sql(xc, yc, r, side):
    """Integral over [-.5, .5] of the height of a half circle, cut to [0, 1]; nothing where the circle does not reach.

    With d the height of the centre above a level, the upper half lies above the level where |x| < sqrt(r^2 - d^2) if d < 0,
    and the lower half where |x| > sqrt(r^2 - d^2) if d > 0.
    """
    def cut(t, limit):
        return f"greatest(-({limit}), least({limit}, {t} - ({xc})))"

    def prim(x):
        return f"(({x}) * sqrt(greatest(0, {r} * {r} - ({x}) * ({x}))) + {r} * {r} * asin(greatest(-1, least(1, ({x}) / {r})))) / 2"

    def between(d, limit, sign):
        a, b = cut("-0.5", limit), cut("0.5", limit)
        return f"(({d}) * ({b} - ({a})) {sign} ({prim(b)} - {prim(a)}))"

    def above(level):
        d = f"(({yc}) - {level})"
        part = f"sqrt(greatest(0, {r} * {r} - {d} * {d}))"
        upper = f"CASE WHEN {d} >= 0 THEN {between(d, r, '+')} ELSE {between(d, part, '+')} END"
        lower = f"CASE WHEN {d} <= 0 THEN 0 ELSE {between(d, r, '-')} - {between(d, part, '-')} END"
        return f"(CASE WHEN {side} > 0 THEN {upper} ELSE {lower} END)"
    return f"({above(0)} - {above(1)})"


def column_sums_sql(kt: int, ks: int, name: str) -> str:
    """Column sums s0.. of the kt x ks part of the normalised windows in memb."""
    ht, hs = kt // 2, ks // 2
    cols = ", ".join(f"sum(CASE WHEN t = {c - ht} THEN norm END) AS s{c}" for c in range(kt))
    return f"""{name} AS MATERIALIZED (
  SELECT grid_id, i, j, axis_rank, axis, up, down, {cols}
  FROM (SELECT *, CASE WHEN up > down THEN 1 - x ELSE x END AS norm FROM memb
        WHERE t BETWEEN {-ht} AND {kt - 1 - ht} AND s BETWEEN {-hs} AND {ks - 1 - hs})
  GROUP BY 1, 2, 3, 4, 5, 6, 7)"""


def sums_sql(kt: int, ks: int, angle: float, k: int, name: str = "sums") -> str:
    """CTEs win, grad, axes, lev and column sums S0.. of the normalised kt x ks window."""
    sobel = [[1, 2, 1], [0, 0, 0], [-1, -2, -1]]
    return f"""{window_sql(k)},
grad AS MATERIALIZED (SELECT grid_id, i, j, {kernel_sum_sql(sobel)} AS gx, {kernel_sum_sql(sobel, True)} AS gy,
    min(CASE WHEN kind = 0 AND abs(di) <= 2 AND abs(dj) <= 2 THEN u END) AS lo,
    max(CASE WHEN kind = 0 AND abs(di) <= 2 AND abs(dj) <= 2 THEN u END) AS hi,
    sum(CASE WHEN abs(di) <= 1 AND abs(dj) <= 1 THEN u * dj ELSE 0 END) AS rise_j,
    sum(CASE WHEN abs(di) <= 1 AND abs(dj) <= 1 THEN u * di ELSE 0 END) AS rise_i FROM win GROUP BY 1, 2, 3),
axes AS MATERIALIZED (
  SELECT *, 0 AS axis_rank, CASE WHEN abs(gx) >= abs(gy) THEN 1 ELSE 0 END AS axis FROM grad
  UNION ALL
  SELECT *, 1, CASE WHEN abs(gx) >= abs(gy) THEN 0 ELSE 1 END FROM grad
  WHERE atan(least(abs(gx), abs(gy)) / (greatest(abs(gx), abs(gy)) + 1e-15)) > {angle} * pi() / 180),
lev AS MATERIALIZED (
  SELECT grid_id, i, j, axis_rank, axis, lo, hi,
         CASE WHEN (CASE WHEN axis = 0 THEN rise_j ELSE rise_i END) >= 0 THEN hi ELSE lo END AS up,
         CASE WHEN (CASE WHEN axis = 0 THEN rise_j ELSE rise_i END) >= 0 THEN lo ELSE hi END AS down
  FROM axes WHERE lo IS NOT NULL),
memb AS (
  SELECT l.*, CASE WHEN axis = 0 THEN di ELSE dj END AS t, CASE WHEN axis = 0 THEN dj ELSE di END AS s,
    ((CASE WHEN w.kind = 0 AND w.u < (up + down) / 2 THEN lo WHEN w.kind = 0 AND w.u > (up + down) / 2 THEN hi
      ELSE w.u END) - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) AS x
  FROM lev l JOIN win w USING (grid_id, i, j)),
{column_sums_sql(kt, ks, name)}"""
