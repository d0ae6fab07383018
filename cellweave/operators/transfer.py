"""One conservative redistribution of cell content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.area import model_integral
from cellweave.functions.index import map_index
from cellweave.operators.grid_ops import clamp
from cellweave.operators.resample import MODEL
from cellweave.schema import KEY, GridShape, with_shape

PARTS = "array<struct<di:int,dj:int,x0:double,x1:double,y0:double,y1:double>>"


def transfer_parts(vi: Column, vj: Column) -> Column:
    """array<struct(di, dj, x0, x1, y0, y1)>: which part of a unit cell moves where.

    Velocities are at most one cell.  A velocity along one axis moves one slab; a
    diagonal one moves a side, a corner and another side.
    """
    def strip(v, moved):
        """Part of [0, 1] that leaves (moved) or stays, for velocity v."""
        lo = F.when(v > 0, 1 - v).otherwise(F.lit(0.0))
        hi = F.when(v > 0, F.lit(1.0)).otherwise(-v)
        stay_lo = F.when(v > 0, F.lit(0.0)).otherwise(-v)
        stay_hi = F.when(v > 0, 1 - v).otherwise(F.lit(1.0))
        return (lo, hi) if moved else (stay_lo, stay_hi)

    si, sj = F.signum(vi).cast("int"), F.signum(vj).cast("int")

    def part(mi, mj):
        (x0, x1), (y0, y1) = strip(vi, mi), strip(vj, mj)
        return F.struct((si if mi else F.lit(0)).alias("di"), (sj if mj else F.lit(0)).alias("dj"),
                        x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))

    none = F.array().cast(PARTS)
    return (F.when((vi == 0) & (vj == 0), none)
            .when(vj == 0, F.array(part(True, False)))
            .when(vi == 0, F.array(part(False, True)))
            .otherwise(F.array(part(True, False), part(True, True), part(False, True))))


def transfer_rectangles(cells: DataFrame) -> DataFrame:
    """One row per cell (columns vi, vj) and receiving neighbour with the moving part."""
    parts = transfer_parts(F.col("vi"), F.col("vj"))
    return cells.withColumn("_t", F.explode(parts)).select(*cells.columns, "_t.*")


def transfer_once(fits: DataFrame, shape: GridShape | DataFrame, velocity: tuple[float, float] | None = None,
                  families=("constant", "line", "quadratic"), lo: float | None = None,
                  hi: float | None = None) -> DataFrame:
    """Move content by each cell's velocity (columns vi, vj or one constant pair).

    Every source emits its own average, minus what leaves and plus what arrives;
    one aggregate with partial sums adds them up, so the total is conserved.
    """
    f = with_shape(fits, shape)
    if velocity is not None:
        f = f.withColumns({"vi": F.lit(float(velocity[0])), "vj": F.lit(float(velocity[1]))})
    none = F.struct(F.lit(0).alias("di"), F.lit(0).alias("dj"),
                    *[F.lit(0.0).alias(x) for x in ("x0", "x1", "y0", "y1")])
    parts = F.concat(F.array(none), transfer_parts(F.col("vi"), F.col("vj")))
    slow = (F.abs("vi") <= 1) & (F.abs("vj") <= 1)
    parts = F.when(slow, parts).otherwise(F.raise_error(F.lit("velocities are at most one cell")).cast(PARTS))
    f = f.select(*KEY, "ni", "nj", "mode_i", "mode_j", "u", *MODEL, F.inline(parts))
    x0, x1, y0, y1 = (F.col(n) - 0.5 for n in ("x0", "x1", "y0", "y1"))
    stay = (F.col("di") == 0) & (F.col("dj") == 0)
    f = f.withColumn("_q", F.when(stay, F.col("u")).otherwise(
        model_integral(families, {n: F.col(n) for n in MODEL}, x0, x1, y0, y1)))

    def entry(di, dj, q):
        return F.struct(di.alias("a"), dj.alias("b"), q.alias("q"))

    gain = entry(F.col("di"), F.col("dj"), F.col("_q"))
    loss = entry(F.lit(0), F.lit(0), -F.col("_q"))
    f = f.withColumn("_e", F.explode(F.when(stay, F.array(gain)).otherwise(F.array(gain, loss))))
    moved = f.select("grid_id",
                     map_index(F.col("i") + F.col("_e.a"), F.col("ni"), F.col("mode_i")).alias("i"),
                     map_index(F.col("j") + F.col("_e.b"), F.col("nj"), F.col("mode_j")).alias("j"),
                     F.col("_e.q").alias("q"))
    out = moved.groupBy(*KEY).agg(F.sum("q").alias("u"))
    return clamp(out, lo, hi) if lo is not None or hi is not None else out


def upwind_once(cells: DataFrame, shape: GridShape | DataFrame, velocity: tuple[float, float]) -> DataFrame:
    """Constant-in-cell special case: the fraction |v| moves to the next cell.

    Only one component may be non-zero.
    """
    vi, vj = velocity
    if vi != 0 and vj != 0:
        raise ValueError("only one velocity component may be non-zero")
    v = abs(vi + vj)
    if v > 1:
        raise ValueError("velocities are at most one cell")
    di, dj = (vi > 0) - (vi < 0), (vj > 0) - (vj < 0)
    c = with_shape(cells.select(*KEY, "u"), shape)
    parts = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1.0 - v).alias("q")),
                    F.struct(F.lit(di).alias("a"), F.lit(dj).alias("b"), F.lit(float(v)).alias("q")))
    return (c.withColumn("_e", F.explode(parts))
            .select("grid_id", map_index(F.col("i") + F.col("_e.a"), F.col("ni"), F.col("mode_i")).alias("i"),
                    map_index(F.col("j") + F.col("_e.b"), F.col("nj"), F.col("mode_j")).alias("j"),
                    (F.col("u") * F.col("_e.q")).alias("q"))
            .groupBy(*KEY).agg(F.sum("q").alias("u")))
