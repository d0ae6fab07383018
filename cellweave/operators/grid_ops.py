"""Projections, filters and orderings on cells (no shuffle unless stated)."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellweave.schema import GridShape, with_shape

COMPARE = {">=": operator.ge, ">": operator.gt, "==": operator.eq,
           "!=": operator.ne, "<=": operator.le, "<": operator.lt}


def all_cells(cells: DataFrame) -> DataFrame:
    return cells


def filter_kind(cells: DataFrame, op: str = ">=", value: float = 1.0, column: str = "si") -> DataFrame:
    """Cells whose smoothness index compares true with a value."""
    return cells.filter(COMPARE[op](F.col(column), value))


def ordered(cells: DataFrame, column: str = "si", descending: bool = True,
            top: int | None = None) -> DataFrame:
    """Global order by a column, ties by grid and position; `top` keeps the first rows."""
    first = F.desc(column) if descending else F.asc(column)
    out = cells.orderBy(first, "grid_id", "i", "j")
    return out.limit(top) if top is not None else out


def rank_in_grid(cells: DataFrame, column: str, top: int, descending: bool = True) -> DataFrame:
    """The `top` cells of each grid by a column, with their rank.

    A salted first round keeps at most `top` rows per grid and slice, so no task
    has to sort all cells of one large grid; the second round ranks what is left.
    """
    order = [F.desc(column) if descending else F.asc(column), F.asc("i"), F.asc("j")]
    slice_ = F.pmod(F.xxhash64("i", "j"), F.lit(64))
    first = Window.partitionBy("grid_id", "_slice").orderBy(*order)
    second = Window.partitionBy("grid_id").orderBy(*order)
    return (cells.withColumn("_slice", slice_)
            .withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= top)
            .withColumn("rank", F.row_number().over(second)).filter(F.col("rank") <= top)
            .drop("_slice", "_r"))


def order_by_error(fits: DataFrame, descending: bool = True, kind: int | None = None,
                   top: int | None = None) -> DataFrame:
    """Worst fitted cells first, optionally only cells of one kind."""
    if kind is not None:
        fits = fits.filter(F.col("kind") == kind)
    return ordered(fits, "loss", descending, top)


def interface_mask(cells: DataFrame) -> DataFrame:
    return cells.withColumn("is_cut", (F.col("u") > 0) & (F.col("u") < 1))


def repeat_cells(cells: DataFrame, fi: int, fj: int) -> DataFrame:
    """Nearest-neighbour refinement: every cell becomes fi x fj cells."""
    return (cells.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(fi * fj - 1))))
            .withColumns({"i": (F.col("i") * fi + F.floor(F.col("_p") / fj)).cast("int"),
                          "j": (F.col("j") * fj + F.pmod("_p", F.lit(fj))).cast("int")}).drop("_p"))


def edge_mask_highres(cells: DataFrame, f: int) -> DataFrame:
    return repeat_cells(interface_mask(cells), f, f)


def grid_shift(cells: DataFrame, shape: GridShape | DataFrame, si: int, sj: int) -> DataFrame:
    """Cyclic shift by whole cells."""
    names = cells.columns
    return (with_shape(cells, shape)
            .withColumns({"i": F.pmod(F.col("i") + si, F.col("ni")).cast("int"),
                          "j": F.pmod(F.col("j") + sj, F.col("nj")).cast("int")}).select(*names))


def threshold(cells: DataFrame, t: float = 0.5) -> DataFrame:
    return cells.withColumn("u", F.when(F.col("u") < t, 0.0).otherwise(1.0))


def clamp(cells: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    u = F.col("u")
    u = u if lo is None else F.greatest(u, F.lit(float(lo)))
    return cells.withColumn("u", u if hi is None else F.least(u, F.lit(float(hi))))


def transpose_grid(cells: DataFrame) -> DataFrame:
    out = cells.withColumns({"i": F.col("j"), "j": F.col("i")})
    if "ni" in cells.columns:
        out = out.withColumns({"ni": F.col("nj"), "nj": F.col("ni")})
    return out


def rotation_field(cells: DataFrame, shape: GridShape | DataFrame, omega: float,
                   velocity: tuple[float, float] = (0.0, 0.0),
                   center: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Velocity per cell: a constant part plus a rotation about `center`.

    The rotation is scaled so that its largest component is omega.  On a full
    grid that component sits on the border, so it follows from the shape alone
    and needs neither a window nor an aggregate.
    """
    c = with_shape(cells, shape)
    x, y = (F.col("i") + 0.5) / F.col("ni"), (F.col("j") + 0.5) / F.col("nj")
    rx, ry = x - center[0], y - center[1]

    def far(n: Column, at: float) -> Column:
        return F.greatest(F.abs(F.lit(0.5) / n - at), F.abs((n - 0.5) / n - at))

    scale = F.lit(float(omega)) / F.greatest(far(F.col("ni"), center[0]), far(F.col("nj"), center[1]))
    return c.withColumns({"vi": F.lit(float(velocity[0])) - ry * scale,
                          "vj": F.lit(float(velocity[1])) + rx * scale}).select(*cells.columns, "vi", "vj")


