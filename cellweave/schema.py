"""Table contracts and the shape of a grid.

Every operator takes and returns DataFrames that follow these layouts.  One row
is one cell, so a table may hold any number of grids of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

CYCLIC, EXTEND, REFLECT = "cyclic", "extend", "reflect"
MODES = (CYCLIC, EXTEND, REFLECT)

REGULAR, CUT = 0, 1

KEY = ["grid_id", "i", "j"]

CELLS = T.StructType([
    T.StructField("grid_id", T.StringType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("j", T.IntegerType()),
    T.StructField("u", T.DoubleType()),
])

GRIDS = T.StructType([
    T.StructField("grid_id", T.StringType()),
    T.StructField("ni", T.IntegerType()),
    T.StructField("nj", T.IntegerType()),
    T.StructField("mode_i", T.StringType()),
    T.StructField("mode_j", T.StringType()),
])

# One proposed local model of a cell.  `cand` numbers the proposals of one model
# and axis; (model_idx, axis_rank, cand) is the order in which ties are decided.
PROPOSAL = T.StructType([
    T.StructField("model_idx", T.IntegerType()),
    T.StructField("axis_rank", T.IntegerType()),
    T.StructField("cand", T.IntegerType()),
    T.StructField("axis", T.IntegerType()),
    T.StructField("family", T.StringType()),
    T.StructField("params", T.ArrayType(T.DoubleType())),
    T.StructField("value_up", T.DoubleType()),
    T.StructField("value_down", T.DoubleType()),
])


@dataclass(frozen=True)
class GridShape:
    """Shape and edge behaviour shared by all grids of a table."""

    ni: int
    nj: int
    mode_i: str = CYCLIC
    mode_j: str = CYCLIC

    def __post_init__(self):
        check_mode(self.mode_i)
        check_mode(self.mode_j)


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown boundary mode {mode!r}, expected one of {MODES}")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def with_shape(cells: DataFrame, shape: GridShape | DataFrame) -> DataFrame:
    """Add ni, nj, mode_i, mode_j to every cell.

    A GridShape becomes literals (no join).  A `grids` table is joined by
    grid_id without a broadcast hint: Spark broadcasts it only while its
    measured size is below spark.sql.autoBroadcastJoinThreshold and otherwise
    joins by shuffle, where adaptive execution splits a hot grid_id.
    """
    require(cells, "grid_id")
    if isinstance(shape, GridShape):
        return cells.withColumns({
            "ni": F.lit(shape.ni), "nj": F.lit(shape.nj),
            "mode_i": F.lit(shape.mode_i), "mode_j": F.lit(shape.mode_j),
        })
    return cells.join(shape.select(*GRIDS.names), "grid_id")


def proposal(model_idx: int, axis_rank: Column, cand: int, axis: Column, family: str,
             params: Column, up: Column, down: Column) -> Column:
    return F.struct(
        F.lit(model_idx).alias("model_idx"), axis_rank.cast("int").alias("axis_rank"),
        F.lit(cand).alias("cand"), axis.cast("int").alias("axis"),
        F.lit(family).alias("family"), params.alias("params"),
        up.cast("double").alias("value_up"), down.cast("double").alias("value_down"),
    )
