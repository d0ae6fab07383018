"""From points, pixels and sparse cells to dense grids of cell averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.schema import GridShape, require, with_shape


def bin_to_cells(df: DataFrame, i: Column, j: Column, value: Column,
                 grid_id: Column, agg: str = "avg") -> DataFrame:
    """Aggregate all points that fall into a cell (averages by default).

    Partial aggregation runs before the shuffle, so a hot cell or grid costs one
    row per task.
    """
    fn = {"avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[agg]
    return (df.select(grid_id.cast("string").alias("grid_id"), F.floor(i).cast("int").alias("i"),
                      F.floor(j).cast("int").alias("j"), value.cast("double").alias("u"))
            .groupBy("grid_id", "i", "j").agg(fn("u").cast("double").alias("u")))


def coarsen(cells: DataFrame, fi: int, fj: int, value: str = "u") -> DataFrame:
    """Block averages of fi x fj cells (or pixels)."""
    return bin_to_cells(cells, F.col("i") / fi, F.col("j") / fj, F.col(value), F.col("grid_id"))


def normalize_grid(cells: DataFrame, value: str = "u") -> DataFrame:
    """Per grid: subtract the minimum, then divide by the new maximum.

    Two statistics per grid are aggregated and joined back; the join carries no
    broadcast hint, Spark decides by measured size.
    """
    stats = cells.groupBy("grid_id").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return (cells.join(stats, "grid_id")
            .withColumn(value, (F.col(value) - F.col("_lo")) / F.when(span == 0, 1.0).otherwise(span))
            .drop("_lo", "_hi"))


def spine(grids: DataFrame) -> DataFrame:
    """All (i, j) of every grid of a grids table; extra columns are kept.

    The rows of a grid are spread over tasks before they are filled with columns,
    so one huge grid is not made by one task.
    """
    require(grids, "grid_id", "ni", "nj")
    width = int(grids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = grids.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)))
    return (rows.repartition(width, "grid_id", "i")
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))))


def grids_of(cells: DataFrame, shape: GridShape) -> DataFrame:
    """The grids table of equally shaped grids."""
    return with_shape(cells.select("grid_id").distinct(), shape)


def densify(cells: DataFrame, grids: DataFrame, fill: float = 0.0, outside: str = "raise") -> DataFrame:
    """Add the missing cells of every grid with a fill value.

    Cells of no listed grid, or beyond its size, raise an error, unless outside="drop" asks to leave them out.
    """
    if outside == "raise":
        known = grids.select("grid_id", F.col("ni").alias("_ni"), F.col("nj").alias("_nj"))
        inside = (F.col("i") >= 0) & (F.col("i") < F.col("_ni")) & (F.col("j") >= 0) & (F.col("j") < F.col("_nj"))
        error = F.raise_error(F.concat(F.lit("cell outside its grid: "), F.col("grid_id").cast("string"))).cast("double")
        cells = cells.join(known, "grid_id", "left").select(
            "grid_id", F.when(F.coalesce(inside, F.lit(False)), F.col("i")).otherwise(error).cast("int").alias("i"), "j", "u")
    full = spine(grids.select("grid_id", "ni", "nj")).select("grid_id", "i", "j")
    return (full.join(cells.select("grid_id", "i", "j", "u"), ["grid_id", "i", "j"], "left")
            .withColumn("u", F.coalesce("u", F.lit(float(fill)))))
