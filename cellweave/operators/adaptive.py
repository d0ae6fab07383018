"""Windows that follow the interface, and curve fits on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.index import fdiv, map_index, weighted
from cellweave.operators.curves import fit_matrix
from cellweave.operators.sides import column_runs
from cellweave.schema import CUT, KEY, REFLECT, REGULAR, GridShape, with_shape

#: Cells in a piece of a column.
PIECE = 32


def _pointers(cells: DataFrame, shape: GridShape | DataFrame, axis: int) -> DataFrame:
    """For every cut cell and side (-1, 1) the nearest cut cell of the next column.

    Rows: grid_id, c, p, side; path, an array with one struct(lo, hi) if that column has a bounded run; and where to go
    on: ec, ep (folded cell), off (its place less the origin's) and es (side there).  Bounds and places are relative
    to the origin.  Past a mirrored edge the side turns; past an edge that extends the column follows itself.
    """
    col, pos = ("i", "j") if axis == 0 else ("j", "i")
    (ncol, mcol), (npos, mpos) = (("ni", "mode_i"), ("nj", "mode_j"))[::1 if axis == 0 else -1]
    runs = column_runs(cells.select(*KEY, "u", "kind"), shape, axis, F.col("kind") == REGULAR)
    runs = runs.select(*KEY, "u", "kind", F.col("prev.pos").alias("lo"), F.col("next.pos").alias("hi"))
    near = column_runs(runs, shape, axis, F.col("kind") == CUT, carry=("lo", "hi"))
    up, down = F.col("next.pos") - F.col(pos), F.col(pos) - F.col("prev.pos")
    best = F.when(down.isNull() | (up <= down), F.col("next")).otherwise(F.col("prev"))
    near = near.withColumn("n", best).select(
        "grid_id", F.col(col).alias("ec"), F.col(pos).alias("p"), (F.col("n.pos") - F.col(pos)).alias("off"),
        (F.col("n.lo") - F.col(pos)).alias("lo"), (F.col("n.hi") - F.col(pos)).alias("hi"))
    both = with_shape(cells.filter(F.col("kind") == CUT).select(*KEY), shape).select(
        "grid_id", F.col(col).alias("c"), F.col(pos).alias("p"), F.col(ncol).alias("nc"), F.col(mcol).alias("mc"), F.col(npos).alias("np"),
        F.col(mpos).alias("mp"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    at = F.col("c") + F.col("side")
    outside = (at < 0) | (at >= F.col("nc"))
    both = both.withColumns({"ec": map_index(at, F.col("nc"), F.col("mc")), "es": F.when(outside & (F.col("mc") == REFLECT), -F.col("side")).otherwise(F.col("side"))})
    linked = both.join(near, ["grid_id", "ec", "p"], "left")
    bounded = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    path = F.when(bounded, F.array(F.struct("lo", "hi"))).otherwise(F.array()).cast(PATH)
    return linked.select("grid_id", "c", "p", "side", path.alias("path"), "ec", map_index(F.col("p") + F.col("off"), F.col("np"), F.col("mp")).alias("ep"),
                         F.col("off").cast("int").alias("off"), "es")


PATH = "array<struct<lo:int,hi:int>>"


def _doubled(hops: DataFrame, length: int) -> DataFrame:
    """Pointers twice as long (list ranking): a full path of `length` columns goes on with the path of its end."""
    end = hops.select("grid_id", F.col("c").alias("ec"), F.col("p").alias("ep"), F.col("side").alias("es"), F.col("path").alias("n_path"),
                      F.col("ec").alias("n_ec"), F.col("ep").alias("n_ep"), F.col("off").alias("n_off"), F.col("es").alias("n_es"))
    both = hops.join(end, ["grid_id", "ec", "ep", "es"], "left")
    whole = (F.size("path") == length) & F.col("n_path").isNotNull()
    moved = F.transform("n_path", lambda x: F.struct((x["lo"] + F.col("off")).alias("lo"), (x["hi"] + F.col("off")).alias("hi")))
    return both.select("grid_id", "c", "p", "side", F.when(whole, F.concat("path", moved.cast(PATH))).otherwise(F.col("path")).alias("path"),
                       F.col("n_ec").alias("ec"), F.col("n_ep").alias("ep"), (F.col("off") + F.col("n_off")).alias("off"), F.col("n_es").alias("es"))


def adaptive_stencil(cells: DataFrame, shape: GridShape | DataFrame, axis: int, k: int = 3, center_weight: float = 2.1,
                     dep_size: int | None = None) -> DataFrame:
    """Window of k columns along the interface for every cut cell.

    In each column the run of cut cells and its two bounding regular cells count.
    The interface is followed k - 1 columns to both sides, by pointers from cut cell to cut cell whose length doubles
    with each join; among the k window positions the one with the smallest height + center_weight * |shift| wins.
    Where it cannot be followed, or the cell's own run has no bound, the centred square stays.  Edges may be cyclic,
    mirrored or extended (a run that ends at an extended edge has no bound there).  Rows: KEY, c0, c1 (first
    and last column), s0, s1 (first and last row), all unwrapped.
    """
    col, pos = ("i", "j") if axis == 0 else ("j", "i")
    hops, length = _pointers(cells, shape, axis), 1
    while length < k - 1:
        hops, length = _doubled(hops, length), 2 * length
    own = column_runs(cells.select(*KEY, "u", "kind"), shape, axis, F.col("kind") == REGULAR).filter(F.col("kind") == CUT).select(
        "grid_id", F.col(col).alias("c"), F.col(pos).alias("p"), F.array(F.struct(
            (F.col("prev.pos") - F.col(pos)).alias("lo"), (F.col("next.pos") - F.col(pos)).alias("hi"))).cast(PATH).alias("path"))
    rows = hops.select("grid_id", "c", "p", "side", F.slice("path", 1, k - 1).alias("path")).unionByName(
        own.select("grid_id", "c", "p", F.lit(0).alias("side"), F.filter("path", lambda x: x["lo"].isNotNull() & x["hi"].isNotNull()).alias("path")))
    bound = "array<struct<d:int,lo:int,hi:int>>"
    placed = F.transform("path", lambda x, n: F.struct(((n + F.when(F.col("side") == 0, 0).otherwise(1)) * F.col("side")).alias("d"),
                                                       (x["lo"] + F.col("p")).alias("lo"), (x["hi"] + F.col("p")).alias("hi"))).cast(bound)
    both = rows.select("grid_id", F.col("c").alias(col), F.col("p").alias(pos), placed.alias("cols")).groupBy(*KEY).agg(
        F.flatten(F.collect_list("cols")).alias("cols"))

    def option(n):
        first = n - (k - 1)
        part = F.filter("cols", lambda c: (c["d"] >= first) & (c["d"] < first + k))
        lo, hi = F.array_min(F.transform(part, lambda c: c["lo"])), F.array_max(F.transform(part, lambda c: c["hi"]))
        cost = hi - lo + center_weight * abs(n - k // 2)
        return F.when(F.size(part) == k, F.struct(cost.alias("cost"), F.lit(n).alias("n"), F.lit(first).alias("first"),
                                                  lo.alias("lo"), hi.alias("hi")))

    both = both.withColumn("_w", F.array_min(F.filter(F.array(*[option(n) for n in range(k)]), lambda o: o.isNotNull())))
    h = k // 2
    c0 = F.col(col) + F.coalesce(F.col("_w.first"), F.lit(-h))
    s0 = F.coalesce(F.col("_w.lo"), F.col(pos) - h)
    s1 = F.coalesce(F.col("_w.hi"), F.col(pos) - h + k - 1)
    if dep_size is not None:
        need = F.greatest(F.lit(-dep_size), F.least(F.lit(dep_size), F.lit(dep_size) - (s1 - s0 + 1)))
        first = F.when(need >= 0, F.ceil(need / 2)).otherwise(F.floor(need / 2))
        s0, s1 = s0 - first, s1 + (need - first)
    return both.select(*KEY, c0.cast("int").alias("c0"), (c0 + k - 1).cast("int").alias("c1"),
                       s0.cast("int").alias("s0"), s1.cast("int").alias("s1"))


def _pieces(cells: DataFrame, col: str, pos: str) -> DataFrame:
    """Cells as pieces of columns: grid_id, _at (column), _piece and _cells, PIECE structs (u, kind), NULL where there is no cell."""
    place = F.pmod(F.col(pos), F.lit(PIECE))
    c = cells.select("grid_id", F.col(col).alias("_at"), fdiv(F.col(pos), PIECE).alias("_piece"), F.struct(
        place.alias("key"), F.struct("u", "kind").alias("value")).alias("_e"))
    c = c.groupBy("grid_id", "_at", "_piece").agg(F.map_from_entries(F.collect_list("_e")).alias("_m"))
    return c.select("grid_id", "_at", "_piece", F.transform(F.sequence(F.lit(0), F.lit(PIECE - 1)), lambda n: F.col("_m")[n]).alias("_cells"))


def adaptive_sums(windows: DataFrame, levels: DataFrame, cells: DataFrame, shape: GridShape | DataFrame, axis: int) -> DataFrame:
    """Column sums of the normalised adaptive windows.

    `levels` has KEY, value_up, value_down.  Rows: KEY, levels, shift (place of the
    cell's own column), base (lower edge of the window), sums array<double>.
    Windows meet pieces of columns, not single cells, and each sums its part of a column there, so that what is shuffled
    is a row for each column of a window.
    """
    col, pos = ("i", "j") if axis == 0 else ("j", "i")
    w = with_shape(windows.join(levels.select(*KEY, "value_up", "value_down"), KEY), shape)
    (ncol, mcol), (npos, mpos) = (("ni", "mode_i"), ("nj", "mode_j"))[::1 if axis == 0 else -1]
    m = w.withColumn("_c", F.explode(F.sequence("c0", "c1")))
    m = m.withColumns({"_at": map_index(F.col("_c"), F.col(ncol), F.col(mcol)),
                       "_ps": F.transform(F.sequence("s0", "s1"), lambda p: map_index(p, F.col(npos), F.col(mpos)))})
    m = m.withColumn("_piece", F.explode(F.array_distinct(F.transform("_ps", lambda p: fdiv(p, PIECE)))))
    group = [*KEY, "value_up", "value_down", "c0", "s0"]
    m = m.withColumn("_ps", F.transform(F.filter("_ps", lambda p: fdiv(p, PIECE) == F.col("_piece")), lambda p: F.pmod(p, F.lit(PIECE))))
    # a piece is many times larger than Spark's estimate, so it must not be broadcast
    m = m.select(*group, "_c", "_at", "_piece", "_ps").join(_pieces(cells, col, pos).hint("merge"), ["grid_id", "_at", "_piece"])
    up, down = F.col("value_up"), F.col("value_down")
    lo, hi, mid = F.least(up, down), F.greatest(up, down), (up + down) / 2

    def normal(cell):
        u, regular = cell["u"], cell["kind"] == REGULAR
        snapped = F.when(regular & (u < mid), lo).when(regular & (u > mid), hi).otherwise(u)
        x = (snapped - lo) / F.when(hi == lo, 1.0).otherwise(hi - lo)
        return F.when(up > down, 1 - x).otherwise(x)

    seen = F.filter(F.transform("_ps", lambda p: F.get("_cells", p)), lambda cell: cell.isNotNull())
    part = F.aggregate(F.transform(seen, normal), F.lit(None).cast("double"), added)
    m = m.withColumn("_seen", seen).filter(F.size("_seen") > 0).select(*group, "_c", part.alias("_x"))
    # the scores join by cell afterwards, and find these rows in place
    sums = m.repartition(*KEY).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_c", "_x"))).alias("_a"))
    columns = F.array_distinct(F.transform("_a", lambda a: a["_c"]))
    sums = sums.withColumn("_sums", F.transform(columns, lambda c: F.aggregate(
        F.filter("_a", lambda a: a["_c"] == c), F.lit(None).cast("double"), lambda s, a: added(s, a["_x"]))))
    return sums.select(*KEY, "value_up", "value_down", (F.col(col) - F.col("c0")).alias("shift"),
                       (F.col("s0") - F.col(pos)).alias("base"), F.col("_sums").alias("sums"))


def added(total: Column, x: Column) -> Column:
    """A sum that passes over NULL, and is NULL without any number."""
    return F.when(x.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + x)


def propose_adaptive(sums: DataFrame, axis: int, degree: int = 2, k: int = 3, ccew: float = 0.0,
                     consistent: bool = False, model_idx: int = 1) -> DataFrame:
    """Curve proposals from adaptive column sums, one literal matrix per window position."""
    params: Column | None = None
    for shift in range(k):
        xs = np.arange(k) - shift
        if consistent:
            w = (np.abs(xs) < 2).astype(float)
        else:
            w = np.exp(-np.square(xs.astype(float)))
        w[shift] += ccew
        rows = [weighted(F.col("sums"), r) for r in fit_matrix(xs, degree, True, w)]
        if consistent:
            rows[0] = F.col("sums")[shift]
        rows[0] = rows[0] + F.col("base")
        p = F.array(*rows)
        params = F.when(F.col("shift") == shift, p) if params is None else params.when(F.col("shift") == shift, p)
    family = {1: "line", 2: "quadratic"}.get(degree, "curve_poly")
    return sums.select(*KEY, F.lit(model_idx).alias("model_idx"), F.lit(0).alias("axis_rank"), F.lit(0).alias("cand"),
                       F.lit(axis).alias("axis"), F.lit(family).alias("family"), params.alias("params"),
                       "value_up", "value_down")
