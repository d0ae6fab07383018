"""Searching the pure cells on both sides of a cut cell, along columns, rays and greedy walks.

Positions in results are not wrapped: a cyclic walk may end below 0 or beyond
n - 1, which keeps "down" and "up" apart.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellweave.functions.area import model_eval, model_integral
from cellweave.functions.index import let, map_index
from cellweave.operators.curves import window_opposites
from cellweave.operators.labels import window_gradient
from cellweave.operators.walks import Walks, greedy, ray, sides, start, supersteps
from cellweave.operators.windows import with_windows
from cellweave.plans.lineage import cut_lineage
from cellweave.schema import CUT, CYCLIC, KEY, REFLECT, REGULAR, GridShape, with_shape

BLOCK = 4096


def column_runs(cells: DataFrame, shape: GridShape | DataFrame, axis: int, accept: Column,
                block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """For every cell the last accepted cell at or before it and the first at or after it.

    Columns run along the dependent axis.  Adds prev and next, struct(pos, u), or
    NULL; `carry` names further position columns to put into the struct.  On cyclic grids the search continues around
    the edge, on mirrored ones over the images behind it.  A column of more than `block` cells, or of unknown length, is
    scanned in blocks: windows within blocks, then one small window over block
    summaries, so no task has to sort a whole long column.
    """
    col, pos = ("i", "j") if axis == 0 else ("j", "i")
    n, mode = ("nj", "mode_j") if axis == 0 else ("ni", "mode_i")
    hit = F.when(accept, F.struct(F.col(pos).alias("pos"), F.col("u").alias("u"), *carry))
    c = with_shape(cells, shape).withColumn("_hit", hit)
    before, after = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)
    if isinstance(shape, GridShape) and (shape.nj if axis == 0 else shape.ni) <= block:
        whole = Window.partitionBy("grid_id", col)
        line = whole.orderBy(pos)
        c = c.withColumns({"_before": F.last("_hit", ignorenulls=True).over(line.rowsBetween(*before)),
                           "_after": F.first("_hit", ignorenulls=True).over(line.rowsBetween(*after)),
                           "_first": F.min("_hit").over(whole), "_last": F.max("_hit").over(whole)})
    else:
        c = c.withColumn("_k", F.floor(F.col(pos) / block).cast("int"))
        inner = Window.partitionBy("grid_id", col, "_k").orderBy(pos)
        c = c.withColumns({"_p": F.last("_hit", ignorenulls=True).over(inner.rowsBetween(*before)),
                           "_n": F.first("_hit", ignorenulls=True).over(inner.rowsBetween(*after))})
        whole = Window.partitionBy("grid_id", col)
        line = whole.orderBy("_k")
        sums = c.groupBy("grid_id", col, "_k").agg(F.min("_hit").alias("_lo"), F.max("_hit").alias("_hi"))
        sums = sums.select(
            "grid_id", col, "_k",
            F.max("_hi").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_b"),
            F.min("_lo").over(line.rowsBetween(1, Window.unboundedFollowing)).alias("_a"),
            F.min("_lo").over(whole).alias("_first"), F.max("_hi").over(whole).alias("_last"))
        c = c.join(sums, ["grid_id", col, "_k"]).withColumns({"_before": F.coalesce("_p", "_b"), "_after": F.coalesce("_n", "_a")})
        c = c.drop("_k", "_p", "_n", "_a", "_b")

    def around(s, shift, mirrored):
        turned = F.when(F.col(mode) == CYCLIC, F.struct(
            (s["pos"] + shift).alias("pos"), s["u"].alias("u"), *[(s[x] + shift).alias(x) for x in carry]))
        return turned if mirrored is None else turned.when(F.col(mode) == REFLECT, mirrored)

    # past a mirrored edge the first accepted cell below is the image of the first one above, and the other way round;
    # carried positions have no such image
    images = (None, None)
    if not carry:
        first, last, top = F.col("_first"), F.col("_last"), 2 * (F.col(n) - 1)
        images = tuple(F.struct(p.alias("pos"), s["u"].alias("u")) for p, s in ((-first["pos"], first), (top - last["pos"], last)))
    return c.withColumns({
        "prev": F.coalesce("_before", F.when(F.col("_last").isNotNull(), around(F.col("_last"), -F.col(n), images[0]))),
        "next": F.coalesce("_after", F.when(F.col("_first").isNotNull(), around(F.col("_first"), F.col(n), images[1]))),
    }).drop("_hit", "_before", "_after", "_first", "_last")


def opposite_by_direction(cells: DataFrame, shape: GridShape | DataFrame, axis: int, start: int = 1,
                          accept: Column | None = None) -> DataFrame:
    """First accepted (by default regular) cell below and above each cut cell.

    The walk begins `start` cells away and visits fewer than n cells.  Rows: KEY,
    down_pos, down_u, up_pos, up_u; NULL where a side has none.
    """
    accept = F.col("kind") == REGULAR if accept is None else accept
    pos, n, mode = ("j", "nj", "mode_j") if axis == 0 else ("i", "ni", "mode_i")
    runs = column_runs(cells, shape, axis, accept)
    if start <= 1:
        out = runs.filter(F.col("kind") == CUT)
        out = out.withColumns({"_d": F.col("prev"), "_u": F.col("next")})
    else:
        look = runs.select("grid_id", "i", "j", "prev", "next")
        origins = with_shape(cells.filter(F.col("kind") == CUT), shape)

        def side(df, shift, take, name):
            at = F.col(pos) + shift
            here = map_index(at, F.col(n), F.col(mode))
            keys = {"i": "_i", "j": "_j"}
            df = df.withColumns({"_i": here if pos == "i" else F.col("i"), "_j": here if pos == "j" else F.col("j"),
                                 "_off": at - here})
            found = look.select("grid_id", *[F.col(a).alias(b) for a, b in keys.items()], F.col(take).alias("_t"),
                                F.col("next" if take == "prev" else "prev").alias("_m"))
            # a start behind a mirrored edge walks the other way inside: its first image counts
            axis_at = here + F.col("_off")
            behind = (F.col(mode) == REFLECT) & ((axis_at < 0) | (axis_at >= F.col(n)))
            turn = F.when(axis_at < 0, F.lit(0)).otherwise(2 * (F.col(n) - 1))
            hit = F.when(behind, F.struct((turn - F.col("_m.pos")).alias("pos"), F.col("_m.u").alias("u"))).otherwise(
                F.struct((F.col("_t.pos") + F.col("_off")).alias("pos"), F.col("_t.u").alias("u")))
            return df.join(found, ["grid_id", "_i", "_j"], "left").withColumn(name, F.when(
                F.when(behind, F.col("_m").isNotNull()).otherwise(F.col("_t").isNotNull()), hit)).drop("_i", "_j", "_off", "_t", "_m")

        out = side(side(origins, -start, "prev", "_d"), start, "next", "_u")
    near = (F.col(n) - 1)
    d = F.when(F.col(pos) - F.col("_d.pos") <= near, F.col("_d"))
    u = F.when(F.col("_u.pos") - F.col(pos) <= near, F.col("_u"))
    return out.select(*KEY, d["pos"].alias("down_pos"), d["u"].alias("down_u"),
                      u["pos"].alias("up_pos"), u["u"].alias("up_u"))


def opposite_by_threshold(cells: DataFrame, shape: GridShape | DataFrame, axis: int, threshold: float = 0.5) -> DataFrame:
    """As above from two cells away, accepting regular cells with si <= threshold."""
    return opposite_by_direction(cells, shape, axis, 2, (F.col("kind") == REGULAR) & (F.col("si") <= threshold))


def _relative(threshold: float, w: Walks, own, seen):
    return (seen["kind"] == REGULAR) & (seen["si"] <= threshold * w.ref[own])


def opposite_by_relative(cells: DataFrame, shape: GridShape | DataFrame, axis: int, threshold: float = 0.5) -> DataFrame:
    """Regular cells whose si is at most threshold times the origin's, from two cells away; NULL where a side has none."""
    origins = with_shape(cells.filter(F.col("kind") == CUT).select(*KEY, F.col("si").alias("_si")), shape)
    gi, gj = (0.0, 1.0) if axis == 0 else (1.0, 0.0)
    walks = start(origins, 2, F.col("i"), F.col("j"), gi, gj, F.col("_si"))
    found = supersteps(walks, cells, shape, ["u", "kind", "si"], ray(partial(_relative, threshold), "nj" if axis == 0 else "ni"))
    return sides(found, origins, axis)


def _clean(radius: int, ratio: float | None, w: Walks, own, seen):
    far = np.maximum(np.abs(w.pi[own] - w.i[own]), np.abs(w.pj[own] - w.j[own])) > radius
    calm = True if ratio is None else seen["si"] < ratio * w.ref[own]
    return (seen["kind"] == REGULAR) & far & calm


def opposite_by_gradient(cells: DataFrame, shape: GridShape | DataFrame, axis: int, stencil_radius: int = 0,
                         half_step: bool = False, ratio: float | None = 0.5) -> DataFrame:
    """Walk both ways along the normalised gradient until a clean regular cell.

    Clean: its own stencil (radius given) does not reach the start, and its si is
    below `ratio` times the start's.  half_step uses half-length steps from one
    step on, without the ratio rule if ratio is None.  Every cut cell has a row; a side
    that meets no clean cell within ni steps is NULL.
    """
    w = with_windows(cells, shape, 3, 3, ["u", "kind", "si"], where=F.col("kind") == CUT)
    gx, gy = window_gradient(F.col("w_u"), (3, 3), "scharr", 3, True)
    f = 0.5 if half_step else 1.0
    origins = cut_lineage(with_shape(w.select(*KEY, F.col("si").alias("_si"), (gx * f).alias("_gx"), (gy * f).alias("_gy")), shape))
    walks = start(origins, 1 if half_step else 2, F.col("i"), F.col("j"), F.col("_gx"), F.col("_gy"), F.col("_si"))
    found = supersteps(walks, cells, shape, ["u", "kind", "si"], ray(partial(_clean, stencil_radius, ratio), "ni"))
    return sides(found, origins, axis)


def opposite_by_minmax(cells: DataFrame, shape: GridShape | DataFrame, axis: int, max_steps: int | None = None) -> DataFrame:
    """Two greedy walks from the neighbours along the dependent axis.

    The first climbs to the largest unvisited 8-neighbour, the second descends to
    the smallest, until a regular cell; ties favour the dependent direction.
    Walks go on until none is open.  A walk has no way on when all its neighbours are visited, or when it provably goes
    round for ever (`walks.endless`); its side is NULL.  With max_steps, walks still open after so many steps count as
    without a way on.
    """
    cells = cut_lineage(cells.select(*KEY, "u", "kind"))
    origins = with_shape(cells.filter(F.col("kind") == CUT).select(*KEY), shape)
    side, none = F.col("side"), F.lit(0)
    di, dj = (none, side) if axis == 0 else (side, none)
    i, j = F.col("i"), F.col("j")
    path = F.array(i, j, i + di, j + dj, i - di, j - dj)
    walks = start(origins, 0, i + di, j + dj, path=path)
    return sides(supersteps(walks, cells, shape, ["u", "kind"], greedy(axis, max_steps)), origins, axis)


def opposite_by_window(cells: DataFrame, shape: GridShape | DataFrame, axis: int, k: int = 5) -> DataFrame:
    """Smallest and largest regular cell of a k x k window, ordered along the dependent axis; NULL without one."""
    w = with_windows(cells, shape, k, k, ["u", "kind"], where=F.col("kind") == CUT)
    bound = F.struct(F.col("w_u").alias("u"), F.col("w_kind").alias("k"))
    o = w.withColumn("_o", let(bound, lambda x: window_opposites(x["u"], x["k"], (k, k), F.lit(axis), k)))
    return o.select(
        *KEY, *[F.col(f"_o.{s}.{f}").alias(f"{s}_{f}") for s in ("down", "up") for f in ("di", "dj", "u")])


def nearest_interface(cells: DataFrame, shape: GridShape | DataFrame, axis: int) -> DataFrame:
    """Position of the nearest cut cell in the same column; equal distances go up."""
    pos, n = ("j", "nj") if axis == 0 else ("i", "ni")
    runs = column_runs(cells, shape, axis, F.col("kind") != REGULAR)
    up, down = F.col("next.pos") - F.col(pos), F.col(pos) - F.col("prev.pos")
    best = (F.when(up.isNull() & down.isNull(), F.lit(None))
            .when(down.isNull() | (up <= down), F.col("next.pos")).otherwise(F.col("prev.pos")))
    return runs.withColumn("near_pos", best).select(*KEY, F.when(
        F.abs(F.col("near_pos") - F.col(pos)) < F.col(n), F.col("near_pos")).cast("int").alias("near_pos"))


def side_values(opposites: DataFrame, fits: DataFrame, shape: GridShape | DataFrame, how: str = "eval_there",
                families=("constant", "poly")) -> DataFrame:
    """Values on both sides from the regular models of the opposite cells.

    eval_* evaluates at a cell centre, avg_* averages over a cell; *_here is the
    cut cell, *_there the opposite cell itself.  `opposites` has down_di, down_dj,
    up_di, up_dj; a side without an opposite cell has no value.
    """
    kind, place = how.split("_")
    o = with_shape(opposites, shape)
    model = fits.withColumns({c: F.lit(v) for c, v in (("axis", 0), ("value_up", 0.0), ("value_down", 0.0))
                              if c not in fits.columns})
    model = model.select("grid_id", F.col("i").alias("ti"), F.col("j").alias("tj"),
                         F.struct("axis", "family", "params", "value_up", "value_down").alias("m"))
    for s in ("down", "up"):
        di, dj = F.col(f"{s}_di"), F.col(f"{s}_dj")
        o = o.withColumns({"ti": map_index(F.col("i") + di, F.col("ni"), F.col("mode_i")),
                           "tj": map_index(F.col("j") + dj, F.col("nj"), F.col("mode_j"))})
        o = o.join(model, ["grid_id", "ti", "tj"], "left")
        x = -di.cast("double") if place == "here" else F.lit(0.0)
        y = -dj.cast("double") if place == "here" else F.lit(0.0)
        value = (model_eval(families, F.col("m"), x, y) if kind == "eval" else
                 model_integral(families, F.col("m"), x - 0.5, x + 0.5, y - 0.5, y + 0.5))
        o = o.withColumn(f"value_{s}", value).drop("m", "ti", "tj")
    return o.select(*KEY, "value_down", "value_up")
