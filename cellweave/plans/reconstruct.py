"""Fitting whole tables of grids: label, orient, propose, score, select, resample.

A fit is one shuffle (the tiles).  Proposals and window members are rows that
carry the tile's key, so scoring and selection aggregate within the partitions
that the tiles already have.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cellweave.functions.area import FLAT
from cellweave.functions.batches import as_known_lists, as_matrix, missing
from cellweave.functions.index import let
from cellweave.operators import curves as C
from cellweave.operators.labels import axes_of, fixed_axes, gradient_axes, label_piecewise, window_gradient
from cellweave.operators.resample import packed_interface_only, resample_average, resample_interface_only
from cellweave.operators.scoring import FIELDS, line_losses, place_of_best, score_rows, select_best
from cellweave.operators.windows import batched_windows, tile_key, with_windows
from cellweave.schema import CUT, KEY, PROPOSAL, REGULAR, GridShape, proposal
from cellweave.plans.lineage import cut_lineage


@dataclass(frozen=True)
class Preset:
    """A named composition of models and decisions."""

    name: str
    models: tuple[C.CurveModel, ...] = ()
    angle: float = 45.0
    gradient: str = "sobel"
    axis: int | None = None
    levels: Callable = field(default=C.levels_sided)
    p: float = 2.0
    center_weight: float = 0.0
    eps: float = 0.0
    score_cut_only: bool = False

    @property
    def families(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(["constant", *[m.family for m in self.models]]))

    @property
    def window(self) -> int:
        reach = [2 if self.levels in (C.levels_window, C.levels_sided) else 1]
        reach += [max(m.kt // 2, m.ks // 2) for m in self.models]
        return 2 * max(reach) + 1


PRESETS = {p.name: p for p in [
    Preset("constant"),
    Preset("elvira", (C.lines_3slopes(),), angle=0.0),
    Preset("elvira_w", (C.lines_3slopes(),), angle=0.0, center_weight=C.CENTER_WEIGHT),
    Preset("aero_linear", (C.line_consistent(),), center_weight=C.CENTER_WEIGHT),
    Preset("aero_quadratic", (C.curve_averages(2),), angle=0.0, center_weight=C.CENTER_WEIGHT),
    Preset("aero_cubic", (C.curve_averages(3, ks=7),), angle=0.0, center_weight=C.CENTER_WEIGHT),
    Preset("aero_quartic", (C.curve_averages(4, ks=7),), angle=0.0, center_weight=C.CENTER_WEIGHT),
    Preset("elvira+aero_quadratic", (C.lines_3slopes(), C.curve_averages(2)), angle=0.0,
           center_weight=C.CENTER_WEIGHT),
    Preset("aero_linear+quadratic", (C.line_consistent(), C.curve_averages(2)), angle=0.0,
           center_weight=C.CENTER_WEIGHT),
    Preset("corner_4cols", (C.lines_3slopes(), C.curve_averages(2), C.corner_4cols()),
           center_weight=C.CENTER_WEIGHT),
    Preset("circle", (C.lines_3slopes(), C.circle_taylor()), angle=0.0, center_weight=C.CENTER_WEIGHT),
]}


PROPOSALS = T.ArrayType(PROPOSAL)
ROUTE_BITS = "aggregate(route, 0L, (bits, m) -> bits | shiftleft(1L, m))"


def _cut_windows(labelled: DataFrame, shape: GridShape | DataFrame, k: int, keep_tile: bool = True) -> DataFrame:
    """Cut cells with their k x k windows; a column `route` becomes a number, one bit a model."""
    routed = "route" in labelled.columns
    if routed:
        labelled = labelled.withColumn("_route", F.expr(ROUTE_BITS))
    return with_windows(labelled, shape, k, k, ["u", "kind", *["_route"] * routed], where=F.col("kind") == CUT, keep_tile=keep_tile)


def _routed(made: Column, n: int) -> Column:
    """The n-th model's proposals where the cell's route has that model."""
    return F.when(F.col("_route").bitwiseAND(F.lit(2 << n)) != 0, made).otherwise(F.array().cast(PROPOSALS))


def _usable(made: Column) -> Column:
    return F.filter(made, lambda c: c["params"].isNotNull() & c["value_up"].isNotNull() & c["value_down"].isNotNull())


def _axes_columns(w: DataFrame, size: tuple[int, int], preset: Preset, name: str) -> DataFrame:
    """The axes that a preset tries, as column `name`."""
    if preset.axis is not None:
        return w.withColumn(name, fixed_axes(preset.axis))
    gx, gy = window_gradient(F.col("w_u"), size, preset.gradient, 3)
    w = w.withColumns({"_gx": gx, "_gy": gy})
    return w.withColumn(name, gradient_axes(F.col("_gx"), F.col("_gy"), preset.angle)).drop("_gx", "_gy")


def _with_proposals(w: DataFrame, size: tuple[int, int], preset: Preset, axis: str, rank: Column,
                    done: dict) -> tuple[DataFrame, list[Column]]:
    """Each model's proposals for one axis, with levels and column sums evaluated in Arrow batches as columns of the table.

    `done` remembers those columns, which several presets share.
    """

    def once(what, column):
        nonlocal w
        if what not in done:
            done[what] = f"_x{len(done)}"
            w = w.withColumn(done[what], column())
        return done[what]

    def levels():
        if preset.levels is C.levels_sided:
            return C.batched_levels_sided(F.col("w_u"), F.col("w_kind"), size, F.col(axis))
        bound = F.struct(F.col("w_u").alias("u"), F.col("w_kind").alias("k"))
        both = let(bound, lambda x: preset.levels(x["u"], x["k"], size, F.col(axis)))
        return let(both, lambda v: F.array(v["down"], v["up"]))

    sides = once((axis, preset.levels), levels)
    down, up = F.col(sides)[0], F.col(sides)[1]
    sums = [once((axis, preset.levels, m.kt, m.ks), lambda m=m: C.batched_sums(
        F.col("w_u"), F.col("w_kind"), size, m.kt, m.ks, F.col(axis), up, down)) for m in preset.models]
    made = [C.proposals_of(m, n + 1, F.col(x), F.col(axis), rank, up, down) for n, (m, x) in enumerate(zip(preset.models, sums))]
    if "_route" in w.columns:
        made = [_routed(m, n) for n, m in enumerate(made)]
    return w, made


def proposal_arrays(labelled: DataFrame, shape: GridShape | DataFrame, preset: Preset) -> DataFrame:
    """One row per cut cell and axis that it tries: KEY, u, axis_rank, axis and `proposals`, the usable ones in an array.

    Levels and column sums are evaluated in Arrow batches, behind which Spark no longer knows how the tiles are
    partitioned; proposal_rows is for those who group afterwards.
    """
    k = preset.window
    size = (k, k)
    w = _axes_columns(_cut_windows(labelled, shape, k, keep_tile=False), size, preset, "_axes")
    # outer, though no cell is without axes: otherwise Spark looks for such cells first and copies the axes below the windows
    w = w.select(*KEY, "u", "w_u", "w_kind", *["_route"] * ("_route" in w.columns), F.posexplode_outer("_axes").alias("axis_rank", "axis"))
    w, made = _with_proposals(w, size, preset, "axis", F.col("axis_rank"), {})
    # a generator, so that later filters cannot copy this expression below themselves
    return w.select(*KEY, "u", "axis_rank", "axis", F.explode(F.array(_usable(F.concat(*made)))).alias("proposals"))


def _in_batches(presets: list[Preset]) -> bool:
    """Whether all proposals are lines whose parameters are plain sums, with side values from the window: these are fitted in Arrow batches."""
    return all(x.levels is C.levels_sided and all(m.family == "line" and m.coefs is not None for m in x.models) for x in presets)


WON = T.ArrayType(T.StructType([T.StructField("preset", T.IntegerType()), T.StructField("loss", T.DoubleType()), *PROPOSAL.fields]))


def _won(w: pa.Array, wk: pa.Array, u: pa.Array, route: pa.Array | None, presets: list[tuple[int, Preset]], size: tuple[int, int]) -> pa.Array:
    """Each cell's winner for each preset: proposals of lines, their losses and the choice for a batch of windows."""
    cells = size[0] * size[1]
    data, gone, kind = as_matrix(w, cells), missing(w, cells), as_matrix(wk, cells)
    n, regular = len(data), kind == REGULAR
    lo, hi, seen = C.known_range(data, gone, kind, size)
    aims, sides, sums = {}, {}, {}

    def aim(x: Preset):
        """(axis, NULL or not, tried or not) by rank."""
        at = (x.axis, x.gradient, x.angle)
        if at not in aims and x.axis is not None:
            aims[at] = [(np.full(n, x.axis), np.zeros(n, bool), np.ones(n, bool))]
        elif at not in aims:
            axis, unsure, both = axes_of(data, gone, size, x.gradient, x.angle)
            aims[at] = [(axis, unsure, np.ones(n, bool)), (1 - axis, unsure, both)]
        return at, aims[at]

    own = u.to_numpy(zero_copy_only=False).astype(float, copy=False)
    bits = None if route is None else route.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    made = []
    for _, x in presets:
        at, axes = aim(x)
        columns = []
        for place, model in enumerate(x.models):
            for rank, (axis, unsure, tried) in enumerate(axes):
                turns = (axis == 0) & ~unsure
                if (at, rank) not in sides:
                    near = [C.turned(a, size, 3, 3, turns) for a in (data, gone, kind)]
                    sides[at, rank] = (*near, *C.sides_of(lo, hi, *near[:2]))
                near, lost, kinds, down, up = sides[at, rank]
                if (at, rank, model.kt, model.ks) not in sums:
                    sums[at, rank, model.kt, model.ks] = C.sums_of(
                        *[C.turned(a, size, model.kt, model.ks, turns) for a in (data, gone, regular)], up, down)
                s, unknown = sums[at, rank, model.kt, model.ks]
                usable = seen & tried
                if bits is not None:
                    usable = usable & ((bits & (2 << place)) != 0)
                rows = np.flatnonzero(usable)
                with np.errstate(all="ignore"):
                    lines = model.coefs(list(s.T))
                # a parameter is NULL where a sum is that it is made of
                holes = model.coefs(list(np.where(unknown, np.nan, 0.0).T)) if unknown.any() else [(0.0, 0.0)] * len(lines)
                for cand, ((b, m), hole) in enumerate(zip(lines, holes)):
                    b, m = (np.broadcast_to(v, n).astype(float) for v in (b, m))
                    no_b, no_m = (np.broadcast_to(np.isnan(v), n) for v in hole)
                    loss = np.full(n, np.nan)
                    loss[rows] = line_losses(near[rows], lost[rows], kinds[rows], turns[rows], b[rows], m[rows],
                                             (no_m | (no_b & ~(np.abs(m) < FLAT)))[rows], up[rows], down[rows], x.p, x.center_weight, x.score_cut_only)
                    columns.append((loss, place + 1, rank, cand, axis, unsure, b, m, no_b, no_m, up, down))
        made.append((columns, place_of_best(np.stack([c[0] for c in columns], axis=1), x.eps)))

    shape = (n, len(presets))
    out = {f: np.zeros(shape, int) for f in ("model_idx", "axis_rank", "cand", "axis")}
    loss, up, down, no_axis, none = np.full(shape, np.inf), *[np.repeat(own[:, None], len(presets), 1) for _ in range(2)], np.zeros(shape, bool), np.zeros(shape, bool)
    params, holes = np.zeros((*shape, 2)), np.zeros((*shape, 2), bool)
    params[:, :, 0], fallback = own[:, None], np.ones(shape, bool)
    none[:] = holes[:, :, 0] = u.is_null().to_numpy(zero_copy_only=False)[:, None]
    for c, (columns, won) in enumerate(made):
        for place, (lost, model, rank, cand, axis, unsure, b, m, no_b, no_m, above_, below) in enumerate(columns):
            at = np.flatnonzero(won == place)
            for name, value in (("model_idx", model), ("axis_rank", rank), ("cand", cand), ("axis", axis[at])):
                out[name][at, c] = value
            loss[at, c], up[at, c], down[at, c], no_axis[at, c], none[at, c] = lost[at], above_[at], below[at], unsure[at], False
            params[at, c], holes[at, c], fallback[at, c] = np.stack([b[at], m[at]], 1), np.stack([no_b[at], no_m[at]], 1), False
    fallback = fallback.ravel()
    sizes = np.where(fallback, 1, 2)
    there = np.stack([np.ones(len(fallback), bool), ~fallback], axis=1)
    values = pa.array(params.reshape(-1, 2)[there], pa.float64(), mask=holes.reshape(-1, 2)[there])
    ints = {f: pa.array(x.ravel(), pa.int32(), mask=no_axis.ravel() if f == "axis" else None) for f, x in out.items()}
    fields = {"preset": pa.array(np.tile([c for c, _ in presets], n), pa.int32()), "loss": pa.array(loss.ravel(), pa.float64()), **ints,
              "family": pa.DictionaryArray.from_arrays(pa.array(fallback.astype(np.int8)), pa.array(["line", "constant"])).cast(pa.string()),
              "params": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values),
              **{f: pa.array(x.ravel(), pa.float64(), mask=none.ravel()) for f, x in (("value_up", up), ("value_down", down))}}
    fields = {f.name: fields[f.name] for f in WON.elementType.fields}
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(presets), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _cell_winners(labelled: DataFrame, shape: GridShape | DataFrame, presets: list[tuple[int, Preset]], k: int) -> DataFrame:
    """KEY, u, _preset, loss and FIELDS of every cut cell's winner, for presets of lines.

    Windows come from batches of tiles, and all presets are fitted to them in one batch function, so after the tiles' shuffle
    nothing is exploded, grouped or handed back and forth between a cell's steps.
    """
    routed = "route" in labelled.columns
    if routed:
        labelled = labelled.withColumn("_route", F.expr(ROUTE_BITS))
    w = batched_windows(labelled, shape, k, ["u", "kind"], F.col("kind") == CUT, ("u", *["_route"] * routed))

    if routed:
        @F.arrow_udf(WON)
        def won(w: pa.Array, wk: pa.Array, u: pa.Array, route: pa.Array) -> pa.Array:
            return _won(w, wk, u, route, presets, (k, k))
    else:
        @F.arrow_udf(WON)
        def won(w: pa.Array, wk: pa.Array, u: pa.Array) -> pa.Array:
            return _won(w, wk, u, None, presets, (k, k))

    w = w.select(*KEY, "u", F.explode(won("w_u", "w_kind", F.col("u").cast("double"), *["_route"] * routed)).alias("b"))
    return w.select(*KEY, "u", F.col("b.preset").alias("_preset"), "b.loss", *[F.col(f"b.{f}").alias(f) for f in FIELDS])


def proposal_rows(labelled: DataFrame, shape: GridShape | DataFrame, preset: Preset) -> tuple[DataFrame, list[str]]:
    """One row per proposal of every cut cell, next to the cell's windows.

    A column `route` (array of model numbers, 0 the constant, n the preset's n-th model) limits what a cell proposes: a
    model that is not in a cell's route is not evaluated there.  It travels through the tiles as a number, one bit a model.
    Returns the rows and their key: the tile's shuffle key plus the cell, by which
    later groupings need no further shuffle.
    """
    k = preset.window
    size = (k, k)
    routed = "route" in labelled.columns
    key = tile_key(shape) + ["i", "j"]
    w = _axes_columns(_cut_windows(labelled, shape, k), size, preset, "_axes")
    w = w.select(*key, "u", "w_u", "w_kind", *["_route"] * routed, F.posexplode("_axes").alias("_rank", "_axis"))
    bound = F.struct(F.col("w_u").alias("u"), F.col("w_kind").alias("k"))
    w = w.withColumn("_lv", let(bound, lambda x: preset.levels(x["u"], x["k"], size, F.col("_axis"))))
    models = [C.curve_proposals(m, n + 1, F.col("w_u"), F.col("w_kind"), size, F.col("_axis"), F.col("_rank"),
                                F.col("_lv")) for n, m in enumerate(preset.models)]
    if routed:
        models = [_routed(m, n) for n, m in enumerate(models)]
    usable = _usable(F.concat(*models))
    keep = proposal(0, F.col("_rank"), 0, F.lit(0), "constant", F.array("u"), F.col("u"), F.col("u"))
    rows = w.select(*key, "w_u", "w_kind", F.inline(F.concat(F.array(keep), usable)))
    return rows, key


def scored_proposals(labelled: DataFrame, shape: GridShape | DataFrame, preset: Preset) -> DataFrame:
    """All proposals of all cut cells with their losses, one row per proposal."""
    rows, key = proposal_rows(labelled, shape, preset)
    scored = score_rows(rows.filter(F.col("family") != "constant"), key, preset.families,
                        (preset.window, preset.window), 3, preset.p, preset.center_weight, preset.score_cut_only)
    return scored.select(*KEY, *FIELDS, "loss")


def _axes(w: Column, size: tuple[int, int], preset: Preset) -> Column:
    if preset.axis is not None:
        return fixed_axes(preset.axis)
    gx, gy = window_gradient(w, size, preset.gradient, 3)
    return let(F.struct(gx.alias("x"), gy.alias("y")), lambda g: gradient_axes(g["x"], g["y"], preset.angle))


def fit_sweep(labelled: DataFrame, shape: GridShape | DataFrame, presets: list[Preset]) -> DataFrame:
    """fit_cells for several presets in one plan: its columns and `preset`, the name.

    All presets read the same windows, so cells are shuffled once whatever the number of presets; the preset is a column
    that goes along with proposals, scores and winners.  The presets must agree in p, eps and score_cut_only.
    """
    plain, best = sweep_parts(labelled, shape, presets)
    return plain if best is None else plain.unionByName(best)


def sweep_parts(labelled: DataFrame, shape: GridShape | DataFrame, presets: list[Preset]) -> tuple[DataFrame, DataFrame | None]:
    """The fits that keep their averages without a choice, and the winners of the cut cells, if a preset has models."""
    if len({(x.p, x.eps, x.score_cut_only) for x in presets}) != 1:
        raise ValueError("presets of a sweep must agree in p, eps and score_cut_only")
    c = labelled.select(*KEY, "u", "kind")
    k = max(x.window for x in presets)
    size = (k, k)
    names = F.array(*[F.lit(x.name) for x in presets])
    plain = c.withColumn("_preset", F.explode(F.sequence(F.lit(0), F.lit(len(presets) - 1)))).filter(
        (F.col("kind") != CUT) | F.col("_preset").isin(*[n for n, x in enumerate(presets) if not x.models]))
    plain = plain.select(
        *KEY, "u", "kind", F.lit(0).alias("model_idx"), F.lit(0).alias("axis"), F.lit(0).alias("cand"), F.lit("constant").alias("family"),
        F.array("u").alias("params"), F.col("u").alias("value_up"), F.col("u").alias("value_down"), F.lit(None).cast("double").alias("loss"),
        F.get(names, F.col("_preset")).alias("preset"))
    active = [(n, x) for n, x in enumerate(presets) if x.models]
    if not active:
        return plain, None
    if _in_batches([x for _, x in active]):
        best = _cell_winners(c, shape, active, k)
        return plain, _winner_rows(best, "u", F.get(names, F.col("_preset")).alias("preset"))
    w = _cut_windows(c, shape, k)
    key = tile_key(shape) + ["i", "j", "_preset", "_own"]
    tried = F.concat(*[_tried(_axes(F.col("w_u"), size, x), n) for n, x in active])
    w = w.withColumn("_try", F.explode(tried)).select(
        *tile_key(shape), "i", "j", "u", F.col("u").alias("_own"), "w_u", "w_kind", F.col("_try.preset").alias("_preset"),
        F.col("_try.rank").alias("_rank"), F.col("_try.axis").alias("_axis"))
    levels, models = None, None
    for n, x in active:
        own = F.col("_preset") == n
        levels = F.when(own, _levels(x, size)) if levels is None else levels.when(own, _levels(x, size))
    w = w.withColumn("_lv", levels)
    for n, x in active:
        own = F.col("_preset") == n
        made = F.concat(*[C.curve_proposals(m, at + 1, F.col("w_u"), F.col("w_kind"), size, F.col("_axis"), F.col("_rank"), F.col("_lv"))
                          for at, m in enumerate(x.models)])
        models = F.when(own, made) if models is None else models.when(own, made)
    usable = _usable(models)
    keep = proposal(0, F.col("_rank"), 0, F.lit(0), "constant", F.array("u"), F.col("u"), F.col("u"))
    rows = w.select(*key, "w_u", "w_kind", F.inline(F.concat(F.array(keep), usable)))
    families = tuple(dict.fromkeys(f for _, x in active for f in x.families))
    weights = F.get(F.array(*[F.lit(float(x.center_weight)) for x in presets]), F.col("_preset"))
    scored = score_rows(rows, key, families, size, 3, presets[0].p, weights, presets[0].score_cut_only)
    best = select_best(scored, presets[0].eps, key)
    return plain, _winner_rows(best, "_own", F.get(names, F.col("_preset")).alias("preset"))


def _winner_rows(best: DataFrame, own: str, *more: Column) -> DataFrame:
    """Winners in the columns of fits."""
    return best.select(
        *KEY, F.col(own).alias("u"), F.lit(CUT).alias("kind"), "model_idx", "axis", "cand", "family", "params", "value_up", "value_down",
        F.when(F.col("family") != "constant", F.col("loss")).alias("loss"), *more)


def _tried(axes: Column, preset: int) -> Column:
    return F.transform(axes, lambda a, r: F.struct(F.lit(preset).alias("preset"), r.alias("rank"), a.alias("axis")))


def _levels(preset: Preset, size: tuple[int, int]) -> Column:
    bound = F.struct(F.col("w_u").alias("u"), F.col("w_kind").alias("k"))
    return let(bound, lambda b: preset.levels(b["u"], b["k"], size, F.col("_axis")))


def _packed(fine: DataFrame, f: int, by: list[str], value: str) -> DataFrame:
    """One row per coarse cell with its f x f values side by side; rows meet before the shuffle."""
    slot = F.pmod("i", F.lit(f)) * f + F.pmod("j", F.lit(f))
    coarse = [F.floor(F.col(n) / f).cast("int").alias(n) for n in ("i", "j")]
    c = fine.select("grid_id", *coarse, *by, slot.alias("_slot"), F.col(value).alias("_v"))
    c = c.groupBy(*KEY, *by).agg(*[F.max(F.when(F.col("_slot") == n, F.col("_v"))).alias(f"{value}{n}") for n in range(f * f)])
    return c.select(*KEY, *by, F.array(*[f"{value}{n}" for n in range(f * f)]).alias(value))


def run_sweep(cells: DataFrame, truth: DataFrame, shape: GridShape | DataFrame, presets: list[Preset], f: int,
              label=label_piecewise) -> DataFrame:
    """grid_id, preset, error_l1, error_linf: every preset on every grid against a truth f times finer, as one plan.

    Fits and truth meet as one row per coarse cell, and the regular cells, which all presets keep, only once.  The truth is a
    table of fine cells, or one row a coarse cell with `fine` as true_fine_grid packs them.
    """
    plain, best = sweep_parts(label(cells), shape, presets)
    families = tuple(dict.fromkeys(x for p in presets for x in p.families))

    def apart(fits: DataFrame) -> DataFrame:
        regular = (F.col("kind") != CUT) & (F.col("preset") != presets[0].name)
        return fits.filter(~regular).withColumn("preset", F.when(F.col("kind") == CUT, F.col("preset")))

    if best is not None and set(families) <= {"constant", "line"}:
        # a cell that stood there twice would be an error of the windows, so a row is a cell as it is
        fine = packed_interface_only(apart(plain), f, ("constant",), ("preset",)).unionByName(packed_interface_only(apart(best), f, families, ("preset",)))
        fine = fine.withColumnRenamed("fine", "v")
    else:
        fits = apart(plain if best is None else plain.unionByName(best)).withColumn("grid_id", F.to_json(F.struct("grid_id", "preset")))
        fine = resample_interface_only(fits, f, families)
        named = F.from_json("grid_id", "grid_id string, preset string")
        fine = fine.withColumn("_n", named).select(F.col("_n.grid_id").alias("grid_id"), "i", "j", F.col("_n.preset").alias("preset"), F.col("u").alias("v"))
        fine = _packed(fine, f, ["preset"], "v")
    by = KEY
    if "fine" in truth.columns:
        # cells are sorted by a hash, which compares as one number; a truth that was grouped by cell is left as it lies
        by, h = ["_h", *KEY], F.xxhash64(*KEY).alias("_h")
        truth, fine = truth.select(h, *KEY, F.col("fine").alias("u")), fine.select(h, *KEY, "preset", "v")
    else:
        truth = _packed(truth, f, [], "u")
    both = fine.join(truth.hint("merge"), by).select("grid_id", "preset", _gaps(f * f)("v", "u").alias("g"))
    both = both.select("grid_id", "preset", F.col("g")[0].cast("long").alias("n"), F.col("g")[1].alias("s"), F.col("g")[2].alias("top"))
    sums = both.groupBy("grid_id", "preset").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("top").alias("top"))
    # what holds for all presets goes to each of them
    all_ = F.array(*[F.lit(x.name) for x in presets])
    sums = sums.withColumn("preset", F.explode(F.when(F.col("preset").isNull(), all_).otherwise(F.array("preset"))))
    return sums.groupBy("grid_id", "preset").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("error_l1"), F.max("top").alias("error_linf"))


def _gaps(parts: int):
    """Of two arrays of a cell's fine values, one entry standing for all: how many gaps are known, their sum and the largest."""
    def spread(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = x.offsets.to_numpy()[:-1, None] - x.offsets[0].as_py() + np.where(
            x.value_lengths().to_numpy(zero_copy_only=False)[:, None] == 1, 0, np.arange(parts))
        flat = x.flatten()
        return flat.to_numpy(zero_copy_only=False).astype(float, copy=False)[at], flat.is_null().to_numpy(zero_copy_only=False)[at]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def gaps(v: pa.Array, u: pa.Array) -> pa.Array:
        (v, no_v), (u, no_u) = spread(v), spread(u)
        known = ~(no_v | no_u)
        with np.errstate(all="ignore"):
            gap = np.abs(v - u)
            sums = np.zeros(len(gap))
            for n in range(parts):
                sums = sums + np.where(known[:, n], gap[:, n], 0.0)
            top = np.where(known, gap, -np.inf).max(axis=1, initial=-np.inf)
        n = known.sum(axis=1)
        out = np.stack([n, sums, top], axis=1)
        return as_known_lists(out, np.stack([n < 0, n < 0, n == 0], axis=1))

    return gaps


def fit_cells(labelled: DataFrame, shape: GridShape | DataFrame, preset: Preset) -> DataFrame:
    """Best model of every cell.

    Regular cells, and cut cells without any proposal, keep their average.  With a column `route` (see proposal_rows)
    only routed models compete in a cell.
    """
    c = labelled.select(*KEY, "u", "kind", *[n for n in ("route",) if n in labelled.columns])
    plain = (c if not preset.models else c.filter(F.col("kind") != CUT)).select(
        *KEY, "u", "kind", F.lit(0).alias("model_idx"), F.lit(0).alias("axis"), F.lit(0).alias("cand"),
        F.lit("constant").alias("family"), F.array("u").alias("params"), F.col("u").alias("value_up"),
        F.col("u").alias("value_down"), F.lit(None).cast("double").alias("loss"))
    if not preset.models:
        return plain
    k = preset.window
    if _in_batches([preset]):
        return plain.unionByName(_winner_rows(_cell_winners(c, shape, [(0, preset)], k), "u"))
    rows, key = proposal_rows(c, shape, preset)
    own = F.get("w_u", F.lit((k // 2) * k + k // 2))
    scored = score_rows(rows.withColumn("_own", own), key + ["_own"], preset.families, (k, k), 3, preset.p,
                        preset.center_weight, preset.score_cut_only)
    best = select_best(scored, preset.eps, key + ["_own"])
    return plain.unionByName(_winner_rows(best, "_own"))


def reconstruct(cells: DataFrame, shape: GridShape | DataFrame, preset: Preset, refinement: int = 1,
                label=label_piecewise) -> tuple[DataFrame, GridShape | DataFrame]:
    """Fits after `refinement` passes of fit -> resample x2 -> fit.

    Lineage is cut between passes; with several passes the returned shape is the finer one.  A `grids` table lets grids
    of different sizes go through the same passes; it is refined along with them.
    """
    for step in range(refinement):
        fits = fit_cells(label(cells), shape, preset)
        if step < refinement - 1:
            cells = cut_lineage(resample_average(fits, 2, families=preset.families))
            shape = (replace(shape, ni=shape.ni * 2, nj=shape.nj * 2) if isinstance(shape, GridShape) else
                     shape.withColumns({n: (F.col(n) * 2).cast("int") for n in ("ni", "nj")}))
    return fits, shape
