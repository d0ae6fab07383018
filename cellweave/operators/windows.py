"""Neighbourhoods of cells.

Cells are packed into tiles of `tile` x `tile` cells plus a rim of r copied
cells, with one shuffle on (grid_id, tile row, tile column).  A tile is a bounded
group, so a single huge grid spreads over many tasks.  Within a tile every
window of radius r is a local array slice: any number of stencil operators run
on the same tiles without another shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.batches import as_known_lists, folded
from cellweave.functions.index import fdiv, images, let, map_index, offsets
from cellweave.schema import CYCLIC, EXTEND, KEY, MODES, REFLECT, GridShape, require, with_shape

TILE = 32
#: Tasks of a heavy stage for each shuffle partition of the session.
HEAVY = 4
#: Cells, rims included, whose windows are made together in batches.
CELLS_AT_ONCE = 1 << 16


def heavy_width(df: DataFrame) -> int:
    """Number of tasks for stages that take far more time and memory for a byte than others do."""
    return HEAVY * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tile_key(shape: GridShape | DataFrame, tile: int = TILE) -> list[str]:
    """Columns that the tile shuffle partitions by."""
    if not isinstance(shape, GridShape):
        return ["grid_id", "bi", "bj"]
    return ["grid_id"] + ["bi"] * (shape.ni > tile) + ["bj"] * (shape.nj > tile)


def _in_tiles(cells: DataFrame, shape: GridShape | DataFrame, radius: int, values: list[str], tile: int) -> tuple[DataFrame, tuple[bool, bool]]:
    """Cells at their places ei, ej in each tile bi, bj that has them as core or rim, and along which axes tiles can be many."""
    require(cells, "grid_id", "i", "j", *values)
    if tile <= radius:
        raise ValueError("tile must be larger than the radius")
    r = radius
    c = with_shape(cells.select("grid_id", "i", "j", *values), shape)
    spill_i, spill_j = F.col("ni") > tile, F.col("nj") > tile
    if isinstance(shape, GridShape):
        many = (shape.ni > tile, shape.nj > tile)
    else:
        many = (True, True)

    for axis, (pos, n, mode, spill) in enumerate(
            [("i", "ni", "mode_i", spill_i), ("j", "nj", "mode_j", spill_j)]):
        e, b = f"e{pos}", f"b{pos}"
        if not many[axis]:
            c = c.withColumns({e: F.col(pos), b: F.lit(0)})
            continue
        last = fdiv(F.col(n) - 1, tile)
        spots = F.when(spill, images(F.col(pos), F.col(n), F.col(mode), r)).otherwise(
            F.array(F.col(pos)))
        c = c.withColumn(e, F.explode(spots))
        c = c.withColumn(b, F.explode(F.when(spill, F.sequence(
            F.greatest(F.lit(0), fdiv(F.col(e) - r, tile)),
            F.least(last, fdiv(F.col(e) + r, tile)))).otherwise(F.array(F.lit(0)))))
    return c, many


def tiles(cells: DataFrame, shape: GridShape | DataFrame, radius: int,
          values: list[str], tile: int = TILE) -> DataFrame:
    """Pack cells into tiles: one row per tile with padded row-major arrays.

    Columns: grid_id, bi, bj, ni, nj, rows, cols (core size) and one array per
    value column of size (rows + 2r) x (cols + 2r).  A grid has to be dense; a
    missing or doubled cell raises an error instead of shifting values.
    """
    r = radius
    c, many = _in_tiles(cells, shape, r, values, tile)
    spill_i, spill_j = F.col("ni") > tile, F.col("nj") > tile

    # sort key first: positions inside the tile; (row, column) order after sort_array
    packed = F.struct(F.col("ei"), F.col("ej"), *[F.col(v) for v in values])
    same = isinstance(shape, GridShape)
    names = ("ni", "nj", "mode_i", "mode_j")
    # a tile coordinate that cannot vary is no grouping key, so that later groupings
    # by (grid_id[, bi, bj], ...) are already satisfied by this shuffle
    # The stages after this shuffle are heavy per byte, so their number of tasks is set
    # here and not by the small size of the shuffled data.
    width = heavy_width(c)
    c = c.select("grid_id", "bi", "bj", "ei", "ej", *values, *([] if same else names))
    t = c.repartition(width, *tile_key(shape, tile)).groupBy(*tile_key(shape, tile)).agg(
        F.collect_list(packed).alias("_m"),
        *([] if same else [F.first(x).alias(x) for x in names]))
    if same:
        t = with_shape(t, shape).withColumns({
            b: F.lit(0) for b, m in zip(("bi", "bj"), many) if not m})

    ni, nj = F.col("ni"), F.col("nj")
    rows = F.least(F.lit(tile), ni - F.col("bi") * tile)
    cols = F.least(F.lit(tile), nj - F.col("bj") * tile)
    have_w = F.when(spill_j, cols + 2 * r).otherwise(cols)
    have = F.when(spill_i, rows + 2 * r).otherwise(rows) * have_w
    checked = F.when(F.size("_m") == have, F.sort_array("_m")).otherwise(F.raise_error(
        F.concat(F.lit("grid is not dense, densify it first: "), F.col("grid_id"))))

    def pads(m):
        if r == 0:
            return F.struct(*[m[v].alias(v) for v in values])
        # source row / column of every padded row / column, bound once per tile
        ri = F.transform(F.sequence(F.lit(0), rows + (2 * r - 1)), lambda a: F.when(
            spill_i, a).otherwise(map_index(a - r, ni, F.col("mode_i"))) * have_w)
        rj = F.transform(F.sequence(F.lit(0), cols + (2 * r - 1)), lambda b: F.when(
            spill_j, b).otherwise(map_index(b - r, nj, F.col("mode_j"))))

        def pad(x):
            return let(rj, lambda js: F.flatten(F.transform(ri, lambda a: F.transform(
                js, lambda b: F.get(x, a + b)))))

        return F.struct(*[let(m[v], pad).alias(v) for v in values])

    # a generator, so that later filters cannot copy this expression below themselves
    t = t.withColumn("_t", F.explode(F.transform(F.array(checked), pads)))
    return t.select("grid_id", "bi", "bj", "ni", "nj", rows.alias("rows"), cols.alias("cols"),
                    *[F.col("_t")[v].alias(v) for v in values])


def with_windows(cells: DataFrame, shape: GridShape | DataFrame, ki: int, kj: int,
                 values: list[str] | None = None, where: Column | None = None,
                 tile: int = TILE, keep_tile: bool = False) -> DataFrame:
    """Every cell with its ki x kj neighbourhood as arrays `w_<value>` (row-major).

    `where` is a condition on the value columns; cells that fail it are dropped
    before their windows are built (they still serve as neighbours).  With
    `keep_tile` the tile coordinates bi, bj stay in the result.
    """
    values = values or ["u"]
    oi, oj = offsets(ki), offsets(kj)
    r = max(-oi[0], oi[-1], -oj[0], oj[-1])
    t = tiles(cells, shape, r, values, tile)
    width = F.col("cols") + 2 * r
    t = t.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1)))
    t = t.withColumns({"_a": F.floor(F.col("_p") / F.col("cols")).cast("int"),
                       "_b": F.pmod("_p", "cols")})
    at = (F.col("_a") + r) * width + F.col("_b") + r

    def window(v):
        parts = [F.slice(F.col(v), at + (d * width + (oj[0] + 1)), F.lit(kj)) for d in oi]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    out = t.select(
        *(["bi", "bj"] if keep_tile else []), "grid_id", (F.col("bi") * tile + F.col("_a")).cast("int").alias("i"),
        (F.col("bj") * tile + F.col("_b")).cast("int").alias("j"), "ni", "nj",
        *[F.get(F.col(v), at).alias(v) for v in values],
        *[window(v).alias(f"w_{v}") for v in values])
    return out.filter(where) if where is not None else out


def batched_windows(cells: DataFrame, shape: GridShape | DataFrame, k: int, values: list[str], where: Column | None = None,
                    carry: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """KEY, `carry` and the k x k neighbourhoods `w_<value>` (doubles) of the cells that meet `where`, as with_windows makes them.

    Cells go through the same shuffle, are sorted by tile and place, and are cut into windows in Arrow batches of whole
    tiles, so nothing is packed into arrays and taken out again row by row.  Spark no longer knows the tiles' partitioning
    behind it; with_windows is for those who group by tile afterwards.
    """
    wanted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    columns = list(dict.fromkeys([*values, *carry]))
    c = cells.select(*KEY, *columns, wanted.alias("_own"))
    c, _ = _in_tiles(c, shape, k // 2, [*columns, "_own"], tile)
    same = isinstance(shape, GridShape)
    sizes = [] if same else ["ni", "nj", *[F.when(F.col(m) == CYCLIC, MODES.index(CYCLIC)).when(F.col(m) == EXTEND, MODES.index(EXTEND))
                                           .otherwise(MODES.index(REFLECT)).alias(m) for m in ("mode_i", "mode_j")]]
    key = tile_key(shape, tile)
    c = c.select("grid_id", "bi", "bj", "ei", "ej", *columns, "_own", *sizes).repartition(heavy_width(c), *key)
    c = c.sortWithinPartitions(*key, "ei", "ej", *columns).drop("ei", "ej")
    types = {f.name: f.dataType.simpleString() for f in c.schema}
    out = [f"grid_id {types['grid_id']}, i int, j int", *[f"{n} {types[n]}" for n in carry], *[f"w_{v} array<double>" for v in values]]
    return c.mapInArrow(partial(_window_batches, shape=shape if same else None, k=k, values=values, carry=carry, tile=tile), ", ".join(out))


def _tile_starts(cells: pa.Table) -> np.ndarray:
    """First row of each tile of sorted cells."""
    new = np.zeros(cells.num_rows, bool)
    new[:1] = True
    for name in ("grid_id", "bi", "bj"):
        x = cells.column(name)
        a, b = x.slice(0, len(x) - 1), x.slice(1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy()
        new[1:] |= differs | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy())
    return np.flatnonzero(new)


def _window_batches(batches: Iterator[pa.RecordBatch], **how) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CELLS_AT_ONCE:
            cells = pa.Table.from_batches(held).combine_chunks()
            starts = _tile_starts(cells)
            # the last tile may go on in the next batch
            yield from _tile_windows(cells.slice(0, starts[-1]), starts[:-1], **how)
            rest = cells.slice(starts[-1])
            held, n = rest.to_batches(), rest.num_rows
    if n:
        cells = pa.Table.from_batches(held).combine_chunks()
        yield from _tile_windows(cells, _tile_starts(cells), **how)


def _tile_windows(cells: pa.Table, starts: np.ndarray, shape: GridShape | None, k: int, values: list[str], carry: tuple[str, ...],
                  tile: int) -> Iterator[pa.RecordBatch]:
    """Windows of whole tiles; tiles of one form are cut together."""
    if not len(starts):
        return
    r, column = k // 2, {n: cells.column(n).combine_chunks() for n in cells.column_names}
    bi, bj = (column[n].to_numpy()[starts].astype(np.int64) for n in ("bi", "bj"))
    if shape is None:
        ni, nj, mi, mj = (column[n].to_numpy()[starts].astype(np.int64) for n in ("ni", "nj", "mode_i", "mode_j"))
    else:
        ni, nj, mi, mj = (np.full(len(starts), n) for n in (shape.ni, shape.nj, MODES.index(shape.mode_i), MODES.index(shape.mode_j)))
    rows, cols = np.minimum(tile, ni - bi * tile), np.minimum(tile, nj - bj * tile)
    high, wide = np.where(ni > tile, rows + 2 * r, rows), np.where(nj > tile, cols + 2 * r, cols)
    bad = np.flatnonzero(np.diff(np.append(starts, cells.num_rows)) != high * wide)
    if len(bad):
        raise ValueError(f"grid is not dense, densify it first: {column['grid_id'][starts[bad[0]]].as_py()}")
    own = column["_own"].to_numpy(zero_copy_only=False)
    gone = {v: column[v].is_null().to_numpy(zero_copy_only=False) for v in values}
    known = {v: column[v].to_numpy(zero_copy_only=False).astype(float, copy=False) for v in values}
    forms, form = np.unique(np.stack([rows, cols, ni, nj, mi, mj], axis=1), axis=0, return_inverse=True)
    for f, (n_rows, n_cols, n_i, n_j, m_i, m_j) in enumerate(forms.tolist()):
        mine = np.flatnonzero(form.ravel() == f)
        width = n_cols + 2 * r if n_j > tile else n_cols
        down, along = (np.arange(n + 2 * r) if size > tile else folded(np.arange(-r, n + r), size, MODES[m])
                       for n, size, m in ((n_rows, n_i, m_i), (n_cols, n_j, m_j)))
        place = down[:, None] * width + along[None, :]
        spots = np.lib.stride_tricks.sliding_window_view(place, (k, k)).reshape(n_rows * n_cols, k * k)
        t, p = np.nonzero(own[starts[mine][:, None] + spots[:, r * k + r][None, :]])
        if not len(t):
            continue
        first = starts[mine[t]]
        at = first[:, None] + spots[p]
        middle = pa.array(at[:, r * k + r])
        lead = [column["grid_id"].take(middle), pa.array((bi[mine[t]] * tile + p // n_cols).astype(np.int32)),
                pa.array((bj[mine[t]] * tile + p % n_cols).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(
            [*lead, *[column[n].take(middle) for n in carry], *[as_known_lists(known[v][at], gone[v][at]) for v in values]],
            [*KEY, *carry, *[f"w_{v}" for v in values]])


def convolve_scatter(cells: DataFrame, shape: GridShape | DataFrame,
                     kernels: dict[str, list[list[float]]], value: str = "u") -> DataFrame:
    """Linear kernels by scattering each cell to its targets and summing there.

    Unlike the tile form this accepts sparse grids (missing cells count as
    zero); partial sums are combined before the shuffle.  Edges must be cyclic,
    because only then is the map from source to target one to one.
    """
    k = len(next(iter(kernels.values())))
    steps = [(p, q, *[float(m[p][q]) for m in kernels.values()]) for p in range(k) for q in range(k)
             if any(m[p][q] for m in kernels.values())]
    names = list(kernels)
    rows = F.array(*[F.struct(F.lit(p - k // 2).alias("di"), F.lit(q - k // 2).alias("dj"),
                              *[F.lit(x).alias(f"k_{n}") for n, x in zip(names, xs)])
                     for p, q, *xs in steps])
    cyclic = (F.col("mode_i") == CYCLIC) & (F.col("mode_j") == CYCLIC)
    rows = F.when(cyclic, rows).otherwise(F.raise_error(F.lit("scattering needs cyclic edges")).cast(
        "array<struct<" + ",".join(["di:int", "dj:int", *[f"k_{n}:double" for n in names]]) + ">>"))
    c = with_shape(cells, shape).withColumn("_s", F.explode(rows))
    return (c.select("grid_id", F.pmod(F.col("i") - F.col("_s.di"), F.col("ni")).cast("int").alias("i"),
                     F.pmod(F.col("j") - F.col("_s.dj"), F.col("nj")).cast("int").alias("j"),
                     *[(F.col(value) * F.col(f"_s.k_{n}")).alias(n) for n in names])
            .groupBy("grid_id", "i", "j").agg(*[F.sum(n).alias(n) for n in names]))
