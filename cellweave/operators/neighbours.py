"""Neighbour lists, shifted windows and region stencils."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.batches import folded
from cellweave.functions.index import fdiv, let, map_index, offsets
from cellweave.operators.windows import TILE, heavy_width, with_windows
from cellweave.schema import CYCLIC, KEY, GridShape, with_shape

# Rings around a cell, in visiting order.
RING_8 = [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 1), (1, -1), (-1, -1), (-1, 1)]
RING_16 = [(2, 0), (0, 2), (-2, 0), (0, -2),
           (2, 1), (2, -1), (1, 2), (-1, 2), (-2, 1), (-2, -1), (1, -2), (-1, -2),
           (2, 2), (2, -2), (-2, -2), (-2, 2)]


def offset_array(steps) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in steps])


def moved(o: Column) -> tuple[Column, Column]:
    return (map_index(F.col("i") + o["di"], F.col("ni"), F.col("mode_i")),
            map_index(F.col("j") + o["dj"], F.col("nj"), F.col("mode_j")))


def neighbours_sorted(cells: DataFrame, shape: GridShape | DataFrame, r: int = 1) -> DataFrame:
    """All cells within radius r (square) without the centre, near to far.

    A cell that is reached more than once (small or clamped grids) counts at its
    smallest distance.  Rows: KEY, rank, ti, tj, dist2.
    """
    steps = sorted([(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)],
                   key=lambda s: (s[0] ** 2 + s[1] ** 2, s))
    c = with_shape(cells.select(*KEY), shape)

    def target(o):
        ti, tj = moved(o)
        return F.struct(ti.alias("ti"), tj.alias("tj"))

    spots = F.transform(offset_array(steps), target)
    dist = F.array(*[F.lit(a * a + b * b) for a, b in steps])
    return (c.withColumn("_all", spots)
            .select(*KEY, "_all", F.posexplode(F.array_distinct("_all")).alias("rank", "t"))
            .filter(F.col("rank") > 0)
            .select(*KEY, "rank", "t.ti", "t.tj",
                    F.get(dist, (F.array_position("_all", F.col("t")) - 1).cast("int")).alias("dist2")))


def ring(cells: DataFrame, shape: GridShape | DataFrame, size: int = 8) -> DataFrame:
    """The fixed 8- or 16-neighbour ring in visiting order: KEY, rank, ti, tj."""
    steps = {8: RING_8, 16: RING_16}[size]
    c = with_shape(cells.select(*KEY), shape)
    c = c.select("*", F.posexplode(offset_array(steps)).alias("rank", "o"))
    ti, tj = moved(F.col("o"))
    return c.select(*KEY, "rank", ti.alias("ti"), tj.alias("tj"))


def gather(requests: DataFrame, cells: DataFrame, values: list[str], ti: str = "ti", tj: str = "tj") -> DataFrame:
    """Look up cells by (grid_id, ti, tj); the key is spread evenly over all cells.

    Cells made of packed rows are many times larger than Spark's estimate, which is that of the rows, so it must not
    broadcast them.
    """
    look = cells.select(F.col("grid_id"), F.col("i").alias(ti), F.col("j").alias(tj),
                        *[F.col(v).alias(f"t_{v}") for v in values])
    return requests.join(look.hint("merge"), ["grid_id", ti, tj])


def keep_stencil_cells(df: DataFrame, w: str = "w_u", labels: str = "w_kind", value: int = 1) -> DataFrame:
    """Keep only window members whose label has a given value."""
    kept = F.transform(F.filter(F.arrays_zip(F.col(w).alias("u"), F.col(labels).alias("k")),
                                lambda m: m["k"] == value), lambda m: m["u"])
    return df.withColumn(w, kept)


def smooth_shifted_stencil(cells: DataFrame, shape: GridShape | DataFrame, k: int = 3,
                           tradeoff: float = 0.5) -> DataFrame:
    """Move each window to the neighbour that is smoother without being far.

    Minimises tradeoff * dist / maxdist + si_neighbour / si_centre; stays where si
    is 0 or all members agree; ties go to the nearest.  `cells` carries si.  Wide
    windows hold both the search and the moved window, so one shuffle suffices.
    """
    h = k // 2
    big = 4 * h + 1
    c = with_windows(cells, shape, big, big, ["u", "si"])
    steps = [(a, b) for a in offsets(k) for b in offsets(k)]
    far = max((a * a + b * b) ** .5 for a, b in steps)
    spots = F.array(*[F.struct(
        F.lit((a * a + b * b) ** .5 / far).alias("d"), F.lit(n).alias("n"), F.lit(a).alias("di"),
        F.lit(b).alias("dj"), F.lit((a + 2 * h) * big + b + 2 * h).alias("at")) for n, (a, b) in enumerate(steps)])

    def choose(x):
        centre = F.get(x, F.lit(2 * h * big + 2 * h))
        near = F.transform(spots, lambda o: F.get(x, o["at"]))
        tol = 1e-8 + 1e-5 * F.abs(centre)
        same = F.forall(near, lambda v: F.abs(v - centre) <= tol)
        best = F.array_min(F.transform(spots, lambda o: F.struct(
            (tradeoff * o["d"] + F.get(x, o["at"]) / centre).alias("score"), o["d"].alias("d"), o["n"].alias("n"),
            o["di"].alias("di"), o["dj"].alias("dj"))))
        stay = F.struct(F.lit(0).alias("di"), F.lit(0).alias("dj"))
        return F.when((centre == 0) | same, stay).otherwise(let(best, lambda b: F.struct(b["di"], b["dj"])))

    c = c.withColumn("_s", let(F.col("w_si"), choose))

    def cut(w):
        return F.flatten(F.transform(F.sequence(F.lit(-h), F.lit(k - 1 - h)), lambda a: F.slice(
            w, (a + F.col("_s.di") + 2 * h) * big + F.col("_s.dj") + (h + 1), k)))

    return c.select(*KEY, "u", "si", F.col("_s.di").alias("di"), F.col("_s.dj").alias("dj"),
                    cut(F.col("w_u")).alias("w_u"))


#: Tiles that grow their regions together.
REGION_TILES = 64
MEMBERS = "array<struct<i:int,j:int,u:double>>"


def _grown(part: pa.RecordBatch, m: int) -> pa.RecordBatch:
    """Regions of the own cells of some tiles (columns of _region_tiles), all in the same rounds."""
    packed = part.column("cells")
    flat = packed.flatten()
    tile = np.repeat(np.arange(part.num_rows), np.diff(packed.offsets.to_numpy()))
    i, j = (flat.field(n).to_numpy().astype(np.int64) for n in ("i", "j"))
    label = np.asarray(flat.field("label").dictionary_encode().indices.fill_null(-1)).astype(np.int64)
    u = flat.field("u")
    ni, nj = (part.column(n).to_numpy().astype(np.int64) for n in ("ni", "nj"))
    mi, mj = (np.array(part.column(n).to_pylist(), str) for n in ("mode_i", "mode_j"))
    rows_, cols = max(ni.max(), i.max() + 1), max(nj.max(), j.max() + 1)

    def code(t: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return ((t * rows_ + a) * cols + b) * (label.max() + 1) + kind

    # what a step can meet: labelled cells; of cells that stand there twice the one of smallest u, NULL first
    real = np.flatnonzero((label >= 0) & (i >= 0) & (i < ni[tile]) & (j >= 0) & (j < nj[tile]))
    where = code(tile[real], i[real], j[real], label[real])
    known, values = np.asarray(u.is_valid())[real], u.to_numpy(zero_copy_only=False).astype(float)[real]
    order = np.lexsort((values, known, where))
    where, first = np.unique(where[order], return_index=True)
    there = real[order][first]

    own = np.flatnonzero(flat.field("own").to_numpy(zero_copy_only=False).astype(bool))
    seen, member = np.full((len(own), m), -1, np.int64), np.zeros((len(own), m), np.int64)
    seen[:, 0], member[:, 0], count = i[own] * cols + j[own], own, np.ones(len(own), np.int64)
    o = np.flatnonzero((label[own] >= 0) & (m > 1))
    fi, fj, fa, fb = i[own[o]], j[own[o]], np.zeros(len(o), np.int64), np.zeros(len(o), np.int64)
    di, dj = np.array(RING_8).T
    while len(o) and len(where):
        o, a, b = np.repeat(o, 8), np.repeat(fa, 8) + np.tile(di, len(o)), np.repeat(fb, 8) + np.tile(dj, len(o))
        t = tile[own[o]]
        ti = folded(np.repeat(fi, 8) + np.tile(di, len(fi)), ni[t], mi[t])
        tj = folded(np.repeat(fj, 8) + np.tile(dj, len(fj)), nj[t], mj[t])
        wanted = code(t, ti, tj, label[own[o]])
        place = np.minimum(np.searchsorted(where, wanted), len(where) - 1)
        spot = ti * cols + tj
        fresh = np.flatnonzero((where[place] == wanted) & ~(seen[o] == spot[:, None]).any(axis=1))
        fresh = fresh[np.lexsort((b[fresh], a[fresh], tj[fresh], ti[fresh], a[fresh] ** 2 + b[fresh] ** 2, o[fresh]))]
        # across the edges of small grids a cell is reached more than once; the nearest way counts
        nearest = np.sort(np.unique(o[fresh] * (rows_ * cols) + spot[fresh], return_index=True)[1])
        fresh = fresh[nearest]
        o, fi, fj, fa, fb = o[fresh], ti[fresh], tj[fresh], a[fresh], b[fresh]
        begun, first, n = np.unique(o, return_index=True, return_counts=True)
        at = count[o] + np.arange(len(o)) - np.repeat(first, n)
        fits = at < m
        seen[o[fits], at[fits]], member[o[fits], at[fits]] = spot[fresh][fits], there[place[fresh]][fits]
        count[begun] = np.minimum(count[begun] + n, m)
        on = count[o] < m
        o, fi, fj, fa, fb = (x[on] for x in (o, fi, fj, fa, fb))
    chosen = pa.array(member[np.arange(m) < count[:, None]])
    ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
    members = pa.StructArray.from_arrays([flat.field(n).take(chosen) for n in ("i", "j", "u")], ["i", "j", "u"])
    return pa.RecordBatch.from_arrays([part.column("grid_id").take(pa.array(tile[own])), *[flat.field(n).take(pa.array(own)) for n in ("i", "j")],
                                       pa.ListArray.from_arrays(ends, members)], [*KEY, "members"])


def _region_batches(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, REGION_TILES):
            yield _grown(batch.slice(first, REGION_TILES), m)


def _region_tiles(cells: DataFrame, reach: int) -> DataFrame:
    """One row per tile: its own cells and all cells that `reach` steps from them can meet; sparse grids are fine."""
    tile = max(TILE, reach)
    for pos, n, mode in (("i", "ni", "mode_i"), ("j", "nj", "mode_j")):
        last = fdiv(F.col(n) - 1, tile)
        home = fdiv(map_index(F.col(pos), F.col(n), F.col(mode)), tile)
        spots = F.when(F.col(mode) == CYCLIC, F.array(F.col(pos) - F.col(n), pos, F.col(pos) + F.col(n))).otherwise(F.array(pos))
        near = F.flatten(F.transform(spots, lambda x: F.filter(
            F.array(*[fdiv(x - reach, tile) + k for k in range(3)]), lambda b: b <= fdiv(x + reach, tile))))
        inside = F.filter(near, lambda b: (b >= 0) & (b <= last))
        cells = cells.withColumn(f"_h{pos}", home).withColumn(f"b{pos}", F.explode(F.array_distinct(F.concat(inside, F.array(f"_h{pos}")))))
    own = F.col("own") & (F.col("_hi") == F.col("bi")) & (F.col("_hj") == F.col("bj"))
    key, edges = ["grid_id", "bi", "bj"], ["ni", "nj", "mode_i", "mode_j"]
    packed = F.struct("i", "j", "u", "label", own.alias("own"))
    return cells.repartition(heavy_width(cells), *key).groupBy(*key).agg(
        *[F.first(x).alias(x) for x in edges], F.collect_list(packed).alias("cells")).select("grid_id", *edges, "cells")


def same_region_stencil(cells: DataFrame, shape: GridShape | DataFrame, m: int = 9,
                        origins: DataFrame | None = None, label: str = "kind") -> DataFrame:
    """Breadth-first growth over 8-neighbours of the same label until m cells.

    Rows: KEY and members array<struct(i, j, u)> in visiting order (round, then
    distance to the origin, then i, j).  A region of m cells ends within m - 1 steps of its origin, so that tiles with
    a rim of that width hold all it needs: the cells are shuffled once, and the rounds run inside the tiles.
    """
    c = with_shape(cells.select(*KEY, F.col("u").cast("double").alias("u"), F.col(label).alias("label")), shape)
    if origins is None:
        c = c.withColumn("own", F.lit(True))
    else:
        c = c.join(origins.select(*KEY, F.lit(True).alias("own")).distinct(), KEY, "left").withColumn("own", F.coalesce("own", F.lit(False)))
    placed = F.col("grid_id").isNotNull() & F.col("i").isNotNull() & F.col("j").isNotNull()
    grown = _region_tiles(c.filter(placed), max(m - 1, 0)).mapInArrow(
        partial(_region_batches, m=m), cells.select(*KEY).schema.simpleString()[7:-1].replace(":", " ") + f", members {MEMBERS}")
    # a cell without a place has no neighbours
    alone = c.filter(~placed & F.col("own")).select(*KEY, F.array(F.struct("i", "j", "u")).cast(MEMBERS).alias("members"))
    return grown.unionByName(alone)
