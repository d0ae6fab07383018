"""Walks over cells in supersteps by tile.

A walk moves inside its tile as far as it can, in one Arrow batch with all other walks of the tile; only walks that
leave a tile change tasks.  The number of joins is therefore the number of tiles that the longest walk crosses, not
its number of steps, and a grid that fits a tile needs a single one.  A tile is a bounded group; from the second
superstep on, the walks that meet in a tile are also spread by where they come from.  Open and finished walks are
written once a superstep, so a lost executor costs one superstep, and plans do not grow with the walks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.batches import folded
from cellweave.functions.index import fdiv, map_index
from cellweave.operators.neighbours import RING_8
from cellweave.operators.windows import TILE, heavy_width, tiles
from cellweave.plans.lineage import cut_lineage
from cellweave.schema import CYCLIC, EXTEND, KEY, REFLECT, REGULAR, GridShape, with_shape

#: Groups that the walks of one tile are spread over once they have left their own tile.
SALTS = 16
#: Supersteps after which finished walks are folded into one table.
FOLD = 8
WALK = ("grid_id string, i int, j int, side int, ni int, nj int, mode_i string, mode_j string, k int, pi int, pj int, gi double, gj double, "
        "ref double, path array<int>")
MOVED = WALK + ", done boolean, hit_u double"

#: Moves the walks of one tile: state and tile arrays in, `done` and `hit_u` (NULL without a hit) out.
Step = Callable[["Walks", "Tile"], None]


class Tile:
    """Values of a tile and its rim of one cell, found by cell index."""

    def __init__(self, row: dict, names: list[str]):
        self.bi, self.bj, self.rows, self.cols = row["bi"], row["bj"], row["rows"], row["cols"]
        self.values = {n: np.array(row[n], float).reshape(self.rows + 2, self.cols + 2) for n in names}

    def core(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (i // TILE == self.bi) & (j // TILE == self.bj)

    def place(self, at: np.ndarray, n: np.ndarray, block: int, size: int) -> np.ndarray:
        """Row or column in the padded arrays; cells across a cyclic seam stand on the rim."""
        p = at - block * TILE + 1
        p = np.where(p < 0, p + n, p)
        return np.where(p > size + 1, p - n, p)

    def at(self, name: str, i: np.ndarray, j: np.ndarray, ni: np.ndarray, nj: np.ndarray) -> np.ndarray:
        return self.values[name][self.place(i, ni, self.bi, self.rows), self.place(j, nj, self.bj, self.cols)]


class Walks:
    """State of the walks of one tile as arrays."""

    def __init__(self, table: pa.Table):
        self.table, self.n = table, table.num_rows
        for name in ("i", "j", "side", "ni", "nj", "k", "pi", "pj"):
            setattr(self, name, table.column(name).to_numpy().astype(np.int64))
        for name in ("gi", "gj", "ref"):
            setattr(self, name, table.column(name).to_numpy().astype(float))
        self.mode_i, self.mode_j = (np.array(table.column(m).to_pylist(), object) for m in ("mode_i", "mode_j"))
        self.path = [list(p or ()) for p in table.column("path").to_pylist()]
        self.done, self.hit_u = np.zeros(self.n, bool), np.full(self.n, np.nan)

    def index(self, own: np.ndarray, pi: np.ndarray, pj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(own),) + (1,) * (pi.ndim - 1)
        axis = [(pi, self.ni, self.mode_i), (pj, self.nj, self.mode_j)]
        return tuple(folded(p, n[own].reshape(shape), m[own].reshape(shape)) for p, n, m in axis)

    def result(self) -> pa.Table:
        t = self.table
        new = {"k": pa.array(self.k, pa.int32()), "pi": pa.array(self.pi, pa.int32()), "pj": pa.array(self.pj, pa.int32()),
               "path": pa.array(self.path, pa.list_(pa.int32())), "done": pa.array(self.done),
               "hit_u": pa.array(self.hit_u, from_pandas=True)}
        names = [c.split()[0] for c in MOVED.split(", ")]
        return pa.table({n: new[n] if n in new else t.column(n) for n in names})


def _move(walks: pa.Table, tile: pa.Table, step: Step, values: tuple[str, ...]) -> pa.Table:
    state = Walks(walks)
    if state.n and tile.num_rows:
        step(state, Tile(tile.slice(0, 1).to_pylist()[0], list(values)))
    return state.result()


def supersteps(walks: DataFrame, cells: DataFrame, shape: GridShape | DataFrame, values: list[str], step: Step) -> DataFrame:
    """KEY, side, pi, pj, hit_u of every walk that ended at a hit; `walks` has the columns of WALK."""
    names = [c.split()[0] for c in WALK.split(", ")]
    ground = cut_lineage(tiles(cells, shape, 1, values).select("grid_id", "bi", "bj", "rows", "cols", *values))
    open_, found, rounds = walks.select(*names), None, 0
    keys = ["grid_id", "bi", "bj"]
    while True:
        placed = open_.withColumns({"bi": fdiv(map_index(F.col("pi"), F.col("ni"), F.col("mode_i")), TILE),
                                    "bj": fdiv(map_index(F.col("pj"), F.col("nj"), F.col("mode_j")), TILE)})
        base = ground
        if rounds:
            keys = ["grid_id", "bi", "bj", "salt"]
            placed = placed.withColumn("salt", F.pmod(F.hash(fdiv(F.col("i"), TILE), fdiv(F.col("j"), TILE)), F.lit(SALTS)))
            wanted = placed.select(*keys).distinct().withColumn("salt", F.col("salt") + 0)  # a column of its own
            base = ground.join(wanted, ["grid_id", "bi", "bj"])
        # walks are few bytes and many steps: Spark would put those of many tiles into one task
        width = heavy_width(placed)
        placed, base = placed.repartition(width, *keys), base.repartition(width, *keys)
        moved = placed.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInArrow(partial(_move, step=step, values=tuple(values)), MOVED)
        moved = cut_lineage(moved)
        hits = moved.filter("done AND hit_u IS NOT NULL").select(*KEY, "side", "pi", "pj", "hit_u")
        found = hits if found is None else found.unionByName(hits)
        open_, rounds = moved.filter("NOT done").select(*names), rounds + 1
        if rounds % FOLD == 0:
            found = cut_lineage(found)
        if open_.isEmpty():
            return found


def start(origins: DataFrame, k: int, pi: Column, pj: Column, gi: Column | float = 0.0, gj: Column | float = 0.0,
          ref: Column | float = 0.0, path: Column | None = None) -> DataFrame:
    """Two walks, side -1 and 1, for each origin (KEY and the columns of with_shape); expressions may use `side`."""
    def double(x):
        return (F.lit(x) if isinstance(x, float) else x).cast("double")
    both = origins.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    return both.select(*KEY, "side", "ni", "nj", "mode_i", "mode_j", F.lit(k).alias("k"), pi.cast("int").alias("pi"), pj.cast("int").alias("pj"),
                       double(gi).alias("gi"), double(gj).alias("gj"), double(ref).alias("ref"),
                       (F.array() if path is None else path).cast("array<int>").alias("path"))


def ray(accept: Callable[[Walks, np.ndarray, dict[str, np.ndarray]], np.ndarray], length: str) -> Step:
    """Cells at k = k0, k0 + 1, ... along (gi, gj) from the middle of the origin, fewer than `length` (ni or nj)."""
    def step(w: Walks, t: Tile) -> None:
        own = np.arange(w.n)
        while len(own):
            over = w.k[own] >= getattr(w, length)[own]
            w.done[own[over]] = True
            own = own[~over]
            if not len(own):
                return
            far = w.k[own] * w.side[own]
            w.pi[own] = np.floor(w.i[own] + 0.5 + far * w.gi[own])
            w.pj[own] = np.floor(w.j[own] + 0.5 + far * w.gj[own])
            i, j = w.index(own, w.pi[own], w.pj[own])
            here = t.core(i, j)
            own, i, j = own[here], i[here], j[here]
            seen = {n: t.at(n, i, j, w.ni[own], w.nj[own]) for n in t.values}
            hit = accept(w, own, seen)
            w.done[own[hit]] = True
            w.hit_u[own[hit]] = seen["u"][hit]
            own = own[~hit]
            w.k[own] += 1
    return step


def greedy(axis: int, max_steps: int | None = None) -> Step:
    """The largest (side 1) or smallest (side -1) unvisited 8-neighbour until a regular cell."""
    ring = np.array(RING_8)

    def step(w: Walks, t: Tile) -> None:
        own = np.arange(w.n)
        size = np.array([len(p) // 2 for p in w.path])
        seen = np.full((w.n, int(size.max()) + 16, 2), np.iinfo(np.int64).max)
        for r, p in enumerate(w.path):
            seen[r, :size[r]] = np.array(p).reshape(-1, 2)
        dep = w.j if axis == 0 else w.i
        while len(own):
            ci, cj = w.pi[own, None] + ring[:, 0], w.pj[own, None] + ring[:, 1]
            i, j = w.index(own, ci, cj)
            u = t.at("u", i, j, w.ni[own, None], w.nj[own, None])
            last = int(size[own].max())
            past = seen[own, None, :last]
            visited = ((past[..., 0] == ci[..., None]) & (past[..., 1] == cj[..., None])).any(axis=2)
            score = -w.side[own, None] * u - 1e-5 * np.abs((cj if axis == 0 else ci) - dep[own, None])
            score = np.where(visited | np.isnan(score), np.inf, score)
            best = score.argmin(axis=1)
            row = np.arange(len(own))
            stuck = np.isinf(score[row, best])
            w.done[own[stuck]] = True
            row, best, own = row[~stuck], best[~stuck], own[~stuck]
            w.pi[own], w.pj[own] = ci[row, best], cj[row, best]
            w.k[own] += 1
            if last + 1 >= seen.shape[1]:
                seen = np.concatenate([seen, np.full(seen.shape, np.iinfo(np.int64).max)], axis=1)
            seen[own, size[own]] = np.stack([w.pi[own], w.pj[own]], axis=1)
            size[own] += 1
            i, j = i[row, best], j[row, best]
            hit = t.at("kind", i, j, w.ni[own], w.nj[own]) == REGULAR
            w.done[own[hit]] = True
            w.hit_u[own[hit]] = u[row, best][hit]
            lost = ~hit & (w.k[own] >= max_steps) if max_steps is not None else np.zeros(len(own), bool)
            for r in np.flatnonzero(~hit & (w.k[own] % 8 == 0)):
                x = own[r]
                lost[r] |= endless(seen[x, :size[x]], (w.ni[x], w.nj[x]), (w.mode_i[x], w.mode_j[x]), axis)
            w.done[own[lost]] = True
            own = own[~hit & ~lost & t.core(i, j)]
        w.path = [[] if w.done[r] else seen[r, :size[r]].ravel().tolist() for r in range(w.n)]
    return step


def endless(seen, sizes: tuple, modes: tuple, axis: int) -> bool:
    """Whether a greedy walk (three starting cells, then its path) provably repeats itself for ever.

    Its end must be laps of equal length, each the one before moved by whole grids (or outside an edge that extends),
    and nothing before the laps may lie beside or ahead of the last one: then every later lap sees the same.
    """
    starts, path = [tuple(x) for x in seen[:3]], [tuple(x) for x in seen[3:]]
    for lap in range(1, (len(path) - 1) // 2 + 1):
        move = tuple(b - a for a, b in zip(path[-1 - lap], path[-1]))
        if move == (0, 0):
            continue
        first = len(path)
        while first > lap and tuple(b - a for a, b in zip(path[first - 1 - lap], path[first - 1])) == move:
            first -= 1
        if len(path) - first < lap + 1:  # the cells up to `first` do not follow from the lap before
            continue
        a = 1 - axis if move[1 - axis] else axis  # the dependent axis if it moves, whose distance is in the score
        sign, last = 1 if move[a] > 0 else -1, path[-1 - lap:]
        ahead = min(sign * x[a] for x in last) - 1
        if max(sign * x[a] for x in starts + path[:first]) >= ahead:
            continue
        outside = [min(x[k] for x in last) - 1 >= sizes[k] - 1 if move[k] > 0 else max(x[k] for x in last) + 1 <= 0 for k in (0, 1)]
        again = [{CYCLIC: n, REFLECT: max(2 * (n - 1), 1)}.get(mode) for n, mode in zip(sizes, modes)]  # the same cells come again
        if all(not move[k] or (move[k] % again[k] == 0 if again[k] else outside[k]) for k in (0, 1)):
            return True
    return False


def sides(found: DataFrame, origins: DataFrame, axis: int) -> DataFrame:
    """KEY, down_i, down_j, down_u, up_i, up_j, up_u for every origin, ordered along the dependent axis.

    Of two hits at one position the one of side -1 is below.  A single hit is below if it lies below its cell, or level
    with it on side -1, and above otherwise; the other side is NULL.
    """
    pos, own = ("pj", "j") if axis == 0 else ("pi", "i")
    hit = F.struct(F.col(pos).alias("pos"), F.col("side"), F.col("pi").alias("i"), F.col("pj").alias("j"), F.col("hit_u").alias("u"))
    g = found.groupBy(*KEY).agg(F.min(hit).alias("a"), F.max(hit).alias("b"), F.count(F.lit(1)).alias("n"))
    below = (F.col("a.pos") < F.col(own)) | ((F.col("a.pos") == F.col(own)) & (F.col("a.side") < 0))
    down = F.when((F.col("n") == 2) | below, F.col("a"))
    up = F.when((F.col("n") == 2) | ~below, F.col("b"))
    g = g.select(*KEY, *[s[f].alias(f"{n}_{f}") for n, s in (("down", down), ("up", up)) for f in ("i", "j", "u")])
    return origins.select(*KEY).join(g, KEY, "left")
