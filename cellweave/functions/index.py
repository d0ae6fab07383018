"""Index arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cellweave.schema import CYCLIC, EXTEND, check_mode


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` (a local binding)."""
    return F.transform(F.array(value), body)[0]


def map_index(i: Column, n: Column, mode: Column | str) -> Column:
    """Index of the cell that stands at position `i` of an axis of length `n`.

    cyclic wraps, extend clamps, reflect mirrors without repeating the edge.
    """
    period = F.greatest(F.lit(2) * (n - 1), F.lit(1))
    folded = F.pmod(i, period)
    cyclic = F.pmod(i, n)
    clamped = F.greatest(F.lit(0), F.least(i, n - 1))
    mirrored = F.least(folded, period - folded)
    if isinstance(mode, str):
        check_mode(mode)
        chosen = {CYCLIC: cyclic, EXTEND: clamped}.get(mode, mirrored)
    else:
        chosen = (F.when(mode == CYCLIC, cyclic).when(mode == EXTEND, clamped)
                  .otherwise(F.when(n == 1, F.lit(0)).otherwise(mirrored)))
    return chosen.cast("int")


def images(i: Column, n: Column, mode: Column, r: int) -> Column:
    """All positions in [-r, n+r) at which cell `i` is seen; needs r < n.

    With r < n at most one copy lies on each side, so three candidates suffice.
    """
    below = (F.when(mode == CYCLIC, F.array(i - n))
             .when(mode == EXTEND, F.when(i == 0, F.sequence(F.lit(-r), F.lit(-1))))
             .otherwise(F.when(i > 0, F.array(-i))))
    above = (F.when(mode == CYCLIC, F.array(i + n))
             .when(mode == EXTEND, F.when(i == n - 1, F.sequence(n, n + (r - 1))))
             .otherwise(F.when(i < n - 1, F.array(2 * (n - 1) - i))))
    if r == 0:
        return F.array(i)
    none = F.array().cast("array<int>")
    both = F.concat(F.coalesce(below, none), F.array(i), F.coalesce(above, none))
    return F.filter(both, lambda e: (e >= -r) & (e < n + r))


def fdiv(a: Column, b: int) -> Column:
    """Floor division by a positive constant."""
    return F.floor(a / F.lit(b)).cast("int")


def offsets(k: int) -> list[int]:
    """Offsets of a window of k cells; even sizes reach further to the left."""
    return [p - k // 2 for p in range(k)]


def sub_window(w: Column, size: tuple[int, int], inner: tuple[int, int],
               transposed: bool = False) -> Column:
    """Cut a smaller window with the same centre out of a row-major window."""
    if size == inner and not transposed:
        return w
    ki, kj = size
    rows = [ki // 2 + d for d in offsets(inner[0])]
    cols = [kj // 2 + d for d in offsets(inner[1])]
    if transposed:
        return F.array(*[w[a * kj + b] for b in cols for a in rows])
    return F.array(*[w[a * kj + b] for a in rows for b in cols])


def oriented(w: Column, size: tuple[int, int], kt: int, ks: int, axis: Column) -> Column:
    """Window turned so that rows run along the independent axis."""
    return F.when(axis == 0, sub_window(w, size, (kt, ks))).otherwise(
        sub_window(w, size, (ks, kt), transposed=True))


def total(cols) -> Column:
    out = None
    for c in cols:
        out = c if out is None else out + c
    return out


def weighted(w: Column, weights) -> Column:
    """Sum of literal weights times the entries of an array column or a list of numbers (zero weights are left out)."""
    terms = [w[p] * float(x) for p, x in enumerate(weights) if x != 0]
    return total(terms) if terms else F.lit(0.0) if isinstance(w, Column) else 0.0
