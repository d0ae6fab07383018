"""Arrays of Arrow batches as matrices (NULL stands as NaN), and index arithmetic on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cellweave.schema import CYCLIC, EXTEND, REFLECT


def as_matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of arrays of `width` numbers each."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lists), width)


def as_lists(rows: np.ndarray) -> pa.Array:
    values = pa.array(np.ascontiguousarray(rows, float).ravel(), pa.float64(), from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), values)


def above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a > b as SQL orders numbers, NaN last."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def missing(lists: pa.Array, width: int) -> np.ndarray:
    """Where rows of arrays of `width` numbers hold NULL, which as_matrix shows as NaN."""
    return lists.flatten().is_null().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def as_known_lists(rows: np.ndarray, unknown: np.ndarray) -> pa.Array:
    """Rows as lists with NULL only where `unknown` says so; NaN stays."""
    values = pa.array(np.ascontiguousarray(rows, float).ravel(), pa.float64(), mask=np.ascontiguousarray(unknown).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), values)


def folded(p: np.ndarray, n: np.ndarray, mode: np.ndarray) -> np.ndarray:
    """Index of the cell that stands at unwrapped positions p of axes of length n."""
    period = np.maximum(2 * (n - 1), 1)
    turned = p % period
    out = np.where(mode == CYCLIC, p % n, np.minimum(turned, period - turned))
    out = np.where(mode == EXTEND, np.clip(p, 0, n - 1), out)
    return np.where((mode == REFLECT) & (n == 1), 0, out)
