"""Random numbers that depend only on row keys and a seed.

Unlike rand(), the result does not change with partitioning, retries or lost
executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def uniform(keys, seed: int, lo: float = 0.0, hi: float = 1.0) -> Column:
    h = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11)
    return F.lit(float(lo)) + h * F.lit(2.0 ** -53) * F.lit(float(hi) - float(lo))


def gaussian(keys, seed: int, sigma: float = 1.0) -> Column:
    u, v = uniform(keys, seed), uniform(keys, seed + 7919)
    return F.lit(float(sigma)) * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def choice(keys, seed: int, n: int) -> Column:
    """Integer in [0, n)."""
    return F.least(F.floor(uniform(keys, seed) * n), F.lit(n - 1)).cast("int")
