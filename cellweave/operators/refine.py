"""Improving proposals by trying changed parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellweave.operators.scoring import score_rows

IDS = ["model_idx", "axis_rank", "cand"]


def refine_candidates(rows: DataFrame, key: list[str], families, size: tuple[int, int], rounds: int = 5,
                      step: float = 0.1, k: int = 3, p: float = 2.0, center_weight: float = 0.0) -> DataFrame:
    """Pattern search on every proposal at once: a fixed number of rounds.

    Each round scores the proposal and its neighbours at +-step in every parameter,
    keeps the best and halves the step, so the loss never grows.  All rounds stay in
    the partitions of the proposal rows.  `rows` carry w_u and PROPOSAL columns.
    """
    keep = key + ["w_u"]
    current = rows.filter(F.col("family") != "constant").select(
        *keep, *IDS, "axis", "family", "params", "value_up", "value_down")
    for r in range(rounds):
        h = step / 2 ** r
        moves = F.flatten(F.transform(F.sequence(F.lit(0), F.size("params") - 1), lambda n: F.array(*[
            F.transform("params", _shift(n, s * h)) for s in (1.0, -1.0)])))
        tried = current.withColumn("_v", F.explode(F.concat(F.array("params"), moves))).withColumn("params", F.col("_v")).drop("_v")
        scored = score_rows(tried, keep, families, size, k, p, center_weight)
        row = F.struct("loss", "params", "axis", "family", "value_up", "value_down")
        current = scored.filter(F.col("loss").isNotNull()).groupBy(*keep, *IDS).agg(F.min(row).alias("b")).select(
            *keep, *IDS, "b.axis", "b.family", "b.params", "b.value_up", "b.value_down", "b.loss")
    return current.drop("w_u")


def _shift(n, amount):
    return lambda v, m: F.when(m == n, v + amount).otherwise(v)
