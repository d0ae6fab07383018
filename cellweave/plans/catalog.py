"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.plans import queries_data, queries_fit, queries_grid, queries_search  # noqa: F401
from cellweave.plans.fixtures import PATCH, labelled_patch
from cellweave.plans.reconstruct import PRESETS, fit_cells
from cellweave.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Label, orient, propose, score and select on all patches; winners and losses per family."""
    fits = fit_cells(labelled_patch(spark, d), PATCH, PRESETS["elvira+aero_quadratic"])
    return fits.groupBy("kind", "family", "axis").agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.avg("loss"), 6).alias("mean_loss"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
