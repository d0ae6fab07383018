"""Errors, convergence rates, durations and parameter sweeps."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cellweave.plans.lineage import cut_lineage
from cellweave.schema import KEY
from cellweave.sources.binning import coarsen

ERRORS = ("error_l1", "error_linf")


def pair(a: DataFrame, b: DataFrame, value: str = "u") -> DataFrame:
    """Two grids side by side: KEY, a, b."""
    return (a.select(*KEY, F.col(value).alias("a"))
            .join(b.select(*KEY, F.col(value).alias("b")), KEY))


def norms(gap: Column, p: float | None = None) -> list[Column]:
    out = [F.avg(F.abs(gap)).alias("error_l1"), F.max(F.abs(gap)).alias("error_linf")]
    if p is not None:
        out.append(F.pow(F.avg(F.pow(F.abs(gap), p)), 1.0 / p).alias("error_lp"))
    return out


def error_norms(a: DataFrame, b: DataFrame, p: float | None = None, by=("grid_id",)) -> DataFrame:
    """L1 (mean), Linf (max) and optionally Lp distance per grid."""
    return pair(a, b).groupBy(*by).agg(*norms(F.col("a") - F.col("b"), p))


def error_downsampled(rebuilt: DataFrame, truth: DataFrame, f: int) -> DataFrame:
    """Compare with the truth averaged over f x f blocks."""
    return error_norms(rebuilt, coarsen(truth, f, f) if f > 1 else truth)


def error_masked(a: DataFrame, b: DataFrame, mask: DataFrame, keep: bool = True, rmse: bool = False) -> DataFrame:
    """Errors on (keep) or off the cells of a mask table."""
    side = pair(a, b).join(mask.select(*KEY), KEY, "left_semi" if keep else "left_anti")
    gap = F.col("a") - F.col("b")
    out = F.sqrt(F.avg(gap * gap)).alias("error_rmse") if rmse else F.avg(F.abs(gap)).alias("error_l1")
    return side.groupBy("grid_id").agg(out)


def error_per_interface_cell(fine: DataFrame, truth: DataFrame, coarse: DataFrame, f: int, n: int) -> DataFrame:
    """Mean fine error inside each cut cell, relative to n^2."""
    fine_gap = pair(fine, truth).select("grid_id", F.floor(F.col("i") / f).cast("int").alias("i"),
                                        F.floor(F.col("j") / f).cast("int").alias("j"),
                                        F.abs(F.col("a") - F.col("b")).alias("e"))
    per_cell = fine_gap.groupBy(*KEY).agg((F.avg("e") / (n * n)).alias("error"))
    return per_cell.join(coarse.filter((F.col("u") > 0) & (F.col("u") < 1)).select(*KEY), KEY, "left_semi")


def error_over_steps(a: DataFrame, b: DataFrame) -> DataFrame:
    """L1 per step of two histories with a step column."""
    key = ["step", *KEY]
    return (a.select(*key, F.col("u").alias("a")).join(b.select(*key, F.col("u").alias("b")), key)
            .groupBy("step").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("error_l1")))


def convergence_rate(results: DataFrame, min_n: float = 0, error: str = "error_l1", by=("model",)) -> DataFrame:
    """Slope and intercept of log(error) over log(n), for n above a threshold."""
    r = results.filter((F.col("n") > min_n) & (F.col(error) > 0))
    x, y = F.log(F.col("n")), F.log(F.col(error))
    return r.groupBy(*by).agg(F.regr_slope(y, x).alias("rate"), F.regr_intercept(y, x).alias("origin"))


#: Buckets of one round, and rows of a bucket that are sorted at once.
BUCKETS, SORTED = 1 << 20, 1 << 20


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], sorted_rows: int = SORTED) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: by, prob, quantile.

    The built-in exact percentile keeps all distinct values of a group in one task.
    Here values are counted in buckets first (partial sums), and the few buckets that
    hold the wanted ranks are found in a window of at most BUCKETS rows.  The first round has buckets of equal width on a
    logarithmic scale, so that an outlier does not push all others into one; a bucket with more than sorted_rows
    values is divided again between its own smallest and largest value, until all are small or hold one value.
    Only then are the values of those buckets sorted.
    """
    d = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    stats = d.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min(F.when(F.col("_v") != 0, F.abs("_v"))).alias("_unit"),
                               F.count(F.lit(1)).alias("_n"))
    at = (F.col("_n") - 1) * F.col("prob")
    ranks = stats.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    ranks = ranks.select(*by, "prob", at.alias("_h"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("_r"))

    def scaled(v: Column) -> Column:
        return F.signum(v) * F.log1p(F.abs(v) / F.coalesce("_unit", F.lit(1.0)))

    spots, scale = stats.select(*by, "_lo", "_hi", "_unit", F.lit(0).cast("long").alias("_before")), scaled
    while True:
        low, high = scale(F.col("_lo")), scale(F.col("_hi"))
        place = F.when(high == low, F.lit(0.0)).otherwise((scale(F.col("_v")) - low) / (high - low))
        inside = d.join(spots, by).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        bucket = F.greatest(F.lit(0), F.least(F.floor(place * BUCKETS), F.lit(BUCKETS - 1)))
        counts = inside.groupBy(*by, "_lo", "_before", bucket.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        line = Window.partitionBy(*by, "_lo").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_upto", F.col("_before") + F.coalesce(F.sum("_c").over(line), F.lit(0)))
        wanted = ranks.join(counts, by).filter((F.col("_r") >= F.col("_upto")) & (F.col("_r") < F.col("_upto") + F.col("_c")))
        spots = cut_lineage(wanted.select(*by, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.lit(None).cast("double").alias("_unit"),
                                          F.col("_upto").alias("_before"), "_c").distinct())
        largest = spots.filter("_lo < _hi").agg(F.max("_c")).first()[0]
        spots, scale = spots.drop("_c"), lambda v: v
        if (largest or 0) <= sorted_rows:
            break

    inner = Window.partitionBy(*by, "_lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    values = (d.join(spots, by).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
              .groupBy(*by, "_lo", "_before", "_v").agg(F.count(F.lit(1)).alias("_k")))
    values = values.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_k").over(inner), F.lit(0)))
    hit = ranks.join(values, by).filter((F.col("_r") >= F.col("_first")) & (F.col("_r") < F.col("_first") + F.col("_k")))
    low, high = F.min("_v"), F.max("_v")
    part = F.first("_h") - F.floor(F.first("_h"))
    return hit.groupBy(*by, "prob").agg((low + (high - low) * part).alias("quantile"))


def duration_stats(results: DataFrame, seconds: str = "seconds", by=("model",)) -> DataFrame:
    """Mean, population standard deviation and 5 / 50 / 95 % quantiles, skipping NaN."""
    by = list(by)
    s = F.when(~F.isnan(F.col(seconds).cast("double")), F.col(seconds).cast("double"))
    moments = results.groupBy(*by).agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"))
    names = {0.05: "q05", 0.5: "q50", 0.95: "q95"}
    q = exact_quantiles(results, by, seconds, list(names)).groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n) for p, n in names.items()])
    return moments.join(q, by, "left")


def per_step_cost(results: DataFrame, steps: int, seconds: str = "seconds", by=("model",)) -> DataFrame:
    return results.groupBy(*by).agg((F.avg(seconds) / F.lit(float(steps))).alias("per_step"))


def param_grid(base: DataFrame, **lists) -> DataFrame:
    """Every combination of literal lists, next to each row of `base`."""
    out = base
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def select_results(results: DataFrame, **filters) -> DataFrame:
    """Equality or membership filters on sweep parameters."""
    for name, v in filters.items():
        results = results.filter(F.col(name).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(name) == v)
    return results


def log_spaced(spark: SparkSession, a: float, b: float, num: int) -> DataFrame:
    """Distinct integers, logarithmically spaced from a to b (truncated)."""
    return _log_spaced(spark.range(num).select(F.col("id").alias("p")), F.lit(float(a)), F.lit(float(b)), num)


def log_spaced_per_row(df: DataFrame, a: Column, b: Column, num: int) -> DataFrame:
    """The same list per row of a table; columns grid_id and n."""
    p = F.explode(F.sequence(F.lit(0), F.lit(num - 1)))
    return _log_spaced(df.withColumns({"_a": a, "_b": b}).select("grid_id", "_a", "_b", p.alias("p")),
                       F.col("_a"), F.col("_b"), num)


def _log_spaced(df: DataFrame, a: Column, b: Column, num: int) -> DataFrame:
    step = (F.log(b) - F.log(a)) / max(num - 1, 1)
    n = F.floor(F.exp(F.log(a) + F.col("p") * step) + 1e-9).cast("int").alias("n")
    keep = ["grid_id"] if "grid_id" in df.columns else []
    return df.select(*keep, n).distinct()


