"""Models on labelled samples: training, errors, reuse, and use in fits.

Linear models with any number of outputs come from one pass that adds up products (a Gram matrix of fixed size); the
others are Spark ML pipelines, one for each output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.functions.index import let, oriented, sub_window, total
from cellweave.functions.random import gaussian
from cellweave.operators.curves import normalise
from cellweave.operators.labels import route_by_probability
from cellweave.operators.windows import with_windows
from cellweave.plans.lineage import cut_lineage
from cellweave.schema import CUT, KEY, GridShape
from cellweave.sources.tables import exists

REGRESSORS = {"tree": lambda: DecisionTreeRegressor(maxDepth=8, seed=42),
              "forest": lambda: RandomForestRegressor(numTrees=20, maxDepth=8, seed=42)}


def classifier(kind: str, n_inputs: int, n_classes: int):
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_inputs, 20, 20, n_classes], seed=42)
    return {"logistic": lambda: LogisticRegression(), "tree": lambda: DecisionTreeClassifier(maxDepth=8, seed=42),
            "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=8, seed=42)}[kind]()


@dataclass
class Fitted:
    """One Spark ML pipeline per output (Spark has no multi-output regressor)."""

    models: list[PipelineModel]
    is_classifier: bool = False

    def transform(self, df: DataFrame, x: str = "x") -> DataFrame:
        """Add prediction array<double> (and probability array<double> for classifiers)."""
        out = df.withColumn("features", array_to_vector(x))
        for n, m in enumerate(self.models):
            out = m.transform(out).withColumnRenamed("prediction", f"_p{n}")
            if self.is_classifier:
                out = out.withColumn("_prob", vector_to_array("probability")).drop("probability", "rawPrediction")
        names = [f"_p{n}" for n in range(len(self.models))]
        out = out.withColumn("prediction", F.array(*names)).drop("features", *names)
        return out.withColumnRenamed("_prob", "probability") if self.is_classifier else out

    def save(self, path: str) -> None:
        for n, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}/output_{n}")

    @staticmethod
    def load(path: str, outputs: int, is_classifier: bool = False) -> Fitted:
        return Fitted([PipelineModel.load(f"{path}/output_{n}") for n in range(outputs)], is_classifier)


@dataclass
class LinearFit:
    """Least squares for all outputs at once: coefficients[output] = [constant, one for each input]."""

    coefficients: list[list[float]]

    def transform(self, df: DataFrame, x: str = "x") -> DataFrame:
        made = [total([F.lit(c[0]), *[F.get(x, F.lit(n)) * F.lit(v) for n, v in enumerate(c[1:])]]) for c in self.coefficients]
        return df.withColumn("prediction", F.array(*made))

    def save(self, path: str) -> None:
        rows = [(n, c) for n, c in enumerate(self.coefficients)]
        spark = SparkSession.active()
        spark.createDataFrame(rows, "output int, coefficients array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")

    @staticmethod
    def load(path: str) -> LinearFit:
        rows = SparkSession.active().read.parquet(f"{path}/coefficients").orderBy("output").collect()
        return LinearFit([list(r.coefficients) for r in rows])


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of (1, x, y) over a task's rows."""
    gram = None
    for batch in batches:
        n = batch.num_rows
        if n:
            parts = [c.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in batch.columns]
            z = np.concatenate([np.ones((n, 1)), *parts], axis=1)
            gram = z.T @ z if gram is None else gram + z.T @ z
    if gram is not None:
        yield pa.RecordBatch.from_arrays([pa.array([gram.ravel()], pa.list_(pa.float64()))], ["gram"])


def fit_linear(train: DataFrame, inputs: int | None = None) -> LinearFit:
    """One job for all outputs; only a matrix of (1 + inputs + outputs)^2 sums reaches the driver.

    Inputs that depend on each other get the smallest coefficients that fit.
    """
    sums = (train.select(F.col("x").cast("array<double>"), F.col("y").cast("array<double>")).mapInArrow(_gram_batches, "gram array<double>")
            .select(F.posexplode("gram").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect())
    if not sums:
        raise ValueError("no training rows")
    flat = np.zeros(len(sums))
    flat[[r["at"] for r in sums]] = [r["v"] for r in sums]
    gram = flat.reshape(math.isqrt(len(sums)), -1)
    d = 1 + (len(train.select("x").first()["x"]) if inputs is None else inputs)
    return LinearFit((np.linalg.pinv(gram[:d, :d], rcond=1e-12, hermitian=True) @ gram[:d, d:]).T.tolist())


def add_train_noise(view: DataFrame, sigma: float = 1e-5, seed: int = 42) -> DataFrame:
    """Gaussian noise on the inputs, reproducible per sample and position."""
    noisy = F.transform("x", lambda v, n: v + gaussian([F.col("sample_id"), n], seed, sigma))
    return view.withColumn("x", noisy)


def fit_model(view: DataFrame, kind: str, outputs: int = 1, inputs: int | None = None,
              classes: int | None = None, class_weights: dict[int, float] | None = None,
              noise: float = 0.0) -> Fitted | LinearFit:
    """Train on the rows with is_train: "linear" in one job for all outputs, others as one pipeline per output.

    With `classes` the first output is a class id; class_weights become a weight
    column for models that take one.  Training rows are written once and read by every pipeline.
    """
    train = view.filter("is_train")
    if noise:
        train = add_train_noise(train, noise)
    if kind == "linear":
        return fit_linear(train, inputs)
    train = cut_lineage(train.withColumn("features", array_to_vector("x")))
    models = []
    for n in range(outputs):
        data = train.withColumn("label", F.get("y", F.lit(n)).cast("double"))
        est = REGRESSORS[kind]() if classes is None else classifier(kind, inputs, classes)
        if class_weights and est.hasParam("weightCol"):
            w = F.lit(1.0)
            for c, x in class_weights.items():
                w = F.when(F.col("label") == c, float(x)).otherwise(w)
            data = data.withColumn("weight", w)
            est.setWeightCol("weight")
        models.append(Pipeline(stages=[est.setFeaturesCol("features").setLabelCol("label")]).fit(
            data.select("features", "label", *(["weight"] if "weight" in data.columns else []))))
    return Fitted(models, classes is not None)


def fit_or_load(spark: SparkSession, path: str, view: DataFrame, kind: str, outputs: int = 1, **kw) -> Fitted | LinearFit:
    """Reuse a saved model; train and save it if there is none."""
    linear = kind == "linear"
    done = exists(spark, f"{path}/coefficients") if linear else all(exists(spark, f"{path}/output_{n}/metadata") for n in range(outputs))
    if done and linear:
        return LinearFit.load(path)
    if done:
        return Fitted.load(path, outputs, kw.get("classes") is not None)
    model = fit_model(view, kind, outputs, **kw)
    model.save(path)
    return model


def model_errors(predicted: DataFrame) -> DataFrame:
    """L1 and Linf over all outputs, for the training and the test part."""
    gaps = F.zip_with("prediction", "y", lambda a, b: F.abs(a - b.cast("double")))
    return (predicted.select("is_train", F.explode(gaps).alias("e")).groupBy("is_train")
            .agg(F.avg("e").alias("error_l1"), F.max("e").alias("error_linf")))


def tune_class_weight(probabilities: DataFrame, cls: int, target: tuple[int, int], low: float = 1e-9, high: float = 1e9,
                      bins: int = 1024, rounds: int = 8) -> tuple[float, int]:
    """Weight of one class at which the number of rows that it wins lies in the band, and that number.

    Multiplying a class's odds by a weight is what training with that weight does to a calibrated model, so nothing is
    trained again.  A row (probability array) goes to the class as soon as the weight exceeds its critical one, the best
    other probability over the class's own.  Each round counts critical weights in log-spaced bins (one pass, at most
    `bins` rows back) and narrows the range to the bin where the count crosses the band.
    """
    own = F.get("probability", F.lit(cls))
    others = F.array_max(F.filter("probability", lambda p, n: n != cls))
    critical = probabilities.select(F.when(own > 0, F.log(others / own)).alias("w")).filter("w IS NOT NULL")
    critical = cut_lineage(critical)
    lo, hi = math.log(low), math.log(high)
    below = critical.filter(F.col("w") < lo).count()
    for _ in range(rounds):
        width = (hi - lo) / bins
        inside = critical.filter((F.col("w") >= lo) & (F.col("w") < hi))
        counts = {r.b: r.n for r in inside.groupBy(F.floor((F.col("w") - lo) / width).alias("b")).agg(F.count("*").alias("n")).collect()}
        n, edge = below, 0
        while edge < bins and n < target[0] and n + counts.get(edge, 0) <= target[1]:
            n += counts.get(edge, 0)
            edge += 1
        weight = lo + edge * width
        if n >= target[0] or edge == bins or width < 1e-12:
            break
        lo, hi, below = weight, weight + width, n
    return math.exp(weight), n


# ---------------------------------------------------------------- models inside fits

def route_by_model(cells: DataFrame, shape: GridShape | DataFrame, model: Fitted, k: int = 3,
                   damping=(1.0, 1.0, 1e-4)) -> DataFrame:
    """Models to try per cell (column route), from the predicted curve class."""
    w = with_windows(cells, shape, k, k, ["u", "kind"]).withColumnRenamed("w_u", "x")
    p = model.transform(w)
    return p.select(*KEY, "u", "kind", route_by_probability(F.col("kind"), F.col("probability"), damping).alias("route"))


def normalised_windows(cells: DataFrame, shape: GridShape | DataFrame, k: int, axis: int, levels) -> DataFrame:
    """Cut cells with their normalised k x k window as model input x, and both side values."""
    size = (max(k, 5), max(k, 5))
    w = with_windows(cells, shape, *size, ["u", "kind"], where=F.col("kind") == CUT)
    bound = F.struct(F.col("w_u").alias("u"), F.col("w_kind").alias("k"))
    w = w.withColumn("_lv", let(bound, lambda x: levels(x["u"], x["k"], size, F.lit(axis))))
    x = normalise(oriented(F.col("w_u"), size, k, k, F.lit(axis)), oriented(F.col("w_kind"), size, k, k, F.lit(axis)),
                  F.col("_lv.up"), F.col("_lv.down"))
    return w.filter(F.col("_lv.up").isNotNull()).select(
        *KEY, "u", F.lit(axis).alias("axis"), F.col("_lv.up").alias("value_up"), F.col("_lv.down").alias("value_down"),
        x.alias("x"), sub_window(F.col("w_u"), size, (3, 3)).alias("w_u"))


def propose_learned_curve(cells: DataFrame, shape: GridShape | DataFrame, model: Fitted, family: str, levels,
                          k: int = 3, axis: int = 0, model_idx: int = 1) -> DataFrame:
    """Curve parameters predicted from the normalised window, as proposal rows.

    Samples have their origin at the cell centre, curves at its lower edge, so the
    first coefficient moves up by one half.
    """
    p = model.transform(normalised_windows(cells, shape, k, axis, levels))
    params = F.transform("prediction", lambda v, n: F.when(n == 0, v + 0.5).otherwise(v))
    return p.select(*KEY, "w_u", "x", F.lit(model_idx).alias("model_idx"), F.lit(0).alias("axis_rank"), F.lit(0).alias("cand"),
                    "axis", F.lit(family).alias("family"), params.alias("params"), "value_up", "value_down")


def predict_transfer(cells: DataFrame, shape: GridShape, model: Fitted, v: float, levels, k: int = 3,
                     axis: int = 0) -> DataFrame:
    """Learned content that leaves a cut cell along one axis: KEY, di, dj, q."""
    w = normalised_windows(cells, shape, k, axis, levels)
    w = w.withColumn("x", F.concat("x", F.array(F.lit(float(v)), F.lit(0.0))))
    f = F.get(F.col("prediction"), F.lit(0))
    q = f * F.col("value_down") + (abs(v) - f) * F.col("value_up")
    step = (v > 0) - (v < 0)
    return model.transform(w).select(*KEY, F.lit(step if axis == 0 else 0).alias("di"),
                                     F.lit(step if axis == 1 else 0).alias("dj"), q.alias("q"))


def score_learned(proposals: DataFrame, model: Fitted, k: int = 3, p: float = 2.0) -> DataFrame:
    """Loss of proposals by a model that predicts the normalised window from curve parameters."""
    x = F.transform("params", lambda v, n: F.when(n == 0, v - 0.5).otherwise(v))
    made = model.transform(proposals.withColumnRenamed("x", "_norm").withColumn("x", x))
    lo, hi = F.least("value_up", "value_down"), F.greatest("value_up", "value_down")
    shown = F.transform("prediction", lambda v: F.when(F.col("value_up") > F.col("value_down"), 1 - v).otherwise(v) * (hi - lo) + lo)
    data = F.when(F.col("axis") == 0, F.col("w_u")).otherwise(sub_window(F.col("w_u"), (k, k), (k, k), transposed=True))
    loss = F.aggregate(F.zip_with(shown, data, lambda a, b: F.pow(F.abs(a - b), p)), F.lit(0.0), lambda acc, e: acc + e)
    return made.withColumn("loss", loss).drop("prediction", "_norm", "x", "w_u")
