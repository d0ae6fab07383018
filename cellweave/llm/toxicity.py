"""Toxicity from two class-conditional Kneser-Ney models with shared backoff.

Labelled training texts give, for each class, the number of different words that a word follows: Kneser-Ney's
continuation counts, which copied passages do not inflate.  They are discounted, and the freed mass goes to
continuation counts of both classes together, so that an expression too rare for one class is judged by what both
know.  A text is compared under both models by log likelihoods a word: over its most toxic stretches of fixed
lengths, and by the toxic surplus of all words against the text's length, since a few words decide about a long
text.  A logistic curve over these, fitted on training texts that the models have not seen, gives the score.
Words fall into a fixed number of hash buckets, so the models have a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import cut

WORD_BITS = 19
WORDS = 2**WORD_BITS
#: Above two, so that words which a class has seen twice at most are left to the shared counts.
DISCOUNT = 2.5
SHARED_DISCOUNT = 0.75
STRETCHES = (1, 8)
#: Bounds of the labelled sample that the classifier is fitted on, by class; chosen by a hash of the id.
SAMPLE = {0: 8_000, 1: 4_000}
LETTERS = r"[^\W\d_]+"


class _Buckets(dict):
    """Word -> bucket from 1 (0 stands before the first word), remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = 1 + xxhash.xxh3_64_intdigest(word) % (WORDS - 1)
        return value


def _words(text: str | None, letters: re.Pattern, memo: _Buckets) -> np.ndarray:
    found = letters.findall((text or "").lower())
    return np.fromiter(map(memo.__getitem__, found), np.int64, len(found))


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different (previous word, word, class) per block of texts."""
    letters, memo = re.compile(LETTERS), _Buckets()

    def counted(keys: list[np.ndarray]) -> pa.RecordBatch:
        key = np.unique(np.concatenate(keys))
        return pa.RecordBatch.from_arrays([pa.array(key >> (WORD_BITS + 1)), pa.array(key >> 1 & (WORDS - 1)),
                                           pa.array((key & 1).astype(np.int32))], ["before", "word", "toxic"])

    keys, held = [], 0
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = _words(text, letters, memo)
            if len(words):
                before = np.concatenate([[0], words[:-1]])
                keys.append((before << WORD_BITS | words) << 1 | toxic)
                held += len(words)
            if held > 2_000_000:
                yield counted(keys)
                keys, held = [], 0
    if keys:
        yield counted(keys)


def fit_models(pairs: DataFrame) -> np.ndarray:
    """Log likelihood of each word bucket under the toxic model less that under the ordinary one.

    pairs(before, word, toxic) may repeat.  At most one row for each bucket reaches the driver.
    """
    seen = pairs.groupBy("before", "word").agg(*[F.max((F.col("toxic") == k).cast("int")).alias(f"c{k}") for k in (0, 1)])
    got = seen.groupBy("word").agg(F.sum("c0"), F.sum("c1"), F.count("*")).toPandas().to_numpy(np.int64)
    counts = np.zeros((3, WORDS))
    counts[:, got[:, 0]] = got[:, 1:].T
    shared = _discounted(counts[2], SHARED_DISCOUNT, np.full(WORDS, 1.0 / WORDS))
    ordinary, toxic = (_discounted(counts[k], DISCOUNT, shared) for k in (0, 1))
    return (np.log(toxic) - np.log(ordinary)).astype(np.float32)


def _discounted(counts: np.ndarray, discount: float, backoff: np.ndarray) -> np.ndarray:
    total = max(float(counts.sum()), 1.0)
    kept = np.maximum(counts - discount, 0) / total
    return kept + (1.0 - float(kept.sum())) * backoff


def _features(gain: np.ndarray) -> list[float]:
    """Mean advantage of the toxic model in the best stretch of each length; its surplus over one, by length."""
    if not len(gain):
        return [0.0] * (4 + len(STRETCHES))
    total, out = np.concatenate([[0.0], np.cumsum(gain, dtype=np.float64)]), []
    for n in STRETCHES:
        n = min(n, len(gain))
        out.append(float((total[n:] - total[:-n]).max()) / n)
    surplus = float(np.maximum(gain - 1.0, 0.0).sum())
    return [*out, surplus / len(gain) ** 0.5, surplus / len(gain), float(np.log1p(surplus)), float(np.log1p(len(gain)))]


def _feature_batches(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    letters, memo = re.compile(LETTERS), _Buckets()
    for batch in batches:
        rows = [_features(gains[_words(text, letters, memo)]) for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))],
                                         [*batch.schema.names[1:], "features"])


class Classifier:
    """Gains of words and the curve over features; without a curve, one score for all texts."""

    def __init__(self, gains: np.ndarray | None, curve: np.ndarray | None, share: float):
        self.gains, self.curve, self.share = gains, curve, share

    def scores(self, texts: list[str | None], letters: re.Pattern, memo: _Buckets) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.share)
        x = np.array([_features(self.gains[_words(t, letters, memo)]) for t in texts]).reshape(len(texts), len(self.curve) - 1)
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -700, 700)))


def _score_batches(batches: Iterator[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, the text, by its score."""
    letters, memo = re.compile(LETTERS), _Buckets()
    for batch in batches:
        scores = model.scores(batch.columns[-1].to_pylist(), letters, memo)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])


def _kept_batches(batches: Iterator[pa.RecordBatch], model: Classifier, threshold: float, text_col: str) -> Iterator[pa.RecordBatch]:
    """Rows whose text scores below the threshold, a thousand at a time."""
    letters, memo = re.compile(LETTERS), _Buckets()
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            texts = batch.column(text_col).cast(pa.string()).to_pylist()
            yield batch.filter(pa.array(model.scores(texts, letters, memo) < threshold, pa.bool_()))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on standardised columns; returns weights for raw columns and the constant last."""
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    raw = w[:-1] / spread
    return np.append(raw, w[-1] - raw @ mean)


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Learns labels(doc_id, toxic) of docs only from rows whose crc32 of the id as text modulo 4 is not 2.

    Remainders 0 and 1 train the models, 3 fits the curve, at most about SAMPLE rows of each class, which is the bound
    of what is broadcast.  Labels that are null or neither 0 nor 1 teach nothing.
    """
    known = (labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))).filter("fold <> 2"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(sizes) < 2:
        return Classifier(None, None, share)
    keep = F.lit(False)
    for k, bound in SAMPLE.items():
        part = min(1.0, bound / max(1, sizes.get(k, 0)))
        keep = keep | ((F.col("toxic") == k) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000))
    chosen = F.broadcast(known.filter(keep).withColumnRenamed("doc_id", "_id"))
    taught = cut(docs.select(F.col(id_col).cast("long").alias("_own"), F.col(text_col).cast("string").alias("text")).join(
        chosen, F.col("_own") == F.col("_id")).select("text", F.col("toxic").cast("int").alias("toxic"), "fold"), "taught")
    gains = fit_models(taught.filter("fold < 2").select("text", "toxic").mapInArrow(_pair_batches, "before long, word long, toxic int"))
    fitted = (taught.filter("fold = 3").select("text", "toxic")
              .mapInArrow(partial(_feature_batches, gains=gains), "toxic int, features array<double>").toPandas())
    if fitted.toxic.nunique() < 2:
        return Classifier(None, None, share)
    return Classifier(gains, fit_logistic(np.array(fitted.features.tolist()), fitted.toxic.to_numpy(float)), share)


def toxicity(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, id_col: str = "doc_id",
             text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    The classifier is fitted on training_docs (default: docs).  Null and empty texts have neutral features; null ids
    are scored and not held out.  Without labels of both classes every score is the toxic share of those there are.
    Repeated rows are scored each; an empty table gives an empty result.
    """
    model = fit_classifier(docs if training_docs is None else training_docs, labels, id_col, text_col)
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))
    facts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
                        F.col(text_col).cast("string").alias("text"))
    scored = facts.mapInArrow(partial(_score_batches, model=model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs (all columns) that are not predicted toxic; nothing is shuffled for it."""
    model = fit_classifier(docs, labels, id_col, text_col)
    return docs.mapInArrow(partial(_kept_batches, model=model, threshold=threshold, text_col=text_col), docs.schema)
