"""Near duplicates by SetSketch registers.

A document is the set of its 5-word shingles.  Each shingle is a Poisson process whose points fall on M registers; a
register keeps the first point of all shingles, so it is an exponential minimum with the set's size as its rate.
Its exponent to base B, truncated to a whole number, is stored: registers of a union are the maxima of its parts'
registers, and two sets agree in a register with a probability near their Jaccard similarity.

1. Equal sets collapse to their smallest id (a class).
2. Registers are cut into BANDS bands of ROWS; classes that share a band's values meet in a bucket.  At similarity
   0.75 a pair misses all bands with probability (1 - 0.75^5)^60 = 9e-8, and less above.
3. Every bucket member is paired with the bucket's smallest id only, so that a bucket of n gives n - 1 pairs.
4. Pairs are filtered by the joint likelihood of both sketches: those whose likelihood at the threshold is e^-18
   of the largest are far below it.  The others are verified on their full sets.
5. Links found so far are joined to components.  Documents of buckets that still hold several components are then
   compared across components, in a way that loses no link and yet does not emit a bucket's pairs: two sets of
   similarity t share one of the rarest (1 - t) of their shingles, under any fixed order of shingles, so documents
   meet on those alone, and only if the shingles behind their first common one suffice.  The order takes the shingles that are common among a sample of these documents last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import cut
from cellweave.llm.components import components
from cellweave.llm.shingles import GOLDEN, WordHashes, blocks, mix64, shingle_set, word_hashes

ROWS, BANDS = 5, 60
M = ROWS * BANDS
B = 1.001
#: Points later than this are register value 0; any set with an element has all registers before it.
LATEST = 20.0
THRESHOLD = 0.75
#: Log likelihood, against its maximum, below which a similarity of THRESHOLD is ruled out.
RULED_OUT = -18.0
#: Sample from which the order of shingles is taken, in documents, and how many common shingles it keeps; both only
#: bear on speed, since any order finds all links.
ORDER_DOCS, ORDER_SHINGLES = 10_000, 200_000


def registers(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """Register values (uint16) of non-empty sets, one row each."""
    n = len(sets)
    first = np.full(n * m, np.inf)
    key = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    time, step = np.zeros(len(key)), 0
    with np.errstate(over="ignore"):
        while len(key):
            turns = int(min(32, max(1, 30_000 // len(key))))  # short tails take several points at once
            number = (np.arange(step + 1, step + turns + 1, dtype=np.uint64) * GOLDEN)[None, :]
            bits = mix64(key[:, None] + number)
            gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
            at = time[:, None] + np.cumsum(gap, axis=1)
            place = (mix64(bits ^ GOLDEN) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
            np.minimum.at(first, (owner[:, None] * m + place.astype(np.int64)).ravel(), at.ravel())
            time = at[:, -1]
            step += turns
            active = np.unique(owner)
            latest = first.reshape(n, m)[active].max(axis=1)
            alive = time < latest[np.searchsorted(active, owner)]
            key, owner, time = key[alive], owner[alive], time[alive]
    value = np.floor(1.0 - np.log(first / LATEST) / np.log(B))
    return np.clip(value, 0, 65535).astype(np.uint16).reshape(n, m)


def _sketch_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        rows = ((ids[i].as_py(), shingle_set(word_hashes(texts[i].as_py(), memo), length)) for i in range(len(ids)))
        for block in blocks(rows):
            full = [s for _, s in block if len(s)]
            kept = iter(registers(full)) if full else iter(())
            sketches, low, high = [], [], []
            for _, s in block:
                sketches.append(next(kept).tobytes() if len(s) else b"")
                with np.errstate(over="ignore"):
                    low.append(int(np.sum(mix64(s), dtype=np.uint64).astype(np.int64)))
                    high.append(int(np.bitwise_xor.reduce(mix64(s + GOLDEN)).astype(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in block], pa.int64()), pa.array([len(s) for _, s in block], pa.int64()),
                 pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sketches, pa.binary())],
                ["doc_id", "n", "low", "high", "sketch"])


def _set_batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        rows = ((ids[i].as_py(), shingle_set(word_hashes(texts[i].as_py(), memo), length)) for i in range(len(ids)))
        for block in blocks(rows):
            offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in block])])
            values = np.concatenate([s for _, s in block]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in block], pa.int64()),
                 pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))],
                ["doc_id", "shingles"])


def _rarest_batches(batches: Iterator[pa.RecordBatch], length: int, common: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The shingles of each set that a set of similarity THRESHOLD must share one of."""
    memo = WordHashes()
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            s = shingle_set(word_hashes(text, memo), length).view(np.int64)
            at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
            count = np.where(common[at] == s, counts[at], 0) if len(common) else np.zeros(len(s), np.int64)
            needed = -(-75 * len(s) // 100)
            out.append(s[np.lexsort((s, count))[:len(s) - needed + 1]] if len(s) else s)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "rarest"])


def log_likelihood(similarity: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of a Jaccard similarity, given how many registers of the first set are larger, smaller and equal.

    share: the first set's part of the sum of both sizes.
    """
    def part(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0.0, 1.0) * (B - 1.0) / B) / np.log(B)

    over, under = part(share - (1 - share) * similarity), part(1 - share - share * similarity)
    tiny = 1e-12
    return (more * np.log(np.maximum(over, tiny)) + less * np.log(np.maximum(under, tiny))
            + equal * np.log(np.maximum(1 - over - under, tiny)))


def _likely_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, n_a, n_b, s_a, s_b = (batch.column(i) for i in range(6))
        x = np.frombuffer(b"".join(s_a.to_pylist()), np.uint16).reshape(-1, M)
        y = np.frombuffer(b"".join(s_b.to_pylist()), np.uint16).reshape(-1, M)
        more, less = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
        sizes = n_a.to_numpy().astype(float), n_b.to_numpy().astype(float)
        share = (sizes[0] / (sizes[0] + sizes[1]))[:, None]
        highest = np.minimum(share, 1 - share) / np.maximum(share, 1 - share)  # no two sets of these sizes are more alike
        grid = np.linspace(0.0, 1.0, 41)[None, :] * highest
        curve = log_likelihood(grid, more, less, M - more - less, share)
        at = log_likelihood(np.minimum(THRESHOLD, highest), more, less, M - more - less, share)[:, 0]
        best = grid[np.arange(len(grid)), curve.argmax(axis=1)]
        keep = (best >= THRESHOLD) | (at - curve.max(axis=1) >= RULED_OUT)
        picked = pa.array(keep)
        yield pa.RecordBatch.from_arrays([a.filter(picked), b.filter(picked)], ["a", "b"])


def _alike(n_a: Column, n_b: Column) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(n_a, n_b) * F.lit(100) >= F.greatest(n_a, n_b) * F.lit(75)


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Those of the distinct pairs a < b whose full sets reach the threshold."""
    side = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    other = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    # the smaller id is the bucket's leader: joined last, its row meets its members without being copied in a shuffle
    both = pairs.join(other, "b").join(side, "a").filter(_alike(F.col("n_a"), F.col("n_b")))
    likely = cut(both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_likely_batches, "a long, b long"), "likely")
    named = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
    sets = (texts.join(named, "doc_id", "left_semi").mapInArrow(partial(_set_batches, length=length),
                                                               "doc_id long, shingles array<long>"))
    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    compared = likely.join(y, "b").join(x, "a").select("a", "b", common.alias("i"), (F.size("x") + F.size("y") - common).alias("u"))
    return cut(compared.filter("i * 100 >= u * 75").select("a", "b").distinct(), "verified")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Texts are linked when their shingle sets have a Jaccard similarity of at least 0.75; component_id is the smallest
    id that links reach.  Texts without words have an empty set and no link.  Rows that share an id are one
    document in links; a null id takes no part (component null, kept).  An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    facts = cut(texts.mapInArrow(partial(_sketch_batches, length=length),
                                 "doc_id long, n long, low long, high long, sketch binary"), "sketches")
    named = facts.filter("doc_id IS NOT NULL AND n > 0")
    classes = cut(named.groupBy("n", "low", "high").agg(F.min("doc_id").alias("first")), "classes")
    sketches = facts.join(classes.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi").filter("n > 0")

    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)])
    spread = sketches.select("doc_id", F.explode(bands).alias("key"))
    crowded = spread.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader < last")
    members = cut(spread.join(crowded.select("key", "leader"), "key"), "buckets")
    stars = members.filter("doc_id > leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = _verified(stars, sketches.dropDuplicates(["doc_id"]), texts, length)
    grouped = components(found)

    labels = grouped.select(F.col("id").alias("doc_id"), "component")
    sizes = sketches.groupBy("doc_id").agg(F.max("n").alias("n"))
    labelled = (members.join(labels, "doc_id", "left")
                .select("key", "leader", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_ = cut(labelled.join(mixed.select("key"), "key").select("doc_id", "component").distinct().join(sizes, "doc_id"), "open")
    share = min(1.0, ORDER_DOCS / max(1, open_.count()))
    drawn = open_.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(share * 1_000_000)).select("doc_id")
    shingles = cut(texts.join(drawn, "doc_id", "left_semi").mapInArrow(partial(_set_batches, length=length), "doc_id long, shingles array<long>")
                   .select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().filter("count > 1"), "counted")
    # the most frequent by a threshold: a sort with a limit would send that many rows from every task
    left, least = ORDER_SHINGLES, 2**62
    for r in shingles.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).collect():  # at most about ORDER_DOCS
        left -= r.n
        if left < 0:
            break
        least = r["count"]
    seen = shingles.filter(F.col("count") >= least).toPandas().sort_values("shingle")  # at most ORDER_SHINGLES rows
    rarest = partial(_rarest_batches, length=length, common=seen["shingle"].to_numpy(np.int64), counts=seen["count"].to_numpy(np.int64))
    tokens = (texts.join(open_.select("doc_id"), "doc_id", "left_semi").mapInArrow(rarest, "doc_id long, rarest array<long>")
              .join(open_, "doc_id").select("doc_id", "component", "n", F.posexplode("rarest").alias("place", "token")))
    one = tokens.select("token", *[F.col(c).alias(f"{c}_a") for c in ("doc_id", "component", "n", "place")])
    two = tokens.select(F.col("token").alias("same"), *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "component", "n", "place")])
    # what lies behind the first common shingle bounds the intersection, which must reach 75/175 of both sizes together
    bound = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) * 175 >= (F.col("n_a") + F.col("n_b")) * 75
    across = (one.join(two, (F.col("token") == F.col("same")) & (F.col("doc_id_a") < F.col("doc_id_b"))
                       & (F.col("component_a") != F.col("component_b")) & _alike(F.col("n_a"), F.col("n_b")) & bound)
              .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct())
    more = _verified(across, sketches.dropDuplicates(["doc_id"]), texts, length)
    stars = grouped.filter("id > component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    final = components(stars.unionByName(more))

    reps = (classes.join(final.withColumnRenamed("id", "first"), "first", "left")
            .select("n", "low", "high", F.coalesce("component", "first").alias("found")))
    out = facts.join(reps, ["n", "low", "high"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("found"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs (all columns) that stay: one document of each group, one row of each document."""
    kept = near_dedup(docs, id_col, **options).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    named = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("own_id"))
    found = named.join(kept, F.col("own_id").eqNullSafe(F.col("id")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("own_id").orderBy(F.lit(0)))
    return found.withColumn("nth", nth).filter("own_id IS NULL OR nth = 1").select("doc.*")
