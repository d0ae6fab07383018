"""Ranked lexical search: best-first document intervals bounded by range-maximum tables of posting lists.

Queries are answered in blocks against all documents.  A first pass over the texts keeps, for each document, its
length and the counts of the terms that a block asks for; it is written once and gives the collection's statistics.
The second pass reads that table in shards of neighbouring documents, sorted by id.  In a shard each term has a
posting list of exact integer impacts and a sparse table of range maxima over it.  For a query, the sum of its
terms' maxima over an interval of documents bounds every score in it.  The interval with the highest bound is opened
first (many of them at a time, as one array operation): its document of greatest single impact is scored exactly and
splits it in two.  Intervals that cannot reach the best k so far, in score or by id at equal score, are dropped, so
the result is exact.  A task keeps the best k of each query from shard to shard; only these are shuffled, and no
posting list is ever gathered: a term that every document holds is spread over all shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import cut, plain_text

#: Maximal runs of ASCII letters, digits and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same on UTF-8 bytes: letters to lower case, separators to spaces.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
#: Different (query, term) pairs of a block of queries; bounds what is collected and broadcast.
BLOCK_PAIRS = 400_000
#: Documents of a shard at most, entries of a shard's posting lists, and entries of a table of terms by documents.
SHARD, POSTINGS, TABLE = 8192, 2_000_000, 2**22
#: Characters that the first pass splits together.
TEXTS = 4_000_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), 0)


class _Numbers(dict):
    """Term -> number; -1 for terms that no query holds."""

    def __missing__(self, term: bytes) -> int:
        return -1


def _count_batches(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """doc_id, number of terms, and the asked terms of the document with their counts."""
    numbers = _Numbers((t.encode("utf-8", "surrogatepass"), i) for i, t in enumerate(vocabulary.value))
    size = max(len(numbers), 1)
    for batch in batches:
        texts, start = batch.column(1).to_pylist(), 0
        while start < len(texts):
            end, held, lengths, found = start, 0, [], []
            while end < len(texts) and (held < TEXTS or end == start):
                own = texts[end].encode("utf-8", "surrogatepass").translate(FOLD).split()
                found.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
                held += len(texts[end])
                lengths.append(len(own))
                end += 1
            n = np.array(lengths, np.int64)
            term = np.concatenate(found)
            doc = np.repeat(np.arange(len(n)), n)
            key, times = np.unique((doc * size + term)[term >= 0], return_counts=True)
            offsets = np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (key % size, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], pa.array(n), *lists], ["doc_id", "n", "terms", "times"])
            start = end


class Shard:
    """Posting lists of neighbouring documents, with a sparse table of the places of range maxima."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.argsort(term * n_docs + doc, kind="stable")
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        n = len(order)
        levels = [np.arange(n, dtype=np.int32)]
        longest = int(np.diff(self.bounds).max(initial=1))
        # entry i of level k: place of the maximum of the 2^k entries from i on; those across lists are never asked for
        for k in range(1, max(longest, 1).bit_length()):
            half, last = 1 << (k - 1), levels[-1]
            other = last[np.minimum(np.arange(n) + half, n - 1)]
            levels.append(np.where(self.impact[other] > self.impact[last], other, last))
        self.tables = np.stack(levels) if n else np.zeros((1, 0), np.int32)
        self.log = np.zeros(longest + 2, np.int64)
        for i in range(2, longest + 2):
            self.log[i] = self.log[i >> 1] + 1

    def ranks(self, own: np.ndarray) -> np.ndarray:
        """For each term and place 0..n_docs: where the term's postings from that document on begin."""
        held = np.zeros((len(own), self.n_docs + 1), np.int32)
        for row, t in enumerate(own.tolist()):
            held[row, self.doc[self.bounds[t]:self.bounds[t + 1]] + 1] = 1
        return np.cumsum(held, axis=1, dtype=np.int32) + self.bounds[own].astype(np.int32)[:, None]

    def bound(self, ranks: np.ndarray, times: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of the scores in each interval [lo, hi), and its document of greatest single impact."""
        first, last = ranks[:, lo], ranks[:, hi]
        size = last - first
        level = self.log[size]
        some = size > 0
        a = self.tables[level, np.where(some, first, 0)]
        b = self.tables[level, np.where(some, last - (1 << level), 0)]
        best = np.where(self.impact[b] > self.impact[a], b, a)
        value = np.where(some, self.impact[best] * times[:, None], 0)
        top = value.argmax(axis=0)
        return value.sum(axis=0), self.doc[best[top, np.arange(len(lo))]]

    def scores(self, ranks: np.ndarray, times: np.ndarray, docs: np.ndarray) -> np.ndarray:
        first = ranks[:, docs]
        held = ranks[:, docs + 1] > first
        return np.where(held, self.impact[np.where(held, first, 0)] * times[:, None], 0).sum(axis=0)


class Best:
    """The k best (score, id) so far; ids ascend at equal scores."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[:self.k]
        self.score, self.ids = score[order], ids[order]

    def reachable(self, bound: np.ndarray, smallest_id: np.ndarray) -> np.ndarray:
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (bound > 0) & (smallest_id < self.ids[-1]))


def search_shard(shard: Shard, ids: np.ndarray, own: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Adds the shard's documents that belong to the best of one query; returns how many documents were scored."""
    here = shard.bounds[own + 1] > shard.bounds[own]
    own, times = own[here], times[here]
    if not len(own):
        return 0
    ranks, opened = shard.ranks(own), 0
    width = max(16, min(512, 2**18 // len(own)))
    lo, hi = np.zeros(1, np.int64), np.full(1, shard.n_docs, np.int64)
    bound, split = shard.bound(ranks, times, lo, hi)
    while True:
        open_ = best.reachable(bound, ids[lo])
        if not open_.all():
            lo, hi, bound, split = lo[open_], hi[open_], bound[open_], split[open_]
        if not len(lo):
            return opened
        if len(lo) > width:
            chosen = np.argpartition(-bound, width)[:width]
            rest = np.ones(len(lo), bool)
            rest[chosen] = False
        else:
            chosen, rest = np.arange(len(lo)), np.zeros(len(lo), bool)
        at = split[chosen]
        best.add(shard.scores(ranks, times, at), ids[at])
        opened += len(at)
        left, right = np.concatenate([lo[chosen], at + 1]), np.concatenate([at, hi[chosen]])
        some = left < right
        left, right = left[some], right[some]
        new_bound, new_split = shard.bound(ranks, times, left, right) if len(left) else (bound[:0], split[:0])
        lo, hi = np.concatenate([lo[rest], left]), np.concatenate([hi[rest], right])
        bound, split = np.concatenate([bound[rest], new_bound]), np.concatenate([split[rest], new_split])


NO_ID = np.iinfo(np.int64).max


def _search_batches(batches: Iterator[pa.RecordBatch], block, k: int) -> Iterator[pa.RecordBatch]:
    """slot, doc_id, score: the best k documents of the task for each query."""
    items, weights, n_docs, n_words = block.value
    best = [Best(k) for _ in items]
    shard_rows = max(64, min(SHARD, TABLE // max([len(own) for _, own, _ in items], default=1)))
    held: list[tuple[np.ndarray, ...]] = []

    def search() -> None:
        ids, n, size, term, tf = (np.concatenate([h[i] for h in held]) for i in range(5))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, size)
        m = 25 + (75 * n * n_docs) // n_words
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, size)))
        shard = Shard(term, doc, impact, len(weights), len(ids))
        for (_, own, times), found in zip(items, best):
            search_shard(shard, ids[order], own, times, found)

    rows = postings = 0
    for batch in batches:
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], batch.column(2).value_lengths().to_numpy(zero_copy_only=False).cumsum()])
        term = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tf = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < len(ids):
            by_size = int(np.searchsorted(ends, ends[start] + POSTINGS - postings, "right")) - 1
            end = min(len(ids), start + shard_rows - rows, max(by_size, start + (rows == 0)))
            cells = slice(ends[start], ends[end])
            if end > start:
                held.append((ids[start:end], n[start:end], np.diff(ends[start:end + 1]), term[cells], tf[cells]))
            rows, postings, start = rows + end - start, postings + int(ends[end] - ends[start]), end
            if start < len(ids):
                search()
                held, rows, postings = [], 0, 0
    if held:
        search()
    for (slot, _, _), found in zip(items, best):
        if len(found.ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.ids), slot)), pa.array(found.ids, mask=found.ids == NO_ID),
                                              pa.array(found.score)], ["slot", "doc_id", "score"])


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   query_id: str = "item_id", query_text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each query, scores above 0 only.

    Terms are maximal runs of ASCII letters and digits and all characters beyond ASCII, A-Z in lower case.  With N
    documents that have terms, L terms in all, n in a document, df documents holding a term and tf its occurrences, a
    term weighs floor(1000 ln((2N + 2) / (2 df + 1))) and adds, for each time that the query holds it, that weight
    times (10^9 tf) div (1000 tf + 8 m), where m = 25 + (75 n N) div L.  Equal scores rank by ascending id, null ids
    last.  Null and empty texts have no terms: such a document is never found, such a query finds nothing.  Each row of
    queries is answered, repeated ones too; each row of docs is a document, whatever its length; other columns are
    ignored whatever their names.  Empty tables give an empty result.  Queries come in blocks of about block_pairs
    (query, term) pairs, which reach the driver and every task; a single longer query is a block of that length.
    """
    numbered = queries.select(F.monotonically_increasing_id().alias("slot"), F.col(query_id).cast("long").alias("item_id"),
                              terms(plain_text(query_text)).alias("terms"))
    asked = numbered.select("slot", "item_id", F.explode("terms").alias("term"))
    asked = cut(asked.groupBy("slot", "item_id", "term").agg(F.count("*").alias("times")), "asked")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    blocks = -(-asked.count() // block_pairs)
    found = [_search_block(given, asked.filter(F.pmod(F.xxhash64("slot"), F.lit(blocks)) == b), k) for b in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _search_block(given: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    context = given.sparkSession.sparkContext
    own = asked.orderBy("slot", "term").toPandas()
    if own.empty:
        return None
    vocabulary = sorted(own["term"].unique())
    number = {t: i for i, t in enumerate(vocabulary)}
    counted = cut(given.mapInArrow(partial(_count_batches, vocabulary=context.broadcast(vocabulary)),
                                   "doc_id long, n long, terms array<int>, times array<int>"), "counted")
    totals = counted.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("words")).first()
    if not totals.docs:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
        weights[r.t] = math.floor(1000 * math.log((2 * totals.docs + 2) / (2 * r.df + 1)))
    items = []
    for slot, rows in own.groupby("slot"):
        items.append((int(slot), np.array([number[t] for t in rows["term"]], np.int64), rows["times"].to_numpy(np.int64)))
    block = context.broadcast((items, weights, int(totals.docs), int(totals.words)))
    best = counted.filter(F.size("terms") > 0).mapInArrow(partial(_search_batches, block=block, k=k), "slot long, doc_id long, score long")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(asked.select("slot", "item_id").distinct(), "slot").select("item_id", "rank", "doc_id", "score")
