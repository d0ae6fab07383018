"""Approximate nearest neighbours over balanced posting lists in the manner of inverted indexes with few, full lists.

Centroids come from a bounded sample that is halved again and again by two-means cuts at the median, so that lists are
balanced.  A neighbour graph over the centroids, held in memory by every task, finds a vector's closest centroids.
A vector is filed under all centroids that are nearly as close as its closest one, so that vectors near a boundary
are in every list they border on.  A query reads all lists whose centroid is within a ratio of its closest one; the ratio
is found at run time, from the lists that hold the true neighbours of a sample of the queries.
Lists are cut into shards of bounded size by a hash of the vector, and a list's queries visit each of its shards.
Distances are exact, in double precision, on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import cut

#: Vectors that the centroids are fitted on, at most about.
SAMPLE = 40_000
#: Wanted vectors in a list, and vectors in a shard of a list, at most about.
LIST_SIZE, SHARD_SIZE = 200, 2_000
#: Lists that file a vector, and how much farther than the closest its centroid may be.
COPIES, FILE_RATIO = 4, 1.15
#: Queries that the reading ratio is found on, at most about, and the share of their true neighbours that it has to reach.
TRIALS, RECALL = 256, 0.95
#: Neighbours of a centroid in the graph, and candidates that a search keeps.
DEGREE, BEAM = 16, 64


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Means of about `lists` equal parts of the sample, each cut at the median between two means."""
    rng, parts, done = np.random.default_rng(seed), [sample], []
    while parts and len(parts) + len(done) < lists:
        part = max(parts, key=len)
        parts = [p for p in parts if p is not part]
        distinct = len(np.unique(part, axis=0)) if len(part) < 5_000 else 2
        if distinct < 2:
            done.append(part)
            continue
        ends = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            side = part @ (ends[1] - ends[0])
            right = side > np.median(side)
            if not right.any() or right.all():
                break
            ends = np.stack([part[~right].mean(axis=0), part[right].mean(axis=0)])
        order = np.argsort(part @ (ends[1] - ends[0]), kind="stable")
        parts += [part[order[:len(part) // 2]], part[order[len(part) // 2:]]]
    return np.stack([p.mean(axis=0) for p in parts + done])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T), 0.0)


class CentroidGraph:
    """Nearest centroids by a beam search over a neighbour graph, for blocks of vectors."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        near = np.empty((n, degree), np.int64)
        for start in range(0, n, 1024):
            d = squared(centroids[start:start + 1024], centroids)
            d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf
            near[start:start + 1024] = np.argsort(d, axis=1)[:, :degree]
        links: list[set[int]] = [set(row) for row in near.tolist()]
        for i, row in enumerate(near.tolist()):
            for j in row:
                links[j].add(i)
        width = max((len(x) for x in links), default=0)
        self.links = np.full((n, max(width, 1)), -1, np.int64)
        for i, x in enumerate(links):
            self.links[i, :len(x)] = sorted(x)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 64)).astype(np.int64))

    def nearest(self, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and squared distances of about the k closest centroids of each vector, closest first."""
        n, rows = len(self.centroids), np.arange(len(vectors))
        beam = min(n, max(BEAM, k))
        seen = np.zeros((len(vectors), n), bool)
        found = np.full((len(vectors), n), np.inf)
        found[:, self.entries] = squared(vectors, self.centroids[self.entries])
        norms, own = (self.centroids ** 2).sum(axis=1), (vectors ** 2).sum(axis=1)
        while True:
            edge = np.partition(found, beam - 1, axis=1)[:, beam - 1] if beam < n else np.full(len(vectors), np.inf)
            open_ = np.where(seen | (found > edge[:, None]), np.inf, found)
            at = open_.argmin(axis=1)
            live = np.flatnonzero(np.isfinite(open_[rows, at]))
            if not len(live):
                break
            seen[live, at[live]] = True
            next_ = self.links[at[live]]
            who, where = np.nonzero(next_ >= 0)
            target, source = next_[who, where], live[who]
            new = np.isinf(found[source, target])
            target, source = target[new], source[new]
            dot = np.einsum("ij,ij->i", vectors[source], self.centroids[target])
            found[source, target] = np.maximum(own[source] + norms[target] - 2.0 * dot, 0.0)
        best = np.argsort(found, axis=1, kind="stable")[:, :k]
        return best, found[rows[:, None], best]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _list_batches(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, lists: int, ratio: float) -> Iterator[pa.RecordBatch]:
    """(vec_id, list) for the closest lists whose distance is within the ratio of the closest one."""
    graph = CentroidGraph(centroids)
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            near, distance = graph.nearest(_matrix(part.column(1)), min(lists, len(centroids)))
            keep = np.isfinite(distance) & (distance <= ratio * ratio * distance[:, :1] + 1e-12)
            row, place = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(near[row, place].astype(np.int32))], ["vec_id", "list"])


def _apart(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all centroids, and how much of them may be rounding, for each vector."""
    norms = (centroids * centroids).sum(axis=1)
    return squared(vectors, centroids), 1e-12 * ((vectors * vectors).sum(axis=1) + norms.max())


def _read_batches(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, sizes: np.ndarray, ratio: float, least: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, list) for all lists within the ratio of the closest one, and further ones until `least` filed vectors are read."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            distance, slack = _apart(_matrix(part.column(1)), centroids)
            order = np.argsort(distance, axis=1, kind="stable")
            distance, held = np.take_along_axis(distance, order, axis=1), sizes[order]
            near = distance <= (ratio * ratio * distance[:, 0] + slack)[:, None]
            row, place = np.nonzero((near | (np.cumsum(held, axis=1) - held < least)) & (held > 0))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(order[row, place].astype(np.int32))], ["vec_id", "list"])


def _true_batches(batches: Iterator[pd.DataFrame], trials: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k rows of a partition that are closest to each trial query, by comparing all of them."""
    best = None
    for batch in batches:
        for start in range(0, len(batch), SHARD_SIZE):
            found = _closest(trials, batch.iloc[start:start + SHARD_SIZE], k)
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["query_id", "score", "vec_id"]).groupby("query_id").head(k)
    if best is not None:
        yield best


def reading_ratio(vectors: DataFrame, asked: DataFrame, filed: DataFrame, centroids: np.ndarray, k: int) -> float:
    """How much farther than the closest a list's centroid may be, so that a sample of queries reaches RECALL of its true neighbours."""
    share = min(1.0, TRIALS / max(1, asked.count()))
    drawn = F.pmod(F.xxhash64("vec_id", F.lit("trial")), F.lit(1_000_000)) < F.lit(share * 1_000_000)
    trials = asked.filter(drawn).orderBy("vec_id").select("vec_id", "vector").toPandas()
    if not len(trials):
        trials = asked.limit(TRIALS).select("vec_id", "vector").toPandas()
    if not len(trials):
        return 1.0
    near = vectors.select("vec_id", "vector").mapInPandas(partial(_true_batches, trials=trials, k=k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    true = near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "vec_id")
    places = true.join(filed, "vec_id").toPandas()
    if not len(places):
        return 1.0
    distance, slack = _apart(np.stack(trials.vector.to_numpy()).astype(np.float64), centroids)
    of = pd.Index(trials.vec_id).get_indexer(places.query_id)
    over = np.maximum(distance[of, places["list"].to_numpy()] - slack[of], 0.0)
    closest = distance[of].min(axis=1)
    places["need"] = np.where(over <= closest, 1.0, np.sqrt(over / np.maximum(closest, np.finfo(float).tiny)))
    need = np.sort(places.groupby(["query_id", "vec_id"]).need.min().to_numpy())
    return float(need[max(0, int(np.ceil(RECALL * len(need))) - 1)]) * (1 + 1e-9)


def _closest(queries: pd.DataFrame, members: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k members of a shard that are closest to each query; ties go to the smaller id."""
    out = []
    if len(queries) and len(members):
        ids, m = members.vec_id.to_numpy(np.int64), np.stack(members.vector.to_numpy()).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], m[order]
        scale = float((m * m).sum(axis=1).max())
        names, vectors = queries.vec_id.to_numpy(np.int64), np.stack(queries.vector.to_numpy()).astype(np.float64)
        for start in range(0, len(names), 256):
            block, q = names[start:start + 256], vectors[start:start + 256]
            rough = squared(q, m)
            rough[block[:, None] == ids[None, :]] = np.inf
            most = min(k, len(ids)) - 1
            limit = np.partition(rough, most, axis=1)[:, most] + 1e-9 * (scale + (q * q).sum(axis=1))
            for i, name in enumerate(block):
                near = np.flatnonzero(rough[i] <= limit[i])
                near = near[np.isfinite(rough[i, near])]
                exact = np.sqrt(((m[near] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], exact))[:k]
                out.append(pd.DataFrame({"query_id": name, "vec_id": ids[near[best]], "score": exact[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part: of the most common length, finite, not zero, with an id."""
    named = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = named.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite
                         & F.exists("vector", lambda x: x != 0))
    length = sound.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sound.filter(F.size("vector") == (length.n if length else 0))


def nearest_neighbours(rows: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each valid row that `queries` picks, the k nearest other rows that were found.

    `queries` is a condition on vec_id.  Vectors that are null, zero, hold null or non-finite numbers, or do not
    have the most common length take no part; nor do null ids.  Rows that repeat an id count as one; if they differ,
    the smallest vector stands for it.  Ties go to the smaller id.  Tables without valid rows give an empty result.
    """
    found = valid_vectors(rows, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    vectors = cut(found, "vectors")
    n = vectors.count()
    share = min(1.0, SAMPLE / max(1, n))
    drawn = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < F.lit(share * 1_000_000)).orderBy("vec_id").select("vector").toPandas()
    if not len(drawn):
        drawn = vectors.limit(1).select("vector").toPandas()
    if not len(drawn):
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).filter(F.lit(False))
    sample = np.stack(drawn.vector.to_numpy()).astype(np.float64)
    centroids = balanced_centroids(sample, max(1, min(len(sample) // 8, -(-n // LIST_SIZE))))

    filed = vectors.mapInArrow(partial(_list_batches, centroids=centroids, lists=COPIES, ratio=FILE_RATIO), "vec_id long, list int")
    asked = vectors.filter(queries)
    filed = cut(filed, "filed")
    sizes = np.zeros(len(centroids), np.int64)
    for row in filed.groupBy("list").count().collect():
        sizes[row["list"]] = row["count"]
    ratio = reading_ratio(vectors, asked, filed, centroids, k)
    read = asked.mapInArrow(partial(_read_batches, centroids=centroids, sizes=sizes, ratio=ratio, least=(k + 1) * COPIES), "vec_id long, list int")
    shards = filed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(SHARD_SIZE)).cast("int").alias("shards"))
    members = (filed.join(shards, "list").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
               .join(vectors, "vec_id").select("list", "shard", "vec_id", "vector"))
    visits = (read.join(shards, "list").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
              .join(asked, "vec_id").select("list", "shard", "vec_id", "vector"))
    near = (visits.groupBy("list", "shard").cogroup(members.groupBy("list", "shard"))
            .applyInPandas(partial(_closest, k=k), "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.distinct().withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
