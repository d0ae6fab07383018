"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to.  Words flow from these patterns to the sources'
quotas; the n-th use of a pattern's words costs n, so nothing repeats while unused words would do.  The network
has a node for each pattern and source of the catalogue, none for documents.  The flow of each pattern is then
turned into documents: all of them whole rounds, and a seeded choice for the last, partial round.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import cut, word_count

#: Relative size below which an amount of flow counts as nothing.
NOTHING = 1e-9
#: Patterns up to which tables with one row for each pattern are broadcast; larger catalogues are joined by shuffles.
CATALOGUE = 50_000


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], repeats: int = 3) -> dict[str | None, float]:
    """Shares of all sizes by weight; a source stops at `repeats` times its size, the excess is shared again."""
    total, out, open_ = float(sum(sizes.values())), {}, dict(weights)
    while open_:
        left, mass = total - sum(out.values()), sum(open_.values())
        full = [s for s in open_ if left * open_[s] / mass > repeats * sizes[s]]
        if not full:
            return out | {s: left * w / mass for s, w in open_.items()}
        out |= {s: float(repeats * sizes[s]) for s in full}
        for s in full:
            del open_[s]
    return out


def min_cost_flow(capacity: dict[tuple, float], quotas: dict[str | None, float], repeats: int = 3) -> dict[tuple, float]:
    """Words to take from each pattern (a tuple of sources) so that the quotas are met at the least repetition cost.

    Successive shortest paths with potentials; a path starts at the pattern whose next use is cheapest, and may move
    words that an earlier path sent to a source over to another one.
    """
    patterns, sources = list(capacity), list(quotas)
    flow: dict[tuple[int, int], float] = defaultdict(float)  # pattern, source -> words
    used, met = [0.0] * len(patterns), [0.0] * len(sources)
    scale = max(sum(quotas.values()), 1.0)
    members = [[sources.index(s) for s in p if s in quotas] for p in patterns]
    having = defaultdict(list)
    for p, own in enumerate(members):
        for s in own:
            having[s].append(p)

    def level(p: int) -> tuple[int, float]:
        """The cost of the pattern's next word, and how many words it holds for."""
        size = capacity[patterns[p]]
        for n in range(1, repeats + 1):
            if used[p] < n * size - NOTHING * scale:
                return n, n * size - used[p]
        return 0, 0.0

    while True:
        best: dict[tuple[str, int], tuple[float, tuple | None]] = {}
        heap = []
        for p in range(len(patterns)):
            cost, room = level(p)
            if cost and members[p]:
                heapq.heappush(heap, (cost, "p", p, None))
        end = None
        while heap:
            cost, kind, node, came = heapq.heappop(heap)
            if (kind, node) in best:
                continue
            best[kind, node] = (cost, came)
            if kind == "s":
                if met[node] < quotas[sources[node]] - NOTHING * scale:
                    end = node
                    break
                for p in having[node]:  # take back what an earlier path sent here
                    if flow[p, node] > NOTHING * scale and ("p", p) not in best:
                        heapq.heappush(heap, (cost, "p", p, ("s", node)))
            else:
                for s in members[node]:
                    if ("s", s) not in best:
                        heapq.heappush(heap, (cost, "s", s, ("p", node)))
        if end is None:
            return {p: used[i] for i, p in enumerate(patterns)}
        path, step = [("s", end)], best["s", end][1]
        while step is not None:
            path.append(step)
            step = best[step][1]
        path.reverse()
        start = path[0][1]
        amount = min(level(start)[1], quotas[sources[end]] - met[end])
        for a, b in zip(path, path[1:]):
            if a[0] == "s":
                amount = min(amount, flow[b[1], a[1]])
        for a, b in zip(path, path[1:]):
            if a[0] == "p":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        used[start] += amount
        met[end] += amount


def select_documents(sized: DataFrame, wanted: DataFrame, passes: tuple[int, ...], repeats: int,
                     rows_per_bucket: int = 50_000) -> DataFrame:
    """Adds `extra` to sized(row, pattern, size, draw): further uses that come near wanted(pattern, words, rounds).

    Documents stand in the order of their seeded draw.  Those are chosen whose sizes add up to at most the wanted
    words; each further pass, numbered by the extra uses its documents already have, does the same with what is left
    and still fits; last comes the use, if any, that brings the sum nearest.  None exceeds `repeats` uses.  Sums run
    over ranges of draws, and over documents only in the range where a limit falls.
    """
    bits = max(0, (max(1, sized.count() // rows_per_bucket) - 1).bit_length())
    few = wanted.count() <= CATALOGUE

    def near(by_pattern: DataFrame) -> DataFrame:
        return F.broadcast(by_pattern) if few else by_pattern

    state = sized.withColumn("bucket", F.shiftrightunsigned(F.col("draw"), 63 - bits)).withColumn("extra", F.lit(0))
    left = wanted
    for level in passes:
        fits = (F.col("extra") == level) & (F.col("rounds") + F.col("extra") < repeats) & (F.col("size") > 0) & (F.col("size") <= F.col("words"))
        free = state.join(near(left), "pattern").filter(fits)
        sums = free.groupBy("pattern", "bucket").agg(F.sum("size").alias("mass"), F.max("words").alias("words"))
        upto = F.sum("mass").over(Window.partitionBy("pattern").orderBy("bucket"))
        edge = (sums.withColumn("before", upto - F.col("mass"))
                .filter("before <= words AND before + mass > words").select("pattern", F.col("bucket").alias("edge"), "before"))
        rows = Window.partitionBy("pattern").orderBy("draw", "row").rowsBetween(Window.unboundedPreceding, 0)
        last = (free.join(near(edge), "pattern").filter("bucket = edge")
                .withColumn("upto", F.col("before") + F.sum("size").over(rows)).filter("upto <= words")
                .groupBy("pattern").agg(F.max(F.struct("draw", "row")).alias("last")))
        limits = left.join(edge, "pattern", "left").join(last, "pattern", "left").select("pattern", "words", "rounds", "edge", "last")
        inside = F.col("edge").isNull() | (F.col("bucket") < F.col("edge")) | (
            (F.col("bucket") == F.col("edge")) & (F.struct("draw", "row") <= F.col("last")))
        state = _choose(state, near(limits), fits & inside)
        got = state.groupBy("pattern").agg(F.sum(F.col("size") * F.col("extra")).alias("got"))
        left = cut(wanted.join(got, "pattern").select("pattern", (F.col("words") - F.col("got")).alias("words"), "rounds"), "left")
    gap = F.abs(F.col("size") - F.col("words"))
    nearest = (state.join(near(left), "pattern").filter(F.col("rounds") + F.col("extra") < repeats).filter("size > 0 AND size < 2 * words")
               .groupBy("pattern").agg(F.min(F.struct(gap.alias("gap"), "extra", "draw", "row")).alias("best")))
    best = nearest.select("pattern", F.col("best.row").alias("best_row"))
    return _choose(state, near(best), F.col("row") == F.col("best_row")).drop("bucket")


def _choose(state: DataFrame, limits: DataFrame, chosen: Column) -> DataFrame:
    extra = F.col("extra") + F.when(F.coalesce(chosen, F.lit(False)), F.lit(1)).otherwise(F.lit(0))
    return cut(state.join(limits, "pattern", "left").withColumn("extra", extra).select(*state.columns), "choice")


def mix(docs: DataFrame, members: Column | None = None, weights: dict[str | None, float] | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = 3, seed: int = 1,
        passes: tuple[int, ...] = (0, 0, 0, 1, 1)) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, uses.

    `members` is an array of the sources a document belongs to (default: its one source; null is a source too).
    Without weights, sources in the order of their code points, null last, weigh 1, 2, 3, repeating.  Sizes are words
    of the text, 0 for null.  `taken` is size times `uses`, the rounds in which the mix takes the document, at most
    `repeats`; documents without words are never taken.  source_size and target are summed over a document's
    sources.  Repeated rows count each.  An empty table gives an empty result.
    """
    members = F.array(F.col(source_col).cast("string")) if members is None else members
    rows = cut(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"), F.to_json(F.array_sort(F.array_distinct(members))).alias("pattern"),
        word_count(text_col).alias("size"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1).alias("draw")), "sized")
    # the catalogue: one row for each set of sources
    patterns = {r.pattern: r.size for r in rows.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    owners = {p: tuple(json.loads(p)) for p in patterns}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, own in owners.items():
        for s in own:
            sizes[s] += patterns[p]
    if weights is None:
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weights = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    share = {s: sum(patterns[p] / len(own) for p, own in owners.items() if s in own) for s in sizes}
    if all(len(own) == 1 for own in owners.values()):  # no overlap: whole numbers stay whole
        share = dict(sizes)
    goal = targets(share, weights, repeats)
    flow = min_cost_flow({owners[p]: float(n) for p, n in patterns.items()}, goal, repeats)
    plan = []
    for p, own in owners.items():
        rounds = min(repeats, int((flow[own] + 0.5) // patterns[p])) if patterns[p] else 0
        rest = max(0.0, flow[own] - rounds * patterns[p]) if rounds < repeats else 0.0
        plan.append((p, rounds, rest, sum(sizes[s] for s in own), float(sum(goal[s] for s in own))))
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, "pattern string, rounds int, words double, source_size long, target double")
    chosen = select_documents(rows.select("row", "pattern", "size", "draw"), plan.select("pattern", "words", "rounds"), passes, repeats)
    uses = chosen.select("row", "extra").join(rows.select("row", "doc_id", "source", "pattern", "size"), "row").join(F.broadcast(plan) if len(owners) <= CATALOGUE else plan, "pattern")
    uses = uses.withColumn("uses", F.when(F.col("size") > 0, F.col("rounds") + F.col("extra")).otherwise(0))
    return uses.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("size") * F.col("uses")).cast("long").alias("taken"), F.col("uses").cast("int").alias("uses"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the mix: all columns of docs, each row as often as the mix uses it."""
    used = mix(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias("id"), "size", "uses")
    nth = F.row_number().over(Window.partitionBy("id", "size").orderBy(F.desc("uses")))
    used = used.withColumn("nth", nth).filter("uses > 0")
    own = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("own_id"), word_count(text_col).alias("own_size"))
    own = own.withColumn("own_nth", F.row_number().over(Window.partitionBy("own_id", "own_size").orderBy(F.lit(0))))
    found = own.join(used, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_size") == F.col("size")) & (F.col("own_nth") == F.col("nth")))
    return found.select("doc", F.explode(F.sequence(F.lit(1), F.col("uses")))).select("doc.*")
