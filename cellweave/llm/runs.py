"""Periodic stretches of words: recursive splitting by frequency, then a lag scan of what survives.

A word of a run occurs at least as often in the run as the run has whole periods.  A word that occurs less often in
its segment therefore belongs to no run of that segment and splits it; segments too short for a run go, and the
others are counted again until no word splits.  Ordinary prose falls apart in a few rounds.  A surviving segment is
scanned by lag: a run of at least three periods holds two neighbouring blocks of one period that start at a multiple
of the lag, so only those blocks are compared (by hashes, n / lag of them for each lag, n log n in all), and a
match is followed to both ends word by word, which settles it exactly.  Texts are independent, so Spark spreads them
over tasks, nothing is shuffled, and a lost executor costs its tasks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import plain_text

#: Characters that are split together; bounds the memory of a task beyond its longest text.
BLOCK = 4_000_000
#: Lags up to this one are compared word by word over the whole segment.
SHORT = 16
#: Odd multiplier of the block hashes (any would do: hashes only choose what is compared).
BASE = np.uint64(0x9E3779B97F4A7C15)

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def surviving(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, shortest: int) -> list[tuple[int, int]]:
    """Segments in which every word occurs at least `least` times and that hold at least `shortest` words."""
    done: list[tuple[int, int]] = []
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    n_words = int(words.max(initial=0)) + 1
    while len(starts):
        size = ends - starts
        segment = np.repeat(np.arange(len(starts)), size)
        offset = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(len(segment)) - np.repeat(offset - starts, size)
        _, own, counts = np.unique(segment * n_words + words[place], return_inverse=True, return_counts=True)
        rare = counts[own] < least
        split = np.zeros(len(starts), bool)
        split[segment[rare]] = True
        done.extend(zip(starts[~split].tolist(), ends[~split].tolist()))
        # a piece lies between two splitting words, or between one and the edge of its segment
        cuts = np.concatenate([place[rare], starts[split] - 1, ends[split]])
        within = np.concatenate([segment[rare], np.flatnonzero(split), np.flatnonzero(split)])
        order = np.lexsort((cuts, within))
        cuts, within = cuts[order], within[order]
        same = within[1:] == within[:-1]
        starts, ends = cuts[:-1][same] + 1, cuts[1:][same]
        long = ends - starts >= shortest
        starts, ends = starts[long], ends[long]
    return done


def _reach(equal_from: np.ndarray, other: np.ndarray) -> int:
    """How many leading entries agree, by blocks of growing size."""
    done, step, n = 0, 64, len(equal_from)
    while done < n:
        differs = equal_from[done:done + step] != other[done:done + step]
        if differs.any():
            return done + int(differs.argmax())
        done, step = done + step, step * 4
    return n


def runs_of(words: np.ndarray, shortest: int = 24, periods: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch with smallest period p and length >= max(shortest, periods * p)."""
    n, found = len(words), []
    # end of the furthest run found so far over each word; blocks inside one repeat a smaller period
    covered = np.zeros(n, np.int64)

    def keep(first: int, last: int, lag: int) -> None:
        """Words first..last-1 equal those a lag later."""
        end = last + lag
        if end - first >= max(shortest, periods * lag) and covered[first] < end:
            found.append((first, end - first, lag))
            np.maximum(covered[first:end], end, out=covered[first:end])

    for lag in range(1, min(SHORT, n // periods) + 1):
        same = np.concatenate([[0], (words[lag:] == words[:-lag]).astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(same))
        first, last = turns[::2], turns[1::2]
        wide = last - first + lag >= max(shortest, periods * lag)
        for a, b in zip(first[wide].tolist(), last[wide].tolist()):
            keep(a, b, lag)
    if n // periods > SHORT:
        power = np.full(n + 1, BASE)
        power[0] = 1
        power = np.multiply.accumulate(power)
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * power[:-1], dtype=np.uint64)])
        for lag in range(SHORT + 1, n // periods + 1):
            blocks = np.diff(total[::lag])
            at = 0
            for k in np.flatnonzero(blocks[:-1] * power[lag] == blocks[1:]).tolist():
                i = k * lag
                if i < at or covered[i] >= i + 2 * lag:
                    continue
                last = i + _reach(words[i:n - lag], words[i + lag:])
                first = i - _reach(words[:i][::-1], words[lag:i + lag][::-1])
                at = last
                keep(first, last, lag)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _split(texts: list[str | None], shortest: int, periods: int) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """Runs and the text without their repetitions, for each text."""
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    known: dict[bytes, int] = {}
    number = [known.setdefault(w, len(known)) for own in words for w in own]
    ids = np.array(number, np.int64)
    ends = np.cumsum([len(own) for own in words], dtype=np.int64)
    starts = ends - np.array([len(own) for own in words], np.int64)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in surviving(ids, starts, ends, periods, shortest):
        doc = int(np.searchsorted(ends, a, "right"))
        found = runs_of(ids[a:b], shortest, periods)
        runs.setdefault(doc, []).extend((a - int(starts[doc]) + s, n, p) for s, n, p in found)
    for doc, own in enumerate(words):
        mine = sorted(runs.get(doc, ()), key=lambda r: (r[0], r[2]))
        if mine:
            dropped = np.zeros(len(own), bool)
            for s, n, p in mine:
                dropped[s + p:s + n] = True
            own = [w for w, gone in zip(own, dropped.tolist()) if not gone]
        yield mine, b" ".join(own).decode("utf-8", "surrogatepass")


def _run_batches(batches: Iterator[pa.RecordBatch], shortest: int, periods: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, start = batch.column(1).to_pylist(), 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (held < BLOCK or end == start):
                held += len(texts[end] or "")
                end += 1
            runs, collapsed = zip(*_split(texts[start:end], shortest, periods))
            shown = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], pa.array(shown, pa.list_(RUN)), pa.array(collapsed, pa.string())],
                                             ["doc_id", "runs", "collapsed"])
            start = end


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 24, periods: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, runs (array of start, length, period; by start, then period), collapsed.

    Words are maximal runs without ASCII white space, numbered from 0.  A run is a maximal stretch with smallest period
    p and at least max(shortest, periods * p) words.  `collapsed` is the text without the words that some run holds
    after its first p words, joined by single spaces.  Null and empty texts have no words: no runs, an empty string.
    Whole texts are read, however long.  Repeated rows and null ids are rows like any other, runs of equal start come
    by period, other columns are ignored whatever their names, and an empty table gives an empty result.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain_text(text_col).alias("text"))
    return given.mapInArrow(partial(_run_batches, shortest=shortest, periods=periods),
                            "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: str = "runs") -> Column:
    """The run of greatest exact length / period, then smallest start, then smallest period; null without runs."""
    def better(a: Column, b: Column) -> Column:
        # runs come by start, then period: a later one wins only if it is strictly stronger
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.aggregate(F.col(runs), F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where every tenth id by checksum has its words repeated from some place on.

    With h = crc32 of the decimal id and g = h div 10, a text of n > 0 words with h % 10 = 0 keeps its words up to
    a = g % n, and goes on with the p = 1 + (n - a) div (3 + g % 8) words from there over and over, n words in all.
    Other texts, and those of null ids, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(plain_text(text_col), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    root = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), 1, n - a)
    changed = F.when(n > 0, F.concat_ws(" ", F.slice(words, 1, a), tail)).otherwise("")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.when(h % 10 == 0, changed).otherwise(plain_text(text_col)).alias("text"))
