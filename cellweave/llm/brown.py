"""Language-model scores from a class-based bigram model (Brown classes found by exchange).

1. Every word of the training texts is counted, by 64-bit hash; text ends count as a word.
2. Texts are written once as numbers: places among the KNOWN most frequent words, and for other words their hash.
3. Exchange clustering on a matrix of fixed size starts the classes: units are the UNITS most frequent words, and POOLS
   pools that take all other words by their last bytes.  Units move between CLASSES classes while the likelihood of class
   bigrams grows.
4. Every other word of the training texts then gets a class of its own: Spark counts the classes before and after each
   word, and a word leaves its pool's class where that makes its neighbours likelier by more than naming a class costs.
   Only words that training never saw keep the class of their pool, for they have no neighbours.
5. A word's probability is that of its class after the class before (Witten-Bell smoothed) times its emission from
   the class (absolute discounting; what is freed goes to the class's unknown words).
6. Counts and classes of the KNOWN words travel with the job; all rarer words are grouped by text and meet theirs in a
   join, so that both are exact at any size of the vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import cut

UNITS, POOLS, CLASSES = 600, 128, 32
KNOWN = 2**18
#: Stands for the end of a text: no word holds a space.
END = b" "
#: Words remembered inside a task.
MEMORY = 150_000
#: Texts handled together inside a task, and neighbours counted before they are handed on.
TEXTS, NEIGHBOURS = 500, 250_000
#: Most rows that a task hands on at once: a batch stands in Python, on its way and in the JVM.
ROWS = 50_000
#: In sequences of classes: a word whose class is still to come from a join.
OPEN = 255


def _key(word: bytes) -> int:
    """Signed 64-bit hash."""
    value = xxhash.xxh3_64_intdigest(word)
    return value - 2**64 if value >= 2**63 else value


def _pool(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[-3:], seed=1) % POOLS


def _words(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, ROWS):
        yield batch.slice(first, ROWS)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(map(_key, counts), pa.int64()), pa.array(map(_pool, counts), pa.int32()),
                                          pa.array(counts.values(), pa.int64())], ["key", "pool", "n"])
        counts.clear()
        return out

    for part in _parts(batches):
        for text in part.column(0).to_pylist():
            counts.update(_words(text))
            if len(counts) > MEMORY:
                yield from _small(taken())
    if counts:
        yield from _small(taken())


class Lexicon(dict):
    """Word -> its place among the known words, or -1 - its place among the other words met, with their keys and pools."""

    def __init__(self, keys: np.ndarray):
        super().__init__()
        self.known = dict(zip(keys.tolist(), range(len(keys))))
        self.keys: list[int] = []
        self.pools: list[int] = []

    def __missing__(self, word: bytes) -> int:
        key = _key(word)
        code = self.known.get(key)
        if code is None:
            code = -1 - len(self.keys)
            self.keys.append(key)
            self.pools.append(_pool(word))
        self[word] = code
        return code

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMORY:
            for held in (self, self.keys, self.pools):
                held.clear()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def _encode_batches(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts as 32-bit numbers: the place of a known word, -1 - pool of another; `rare` has the others' keys in order."""
    lexicon = Lexicon(keys)
    for batch in _parts(batches):
        codes, rare = [], []
        for text in batch.column("text").to_pylist():
            code = lexicon.codes(_words(text))
            others = np.flatnonzero(code < 0)
            at = (-1 - code[others]).tolist()
            code[others] = [-1 - lexicon.pools[a] for a in at]
            codes.append(code.tobytes())
            rare.append([lexicon.keys[a] for a in at])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.int64()))],
                                         ["row", "doc_id", "held_out", "codes", "rare"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, TEXTS):
            yield batch.slice(first, TEXTS)


def _joined(column: pa.Array, kind: type) -> np.ndarray:
    """The numbers of several texts one after the other; every text ends with END, so the next one begins after it."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _of_code(codes: np.ndarray, known: np.ndarray, pools: np.ndarray) -> np.ndarray:
    """What `known` says of a known word and `pools` of the pool of another one."""
    return np.where(codes >= 0, known[np.maximum(codes, 0)], pools[np.maximum(-1 - codes, 0)])


def _pair_batches(batches: Iterator[pa.RecordBatch], kind: type, known: np.ndarray | None, pools: np.ndarray | None,
                  size: int) -> Iterator[pa.RecordBatch]:
    """Counts of (unit, next unit) as cells of a matrix; texts begin after the end of another, which is unit 0."""
    cells = np.zeros(size * size, np.int64)
    for part in _parts(batches):
        unit = _joined(part.column(0), kind)
        unit = (unit if known is None else _of_code(unit, known, pools)).astype(np.int64)
        if len(unit):
            cells += np.bincount(np.concatenate([[0], unit[:-1]]) * size + unit, minlength=size * size)
    full = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(cells[full])], ["cell", "n"])


def _matrix(rows: DataFrame, size: int, kind: type, known: np.ndarray | None = None, pools: np.ndarray | None = None) -> np.ndarray:
    """size x size counts of pairs over all rows, which hold sequences of numbers."""
    count = partial(_pair_batches, kind=kind, known=known, pools=pools, size=size)
    cells = rows.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most size * size rows
    out = np.zeros(size * size)
    out[cells.cell.to_numpy(np.int64)] = cells.n
    return out.reshape(size, size)


def _neighbour_batches(batches: Iterator[pa.RecordBatch], keys: np.ndarray, pool: np.ndarray, known: np.ndarray,
                       pools: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often each word that is no unit follows class n (cell n) and precedes it (cell CLASSES + n)."""
    names, wait, size = ["key", "pool", "cell", "n"], [], 0

    def taken() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(wait), return_counts=True)
        place, cell = np.divmod(found, 2 * CLASSES)
        wait.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys[place]), pa.array(pool[place].astype(np.int32)), pa.array(cell.astype(np.int32)),
                                           pa.array(n.astype(np.int64))], names)

    for part in _parts(batches):
        codes = _joined(part.column("codes"), np.int32)
        group = _of_code(codes, known, pools).astype(np.int64)
        before, after = np.concatenate([[0], group[:-1]]), CLASSES + np.concatenate([group[1:], [0]])
        at = np.flatnonzero(codes >= UNITS)
        if len(at):
            place = codes[at].astype(np.int64) * (2 * CLASSES)
            wait += [place + before[at], place + after[at]]
            size += 2 * len(at)
        if size > NEIGHBOURS:
            yield from _small(taken())
            size = 0
        at = np.flatnonzero(codes < 0)
        if len(at):
            key, own = part.column("rare").flatten(), pa.array((-1 - codes[at]).astype(np.int32))
            for side in (before, after):
                yield from _small(pa.RecordBatch.from_arrays([key, own, pa.array(side[at].astype(np.int32)), pa.array(np.ones(len(at), np.int64))], names))
    if wait:
        yield from _small(taken())


def _class_batches(batches: Iterator[pa.RecordBatch], gain: np.ndarray, pools: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Class of each word: the one that makes its neighbours likeliest, or its pool's if no other is better by the cost."""
    cost = np.log10(CLASSES)
    for part in _parts(batches):
        cells, pool = part.column("cells"), part.column("pool").to_numpy()
        first = cells.offsets.to_numpy()[:-1] - cells.offsets[0].as_py()
        flat = cells.flatten()
        cell, n = flat.field("cell").to_numpy(), flat.field("n").to_numpy()
        fit = np.add.reduceat(n[:, None] * gain[cell], first)
        fit[:, 0] = -np.inf
        fit[np.arange(len(fit)), pools[pool]] += cost
        count = np.add.reduceat(np.where(cell < CLASSES, n, 0), first)  # every occurrence follows one word
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(count), pa.array(fit.argmax(axis=1).astype(np.int32))], ["key", "c", "g"])


def exchange(bigrams: np.ndarray, fixed: int, classes: int, rounds: int = 12) -> np.ndarray:
    """Class of each unit; unit `fixed` alone makes class 0.  Ends when a round moves nothing."""
    def f(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1.0)), 0.0)

    size = len(bigrams)
    left, right = bigrams.sum(axis=1), bigrams.sum(axis=0)
    order = [u for u in np.argsort(-left, kind="stable") if u != fixed]
    label = np.zeros(size, np.int64)
    label[order] = 1 + np.arange(len(order)) % (classes - 1)
    one = np.zeros((size, classes))
    one[np.arange(size), label] = 1.0
    after, before = bigrams @ one, bigrams.T @ one  # by unit: counts of classes that follow and that precede
    table = one.T @ after
    for _ in range(rounds):
        moved = 0
        for u in order:
            old, own = label[u], bigrams[u, u]
            follow, precede = after[u].copy(), before[u].copy()
            follow[old] -= own
            precede[old] -= own
            table[old] -= follow
            table[:, old] -= precede
            table[old, old] -= own
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            diagonal = np.arange(classes)
            gain = (f(table + follow) - f(table)).sum(axis=1) + (f(table + precede[:, None]) - f(table)).sum(axis=0)
            now, d = table[diagonal, diagonal], f(table[diagonal, diagonal])
            gain += f(now + follow + precede + own) - d - (f(now + follow) - d) - (f(now + precede) - d)
            gain -= f(rows + left[u]) - f(rows) + f(columns + right[u]) - f(columns)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += follow
            table[:, new] += precede
            table[new, new] += own
            if new != old:
                moved += 1
                label[u] = new
                after[:, old] -= bigrams[:, u]
                after[:, new] += bigrams[:, u]
                before[:, old] -= bigrams[u]
                before[:, new] += bigrams[u]
        if not moved:
            break
    return label


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 of P(class | class before), Witten-Bell against the classes' own frequencies."""
    classes = len(table)
    own = (table.sum(axis=0) + 1.0) / (table.sum() + classes)
    kinds = np.maximum((table > 0).sum(axis=1, keepdims=True), 1)
    return np.log10((table + kinds * own) / (table.sum(axis=1, keepdims=True) + kinds))


def _known_batches(batches: Iterator[pa.RecordBatch], group: np.ndarray, counts: np.ndarray, base: np.ndarray, emitted: np.ndarray,
                   pools: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What known words give, the sequence of classes with the others OPEN, and those: keys, their pools' classes, times, spots."""
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "classes", "rare", "own", "times", "spots"]
    types = [None, None, None, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()),
             pa.list_(pa.int32()), pa.binary()]
    for part in _parts(batches):
        out: list[list] = [[] for _ in names[3:]]
        for text, keys in zip(part.column("codes").to_pylist(), part.column("rare")):
            codes = np.frombuffer(text, np.int32)
            often = codes >= 0
            place = codes[often]
            classes = np.full(len(codes), OPEN, np.uint8)
            classes[often] = group[place]
            rare, first, spots, times = np.unique(keys.values.to_numpy(), return_index=True, return_inverse=True, return_counts=True)
            values = (len(codes), int((counts[place] > 0).sum()), float(base[place].sum()), float(emitted[place].sum()), classes.tobytes(),
                      rare, pools[-1 - codes[~often][first]].astype(np.int32), times.astype(np.int32), spots.astype(np.int32).tobytes())
            for column, value in zip(out, values):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(c, t) for c, t in zip(out, types[3:])]], names)


def _fill_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the classes that the join found into the sequences; the last three columns are classes, spots and found."""
    for batch in _parts(batches):
        filled = []
        for text, spots, found in zip(*(batch.column(n).to_pylist() for n in ("classes", "spots", "found"))):
            classes = np.frombuffer(text, np.uint8)
            if found:
                classes = classes.copy()
                classes[classes == OPEN] = np.asarray(found, np.uint8)[np.frombuffer(spots, np.int32)]
            filled.append(classes.tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(filled, pa.binary())], [*batch.schema.names[:-3], "classes"])


def _step_batches(batches: Iterator[pa.RecordBatch], step: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds the steps from class to class to the score; the last columns are score and classes."""
    for part in _parts(batches):
        classes = _joined(part.column("classes"), np.uint8)
        steps = step[np.concatenate([np.zeros(1, np.uint8), classes[:-1]]), classes]
        sizes = part.column("n_tokens").to_numpy()
        moved = np.add.reduceat(steps, np.cumsum(sizes) - sizes)
        yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(part.column("score").to_numpy() + moved)], part.schema.names[:-1])


def _pick(values: np.ndarray, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + 1)


def brown_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Training rows (default: crc32 of the id as text modulo 10 is not 0) give all counts.  Null texts are empty and
    hold one end; a null id is scored and trains like an id whose remainder is not 0.  Without training rows, every
    word is unknown.  Repeated rows count and are scored each; an empty table gives an empty result.
    """
    remainder = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10))
    train = F.coalesce(remainder != 0, F.lit(True)) if train is None else train
    text = F.col(text_col).cast("string").cast("binary").alias("text")
    words = cut(docs.filter(train).select(text).mapInArrow(_count_batches, "key long, pool int, n long").groupBy("key")
                .agg(F.min("pool").alias("pool"), F.sum("n").alias("c")), "words")
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # the most frequent words by a threshold: a sort with a limit would send that many rows from every task
    band = F.floor(F.log2("c") * 64).cast("int")
    left, least = KNOWN, 2**31 - 1
    for r in sorted(words.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect(), reverse=True):  # at most 64 * 64 rows
        left, least = left - r.n, r.band if r.n <= left else least
        if left < 0:
            break
    top = words.filter((band >= least) | (F.col("key") == _key(END))).toPandas().sort_values(["c", "key"], ascending=[False, True])  # about KNOWN rows
    end, rest = top[top.key == _key(END)], top[top.key != _key(END)]
    keys = np.concatenate([[_key(END)], rest.key.to_numpy(np.int64)]).astype(np.int64)
    counts = np.concatenate([[end.c.sum()], rest.c.to_numpy(np.int64)]).astype(np.int64)
    pool = np.concatenate([[0], rest.pool.to_numpy(np.int64)]).astype(np.int64)
    place = np.arange(len(keys))

    facts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), (~train).alias("held_out"), text)
    coded = cut(facts.mapInArrow(partial(_encode_batches, keys=keys), "row long, doc_id long, held_out boolean, codes binary, rare array<long>"), "coded")
    taught = coded.filter(~F.col("held_out"))
    unit = np.where(place < UNITS, place, UNITS + pool)
    bigrams = _matrix(taught.select("codes"), UNITS + POOLS, np.int32, unit, UNITS + np.arange(POOLS))
    label = exchange(bigrams, 0, CLASSES)
    one = np.zeros((UNITS + POOLS, CLASSES))
    one[np.arange(UNITS + POOLS), label] = 1.0
    table = one.T @ bigrams @ one
    start, pools = label[unit], label[UNITS:]

    # every other word's own class
    step = transitions(table)
    gain = np.concatenate([step - np.log10(np.maximum(table.sum(axis=0), 1.0)), step.T])
    beside = taught.select("codes", "rare").mapInArrow(
        partial(_neighbour_batches, keys=keys, pool=pool, known=start, pools=pools), "key long, pool int, cell int, n long")
    beside = (beside.repartition("key").groupBy("key", "cell").agg(F.min("pool").alias("pool"), F.sum("n").alias("n"))
              .groupBy("key").agg(F.min("pool").alias("pool"), F.collect_list(F.struct("cell", "n")).alias("cells")))
    own = cut(beside.mapInArrow(partial(_class_batches, gain=gain, pools=pools), "key long, c long, g int"), "classes")
    moved = own.filter(band >= least).select("key", "g").toPandas()  # at most KNOWN rows
    group, order = start.copy(), np.argsort(keys)
    group[order[np.searchsorted(keys, moved.key.to_numpy(np.int64), sorter=order)]] = moved.g.to_numpy(np.int64)

    # words, kinds of words, and those seen once or twice, by class
    units = place[:UNITS]
    kinds, held, once, twice = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(kinds, group[units], 1.0)
    np.add.at(held, group[units], counts[units])
    for r in own.groupBy("g").agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("n1"),
                                  F.sum((F.col("c") == 2).cast("long")).alias("n2")).collect():  # at most CLASSES rows
        kinds[r.g], held[r.g], once[r.g], twice[r.g] = kinds[r.g] + r.v, held[r.g] + r.n, r.n1, r.n2
    discount = np.clip((once + 0.5) / (once + 2 * twice + 1.0), 0.1, 0.9)
    unknown = np.log10(np.maximum(discount * kinds, 0.1) / np.maximum(held, 1.0))
    held = np.maximum(held, 1.0)

    total = size.n + 0.1 * (size.v + 1)
    emits = np.where(counts > 0, np.log10(np.maximum(counts - discount[group], 0.1) / held[group]), unknown[group])
    known = partial(_known_batches, group=group, counts=counts, base=np.log10((counts + 0.1) / total), emitted=emits, pools=pools)
    scored = cut(coded.mapInArrow(
        known, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, classes binary, "
        "rare array<long>, own array<int>, times array<int>, spots binary"), "scored")
    rare = scored.select("row", F.posexplode(F.arrays_zip("rare", "own", "times")).alias("at", "x")).select(
        "row", "at", F.col("x.rare").alias("key"), F.col("x.own").alias("own"), F.col("x.times").alias("times"))
    c, g, times = F.coalesce("c", F.lit(0)), F.coalesce("g", "own"), F.col("times")
    emitted = F.when(c > 0, F.log10((c - _pick(discount, g)) / _pick(held, g))).otherwise(_pick(unknown, g))
    base = F.log10((c + F.lit(0.1)) / F.lit(total))
    sums = (rare.join(own.select("key", "c", "g"), "key", "left")
            .groupBy("row").agg(F.sum(times * base).alias("base_rare"), F.sum(times * emitted).alias("score_rare"),
                                F.sum(F.when(c > 0, times).otherwise(0)).alias("known_rare"),
                                F.sort_array(F.collect_list(F.struct("at", g.alias("g")))).getField("g").alias("found")))
    zero = F.lit(0.0)
    whole = scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("base_rare", zero)).alias("base_score"), (F.col("score") + F.coalesce("score_rare", zero)).alias("score"),
        "classes", "spots", "found")
    facts = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    whole = cut(whole.mapInArrow(_fill_batches, f"{facts}, classes binary"), "sequences")
    table = _matrix(whole.filter(~F.col("held_out")).select("classes"), CLASSES, np.uint8)
    return whole.mapInArrow(partial(_step_batches, step=transitions(table)), facts).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(size.n).cast("long").alias("train_tokens"), "base_score", "score")
