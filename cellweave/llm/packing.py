"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Documents become pieces inside tasks.  Only the histogram of piece lengths, at most one number for each length, goes
to the driver, where whole histogram cells are combined: for the longest length left, the gap of its sequence is
looked up among the single, pair and triple sums of the lengths that are still available, and as many sequences
as availability allows are filled exactly.  Lengths without an exact complement are placed best-fit afterwards.
The plan is a list of combinations with counts; pieces find their place from their rank within their length.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import cut, salted_rank

# Letters, digits and other signs of Latin scripts; texts with any other character go through the tokenizer whole.
LETTER = r"A-Za-zªµºÀ-ÖØ-öø-ſ"
DIGIT = r"0-9²³¹¼-¾"
BLANK = r"\t\n\r\x0b\x0c\x20"
FOREIGN = rf"[^{BLANK}\x21-\x7e¡-¬®-ſ–—‘-„…€]"
# The byte-level pre-tokenizer's published pattern with these classes.
PIECES = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{BLANK}{LETTER}{DIGIT}]+"
          rf"|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes; words are encoded once and remembered within a bound in bytes.

    Words met since the last turn stand in `known`, those of the turn before in `old`; when `known` has half the bound it
    becomes `old`, so that frequent words stay and a worker's memory does not grow.

    Byte-level BPE never merges across its pre-tokenizer's pieces, so a text's ids are those of its pieces in a row.
    """

    def __init__(self, tokenizer_json: str, bound: int = 64_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bound, self.held = bound, 0
        self.foreign, self.pieces = re.compile(FOREIGN), re.compile(PIECES)
        # fixed rule of byte-level BPE: printable bytes stand for themselves, the others for the signs from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - plain))}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    def of_process(tokenizer_json: str) -> Encoder:
        """The encoder that this Python worker keeps from task to task."""
        kept = sys.modules.setdefault("_llm_encoders", types.ModuleType("_llm_encoders"))
        name = f"e{zlib.crc32(tokenizer_json.encode())}_{len(tokenizer_json)}"
        if not hasattr(kept, name):
            setattr(kept, name, Encoder(tokenizer_json))
        return getattr(kept, name)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_word(self, word: str) -> bytes:
        """A single piece straight through the BPE model, in the alphabet that byte-level tokenizers give to bytes."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def _plain(self, text: str) -> bool:
        return not self.foreign.search(text) and not any(s in text for s in self.special)

    def __call__(self, texts: list[str], block: int = 2_000_000) -> Iterator[bytes]:
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (held < block or end == start):
                held += len(texts[end])
                end += 1
            words = [self.pieces.findall(t) if self._plain(t) else None for t in texts[start:end]]
            if self.held > self.bound // 2:
                self.old, self.known, self.held = self.known, {}, 0
            new = list(set(chain.from_iterable(w for w in words if w)).difference(self.known))
            found = map(self.old.get, new)
            made = [self._encode_word(w) if e is None else e for w, e in zip(new, found)]
            self.known.update(zip(new, made))
            # an entry's objects and its place in the table
            self.held += 220 * len(new) + sum(map(len, new)) + sum(map(len, made))
            get = self.known.__getitem__
            for text, own in zip(texts[start:end], words):
                yield self._encode([text])[0] if own is None else b"".join(map(get, own))
            start = end


def _piece_batches(batches: Iterator[pa.RecordBatch], tokenizer_json: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end = Encoder.of_process(tokenizer_json), np.array([end_id], "<u4").tobytes()
    for batch in batches:
        ids = batch.column(1).to_pylist()
        out: list[list] = [[], [], [], [], [], []]
        for row, doc, tokens in zip(batch.column(0).to_pylist(), ids, encode([t or "" for t in batch.column(2).to_pylist()])):
            data = tokens + end
            total = len(data) // 4
            start, length = 0, total % capacity or capacity
            piece = 0
            while start < total:
                part = (row, doc, piece, start, length, zlib.crc32(data[4 * start:4 * (start + length)]))
                for column, value in zip(out, part):
                    column.append(value)
                start, length, piece = start + length, capacity, piece + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
            ["row", "doc_id", "piece", "start", "length", "ids_crc32"])


class Complements:
    """Which lengths are available, and exact sums of one, two or three of them.

    The sets are bit masks: the pairs with a given sum are the lengths that coincide with the mirrored mask.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, defaultdict(int, {n: c for n, c in counts.items() if c > 0})
        self.mask = sum(1 << n for n in self.left)
        self.mirror = sum(1 << (capacity - n) for n in self.left)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            self.left[n] -= times
            if not self.left[n]:
                self.mask &= ~(1 << n)
                self.mirror &= ~(1 << (self.capacity - n))

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.left[n] // lengths.count(n) for n in lengths)

    def pair(self, total: int, most: int, held: tuple[int, ...]) -> tuple[int, int] | None:
        """The pair with this sum and the largest first length, at most `most`, that fits beside the held lengths."""
        found = self.mask & (self.mirror >> (self.capacity - total)) & ((1 << (most + 1)) - 1)
        found = found >> ((total + 1) // 2) << ((total + 1) // 2)
        while found:
            a = found.bit_length() - 1
            if self.times((*held, a, total - a)):
                return a, total - a
            found ^= 1 << a
        return None

    def fill(self, length: int) -> tuple[int, ...] | None:
        """Lengths that make `length` a full sequence: one, else two, else three."""
        gap = self.capacity - length
        if not gap:
            return ()
        if self.left[gap] and self.times((length, gap)):
            return (gap,)
        two = self.pair(gap, gap - 1, (length,)) if gap > 1 else None
        if two:
            return two
        firsts = self.mask & ((1 << max(gap - 1, 0)) - 1)
        while firsts:
            a = firsts.bit_length() - 1
            if 3 * a < gap:
                return None
            two = self.pair(gap - a, min(a, gap - a - 1), (length, a)) if self.times((length, a)) else None
            if two:
                return (a, *two)
            firsts ^= 1 << a
        return None


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths, each with the number of sequences that hold it."""
    plan, free, rest = [], Complements(counts, capacity), []
    for length in sorted(counts, reverse=True):
        while free.left[length]:
            found = free.fill(length)
            if found is None:
                rest.append((length, free.left[length]))
                free.take((length,), free.left[length])
                break
            own = (length, *found)
            times = free.times(own)
            free.take(own, times)
            plan.append((own, times))
    return plan + _best_fit(rest, capacity)


def _best_fit(rest: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Lengths from long to short, each into the sequences with the smallest gap that takes it."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    mask = 0

    def put(own: tuple[int, ...], times: int) -> None:
        nonlocal mask
        if times:
            gap = capacity - sum(own)
            gaps[gap].append((own, times))
            mask |= 1 << gap

    for length, count in rest:
        while count:
            fitting = mask >> length
            if not fitting:
                each = capacity // length
                put((length,) * each, count // each)
                put((length,) * (count % each), 1 if count % each else 0)
                break
            gap = length + (fitting & -fitting).bit_length() - 1
            own, times = gaps[gap].pop()
            if not gaps[gap]:
                mask &= ~(1 << gap)
            used = min(times, count)
            put(own, times - used)
            put((*own, length), used)
            count -= used
    return [x for group in gaps.values() for x in group]


def _places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset) in the order of ranks."""
    ranks, sequence, out = defaultdict(int), 0, defaultdict(list)
    for own, times in plan:
        offset = 0
        for length in own:
            out[length].append((ranks[length], sequence, offset))
            ranks[length] += times
            offset += length
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _place_batches(batches: Iterator[pa.RecordBatch], places: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for n in np.unique(lengths):
            here, rows = np.flatnonzero(lengths == n), places[int(n)]
            at = np.searchsorted(rows[:, 0], ranks[here], side="right") - 1
            sequence[here] = rows[at, 1] + ranks[here] - rows[at, 0]
            offset[here] = rows[at, 2]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
         end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and end_id (null text: end_id alone).  Longer ones than capacity are cut from their
    end, so that only the first piece may be shorter.  Repeated rows and null ids are packed like any other
    row; an empty table gives an empty result.  Columns besides id and text are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    pieces = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                             F.col(text_col).cast("string").alias("text"))
                 .mapInArrow(partial(_piece_batches, tokenizer_json=tokenizer_json, capacity=capacity, end_id=end_id),
                             "row long, doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    places = _places(pack_lengths(counts, capacity))
    ranked = salted_rank(pieces, ["length"], [F.col("row"), F.col("piece")], ["row", "piece"], "rank")
    return ranked.mapInArrow(partial(_place_batches, places=places), "doc_id long, piece int, start long, length long, "
                             "ids_crc32 long, sequence_id long, offset long")
