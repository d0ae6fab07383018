"""Word shingles as 64-bit hashes, for blocks of texts at a time inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIER = np.uint64(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound so that memory stays flat."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: bytes | None, memo: WordHashes) -> np.ndarray:
    """Hashes of the lower-case (A-Z only) words; bytes.split() splits at exactly the six ASCII white spaces."""
    words = (text or b"").lower().split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def shingle_set(hashes: np.ndarray, length: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `length` words; of all words as one, if there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(length, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = out * MULTIPLIER + hashes[i:n - k + 1 + i]
    return np.unique(mix64(out))


def blocks(sets: Iterable[tuple], size: int = 400_000) -> Iterator[list[tuple]]:
    """Groups (key, set) pairs so that a block holds about `size` elements."""
    block, held = [], 0
    for item in sets:
        block.append(item)
        held += len(item[-1])
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block
