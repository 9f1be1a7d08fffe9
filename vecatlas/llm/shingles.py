"""Word shingles as 64-bit hashes, and the weighted Jaccard similarity of their multisets.

Words are the runs between ASCII blanks, with A-Z lowered. A text of fewer than five words (but
one at least) has the one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


class WordHashes(dict):
    """Hash of a word, remembered while a task sees it again; emptied when it has grown."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, words: WordHashes) -> np.ndarray:
    """The hashes of a text's shingles in order of place, repeats included."""
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=n)
    k = min(n, WORDS)
    with np.errstate(over="ignore"):
        s = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            s = s * np.uint64(0x9FB21C651E98DF25) + w[i : n - k + 1 + i] * _ODD[i]
    return mix(s)


def multiset(text: bytes, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their counts."""
    return np.unique(shingles(text, words), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser counts over the sum of the greater ones; 1 for two empty multisets."""
    (x, m), (y, n) = a, b
    total = int(m.sum() + n.sum())
    if not total:
        return 1.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x if len(y) else np.zeros(len(x), dtype=bool)
    common = int(np.minimum(m[same], n[at[same]]).sum())
    return common / (total - common)
