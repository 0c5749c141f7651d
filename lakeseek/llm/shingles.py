"""Word shingles as 64-bit hashes, and signatures that any two similar sets share."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M1
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes | None, known: WordHash) -> np.ndarray:
    """Hashes of the words of a text: A-Z lowered, runs of bytes other than 32 and 9 to 13."""
    words = (text or b"").lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it has fewer words; empty without words."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    for i in range(min(k, len(h))):
        out = mixed(out * _M1 + h[i : i + n])
    return np.unique(out)


class Parts:
    """Pigeonhole signatures: two sets with 100 * intersection >= percent * union share at least one.

    Sizes fall into classes so that a set's partners lie in its own class or the next. Similar sets whose smaller one is in
    class c differ in at most diff(c) tokens; cut the hash range into more than diff(c) parts, and some part holds the same
    tokens in both. Each set signs the parts of its own class and, as the larger one, of the class before. A part without
    tokens is signed only by sets that have too few filled parts for the argument to hold without it.
    """

    def __init__(self, percent: int):
        self.percent, self.starts, self.cuts = percent, [1], {}

    def size_class(self, n: int) -> int:
        s = self.starts
        while s[-1] <= n:
            s.append(max(s[-1] + 1, (s[-1] - 1) * 100 // self.percent + 1))
        return int(np.searchsorted(s, n, "right")) - 1

    def _of(self, c: int) -> tuple[int, np.ndarray]:
        if c not in self.cuts:
            self.size_class(self.starts[-1] if c + 1 >= len(self.starts) else 1)
            diff = (self.starts[c + 1] - 1) * (100 - self.percent) // self.percent
            p = diff + diff // 10 + 2
            self.cuts[c] = diff, (np.arange(1, p, dtype=object) * 2**64 // p).astype(np.uint64)
        return self.cuts[c]

    def signatures(self, tokens: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """tokens: sorted, distinct, not empty. For the set's own class and the one before: uint64 signatures, and how many of them a similar set of that class must share."""
        own, out = self.size_class(len(tokens)), []
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(tokens * _M2 + _M1), dtype=np.uint64)))
        for c in (own, own - 1):
            if c < 0:
                continue
            diff, cuts = self._of(c)
            edges = np.concatenate(([0], np.searchsorted(tokens, cuts), [len(tokens)]))
            held = np.diff(edges)
            part = np.arange(len(held), dtype=np.uint64)
            keys = mixed(mixed(sums[edges[1:]] - sums[edges[:-1]] + held.astype(np.uint64)) + mixed(part * _M1 + np.uint64(c)))
            filled = held > 0
            # At most diff parts differ, and those that are empty here aren't signed.
            out.append((keys[filled], int(filled.sum()) - diff) if filled.sum() > diff else (keys, 1))
        return out


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    d = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return d & (2**63 - 1), (d >> 64) & (2**63 - 1)
