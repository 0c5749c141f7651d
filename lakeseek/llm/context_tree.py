"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each of the 255 decision nodes has a tree of contexts, the last 0 to DEPTH bytes whatever they are; a context
estimates its decision by Krichevsky-Trofimov counts, and every depth is mixed: P(context) = (KT + product over longer contexts) / 2. Counts come
from all training texts. A context is kept as a node if it was seen KEEP times at least; the others below the same node form one node together, so
nothing is lost, and the tree grows with the corpus. Texts are scored under the trained tree, with an end symbol (byte 255, which UTF-8 never has)
that also stands before each text.

The tree is never in one place. Texts are dealt by hash into blocks of about BLOCK bytes; a block's distinct n-grams go to the buckets of the
last two bytes of their contexts, which hold whole subtrees. Only depths 0 to 2 meet on the driver. Buckets send each block the logs of its n-grams.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import remainder, saved, scoped, worker_state

DEPTH, KEEP = 6, 2
#: Text bytes of a block, positions counted at once, and buckets at least.
BLOCK, CHUNK, BUCKETS = 24_000_000, 4_000_000, 256
#: Depth of the contexts that buckets are made of.
TOP = 2
#: Words whose share of the tokens is at least this are broadcast, 1 / WORD_SHARE at most; the others are joined.
WORD_SHARE = 2.0**-18
END = -1  # the end token's key
_EDGE = b"\xff"
MOST_KEYS = 300_000


def _word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def _stretches(text: bytes) -> list[bytes]:
    """A text's words with the space behind each, cut at spaces only; the edge marks a text's first and last one."""
    out = text.split(b" ")
    out[0] = _EDGE + out[0]
    out[-1] += _EDGE
    return out


def _text_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts and their ends: itself and the DEPTH bytes before as one number, the latest byte lowest; and where each text starts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    code = np.frombuffer(b"".join([x for t in texts for x in (_EDGE * DEPTH, t, _EDGE)]), np.uint8).astype(np.int64)
    for n in (1, 2, 3):  # two, four and seven bytes; of seven the middle one is in both
        longer = code[:-n] << 8 * n
        longer |= code[n:]
        code = longer
    start = np.cumsum(lengths) - lengths
    keep = np.ones(len(code), bool)
    for i in range(DEPTH):  # what begins before a text, less the first one's edges
        keep[(start + DEPTH * np.arange(len(texts)))[1:] - 1 - i] = False
    return code[keep], start


def _codes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a text from its stretches, and each code's stretch."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
    lengths[0] -= 1
    lengths[-1] -= 1
    return _text_codes([b" ".join(keys)[1:-1]])[0], np.repeat(np.arange(len(keys)), lengths)


def _words(batches):
    """Texts -> (code, n): word tokens of a partition."""
    words, ends = Counter(), 0

    def out():
        code = np.array([*map(_word_key, words), END], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.array([*words.values(), ends], np.int64))], names=["code", "n"])

    for batch in batches:
        for t in batch.column(0).cast(pa.binary()):
            words.update((t.as_py() or b"").lower().split())
            ends += 1
            if len(words) > MOST_KEYS:
                yield out()
                words, ends = Counter(), 0
    yield out()


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their n."""
    if not len(codes):
        return codes, n
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(n, first)


def _counts_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    codes = _text_codes(texts)[0]
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as differences, byte by byte: nearly all are zero, for the shuffle's compression."""
    return np.diff(x, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(len(x), 8).T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, len(x) // 8).T).view("<i8").ravel())


def _bucket(codes: np.ndarray, n: int) -> np.ndarray:
    return ((codes >> 8) & 0xFFFF) * 40503 % 65521 % n


def _counted(n_buckets: int):
    """Rows (block, held_out, text) sorted by block -> (bucket, block, codes, counts): a block's distinct n-grams, counted in what is learned from."""

    def merged(parts):
        """One part of several, which are left empty so that none of them outlives its use."""
        if len(parts) == 1:
            return parts.pop()
        codes = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        parts.clear()
        return _summed(codes, n)

    def out(block, parts):
        codes, n = merged(parts)
        bucket = _bucket(codes, n_buckets)
        order = np.argsort(bucket, kind="stable")
        codes, n = codes[order], n[order]
        which, first = np.unique(bucket[order], return_index=True)
        cut = [slice(a, b) for a, b in zip(first, [*first[1:], len(codes)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.full(len(which), block)), pa.array([_packed(codes[c]) for c in cut], pa.binary()), pa.array([_packed(n[c]) for c in cut], pa.binary())], names=["bucket", "block", "codes", "counts"])

    def run(batches):
        at, parts, waiting, size = None, [], ([], []), 0

        def count():
            for held_out in (0, 1):
                if waiting[held_out]:
                    codes, n = _counts_of(waiting[held_out])
                    parts.append((codes, n * (1 - held_out)))
                    del codes, n
                    waiting[held_out].clear()
            # Sorted parts are merged at once: chunks share most n-grams, and all chunks' together are several times a block's.
            parts[:] = [merged(parts)] if parts else []

        for batch in batches:
            for block, held_out, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                if block != at:
                    count()
                    if parts:
                        yield out(at, parts)
                    at, parts, size = block, [], 0
                text = (t.as_py() or b"").lower()
                waiting[held_out].append(text)
                size += len(text) + 1
                if size > CHUNK:
                    count()
                    size = 0
        count()
        if parts:
            yield out(at, parts)

    return run


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log gamma(n + 1/2), by Stirling's series shifted to where it is exact to 1e-12."""
    x = n + 0.5
    shift = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        shift -= np.where(small, np.log(np.maximum(x, 0.5)), 0)
        x = np.where(small, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) + shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma_half(zeros) + _log_gamma_half(ones) - _log_gamma_half(zeros + ones + 0.5) - math.log(math.pi)


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts [context, byte] -> zeros and ones at each of the 255 nodes [context, node], first bit first."""
    zeros, ones = [], []
    for level in range(8):
        c = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(3)
        zeros.append(c[:, :, 0])
        ones.append(c[:, :, 1])
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


def _byte_logs(ones: np.ndarray) -> np.ndarray:
    """Probability of a one at each node -> log10 probability of each byte."""
    out, at = np.zeros((len(ones), 1)), 0
    for level in range(8):
        p = ones[:, at : at + (1 << level)]
        at += 1 << level
        out = np.stack((out + np.log10(1 - p), out + np.log10(p)), 2).reshape(len(ones), 2 << level)
    return out.astype(np.float32)


class Tree:
    """contexts[d]: sorted codes of the kept contexts of d bytes; logs[d][i, byte]: log10 probability of a byte there, where no longer kept context fits."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """grams[d]: context codes, bytes and counts of the kept contexts of d bytes."""
        self.contexts, dense = [], []  # dense: counts of each byte, as single floats are too coarse for them
        for context, byte, n in grams:
            codes, where = np.unique(context, return_inverse=True)
            c = np.zeros((len(codes), 256))
            np.add.at(c, (where, byte), n)
            self.contexts.append(codes)
            dense.append(c)
        if not len(self.contexts[0]):
            self.contexts[0], dense[0] = np.zeros(1, np.int64), np.zeros((1, 256))
        depth = len(grams) - 1
        parent = [None] + [np.searchsorted(self.contexts[d - 1], self.contexts[d] & ((1 << (8 * (d - 1))) - 1)) for d in range(1, depth + 1)]
        mixed_log, kt, own, rest = [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1)
        for d in range(depth, -1, -1):
            n = len(dense[d])
            mixed_log[d], kt[d], own[d], rest[d] = np.empty((n, 255)), *(np.empty((n, 255), np.float32) for _ in range(3))
            left, below = dense[d], np.zeros((n, 255))
            if d < depth and len(self.contexts[d + 1]):
                left = left.copy()
                np.subtract.at(left, parent[d + 1], dense[d + 1])
                np.add.at(below, parent[d + 1], mixed_log[d + 1])
            for s in range(0, n, 1024):
                part = slice(s, s + 1024)
                zeros, ones = _decisions(dense[d][part])
                estimate = _log_kt(zeros, ones)
                kt[d][part] = (ones + 0.5) / (zeros + ones + 1)
                if d == depth:
                    mixed_log[d][part], own[d][part], rest[d][part] = estimate, 1, kt[d][part]
                    continue
                z, o = _decisions(np.maximum(left[part], 0))
                rest[d][part] = (o + 0.5) / (z + o + 1)
                mixed = np.logaddexp(estimate, below[part] + _log_kt(z, o)) - math.log(2)
                mixed_log[d][part], own[d][part] = mixed, np.exp(np.minimum(estimate - math.log(2) - mixed, 0))
            if d < depth:
                dense[d + 1] = mixed_log[d + 1] = None
        self.logs, upto, left_over = [], None, None
        for d in range(depth + 1):
            before = upto[parent[d]] if d else 0.0
            weight = left_over[parent[d]] if d else 1.0
            upto = before + weight * own[d] * kt[d]
            left_over = weight * (1 - own[d])
            self.logs.append(_byte_logs(np.clip(upto + left_over * rest[d], 1e-12, 1 - 1e-12)))

    def score(self, keys: list[bytes]) -> list[float]:
        """log10 probability of each stretch's bytes (less the first DEPTH)."""
        code, of = _codes(keys)
        byte, context = code & 255, code >> 8
        at = np.zeros(len(code), np.int64)
        out = self.logs[0][0, byte].astype(np.float64)
        live = np.arange(len(code))
        for d in range(1, len(self.contexts)):
            held = self.contexts[d]
            if not len(held) or not len(live):
                break
            want = context[live] & ((1 << (8 * d)) - 1)
            i = np.minimum(np.searchsorted(held, want), len(held) - 1)
            fits = held[i] == want
            live, at = live[fits], i[fits]
            out[live] = self.logs[d][at, byte[live]]
        return np.bincount(of, weights=out, minlength=len(keys)).tolist()


def _nodes(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decisions [byte, 8] on the way to each byte, 1 to 255, and their outcomes."""
    level = np.arange(8)
    return (1 << level) | (byte[:, None] >> (8 - level)), (byte[:, None] >> (7 - level)) & 1


def _mask(d: int) -> int:
    return (1 << (8 * d)) - 1


def _shorter(keys: np.ndarray, d: int) -> np.ndarray:
    """Keys (context and decision) of the contexts of d bytes that end the keys' contexts."""
    return ((keys >> 8) & _mask(d)) << 8 | keys & 255


def _place(held: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of want stands in held, which is in order, and whether it does."""
    if not len(held):
        return np.zeros(want.shape, np.int64), np.zeros(want.shape, bool)
    i = np.minimum(np.searchsorted(held, want), len(held) - 1)
    return i, held[i] == want


class Level:
    """The kept contexts of d bytes: keys (context and decision, those met only) with counts, and what the mixture makes of them."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, d: int, below: tuple | None = None):
        """codes, n: distinct n-grams of d + 1 bytes in order; below: keys and mixed of the contexts longer by one, and their n-grams that belong to none."""
        self.d = d
        context, total = _summed(codes >> 8, n)
        self.contexts = context[total >= KEEP] if d else np.zeros(1, np.int64)
        kept = _place(self.contexts, codes >> 8)[1]
        self.dropped = codes[~kept], n[~kept]
        self.keys, self.zeros, self.ones = self._tally(codes[kept], n[kept])
        self.log_kt = _log_kt(self.zeros, self.ones)
        self.rest_zeros, self.rest_ones = np.zeros(len(self.keys)), np.zeros(len(self.keys))
        self.mixed = self.log_kt
        if below is not None:
            keys, mixed, (codes, n) = below
            near, zeros, ones = self._tally(codes & _mask(d + 1), n)
            i, held = _place(self.keys, near)
            self.rest_zeros[i[held]], self.rest_ones[i[held]] = zeros[held], ones[held]
            longer = np.bincount(np.searchsorted(self.keys, _shorter(keys, d)), mixed, len(self.keys)) if len(keys) else 0.0
            self.mixed = np.logaddexp(self.log_kt, longer + _log_kt(self.rest_zeros, self.rest_ones)) - math.log(2)

    def _tally(self, codes, n):
        node, bit = _nodes(codes & 255)
        keys, of = np.unique(((codes >> 8) << 8)[:, None] | node, return_inverse=True)
        n = np.repeat(n.astype(np.float64), 8)
        return keys, *(np.bincount(of.ravel(), n * (bit.ravel() == b), len(keys)) for b in (0, 1))

    def below(self) -> tuple:
        return self.keys, self.mixed, self.dropped

    def weigh(self, shorter: Level | None) -> None:
        """p: probability of a one where no longer context is kept; half: where the decision was never met in the longer one."""
        kt = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        own = np.exp(np.minimum(self.log_kt - math.log(2) - self.mixed, 0)) if self.d < DEPTH else np.ones(len(kt))
        i = np.searchsorted(shorter.keys, _shorter(self.keys, self.d - 1)) if shorter else None
        upto, weight = (shorter.upto[i], shorter.left[i]) if shorter else (0.0, 1.0)
        self.upto, self.left = upto + weight * own * kt, weight * (1 - own)
        self.p = self.upto + self.left * (self.rest_ones + 0.5) / (self.rest_zeros + self.rest_ones + 1)
        self.half = self.upto + self.left * 0.5


def grow(codes: np.ndarray, n: np.ndarray, deepest: int, last: int, below: tuple | None = None) -> list[Level]:
    """Levels last to deepest of distinct n-grams of deepest + 1 bytes."""
    levels = []
    for d in range(deepest, last - 1, -1):
        codes, n = _summed(codes & _mask(d + 1), n)
        levels.append(Level(codes, n, d, below))
        below = levels[-1].below()
    return levels[::-1]


def _start(codes: np.ndarray, levels: list[Level]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What weighed levels make of n-grams of TOP bytes: mass of their decisions' outcomes and what is left [n-gram, 8], and their log10 probability there."""
    node, bit = _nodes(codes & 255)
    upto, left, p = np.zeros(node.shape), np.ones(node.shape), np.full(node.shape, 0.5)
    live = np.arange(len(codes))
    for level in levels:
        context = (codes[live] >> 8) & _mask(level.d)
        kept = _place(level.contexts, context)[1]
        live, context = live[kept], context[kept]
        i, met = _place(level.keys, context[:, None] << 8 | node[live])
        one, b = (bit[live] == 1), live
        if len(level.keys):
            rest = level.left[i]
            own = np.where(one, level.upto[i], 1 - rest - level.upto[i])
            chance = np.where(one, level.p[i], 1 - level.p[i])
            # A decision that was never met there is even.
            p[b] = np.where(met, chance, upto[b] + left[b] * 0.5)
            upto[b], left[b] = np.where(met, own, upto[b] + left[b] * 0.5), np.where(met, rest, 0.0)
        else:
            p[b] = upto[b] + left[b] * 0.5
    return upto, left, np.log10(np.clip(p, 1e-12, 1)).sum(1)


#: Log gammas of whole numbers and a half below this are looked up.
_SMALL = 4096
_TABLE = _log_gamma_half(np.arange(2.0 * _SMALL))


def _log_kt_near(own: np.ndarray, total: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a decision met so often, of those with the outcome own."""
    if not len(total) or total.max() < _SMALL:
        return _TABLE[own] + _TABLE[total - own] - _LOG_FACT[total] - math.log(math.pi)
    return _log_kt((total - own).astype(np.float64), own.astype(np.float64))


_LOG_FACT = _log_gamma_half(np.arange(_SMALL) + 0.5)


class Branches:
    """The contexts of d bytes of a bucket's n-grams in order, which is by context and byte, so that a decision's n-grams stand together.

    total[l]: how often decision l of each n-gram's byte was met in its context (total[8]: the n-gram itself); group[l]: a number for that decision in that
    context, heads[l]: each decision's first n-gram.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, d: int):
        self.d, self.codes = d, codes
        self.total, self.group, self.heads = [], [], []
        for level in range(8):
            key = codes >> (8 - level)
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(head, len(codes)))
            self.heads.append(head)
            self.group.append(np.repeat(np.arange(len(head)), size))
            self.total.append(np.repeat(np.add.reduceat(n, head), size))
        self.total.append(n)
        self.kept = self.total[0] >= KEEP

    def mix(self, deeper: Branches | None, up: np.ndarray | None) -> None:
        """kt, mixed and rest of each decision; up: where the deeper n-grams' endings stand here."""
        self.kt = [_log_kt_near(self.total[level + 1], self.total[level]) for level in range(8)]
        if deeper is None:
            self.mixed, self.rest = self.kt, None
            return
        alone = ~deeper.kept
        n = np.bincount(up[alone], deeper.total[8][alone], len(self.codes)).astype(np.int64)
        self.rest = [np.add.reduceat(n, h)[g] for h, g in zip(self.heads, self.group, strict=True)] + [n]
        self.mixed = []
        for level in range(8):
            head = deeper.heads[level]
            head = head[deeper.kept[head]]
            longer = np.bincount(self.group[level][up[head]], deeper.mixed[level][head], len(self.heads[level]))[self.group[level]]
            self.mixed.append(np.logaddexp(self.kt[level], longer + _log_kt_near(self.rest[level + 1], self.rest[level])) - math.log(2))

    def weigh(self, upto, left, logs) -> tuple:
        """From the shorter contexts' mass, rest and log10 probabilities of each n-gram to these contexts'."""
        upto, left, p = upto.copy(), left.copy(), np.empty_like(upto)
        for level in range(8):
            own = np.exp(np.minimum(self.kt[level] - math.log(2) - self.mixed[level], 0)) if self.rest else 1.0
            upto[:, level] += left[:, level] * own * (self.total[level + 1] + 0.5) / (self.total[level] + 1)
            left[:, level] *= 1 - own
            p[:, level] = upto[:, level] + left[:, level] * (self.rest[level + 1] + 0.5) / (self.rest[level] + 1) if self.rest else upto[:, level]
        return upto, left, np.where(self.kept, np.log10(np.clip(p, 1e-12, 1)).sum(1), logs)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and mixed of the decisions met in kept contexts, in order."""
        keys, mixed = [], []
        for level in range(8):
            head = self.heads[level]
            head = head[self.kept[head] & (self.total[level][head] > 0)]
            keys.append((self.codes[head] >> 8) << 8 | 1 << level | (self.codes[head] & 255) >> (8 - level))
            mixed.append(self.mixed[level][head])
        keys, mixed = np.concatenate(keys), np.concatenate(mixed)
        order = np.argsort(keys)
        return keys[order], mixed[order]


def branches(codes: np.ndarray, n: np.ndarray) -> tuple[list[Branches], list[np.ndarray]]:
    """Depths TOP to DEPTH of a bucket's n-grams, mixed; and where each depth's n-grams end in the shorter one."""
    parts, ups = [Branches(codes, n, DEPTH)], []
    for d in range(DEPTH - 1, TOP - 1, -1):
        short, up = np.unique(parts[-1].codes & _mask(d + 1), return_inverse=True)
        ups.append(up)
        parts.append(Branches(short, np.bincount(up, parts[-1].total[8], len(short)).astype(np.int64), d))
    for i, part in enumerate(parts):
        part.mix(parts[i - 1] if i else None, ups[i - 1] if i else None)
    return parts[::-1], ups[::-1]


def bucket_logs(codes: np.ndarray, n: np.ndarray, top: list[Level]) -> np.ndarray:
    """log10 probability of each n-gram's last byte after the others; top: weighed levels below TOP."""
    parts, ups = branches(codes, n)
    short, up = np.unique(parts[0].codes & _mask(TOP), return_inverse=True)
    state = [x[up] for x in _start(short, top)]
    for part, up in zip(parts, [*ups, None], strict=True):
        state = part.weigh(*state)
        if up is not None:
            state = [x[up] for x in state]
    return state[2]


class Index:
    """Numbers looked up by code: slots by a hash, the next one if it is taken."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(codes)).bit_length())
        self.codes, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        at = self._slot(codes)
        while len(codes):
            free = self.codes[at] == -1
            self.codes[at[free]] = codes[free]  # of several the last one stays
            here = self.codes[at] == codes
            self.values[at[here]] = values[here]
            codes, values, at = codes[~here], values[~here], (at[~here] + 1) & (len(self.codes) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, codes: np.ndarray) -> np.ndarray:
        at = self._slot(codes)
        out = self.values[at]
        left = np.flatnonzero(self.codes[at] != codes)
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.codes) - 1)
            out[left] = self.values[at]
            more = self.codes[at] != codes[left]
            left, at = left[more], at[more]
        return out


_MODEL, _HAS, _SHORT = 0, 1, 2


def _merged(batches):
    """Rows (bucket, block, codes, counts) sorted by bucket -> (bucket, kind, block, a, b).

    _MODEL: the bucket's n-grams and counts; _HAS: which of them a block has, as bits; _SHORT: its n-grams of TOP + 1 bytes, counted, and its keys of TOP bytes, mixed.
    """

    def out(bucket, held):
        codes, n = _summed(np.concatenate([c for _, c, _ in held]), np.concatenate([x for _, _, x in held]))
        level = branches(codes, n)[0][0]
        met = level.total[8] > 0
        keys, mixed = level.keys()
        rows = [(_MODEL, -1, _packed(codes), _packed(n)), (_SHORT, -1, _packed(level.codes[met]), _packed(level.total[8][met])), (_SHORT, -2, _packed(keys), mixed.tobytes())]
        for block, c, _ in held:
            has = np.zeros(len(codes), bool)
            has[np.searchsorted(codes, c)] = True
            rows.append((_HAS, block, np.packbits(has).tobytes(), b""))
        kind, block, a, b = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int64()), pa.array(kind, pa.int32()), pa.array(block, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["bucket", "kind", "block", "a", "b"])

    at, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, block, codes, n = (c[i].as_py() for c in batch.columns)
            if bucket != at and held:
                yield out(at, held)
                held = []
            at = bucket
            held.append((block, _unpacked(codes), _unpacked(n)))
    if held:
        yield out(at, held)


def _logs(shared):
    """Rows (bucket, kind, block, a, b) of _MODEL and _HAS sorted by bucket and kind -> (block, codes, logs)."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                _, kind, block, a, b = (c[row].as_py() for c in batch.columns)
                if kind == _MODEL:
                    codes = _unpacked(a)
                    logs = bucket_logs(codes, _unpacked(b), shared.value).astype(np.float32)
                    continue
                has = np.unpackbits(np.frombuffer(a, np.uint8), count=len(codes)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_packed(codes[has])], pa.binary()), pa.array([logs[has].tobytes()], pa.binary())], names=["block", "codes", "logs"])

    return run


def gram_logs(blocks: DataFrame, n_buckets: int) -> DataFrame:
    """(block, codes, logs): the log10 probabilities of the n-grams of each block of texts (block, held_out, text), in parts."""
    counted = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(scoped(_counted(n_buckets)), "bucket long, block long, codes binary, counts binary")
    merged = saved(counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(scoped(_merged), "bucket long, kind int, block long, a binary, b binary"))
    short = merged.where(f"kind = {_SHORT}").select("block", "a", "b").collect()
    grams = [(_unpacked(r[1]), _unpacked(r[2])) for r in short if r[0] == -1]
    keyed = [(_unpacked(r[1]), np.frombuffer(r[2])) for r in short if r[0] == -2]
    none = np.empty(0, np.int64), np.empty(0)
    codes, n = _summed(*(np.concatenate([none[j], *(g[j] for g in grams)]).astype(np.int64) for j in range(2)))
    keys, mixed = _summed(*(np.concatenate([none[j], *(k[j] for k in keyed)]) for j in range(2)))
    top = grow(codes, n, TOP - 1, 0, (keys, mixed, Level(codes, n, TOP).dropped))
    for shorter, level in zip([None, *top[:-1]], top, strict=True):
        level.weigh(shorter)
    shared = blocks.sparkSession.sparkContext.broadcast(top)
    parts = merged.where(f"kind <> {_SHORT}").repartition("bucket").sortWithinPartitions("bucket", "kind")
    return parts.mapInArrow(scoped(_logs(shared)), "block long, codes binary, logs binary")


def _scored(shared, tag: str):
    def run(batches):
        word_codes, word_logs, floor, known_end = shared.value
        frequent = worker_state(tag, "frequent", lambda: dict(zip(word_codes.tolist(), word_logs.tolist(), strict=True)))
        base = worker_state(tag, "base", dict)
        at, parts, held = None, [], None
        for batch in batches:
            blocks, is_text = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (is_text[1:] != is_text[:-1])))).tolist() if batch.num_rows else []
            for s, e in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if blocks[s] != at:
                    at, parts, held = blocks[s], [], None
                if not is_text[s]:
                    parts += [(_unpacked(c), np.frombuffer(x, np.float32)) for c, x in zip(batch.column(2).slice(s, e - s).to_pylist(), batch.column(3).slice(s, e - s).to_pylist(), strict=True)]
                    continue
                if held is None:
                    held, parts = Index(*(np.concatenate([p[j] for p in parts]) for j in range(2))), []
                for start in range(s, e, 500):
                    part = batch.slice(start, min(500, e - start))
                    texts = [(t.as_py() or b"").lower() for t in part.column(7).cast(pa.binary())]
                    code, first = _text_codes(texts)
                    score = np.add.reduceat(held.look(code).astype(np.float64), first).tolist()
                    length, n_tokens, n_known, sums, rare = [], [], [], [], []
                    for text, own in zip(texts, score, strict=True):
                        length.append(-own * math.log2(10) / (len(text) + 1))
                        words = text.split()
                        n_tokens.append(len(words) + 1)
                        known, total, rest = int(known_end is not None), known_end if known_end is not None else floor, Counter()
                        found = [base.get(w, 1.0) for w in words]
                        for i, x in enumerate(found):
                            if x == 1.0:
                                w = words[i]
                                if len(base) > MOST_KEYS:
                                    base.clear()
                                x = base[w] = frequent.get(_word_key(w), 2.0)
                                found[i] = x
                        if 2.0 in found:
                            rest.update(_word_key(w) for w, x in zip(words, found, strict=True) if x == 2.0)
                        often = [x for x in found if x != 2.0]
                        n_known.append(known + len(often))
                        sums.append(total + math.fsum(often))
                        rare.append([{"w": k, "n": n} for k, n in rest.items()])
                    yield pa.RecordBatch.from_arrays([*part.columns[4:7], pa.array(score, pa.float64()), pa.array(length, pa.float64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(rare, pa.list_(pa.struct([("w", pa.int64()), ("n", pa.int64())])))], names=["doc_id", "held_out", "row", "score", "code_length", "n_tokens", "n_known", "sums", "rare"])

    return scoped(run, tag)


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_length (bits for each byte, end included).

    Learned from the rows with crc32(doc_id as text) mod 5 other than 1 (a null doc_id has no remainder: learned from, not held out). score is the log10
    probability of the text, A-Z lowered, and its end. base_score is that of its words and end by their training counts. A null text is
    empty: one token, the end. Rows stay apart whatever they repeat. An empty table gives no rows; without training rows all tokens are unknown.
    """
    spark = docs.sparkSession
    fold, t = remainder(F.col("doc_id"), 5), F.col("text").cast("string")
    words = docs.where(fold != 1).select(t.alias("text")).mapInArrow(scoped(_words), "code long, n long")
    words = saved(words.groupBy(F.col("code").alias("w")).agg(F.sum("n").alias("c")).where("c > 0"))
    v, n = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    scale = n + 0.5 * (v + 1)
    log = lambda c: F.log10((c + F.lit(0.5)) / F.lit(scale))
    often = F.col("c") >= max(1.0, n * WORD_SHARE)
    frequent = words.where(often & (F.col("w") != END)).toPandas()
    end = words.where(f"w = {END}").first()
    as_log = lambda c: np.log10((c + 0.5) / scale)
    shared = spark.sparkContext.broadcast((frequent["w"].to_numpy(np.int64), as_log(frequent["c"].to_numpy(np.float64)), float(as_log(0.0)), float(as_log(end[1])) if end else None))
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(t) + F.lit(1)), F.lit(0))).first()[0]
    n_blocks = 1 + size // BLOCK
    row = F.xxhash64("doc_id", t)
    dealt = docs.select(F.pmod(row, F.lit(n_blocks)).alias("block"), "doc_id", (fold == 1).alias("held_out"), row.alias("row"), t.alias("text"))
    logs = gram_logs(dealt.select("block", "held_out", "text"), max(BUCKETS, 4 * n_blocks))
    lead = logs.select("block", F.lit(0).alias("is_text"), "codes", "logs", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("text"))
    rows = lead.unionByName(dealt.withColumns({"is_text": F.lit(1), "codes": F.lit(None).cast("binary"), "logs": F.lit(None).cast("binary")}))
    rows = rows.repartition("block").sortWithinPartitions("block", "is_text")
    rows = saved(rows.mapInArrow(_scored(shared, uuid.uuid4().hex), f"doc_id {kind}, held_out boolean, row long, score double, code_length double, n_tokens long, n_known long, sums double, rare array<struct<w:long,n:long>>"))
    # Rare words are looked up by a join; rows alike in all have the same sums, one of them asks.
    asked = rows.select("row", "rare").where(F.size("rare") > 0).select("row", F.explode("rare").alias("x")).select("row", "x.w", "x.n")
    found = asked.join(words.where(~often), "w", "left").select("row", F.col("n").alias("m"), (F.col("n") * log(F.coalesce("c", F.lit(0)))).alias("s"), F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("k"))
    sums = found.groupBy("row").agg(F.sum("m").alias("m"), F.sum("s").alias("s"), F.sum("k").alias("k"))
    # Of alike rows each has asked for all its rare words: a row's part is its own share.
    own = F.aggregate("rare", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = rows.withColumn("own", own).drop("rare").join(sums, "row", "left")
    share = F.coalesce(F.try_divide(F.col("own"), F.col("m")), F.lit(0.0))
    known = F.col("n_known") + F.round(F.coalesce(F.col("k") * share, F.lit(0.0))).cast("long")
    base = F.col("sums") + F.coalesce(F.col("s") * share, F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "code_length")
