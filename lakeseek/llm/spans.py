"""Substring dedup by sliding sentence spans.

Texts are cut into sentences, and sentences of over PIECE words before words whose hash is the least of the REACH words on either side, or
else after LONGEST words, so that a passage is cut alike wherever it stands, but for its first and last words. Every run of several consecutive pieces (RUN at least, and
MIN_WORDS words at least) is hashed to 104 bits. Runs are joined globally; all pieces covered by a run that is not the first one of its
kind (by doc_id, then text, then place) are removed from their text.

Texts are read once. Of the runs of a batch that are alike only the first goes to the join, packed with others of its bucket; the later
ones are known to go whatever other batches hold. So a passage that many documents share sends one row a batch.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.llm.common import from_planes, scoped, to_planes

PIECE, RUN, MIN_WORDS = 8, 3, 20
REACH, LONGEST = 3, 16
#: Text characters of a batch, text bytes of a bucket of runs, and buckets.
BATCH_CHARS, BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 3_000_000, 2 << 20, 64, 1 << 24
MOST_WORDS = 300_000
#: A sentence ends behind these, with white space or without.
_STOPS, _WIDE = ".!?", "。！？"
_WORD = re.compile(f"[^\\s{_WIDE}]*[{_WIDE}]|[^\\s{_WIDE}]+")
_BREAK = "\x00\u00b6\x00"  # stands for a line end
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LAST = 2**63 - 1


class Powers:
    """base ** i and base ** -i, modulo 2 ** 64."""

    def __init__(self):
        self.n, self.of = 0, []

    def upto(self, n: int) -> list:
        if n > self.n:
            self.n, self.of = max(1024, n + n // 8), []
            for base in _BASE:
                up, down = np.full(self.n, base, np.uint64), np.full(self.n, pow(base, -1, 2**64), np.uint64)
                up[0] = down[0] = 1
                self.of.append((np.cumprod(up, dtype=np.uint64, out=up), np.cumprod(down, dtype=np.uint64, out=down)))
        return self.of


class Words(dict):
    """word -> its row in the columns: two 64-bit hashes, and whether a sentence ends behind it."""

    def __init__(self):
        super().__init__()
        self.columns = array("Q"), array("Q"), array("b")

    def __missing__(self, word: str) -> int:
        d = xxhash.xxh3_128_intdigest(word)
        ends = word[-1] in _STOPS or word[-1] in _WIDE or word == _BREAK
        for column, x in zip(self.columns, (d & (2**64 - 1), d >> 64, ends), strict=True):
            column.append(x)
        n = self[word] = len(self.columns[0]) - 1
        return n

    def look(self, texts: list[str]) -> Pieces:
        if len(self) > MOST_WORDS:
            self.clear()
            self.columns = array("Q"), array("Q"), array("b")
        # Of one text at a time, as a word takes far more room than its row.
        held = [np.fromiter(map(self.__getitem__, _marked(t).split()), np.int32) for t in texts]
        lengths = [len(x) for x in held]
        at = np.concatenate(held) if held else np.empty(0, np.int32)
        del held
        one, two, ends = (np.frombuffer(c, k)[at] if len(at) else np.empty(0, k) for c, k in zip(self.columns, (np.uint64, np.uint64, bool), strict=True))
        return Pieces(np.repeat(np.arange(len(texts), dtype=np.int32), lengths), one, two, ends, at != self.get(_BREAK, -1), len(texts))


def _marked(text: str) -> str:
    """A text in lower case, with its line ends as words and a space behind each wide full stop."""
    text = text.lower()
    if any(c in text for c in _WIDE):
        for c in _WIDE:
            text = text.replace(c, c + " ")
    return text.replace("\n", f" {_BREAK} ") if "\n" in text else text


class Pieces:
    """The pieces of several texts. starts: where each begins among all their words; edges: the same and the end; of: its text; first, last: a text's pieces."""

    def __init__(self, of: np.ndarray, one: np.ndarray, two: np.ndarray, ends: np.ndarray, real: np.ndarray, n_texts: int):
        # A line end passes its sentence end on to the word before it.
        back = np.flatnonzero(real)
        stop = np.add.reduceat(ends.astype(np.int64), back) > 0 if len(back) else np.empty(0, bool)
        of, self.hashes = of[real], [one[real], two[real]]
        n = len(of)
        begins = np.ones(n, bool)
        begins[1:] = stop[:-1] | (of[1:] != of[:-1])
        sentence = np.cumsum(begins, dtype=np.int32) - 1
        long = np.bincount(sentence, minlength=1)[sentence] > PIECE
        h = self.hashes[0]
        least = long & ~begins
        for o in range(1, min(REACH, n - 1) + 1):
            same = sentence[o:] == sentence[:-o]
            least[o:] &= ~same | (h[o:] < h[:-o])
            least[:-o] &= ~same | (h[:-o] <= h[o:])
        cut = begins | least
        since = np.arange(n, dtype=np.int32)
        since -= np.maximum.accumulate(np.where(cut, since, 0))
        cut |= long & (since % LONGEST == 0)
        self.starts = np.flatnonzero(cut)
        self.edges = np.append(self.starts, n)
        self.of = of[self.starts]
        self.first = np.searchsorted(self.of, np.arange(n_texts))
        self.last = np.searchsorted(self.of, np.arange(n_texts), "right")

    def runs(self, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """k1, k2, the piece each run starts with and how many it has."""
        start = np.arange(len(self.starts))
        stop = np.maximum(start + RUN, np.searchsorted(self.edges, self.edges[start] + MIN_WORDS))
        whole = stop <= self.last[self.of]
        start, stop = start[whole], stop[whole]
        a, b, keys = self.edges[start], self.edges[stop], []
        for h, (up, down) in zip(self.hashes, powers.upto(len(self.hashes[0]) + 1), strict=True):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(h * up[: len(h)], dtype=np.uint64)))
            key = sums[b]
            key -= sums[a]
            del sums
            key *= down[a]
            key += (stop - start).astype(np.uint64)
            keys.append(key)
        return keys[0].view(np.int64), (keys[1] >> np.uint64(24)).astype(np.int64), start, stop - start


def piece_spans(texts: list[str], words: Words | None = None) -> list[list[tuple[int, int]]]:
    """Character spans of each text's pieces, from first to last word."""
    found = (words if words is not None else Words()).look(texts)
    edges, out = found.edges.tolist(), []
    for text, first, last in zip(texts, found.first.tolist(), found.last.tolist(), strict=True):
        spans = [m.span() for m in _WORD.finditer(text) if m.group().lower() != _BREAK]
        out.append([(spans[a - edges[first]][0], spans[b - edges[first] - 1][1]) for a, b in zip(edges[first:last], edges[first + 1 : last + 1], strict=True)])
    return out


_LEAD, _GONE = 0, 1


def _keyed(n_buckets: int):
    """(doc, mark, text) -> packed rows (bucket, kind, k1, k2, doc, mark, place): the first run of each kind in a batch, and those that stood in it before."""

    def out(docs: list, marks: list, texts: list, words: Words, powers: Powers):
        found = words.look(texts)
        k1, k2, start, length = found.runs(powers)
        of = found.of[start]
        place = (start - found.first[of]) << 6 | length
        doc, mark = np.array(docs, np.int64)[of], np.array(marks, np.int64)[of]
        order = np.lexsort((place, mark, doc, k2, k1))
        k1, k2, doc, mark, place = (x[order] for x in (k1, k2, doc, mark, place))
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.empty(0, np.int64)
        gone = (doc != doc[lead]) | (mark != mark[lead]) | (place >> 6 != place[lead] >> 6)
        bucket = (k1.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(np.where(new, bucket, -1), kind="stable")
        order = order[np.count_nonzero(~new) :]
        rows, cut = [], bucket[order]
        first = np.flatnonzero(np.concatenate(([True], cut[1:] != cut[:-1]))) if len(cut) else np.empty(0, np.int64)
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(cut)], strict=False):
            i = order[s:e]
            least = int(doc[i].min())
            rows.append((int(cut[s]), _LEAD, least, to_planes(k1[i]), to_planes(k2[i], 5), to_planes(doc[i] - least), to_planes(mark[i], 4), to_planes(place[i], 4)))
        if gone.any():
            rows.append((int(doc[gone][0] & 0xFFFF) % n_buckets, _GONE, 0, b"", b"", to_planes(doc[gone]), to_planes(mark[gone], 4), to_planes(place[gone], 4)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["bucket", "kind", "least", "k1", "k2", "doc", "mark", "place"])

    def run(batches):
        words, powers, held, size = Words(), Powers(), ([], [], []), 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                t = row[2].as_py()
                if not t:
                    continue
                for x, y in zip(held, (row[0], row[1], t), strict=True):
                    x.append(y)
                size += len(t)
                if size > BATCH_CHARS:
                    yield out(*held, words, powers)
                    held, size = ([], [], []), 0
        if held[0]:
            yield out(*held, words, powers)

    return scoped(run)


def _later(batches):
    """Packed rows sorted by bucket -> (doc, mark, place) of all runs that are not the first of their kind."""

    def out(parts):
        k1, k2, doc, mark, place = (np.concatenate([p[j] for p in parts]) for j in range(5))
        order = np.lexsort((place, mark, doc, k2, k1))
        k1, k2, doc, mark, place = (x[order] for x in (k1, k2, doc, mark, place))
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (doc != doc[lead]) | (mark != mark[lead]) | (place >> 6 != place[lead] >> 6)
        return table(doc[gone], mark[gone], place[gone])

    def table(*columns):
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["doc", "mark", "place"])

    at, parts = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, kind, least, k1, k2, doc, mark, place = (c[i].as_py() for c in batch.columns)
            if kind == _GONE:
                yield table(from_planes(doc), from_planes(mark, 4), from_planes(place, 4))
                continue
            if bucket != at and parts:
                yield out(parts)
                parts = []
            at = bucket
            parts.append((from_planes(k1), from_planes(k2, 5), from_planes(doc) + least, from_planes(mark, 4), from_planes(place, 4)))
    if parts:
        yield out(parts)


def strip_pieces(text: str, places: list[int], spans: list[tuple[int, int]]) -> tuple[str, int, list[tuple[int, int]]]:
    """The text, of pieces at the spans, without those that the places cover, their number, and the spans cut out."""
    gone = np.zeros(len(spans) + 1, np.int64)
    for p in places:
        start, length = p >> 6, p & 63
        gone[start] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    cut, out, at = [], [], 0
    for i in np.flatnonzero(gone).tolist():
        a, b = spans[i][0], spans[i + 1][0] if i + 1 < len(spans) else len(text)
        if cut and cut[-1][1] == a:
            cut[-1] = cut[-1][0], b
        else:
            cut.append((a, b))
    for a, b in cut:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]]), int(gone.sum()), cut


def _stripped(batches):
    words = Words()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts, flags = part.column(1).to_pylist(), part.column(2).to_pylist()
            held = iter(piece_spans([t for t, f in zip(texts, flags, strict=True) if f], words))
            out = [strip_pieces(t, f, next(held)) if f else (t, 0, []) for t, f in zip(texts, flags, strict=True)]
            spans = pa.array([[{"start": a, "end": b} for a, b in o[2]] for o in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), spans], names=["_row", "_text", "n_removed", "removed"])


def dedup_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' columns with repeated passages gone from the text, and n_removed (pieces), removed (spans of the old text).

    The first place of a run is the one in the smallest doc_id, of one doc_id's texts that with the smallest hash, and there the first; a null doc_id comes
    last. Rows alike in id and text are one document: both keep what it keeps. A null text stays null, an empty one empty; a text may become empty.
    Columns n_removed and removed are replaced. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("n_removed", "removed")]
    t = F.col(f"`{text}`").cast("string")
    key = [F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("doc"), F.shiftrightunsigned(F.coalesce(F.xxhash64(t), F.lit(0)), 33).alias("mark")]
    size = docs.agg(F.coalesce(F.sum(F.octet_length(t)), F.lit(0))).first()[0]
    n_buckets = int(max(LEAST_BUCKETS, min(MOST_BUCKETS, size // BUCKET_BYTES)))
    rows = docs.select(*key, t.alias("text")).mapInArrow(_keyed(n_buckets), "bucket long, kind int, least long, k1 binary, k2 binary, doc binary, mark binary, place binary")
    later = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(scoped(_later), "doc long, mark long, place long")
    flags = later.groupBy("doc", "mark").agg(F.collect_set("place").alias("places"))
    whole = docs.select(*key, F.struct(F.lit(True).alias("_keep_"), *(F.col(f"`{c}`") for c in names if c != text)).alias("_row"), t.alias("_text"))
    joined = whole.join(flags, ["doc", "mark"], "left").select("_row", "_text", "places")
    schema = joined.select("_row").schema.add("_text", "string").add("n_removed", "integer").add("removed", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer")))
    out = joined.mapInArrow(scoped(_stripped), schema)
    return out.select(*(F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in names), "n_removed", "removed")
