"""Language identification by bit-sliced Bloom filters over character n-grams.

Slot i of the filters is a mask with a bit for each language. An n-gram's languages are the AND of the masks at its slots: one look
finds all languages that contain it. A text's score for a language is the share of its n-grams with that bit, corrected for the
filter's false positives: (share - f) / (1 - f), with f the filter's fill to the power of the number of hashes.

A language contains an n-gram if it makes up at least FLOOR of the language's n-grams (so that a filter holds at most 1 / FLOOR of
them, whatever the input) and its share there is at least a RIVAL-th of its largest share in any language.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import remainder, saved, scoped, worker_state

LEAST_ORDER, ORDER, FLOOR, RIVAL = 3, 4, 2.0**-15, 6
SLOTS, HASHES = 1 << 19, 3
MOST_WORDS = 300_000
UNKNOWN = "und"


def _grams(word: str) -> list[str]:
    """n-grams of a word's letters, LEAST_ORDER to ORDER long, within its padded form."""
    parts = [word] if word.isalpha() else "".join([c if c.isalpha() else " " for c in word]).split()
    out = []
    for part in parts:
        w = f"_{part}_"
        n = len(w)
        for o in range(LEAST_ORDER, min(ORDER, n) + 1):
            out += [w[i : i + o] for i in range(n - o + 1)]
    return out


def _slots(gram: str) -> list[int]:
    d = xxhash.xxh3_128_intdigest(gram.encode())
    return [(d >> (40 * i)) % SLOTS for i in range(HASHES)]


def _gram_counts(batches):
    """(text, lang) -> (lang, gram, n): counts of a partition."""
    words: dict[str, Counter] = {}
    for batch in batches:
        for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update((t or "").lower().split())
        if sum(map(len, words.values())) > 2 * MOST_WORDS:
            yield _as_grams(words)
            words = {}
    yield _as_grams(words)


def _as_grams(words: dict[str, Counter]) -> pa.RecordBatch:
    out: list[tuple[str, str, int]] = []
    for lang, counts in words.items():
        grams: Counter = Counter()
        for w, n in counts.items():
            for g in _grams(w):
                grams[g] += n
        out += [(lang, g, n) for g, n in grams.items()]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], names=["lang", "gram", "n"])


class Filters:
    def __init__(self, languages: list[str], members: list[tuple[str, str]]):
        self.languages = languages
        at = {x: i for i, x in enumerate(languages)}
        self.masks = np.zeros((SLOTS, max(1, -(-len(languages) // 8))), np.uint8)
        for lang, gram in members:
            i = at[lang]
            self.masks[_slots(gram), i // 8] |= 1 << (i % 8)
        filled = np.unpackbits(self.masks, axis=1, bitorder="little")[:, : len(languages)]
        self.false = (filled.mean(0) if len(languages) else np.zeros(0)) ** HASHES


def learn_filters(docs: DataFrame) -> Filters:
    """Filters from the documents' text and non-null lang. What reaches the driver is bounded: 1 / FLOOR n-grams a language."""
    rows = docs.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(scoped(_gram_counts), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = saved(counts)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= FLOOR)  # total: a row for each language
    kept = share.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") * RIVAL >= F.col("most"))
    members = [(r[0], r[1]) for r in kept.select("lang", "gram").collect()]
    # A language whose texts have no letters has no filter and is never answered.
    return Filters(sorted({m[0] for m in members}), members)


#: Bits of a lane in which a text's n-grams are counted; a number holds one lane for each language and one for all n-grams.
LANE = 48


def _predicted(filters, key: str):
    def run(batches):
        languages, masks, false = filters.value
        n_langs = len(languages)
        lane = (1 << LANE) - 1
        words, grams = worker_state(key, "language", lambda: ({}, {}))

        def gram_lanes(gram: str) -> int:
            mask = np.bitwise_and.reduce(masks[_slots(gram)], axis=0)
            at = np.flatnonzero(np.unpackbits(mask, bitorder="little")[:n_langs]).tolist()
            return sum(1 << (LANE * i) for i in at) + (1 << (LANE * n_langs))

        def learn(missing):
            if len(words) + len(missing) > MOST_WORDS:
                words.clear()
            if len(grams) > MOST_WORDS:
                grams.clear()
            for w in missing:
                total = 0
                for g in _grams(w):
                    x = grams.get(g)
                    if x is None:
                        x = grams[g] = gram_lanes(g)
                    total += x
                words[w] = total

        for batch in batches:
            langs, scores = [], []
            for t in batch.column(1):
                text = (t.as_py() or "").lower().split()
                total = 0
                for s in range(0, len(text), 100_000):
                    part = text[s : s + 100_000]
                    try:
                        total += sum([words[w] for w in part])
                    except KeyError:
                        learn({w for w in part if w not in words})
                        learn({w for w in part if w not in words})  # if room was made for the others
                        total += sum([words[w] for w in part])
                n = total >> (LANE * n_langs)
                if not n or not n_langs:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                hits = np.array([(total >> (LANE * i)) & lane for i in range(n_langs)], float)
                share = np.clip((hits / n - false) / (1 - false), 0, 1)
                best = int(share.argmax())
                langs.append(languages[best])
                scores.append(float(share[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["_row", "lang_pred", "score"])

    return scoped(run, key)


def predict_language(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """The documents' columns and lang_pred, score (0 to 1: corrected share of the n-grams that the language contains).

    `und` with score 0 if the text is null or has no letter, or no language was learned. Of languages with equal scores the first by
    name is taken. Columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    schema = row.select("_row").schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks, filters.false))  # SLOTS masks: a fixed size for each 8 languages
    return row.mapInArrow(_predicted(shared, uuid.uuid4().hex), schema).select("_row.*", "lang_pred", "score")


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents with crc32(doc_id as text) mod 4 other than 2.

    A null doc_id has no remainder: it is not held out and is learned from. An empty table gives no rows.
    """
    fold = remainder(F.col("doc_id"), 4)
    filters = learn_filters(docs.where(fold != 2))
    rows = docs.select("doc_id", (fold == 2).alias("held_out"), "text")
    return predict_language(rows, filters).select("doc_id", "held_out", "lang_pred", "score")
