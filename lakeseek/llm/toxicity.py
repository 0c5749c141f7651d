"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary words each get a character model: the probability of a word's next letter after its last ORDER - 1 letters is the class's
own discounted count, backed off to a Kneser-Ney model of continuation counts that both classes share, so that expressions too rare in
a class are judged by what all texts have. A word's value is the toxic less the ordinary log-likelihood. Length-normalised, over the
whole text and over its most toxic stretch of WINDOW words, these values are the two inputs of a logistic curve.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeseek.llm.common import remainder, saved, scoped, worker_state

#: Labelled rows of each class that are learned from, at most: the classifier's sample bound.
MOST_ROWS = 20_000
ORDER, DISCOUNT, WINDOW = 6, 0.75, 1
#: Bounds of the two inputs.
MEANS, PEAKS = 5.0, 25.0
#: Letter runs below this share of all letters are left to the backoff, so that a model has at most ORDER / SHARE of them.
SHARE = 2.0**-21
MOST_WORDS = 400_000
_EDGE = "\x02"


def _letters(word: str) -> str:
    return f"{_EDGE}{word}{_EDGE}"


def _runs(word: str) -> list[str]:
    """The longest run of letters, of ORDER at most, that ends at each letter after the first edge."""
    x = _letters(word)
    return [x[:i] for i in range(2, min(ORDER, len(x)) + 1)] + [x[i : i + ORDER] for i in range(1, len(x) - ORDER + 1)]


class _Kept(dict):
    """What make gives for each key, kept until more than `most` are."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        v = self.make(key)
        if len(self) > self.most:
            self.clear()
        self[key] = v
        return v


def _word_counts(batches):
    """(text, toxic) -> (gram, toxic count, ordinary count) of a partition."""

    def out(counts):
        grams: tuple[dict, dict] = {}, {}
        for held, words in zip(grams, counts, strict=True):
            # The longest run at each letter, then the shorter ones that end there.
            longest: dict[str, int] = {}
            for w, n in words.items():
                for g in _runs(w):
                    longest[g] = longest.get(g, 0) + n
            for g, n in longest.items():
                for o in range(len(g)):
                    held[g[o:]] = held.get(g[o:], 0) + n
        every = list(grams[0].keys() | grams[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([g.get(e, 0) for e in every], pa.int64()) for g in grams)], names=["gram", "toxic", "ordinary"])

    counts = Counter(), Counter()
    for batch in batches:
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[0 if y else 1].update((t or "").lower().split())
        if len(counts[0]) + len(counts[1]) > MOST_WORDS:
            yield out(counts)
            counts = Counter(), Counter()
    yield out(counts)


class Model:
    """grams: letter run -> (toxic count, ordinary count)."""

    def __init__(self, grams: dict[str, tuple[int, int]]):
        self.own, self.shared, total = ({}, {}), {}, ({}, {})
        self.known, self.lower = _Kept(self.letter, 2 * MOST_WORDS), _Kept(self.backoff, MOST_WORDS)
        after: dict[str, int] = Counter()
        for g, pair in grams.items():
            for c in range(2):
                if pair[c]:
                    total[c][g[:-1]] = total[c].get(g[:-1], 0) + pair[c]
            # A continuation count: how many letters stand before the run; at a word's start, or at full length, how often it is met.
            n = sum(pair) if len(g) == ORDER or g[0] == _EDGE else 0
            if n:
                self.shared[g] = self.shared.get(g, 0) + n
            if len(g) > 1:
                self.shared[g[1:]] = self.shared.get(g[1:], 0) + 1
        letters = {g for g in grams if len(g) == 1}
        self.floor = 1 / (len(letters) + 2)
        kept: dict[str, float] = Counter()
        for g, n in self.shared.items():
            after[g[:-1]] += n
            kept[g[:-1]] += max(n - DISCOUNT, 0)
        self.after, self.back = dict(after), {x: 1 - kept[x] / after[x] for x in after}
        own_kept: tuple[dict, dict] = Counter(), Counter()
        for g, pair in grams.items():
            for c in range(2):
                if pair[c]:
                    self.own[c][g] = pair[c]
                    own_kept[c][g[:-1]] += max(pair[c] - DISCOUNT, 0)
        self.total, self.own_back = total, tuple({x: 1 - own_kept[c][x] / total[c][x] for x in total[c]} for c in range(2))

    def backoff(self, gram: str) -> float:
        """The shared probability of the last letter after the others."""
        p, x = self.lower[gram[1:]] if len(gram) > 1 else self.floor, gram[:-1]
        return max(self.shared.get(gram, 0) - DISCOUNT, 0) / self.after[x] + self.back[x] * p if x in self.after else p

    def letter(self, gram: str) -> float:
        """Toxic less ordinary log-likelihood of a run's last letter after the others."""
        lower = self.lower[gram[1:]] if len(gram) > 1 else self.floor
        p = []
        for c in range(2):
            n = self.total[c].get(gram[:-1], 0)
            p.append(max(self.own[c].get(gram, 0) - DISCOUNT, 0) / n + self.own_back[c][gram[:-1]] * lower if n else lower)
        return math.log(p[0] / p[1])

    def value(self, word: str) -> float:
        """Toxic less ordinary log-likelihood of a word, as natural logarithm."""
        out = 0.0
        for v in map(self.known.__getitem__, _runs(word)):
            out += v
        return out


def _features(shared, tag: str):
    """(row, text) -> (row, mean, peak)."""

    def run(batches):
        values = worker_state(tag, "values", lambda: _Kept(Model(shared.value).value, MOST_WORDS))
        of = values.__getitem__
        for batch in batches:
            means, peaks = [], []
            for t in batch.column(1):
                words = (t.as_py() or "").lower().split()
                v = np.fromiter(map(of, words), float, len(words))
                sums = np.concatenate(([0.0], np.cumsum(v)))
                w = min(WINDOW, len(v))
                means.append(float(sums[-1] / len(v)) if len(v) else 0.0)
                peaks.append(float((sums[w:] - sums[: len(sums) - w]).max() / WINDOW) if len(v) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(means, pa.float64()), pa.array(peaks, pa.float64())], names=["_row", "mean", "peak"])

    return scoped(run, tag)


def _with_features(docs: DataFrame, shared, tag: str) -> DataFrame:
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"), F.col("text").cast("string").alias("_text"))
    return row.mapInArrow(_features(shared, tag), row.select("_row").schema.add("mean", "double").add("peak", "double")).select("_row.*", "mean", "peak")


def _design(mean: np.ndarray, peak: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(mean), np.clip(mean, -MEANS, MEANS), np.clip(peak, 0, PEAKS), np.clip(peak, 0, PEAKS) ** 2 / PEAKS], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients, by Newton's method with a weak ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each document.

    Learned from labelled rows with crc32(doc_id as text) mod 5 other than 0: at most most_rows of each class (those first by a hash of their id); of
    them mod 5 = 4 fit the logistic curve, the others the models. Null ids or labels teach nothing; several labels of an id teach by the largest.
    Without both classes every score is the share of toxic labels (0 without labels). Null and empty texts have no words, both inputs 0, and are scored so.
    Rows stay apart whatever they repeat. An empty table gives no rows.
    """
    spark = docs.sparkSession
    fold = remainder(F.col("doc_id"), 5)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = marks.where(fold != 0)
    chosen = [named.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows) for c in (1, 0)]
    taught = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = taught.select(F.col("text").cast("string").alias("text"), "toxic", (fold == 4).alias("tunes"))
    grams = rows.where(~F.col("tunes")).select("text", "toxic").mapInArrow(scoped(_word_counts), "gram string, toxic long, ordinary long")
    grams = grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    letters = F.sum(F.when(F.length("gram") == 1, F.col("toxic") + F.col("ordinary")))
    grams = saved(grams)
    total = grams.agg(letters).first()[0] or 0
    kept = grams.where(F.col("toxic") + F.col("ordinary") >= max(2.0, total * SHARE)).toPandas()
    shared = spark.sparkContext.broadcast(dict(zip(kept["gram"], zip(kept["toxic"].tolist(), kept["ordinary"].tolist(), strict=True), strict=True)))
    tag = uuid.uuid4().hex
    tuned = _with_features(rows.where("tunes").select("text", "toxic"), shared, tag).toPandas()
    y = (tuned["toxic"].to_numpy() == 1).astype(float)
    if len(y) and 0 < y.sum() < len(y):
        w = _logistic(_design(tuned["mean"].to_numpy(), tuned["peak"].to_numpy()), y)
    else:
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-12), 1 - 1e-12)
        w = np.array([math.log(p / (1 - p)), 0.0, 0.0, 0.0])
    seen = _with_features(docs.select("doc_id", "text", (fold == 0).alias("held_out")), shared, tag)
    mean, peak = F.greatest(F.lit(-MEANS), F.least(F.lit(MEANS), "mean")), F.greatest(F.lit(0.0), F.least(F.lit(PEAKS), "peak"))
    z = F.lit(float(w[0])) + mean * float(w[1]) + peak * float(w[2]) + peak * peak / PEAKS * float(w[3])
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))
    return seen.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
