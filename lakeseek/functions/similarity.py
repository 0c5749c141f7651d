"""Similarities, distances and band hashes as Column expressions. All are JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product; null when the sizes differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, held within [-1, 1]; 0 for a zero vector; the longer vector is cut to the shorter one."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    norms = F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double")))) * F.sqrt(_sum(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.when(norms == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms)))


def norm_cosine(c: Column) -> Column:
    return (c + 1) / 2


def abs_cosine(c: Column) -> Column:
    return F.abs(c)


def angular(c: Column) -> Column:
    return 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) / F.pi()


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def weighted_jaccard(a: Column, b: Column, weights: Column) -> Column:
    """Weight of shared over weight of all elements; weights: map<element, double>; -1 or absent counts nothing; 0 without weight."""
    weigh = lambda xs: _sum(F.transform(xs, lambda x: F.when(weights[x] == -1, 0.0).otherwise(F.coalesce(weights[x], F.lit(0.0)))))
    total = weigh(F.array_union(a, b))
    return F.when(total == 0, 0.0).otherwise(weigh(F.array_intersect(a, b)) / total)


def adjusted(same: Column, s: Column) -> Column:
    """1 for the same entity, at most 0.95 otherwise."""
    return F.when(same, 1.0).otherwise(F.least(F.lit(0.95), s))


def weighted_distance(a: Column, b: Column, w: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), w, lambda d, v: d * v)))


def distance_similarity(d: Column) -> Column:
    return 1 / (d + 1)


def cosine_to_ones(v: Column) -> Column:
    """Cosine of a vector and the all-ones vector of its size; 0 for a zero vector."""
    norm = F.sqrt(_sum(F.transform(v, lambda x: x * x))) * F.sqrt(F.size(v))
    return F.when(norm == 0, 0.0).otherwise(_sum(v) / norm)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def hamming(a: Column, b: Column) -> Column:
    """Places where two arrays differ; null when the sizes differ."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x))


def concat_digits(a: Column, b: Column) -> Column:
    """The decimal digits of a, then those of b."""
    return (b + a * F.pow(F.lit(10.0), F.ceil(F.log10(b + 1))).cast("long")).cast("long")


def fletcher(values: Column, buckets: int) -> Column:
    """Two running sums modulo 255, the second times 256 plus the first, modulo the number of buckets."""
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(s, x):
        a = (s["a"] + x.cast("long")) % 255
        return F.struct(a.alias("a"), ((s["b"] + a) % 255).alias("b"))

    return F.aggregate(values, start, step, lambda s: (s["b"] * 256 + s["a"]) % buckets)


def bit_band(bits: Column, buckets: int) -> Column:
    """The number whose i-th bit is bits[i], modulo the number of buckets."""
    powers = F.transform(bits, lambda x, i: x.cast("long") * F.pow(F.lit(2.0), i).cast("long"))
    return F.aggregate(powers, F.lit(0).cast("long"), lambda s, x: s + x) % buckets
