"""Locality-sensitive hashing of entities: MinHash over sets, hyperplanes over vectors, bands and votes.

An index is (grp, bucket, table_id, uri); Spark prunes it by grp when it is saved partitioned by grp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeseek.functions import similarity as sim

PRIME = 2_147_483_647


def shingles(values: Column, size: int) -> Column:
    """Ordered tuples of `size` elements, joined by a bar, without those whose elements are all equal; for size 1 the elements."""
    out = F.transform(values, lambda x: F.struct(x.alias("s"), x.alias("first"), F.lit(True).alias("same")))
    for _ in range(size - 1):
        grown = F.transform(out, lambda t: F.transform(values, lambda x: F.struct(F.concat_ws("|", t["s"], x).alias("s"), t["first"].alias("first"), (t["same"] & (t["first"] == x)).alias("same"))))
        out = F.flatten(grown)
    kept = F.filter(out, lambda t: ~t["same"]) if size > 1 else out
    return F.transform(kept, lambda t: t["s"])


def element_number(x: Column) -> Column:
    """A number for an element: the first seven hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long")


def minhash(values: Column, n: int) -> Column:
    """n values min over x of (a_i x + b_i) mod PRIME, with a_i = 2i + 1 and b_i = 7919 (i + 1); null for an empty set."""
    numbers = F.transform(values, lambda x: element_number(x) % PRIME)
    least = lambda i: F.array_min(F.transform(numbers, lambda x: (x * (2 * i + 1) + 7919 * (i + 1)) % PRIME))
    return F.when(F.size(values) > 0, F.array(*map(least, range(n))))


def projections(n: int, dim: int) -> list[list[int]]:
    """n directions of whole numbers from -4 to 4, never all zero, fixed by a rule."""
    return [[((i + 1) * 7919 + (j + 1) * 104_729 + (i + 1) * (j + 1) * 31) % 9 - 4 for j in range(dim)] for i in range(n)]


def hyperplane_bits(vec: Column, n: int, dim: int) -> Column:
    """n bits: whether the dot product with each direction is above 0."""
    zero = F.lit(0.0)
    return F.array(*(F.when(F.coalesce(sim.dot(vec, F.array(*(F.lit(float(x)) for x in p))), zero) > 0, 1).otherwise(0) for p in projections(n, dim)))


def bands(signature: Column, n: int, band: int, buckets: int, bits: bool = False) -> Column:
    """array<struct<grp, bucket>>: a bucket for each run of `band` values; the last run may be short."""
    key = sim.bit_band if bits else sim.fletcher
    return F.array(*(F.struct(F.lit(g).cast("long").alias("grp"), key(F.slice(signature, s + 1, band), buckets).alias("bucket")) for g, s in enumerate(range(0, n, band))))


def set_index(linked: DataFrame, sets: DataFrame, n: int = 30, band: int = 10, buckets: int = 300, size: int = 1, unimportant: DataFrame | None = None, key: str = "uri") -> DataFrame:
    """Index over sets (key, values); `unimportant` (element) are left out of the sets first. linked: table_id and the key."""
    if unimportant is not None:
        each = sets.select(key, F.explode("values").alias("e")).join(unimportant.select(F.col("element").alias("e")), "e", "left_anti")
        sets = each.groupBy(key).agg(F.sort_array(F.collect_set("e")).alias("values"))
    signed = sets.withColumn("sig", minhash(shingles(F.col("values"), size), n)).where("sig is not null")
    keyed = signed.select(key, F.inline(bands(F.col("sig"), n, band, buckets)))
    return linked.select("table_id", key).distinct().join(keyed, key).select("grp", "bucket", "table_id", key)


def vector_index(linked: DataFrame, vectors: DataFrame, n: int = 30, band: int = 10, buckets: int = 300, dim: int = 64, key: str = "uri") -> DataFrame:
    keyed = vectors.select(key, F.inline(bands(hyperplane_bits(F.col("vec"), n, dim), n, band, buckets, bits=True)))
    return linked.select("table_id", key).distinct().join(keyed, key).select("grp", "bucket", "table_id", key)


def lookup(index: DataFrame, keys: DataFrame, vote: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, table_id): tables met in at least `vote` groups. keys: (*by, grp, bucket)."""
    hits = index.select("grp", "bucket", "table_id").distinct().join(keys.select(*by, "grp", "bucket").distinct(), ["grp", "bucket"])
    return hits.groupBy(*by, "table_id").agg(F.count_distinct("grp").alias("votes")).where(F.col("votes") >= vote).drop("votes")


def insert(index: DataFrame, more: DataFrame) -> DataFrame:
    """The index with another one's entries."""
    return index.unionByName(more).distinct()


def remove(index: DataFrame, keys: DataFrame, key: str = "uri") -> DataFrame:
    return index.join(keys.select(key).distinct(), key, "left_anti")
