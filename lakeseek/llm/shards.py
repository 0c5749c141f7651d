"""Uniform sharding with exact shard sizes, by a hypergeometric communication matrix.

1. Rows are dealt into blocks by a hash. How many rows of each block go to each shard is drawn exactly: row sums are the
   blocks' counts, column sums the shards' sizes, each block a multivariate hypergeometric draw from what the shards still lack.
2. Within a block rows are put in a random order; the matrix's row cuts that order into shards.
3. Rows go to their shard and are put in a random order again, which gives their slots.

Only block counts (MOST_BLOCKS at most) reach the driver, and only the matrix (as many rows) is broadcast. No window holds more
than a block, or a slice of a shard. All randomness is a hash of the row and the seed, so a lost task repeats its rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import numbered, saved

LEAST_BLOCKS, MOST_BLOCKS, BLOCK_ROWS = 256, 16_384, 20_000
#: Up to so many rows numpy draws; beyond, hypergeometric().
NUMPY_ROWS = 10**9 - 1


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of `draws` rows taken out of good + bad rows are good, for any counts: rejection by the ratio of uniforms around the mode."""
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    log = lambda k: -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(draws - k + 1) + math.lgamma(bad - draws + k + 1))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    mean = draws * (good / total)
    spread = math.sqrt(mean * (bad / total) * ((total - draws) / (total - 1)) + 0.5)
    width, most = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e), log(mode)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log(k) - most:
            return k


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Random whole numbers with row sums `counts` and column sums `sizes`, as a uniform shuffle makes them."""
    rng, left, out = np.random.default_rng(seed), list(sizes), []
    for n in counts:
        if sum(left) <= NUMPY_ROWS:
            row = rng.multivariate_hypergeometric(np.array(left, np.int64), n, method="marginals").tolist()
        else:
            row, rest = [], sum(left)
            for x in left:
                rest -= x
                row.append(hypergeometric(x, rest, n, rng))
                n -= row[-1]
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def _slices(n: int) -> int:
    return max(LEAST_BLOCKS, min(MOST_BLOCKS, -(-n // BLOCK_ROWS)))


def uniform_shards(docs: DataFrame, n_shards: int = 40, seed: int = 11, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law is `rows`: shards' row counts differ by one at most. size is the text's UTF-8 bytes plus 16 (a null text has none, and
    checksum 0, that of no bytes). slot numbers a shard's rows from 0 without gaps. Rows that repeat id and text are still dealt one
    by one; which of them gets which slot is open, as they are alike. grown_shard is null: the law `rows` moves rows between
    shards when one is added. Null ids hash like any value. An empty table gives no rows.
    """
    spark = docs.sparkSession
    t = F.col(text).cast("string")
    key = lambda n: F.xxhash64(F.lit(seed * 3 + n), "doc_id", "h", "copy")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(t).alias("h"))
    rows = saved(numbered(rows))
    n = rows.count()
    blocks = _slices(n)
    placed = rows.withColumn("block", F.pmod(key(0), F.lit(blocks)).cast("int"))
    counts = dict(placed.groupBy("block").count().collect())
    order = sorted(counts)
    matrix = communication_matrix([counts[b] for b in order], [n // n_shards + (s < n % n_shards) for s in range(n_shards)], seed)
    ends = spark.createDataFrame([(b, np.cumsum(row).tolist()) for b, row in zip(order, matrix, strict=True)], "block int, ends array<long>")
    local = placed.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(key(1), "h", "doc_id", "copy")))
    sent = local.join(F.broadcast(ends), "block").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))).cast("int"))
    # A shard's second permutation: slices by hash, then a random order within each slice.
    slices = max(8, _slices(n) // n_shards)
    sent = saved(sent.select("doc_id", "size", "text_crc32", "h", "copy", "shard", F.pmod(key(2), F.lit(slices)).cast("int").alias("slice")))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("m")).select("shard", "slice", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "slice").orderBy(key(3), "h", "doc_id", "copy"))
    return sent.withColumn("within", within).join(starts, ["shard", "slice"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
