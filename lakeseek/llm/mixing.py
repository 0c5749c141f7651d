"""Mixing sources to target weights along a time-varying curriculum.

Each source has a word target and a weight schedule over training time t in [0, 1]: target * (1 + ramp * (2t - 1)), whose integral up
to t is its cumulative demand target * (t + ramp * (t*t - t)). A source's documents stand in a random but fixed order, over and over; a
copy whose middle word is the x-th one of that row is asked for at the time when demand reaches x, and is left out if it never
does; then one document's copy more or less brings each source nearest to its target. Sorting all copies by that time gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.llm.common import numbered, saved, settled

#: Slices of a source over which its running word count is split, so that a hot source is no single task.
SLICES = 512


def cycle_weight(rank: Column) -> Column:
    """1, 2, 3, repeating."""
    return ((rank - 1) % 3 + 1).cast("double")


def cycle_ramp(rank: Column) -> Column:
    """Falling, even, rising weight, repeating."""
    return ((rank - 1) % 3 - 1).cast("double") * 0.5


def source_targets(sizes: DataFrame, most: float = 3.0, weight=cycle_weight, ramp=cycle_ramp) -> DataFrame:
    """sizes: (source, source_size), one row per source. Adds rank, target and ramp.

    Targets are in proportion to the weights and sum to all sizes, but none exceeds `most` times its source's size; what is above goes
    to the others by weight: target = least(most * size, level * weight), with the level that makes the sum right.
    """
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_rank)).withColumn("weight", weight(F.col("rank"))).withColumn("top", most * F.col("source_size")).withColumn("fills", F.col("top") / F.col("weight"))
    w = Window.orderBy("fills", "rank")
    s = s.withColumn("full", F.coalesce(F.sum("top").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("rest", F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)))
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / F.col("rest"))
    # The first source, in order of the level that fills it, that is not filled.
    s = s.withColumn("level", F.coalesce(F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "rank", "level"))).over(every)["level"], F.lit(0.0)))
    return s.select("source", "source_size", F.least("top", F.col("level") * F.col("weight")).alias("target"), ramp(F.col("rank")).alias("ramp"))


def _row_keys(docs: DataFrame, seed: int) -> list[Column]:
    """128 bits of a whole row (k0, k1), and 64 of its id and text (h), by which a source's documents are ordered."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    keys = [F.xxhash64(F.lit(seed + i), *cols).alias(f"k{i}") for i in range(2)]
    return [*keys, F.xxhash64(F.lit(seed), "doc_id", F.col("text").cast("string"), keys[0]).alias("h")]


def mix_plan(docs: DataFrame, seed: int = 5, most: float = 3.0, weight=cycle_weight, ramp=cycle_ramp) -> DataFrame:
    """One row per document: doc_id, k0, k1, source, size, source_size, target, copies int, taken long, positions array<double>.

    size counts the runs of bytes other than 32 and 9 to 13 (0 for a null or empty text). copies is how often the mix takes the
    document, taken = copies * size, positions the times of the copies. A null source is a source, the last one. k0 and k1 tell rows
    that differ in any column apart; rows that are alike in all are counted each. Other columns are not read. An empty table gives no rows.
    """
    t = F.col("text").cast("string")
    # Word starts: a byte that isn't white space at the start or behind white space.
    size = F.coalesce(F.regexp_count(t, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), *_row_keys(docs, seed), size.alias("size"))
    rows = saved(numbered(rows)).withColumn("h", F.xxhash64("h", "copy")).withColumn("slice", F.pmod(F.shiftright("h", 20), F.lit(SLICES)).cast("int"))
    sums = saved(rows.groupBy("source", "slice").agg(F.sum("size").alias("m")))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(sums.groupBy("source").agg(F.sum("m").alias("source_size")), most, weight, ramp)
    starts = sums.withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0))).join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "m").withColumnsRenamed({"source": "_s", "slice": "_l"})
    upto = Window.partitionBy("source", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(upto)).join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_l"))).drop("_s", "_l")
    middle = F.col("start") + F.col("upto") - F.col("size") / 2
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int")
    copies = (whole + F.when(middle < F.col("target") - whole * F.col("source_size"), 1).otherwise(0)).cast("int")
    rows = saved(rows.withColumn("copies", copies).withColumn("whole", whole).withColumn("middle", middle).drop("upto", "start"))
    # A source misses its target by less than a document: the one document whose copy more, or less, mends that best is changed.
    part = rows.groupBy("source", "slice").agg(F.max("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("m"))
    gap = part.groupBy("source").agg((F.max("target") - F.sum("m")).alias("gap"))
    gaps = part.select("source", "slice").join(gap.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("slice").alias("_l"), "gap")
    more = F.when(F.col("copies") > F.col("whole"), -1).when(F.col("copies") + 1 <= most, 1).otherwise(0)
    mends = rows.join(gaps, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_l"))).withColumn("more", more)
    mends = mends.withColumn("gain", F.abs("gap") - F.abs(F.col("gap") - F.col("more") * F.col("size"))).where("gain > 0")
    best = mends.groupBy("source").agg(F.max(F.struct("gain", F.col("h").alias("_h"), F.col("more").alias("_more"))).alias("x")).select("x._h", "x._more", F.col("source").alias("_s"))
    # Of rows alike in all, one is changed.
    first = F.row_number().over(Window.partitionBy("source", "slice", "h").orderBy("middle")) == 1
    rows = rows.withColumn("first", first).join(best, (F.col("h") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_s")) & F.col("first"), "left")
    rows = rows.withColumn("copies", (F.col("copies") + F.coalesce("_more", F.lit(0))).cast("int"))

    def time(i: Column) -> Column:
        x = F.coalesce(F.least(F.try_divide(F.col("middle") + i * F.col("source_size"), F.col("target")), F.lit(1.0)), F.lit(0.0))
        a = F.col("ramp")
        return F.when(a == 0, x).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * x) - (1 - a)) / (2 * F.when(a != 0, a)))

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), time)).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "k0", "k1", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), positions.alias("positions"))


def curriculum(docs: DataFrame, seed: int = 5, **more) -> DataFrame:
    """The documents as the mix takes them, with their own columns, a row per copy, range-sorted by training position."""
    plan = settled(lambda: mix_plan(docs, seed, **more).where("copies > 0").select("k0", "k1", F.explode("positions").alias("_at")))
    # Rows alike in all columns are one row here, with all their positions.
    k0, k1, _ = _row_keys(docs, seed)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), k0.alias("_k0"), k1.alias("_k1")).dropDuplicates(["_k0", "_k1"])
    taken = rows.join(plan, (F.col("_k0") == F.col("k0")) & (F.col("_k1") == F.col("k1"))).select("_row", "_at", "_k0", "_k1")
    return taken.repartitionByRange("_at", "_k0", "_k1").sortWithinPartitions("_at", "_k0", "_k1").select("_row.*")
