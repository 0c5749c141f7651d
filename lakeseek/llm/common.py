"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found or "/tmp/checkpoints"


#: Rows of a batch sent to Python while saved() runs: texts can be long, and each task holds a batch outside the heap.
ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python in batches of ROWS rows from now on: for sessions that run these operators on whole documents."""
    spark.conf.set(_BATCH_CONF, str(ROWS))


#: Folders that saved() has written and settled() has yet to judge.
_WRITTEN: contextvars.ContextVar[list] = contextvars.ContextVar("written", default=[])  # noqa: B039


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakeseek-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH_CONF)
    spark.conf.set(_BATCH_CONF, str(ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_CONF, before)
    _WRITTEN.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes what saved() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("lakeseek-"):
                _delete(df.sparkSession, path)


def settled(make) -> DataFrame:
    """saved(make()), after which all else that make() saved is deleted: for results that are smaller than the steps to them."""
    outer = _WRITTEN.set([])
    try:
        out = saved(make())
        *steps, last = _WRITTEN.get()
    finally:
        _WRITTEN.reset(outer)
    for path in steps:
        _delete(out.sparkSession, path)
    _WRITTEN.get().append(last)
    release(out.sparkSession)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more; it finds them when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def to_planes(x: np.ndarray, n: int = 8) -> bytes:
    """The low n bytes of whole numbers, byte by byte: what they have in common is left to the shuffle's compression."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(len(x), 8)[:, :n].T).tobytes()


def from_planes(b: bytes, n: int = 8) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(n, len(b) // n).T
    return out.view("<i8").ravel()


#: Copies that one row stands for, at most, before they are told apart.
COPIES = 100_000


def numbered(df: DataFrame, name: str = "copy") -> DataFrame:
    """df with rows alike in all columns numbered from 0. They are counted before the shuffle, so that none of them is a hot key."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    held = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    part = held.withColumn("_part", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPIES})")))
    each = F.explode(F.expr(f"sequence(_part * {COPIES}, least(_n, (_part + 1) * {COPIES}) - 1)"))
    return part.withColumn(name, each).drop("_n", "_part")


def remainder(key: Column, n: int) -> Column:
    """crc32(key as text) mod n; -1 for a null key, so that it belongs to no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(n), F.lit(-1).cast("long"))


_STATE: dict = {}


def worker_state(tag: str, kind: str, make):
    """A value that a Python worker keeps between the tasks of one operator's run, which `tag` names."""
    forget(tag)
    if (tag, kind) not in _STATE:
        _STATE[tag, kind] = make()
    return _STATE[tag, kind]


def forget(tag: str = "") -> None:
    """Drops what the worker keeps of other runs."""
    for k in [k for k in _STATE if k[0] != tag]:
        del _STATE[k]


def _give_back() -> None:
    """Returns freed memory to the machine: idle workers share an executor with what runs next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def scoped(run, tag: str = ""):
    """run, in a worker that keeps nothing of other runs; where it keeps caches (a tag), the collector rests meanwhile, as they hold no cycles."""

    def inner(batches):
        forget(tag)
        if tag:
            gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            _give_back()

    return inner


class Bounded(dict):
    """A cache that starts anew once it holds `most` entries."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def make_room(self, n: int = 1) -> None:
        if len(self) + n > self.most:
            self.clear()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node reachable over the undirected edges. Nodes without edges are absent.

    Alternating large-star and small-star steps, each two joins on node; only counts and one checksum reach the driver.
    A hot node is a skewed join key, which AQE splits. Null endpoints and loops are left out.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    now = saved(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct())
    seen, old = None, None
    for _ in range(rounds):
        if old is not None:
            discard(old)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        old = now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        now = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        stars = now.join(least, "u")
        now = saved(stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    labels = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
