"""Stores and sinks: vectors, indexes, triples, results; a reader registry and a persistent configuration."""

from __future__ import annotations

import dataclasses
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "jdbc")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "/tmp/checkpoints"
    return f"{found}/{name}-{uuid.uuid4().hex}"


class VectorStore:
    """(uri, vec) under one path, in any file format of FORMATS, or a JDBC table given by its options."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet", **options: str):
        if kind not in FORMATS:
            raise ValueError(f"a store is one of {FORMATS}")
        self.spark, self.path, self.kind, self.options = spark, path, kind, options

    def insert(self, vectors: DataFrame) -> None:
        vectors.select("uri", "vec").write.format(self.kind).options(**self.options).mode("append").save(*([] if self.kind == "jdbc" else [self.path]))

    def read(self) -> DataFrame:
        reader = self.spark.read.format(self.kind).options(**self.options)
        return reader.load() if self.kind == "jdbc" else reader.schema("uri string, vec array<double>").load(self.path)

    def lookup(self, *uris: str) -> DataFrame:
        """Point or batch lookup; the filter reaches the scan."""
        return self.read().where(F.col("uri").isin(*uris))

    def lookup_all(self, uris: DataFrame) -> DataFrame:
        """Rows of `uris` (uri) with their vectors; vec is null where there is none."""
        return uris.join(self.read(), "uri", "left")

    def migrate(self, path: str, kind: str | None = None) -> VectorStore:
        other = VectorStore(self.spark, path, kind or self.kind, **self.options)
        other.insert(self.read())
        return other

    def remove(self, uris: DataFrame) -> DataFrame:
        """What remains without the given uris."""
        return self.read().join(uris, "uri", "left_anti")


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder for each part of an index."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def mention_triples(postings: DataFrame) -> DataFrame:
    """(value): <table> mentions <entity>, one for each distinct pair."""
    return postings.select("table_id", "uri").distinct().select(F.format_string("<http://thetable.org/wikitables/%s> <https://schema.org/mentions> <%s> .", F.col("table_id").cast("string"), "uri").alias("value"))


def type_triples(postings: DataFrame) -> DataFrame:
    """(value): <table> is a table, one for each distinct table."""
    return postings.select("table_id").distinct().select(F.format_string("<http://thetable.org/wikitables/%s> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <https://schema.org/Table> .", F.col("table_id").cast("string")).alias("value"))


def page_url(title):
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(title, F.lit(" "), F.lit("_")))


def result_json(results: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, value): a result's JSON, its tables by falling score. results: query_id, table_id, score; titles: table_id, title."""
    rows = results.join(titles, "table_id", "left")
    entry = F.struct((-F.col("score")).alias("_by"), F.col("table_id").cast("string").alias("tableID"), F.col("score"), F.col("title").alias("pgTitle"), page_url(F.col("title")).alias("tableURL"))
    grouped = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("s"))
    scores = F.transform("s", lambda x: F.struct(x["tableID"].alias("tableID"), x["score"].alias("score"), x["pgTitle"].alias("pgTitle"), x["tableURL"].alias("tableURL")))
    return grouped.select("query_id", F.to_json(F.struct(scores.alias("scores"))).alias("value"))


def query_json(queries: DataFrame) -> DataFrame:
    """(query_id, value): the JSON of a query from its (query_id, tuple_id, pos, uri)."""
    tuples = queries.groupBy("query_id", "tuple_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "uri"))), lambda x: x["uri"]).alias("t"))
    rows = tuples.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("tuple_id", "t"))), lambda x: x["t"]).alias("queries"))
    return rows.select("query_id", F.to_json(F.struct("queries")).alias("value"))


@dataclasses.dataclass
class Settings:
    """Configuration kept in a JSON file; saved values win over defaults."""

    store: str = "parquet"
    store_path: str = ""
    vectors: int = 30
    band: int = 10
    threads: int = 4
    log_level: str = "WARN"

    @classmethod
    def load(cls, path: str) -> Settings:
        saved = {}
        if os.path.exists(path):
            with open(path) as f:
                saved = json.load(f)
        return cls(**{k: v for k, v in saved.items() if k in {f.name for f in dataclasses.fields(cls)}})

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(dataclasses.asdict(self), f, indent=1)
