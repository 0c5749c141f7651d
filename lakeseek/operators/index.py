"""Corpus to index: linking, postings, weights, statistics and the knowledge graph's joins.

cells: table_id, row_id, col_id, text, links. linked: table_id, row_id, col_id, uri. edges: src, predicate, dst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIKI, KG = "http://www.wikipedia.org/", "http://dbpedia.org/"
THING, PERSON = "http://www.w3.org/2002/07/owl#Thing", "http://www.wikidata.org/entity/Q5"


def corpus_filter(tables: DataFrame, min_cols: int, min_rows: int, max_rows: int, numeric: bool = False) -> DataFrame:
    """Tables with enough columns, one header row at most and min..max data rows (no upper limit when max <= min)."""
    rows = F.col("numDataRows") >= min_rows
    if max_rows > min_rows:
        rows &= F.col("numDataRows") <= max_rows
    kept = tables.where((F.col("numCols") >= min_cols) & (F.col("numHeaderRows") <= 1) & rows)
    return kept.where(F.size("numericColumns") > 0) if numeric else kept


def first_mappings(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(link, uri) and (uri, link), each key with its first mapping by `seq`."""
    def first(key, value):
        return links.groupBy(key).agg(F.min_by(value, F.struct("seq", value)).alias(value))
    return first("link", "uri"), first("uri", "link")


def link_cells(cells: DataFrame, links: DataFrame) -> DataFrame:
    """linked: each cell's first link that maps; cells without one are left out. Each distinct link is looked up by one join."""
    asked = cells.select("table_id", "row_id", "col_id", F.posexplode("links").alias("at", "link"))
    return asked.join(links, "link").groupBy("table_id", "row_id", "col_id").agg(F.min_by("uri", "at").alias("uri"))


def strip_prefix(x: Column, prefix: str) -> Column:
    return F.when(x.startswith(prefix), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(x)


def primary_topics(edges: DataFrame) -> DataFrame:
    """(link, uri): page -> entity by relations whose name holds isPrimaryTopicOf."""
    return edges.where(F.contains("predicate", F.lit("isPrimaryTopicOf"))).select(F.col("dst").alias("link"), F.col("src").alias("uri")).distinct()


def entity_types(edges: DataFrame, disallowed: tuple[str, ...] = (THING, PERSON)) -> DataFrame:
    """(uri, types): an entity's distinct types, without the disallowed ones."""
    rows = edges.where(F.col("predicate") == "rdf__type").groupBy(F.col("src").alias("uri")).agg(F.sort_array(F.collect_set("dst")).alias("types"))
    return rows.select("uri", F.array_except("types", F.array(*map(F.lit, disallowed))).alias("types"))


def entity_predicates(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("uri")).agg(F.sort_array(F.collect_set("predicate")).alias("predicates"))


def entity_idf(linked: DataFrame, n_tables: Column | int) -> DataFrame:
    """(uri, idf): log10(tables / tables with the entity) + 1."""
    n = n_tables if isinstance(n_tables, Column) else F.lit(n_tables)
    return linked.groupBy("uri").agg(F.count_distinct("table_id").alias("df")).select("uri", (F.log10(n / F.col("df")) + 1).alias("idf"))


def type_idf(types: DataFrame) -> DataFrame:
    """(type, idf): log2(entities / entities of the type), over (uri, types)."""
    n = types.agg(F.count(F.lit(1)).alias("n"))
    freq = types.select("uri", F.explode(F.array_distinct("types")).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("f"))
    return freq.join(F.broadcast(n)).select("type", F.log2(F.col("n") / F.col("f")).alias("idf"))  # n is one row


def histogram(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.cast("long").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def table_stats(cells: DataFrame, linked: DataFrame) -> DataFrame:
    """Per table: rows, columns, cells, mapped cells, distinct entities, and entities of each row and column as text."""
    shape = cells.groupBy("table_id").agg(F.count_distinct("row_id").alias("n_rows"), (F.max("col_id") + 1).cast("long").alias("n_cols"), F.count(F.lit(1)).alias("n_cells"))
    # One pass over the linked cells, grouped by table and place.
    places = linked.select("table_id", F.explode(F.array(F.struct(F.lit("r").alias("k"), F.col("row_id").cast("long").alias("at")), F.struct(F.lit("c").alias("k"), F.col("col_id").cast("long").alias("at")))).alias("p"))
    counts = places.groupBy("table_id", "p.k", "p.at").agg(F.count(F.lit(1)).alias("n"))
    text = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("k") == k, F.struct("at", "n")))), lambda x: F.concat_ws(":", x["at"].cast("string"), x["n"].cast("string"))), ",")
    per = counts.groupBy("table_id").agg(text("r").alias("row_entities"), text("c").alias("col_entities"))
    total = linked.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_mapped"), F.count_distinct("uri").alias("n_entities"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return shape.join(total, "table_id", "left").join(per, "table_id", "left").select("table_id", "n_rows", "n_cols", "n_cells", zero("n_mapped"), zero("n_entities"), F.coalesce("row_entities", F.lit("")).alias("row_entities"), F.coalesce("col_entities", F.lit("")).alias("col_entities"))


def column_sets(linked: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(table_id, col_id, values): distinct elements of a column's entities; values: (uri, array)."""
    return linked.join(values, "uri").groupBy("table_id", "col_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(value)))).alias("values"))


def mean_vectors(linked: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector of each group's entities (entities repeat as often as they are met)."""
    parts = linked.join(vectors, "uri").select(*keys, F.posexplode("vec").alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))


def popular_by_percentile(types: DataFrame, p: float) -> DataFrame:
    """(type, n): types from position int(p * count) on, by rising number of entities, then name."""
    if not 0 <= p <= 1:
        raise ValueError("a percentile is between 0 and 1")
    counts = types.select(F.explode("types").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("at", F.row_number().over(Window.orderBy("n", "type"))).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.where(F.col("at") > F.floor(F.col("all") * F.lit(p))).select("type", "n")


def popular_by_table(linked: DataFrame, types: DataFrame, p: float) -> DataFrame:
    """(type, n): types met in at least the fraction p of all tables."""
    n = linked.agg(F.count_distinct("table_id").alias("all"))
    met = linked.select("table_id", "uri").distinct().join(types, "uri").select("table_id", F.explode("types").alias("type")).groupBy("type").agg(F.count_distinct("table_id").alias("n"))
    return met.join(F.broadcast(n)).where(F.col("n") / F.col("all") >= p).select("type", "n")  # n is one row
