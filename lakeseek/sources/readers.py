"""Readers and parsers: web tables, queries, embeddings, knowledge-graph lines, runs and judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = "struct<text:string,isNumeric:boolean,links:array<string>>"
TABLE = f"_id string, pgId string, numCols int, numDataRows int, numNumericCols int, pgTitle string, tableCaption string, headers array<{CELL}>, rows array<array<{CELL}>>"
RAW_TABLE = "map<string,struct<title:array<string>,data:array<array<string>>,numCols:int,numDataRows:int,numHeaderRows:int,numericColumns:array<int>,pgTitle:string>>"
RESULT = "scores array<struct<tableID:string,score:double>>"


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): every file ending in .json below path, in name order of their paths."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
    return found.select(F.col("_metadata.file_name").alias("file"), "value").orderBy("file")


def parse_tables(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds the parsed table's columns; rows that don't parse, or lack _id or rows, are skipped."""
    return df.withColumn("_t", F.from_json(value, TABLE, {"mode": "PERMISSIVE"})).where("_t._id is not null and _t.rows is not null").select(*df.columns, "_t.*")


def table_cells(tables: DataFrame) -> DataFrame:
    """(table_id, row_id, col_id, text, is_numeric, links) of parsed tables."""
    rows = tables.select(F.col("_id").alias("table_id"), F.posexplode("rows").alias("row_id", "row"))
    return rows.select("table_id", "row_id", F.posexplode("row").alias("col_id", "cell")).select("table_id", "row_id", "col_id", "cell.text", F.col("cell.isNumeric").alias("is_numeric"), "cell.links")


def split_raw(df: DataFrame, value: str = "value") -> DataFrame:
    """A row for each table of a raw file that maps ids to tables."""
    return df.select(F.explode(F.from_json(value, RAW_TABLE)).alias("table_id", "t")).select("table_id", "t.*")


def parse_raw_cell(cell: Column) -> Column:
    """[page|text] -> struct(text, link); a cell without that mark has an empty link."""
    marked = cell.rlike(r"^\[[^|\]]*\|[^\]]*\]$")
    page, text = F.regexp_extract(cell, r"^\[([^|\]]*)\|", 1), F.regexp_extract(cell, r"\|([^\]]*)\]$", 1)
    return F.struct(F.when(marked, text).otherwise(cell).alias("text"), F.when(marked, F.concat(F.lit("http://www.wikipedia.org/wiki/"), F.replace(page, F.lit(" "), F.lit("_")))).otherwise("").alias("link"))


def parse_queries(df: DataFrame, name: str, value: str = "value") -> DataFrame:
    """(query_id, tuple_id, pos, uri) of query files {"queries": [[uri, ...], ...]}."""
    tuples = df.select(F.col(name).alias("query_id"), F.posexplode(F.from_json(value, "queries array<array<string>>")["queries"]).alias("tuple_id", "t"))
    return tuples.select("query_id", "tuple_id", F.posexplode("t").alias("pos", "uri"))


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """Queries of one file, or of every .json file below a folder; a query's name is its file's base name."""
    files = json_files(spark, path).withColumn("name", F.regexp_replace("file", r"\.json$", ""))
    return parse_queries(files, "name")


def parse_embeddings(df: DataFrame, value: str = "value") -> DataFrame:
    """(uri, vec) of lines `uri v1 v2 ...`; a line whose first token has no :// is skipped, as are tokens that aren't decimals."""
    parts = F.split(F.trim(value), r"\s+")
    values = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.expr("1").cast("double") * x.try_cast("double")), lambda x: x.isNotNull())
    return df.select(F.get(parts, F.lit(0)).alias("uri"), values.alias("vec")).where(F.contains("uri", F.lit("://")))


def parse_triples(df: DataFrame, value: str = "value") -> DataFrame:
    """(uri, text) of triple lines: the subject, and its last path segment with spaces for underscores."""
    uri = F.regexp_extract(value, r"^<([^>]*)>", 1)
    return df.select(uri.alias("uri")).where("uri <> ''").select("uri", F.replace(F.element_at(F.split("uri", "/"), -1), F.lit("_"), F.lit(" ")).alias("text"))


def clean_triples(df: DataFrame, unwanted: str, value: str = "value") -> DataFrame:
    """Lines stripped of non-ASCII, that start with a <scheme://...> subject and one space before the next <, without `unwanted`."""
    line = F.regexp_replace(value, r"[^\x00-\x7F]", "")
    return df.select(line.alias(value)).where(F.col(value).rlike(r"^<[a-zA-Z][a-zA-Z0-9+.-]*://[^<> ]+> <") & ~F.contains(F.col(value), F.lit(unwanted)))


def parse_result(df: DataFrame, name: str, value: str = "value") -> DataFrame:
    """(query_id, table_id, score) of saved results."""
    return df.select(F.col(name).alias("query_id"), F.explode(F.from_json(value, RESULT)["scores"]).alias("s")).select("query_id", F.col("s.tableID").alias("table_id"), "s.score")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="query_id string, column2 string, table_id string, relevance double")


def read_bm25_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="wikipage_id string, query string, table_id string, rank int, score double, field string")


def parse_keyword_queries(df: DataFrame, value: str = "value") -> DataFrame:
    """(query_id, text): a line's first token and the rest."""
    parts = F.split(value, " ", 2)
    return df.select(F.get(parts, F.lit(0)).alias("query_id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def parse_mentions(df: DataFrame, value: str = "value") -> DataFrame:
    """(table_id, uri) of mention triples: the first field's last segment without .json, and the third field."""
    fields = F.split(value, " ")
    bare = lambda x: F.regexp_replace(x, r"[<>]", "")
    return df.select(F.regexp_replace(F.element_at(F.split(bare(F.get(fields, F.lit(0))), "/"), -1), r"\.json$", "").alias("table_id"), bare(F.get(fields, F.lit(2))).alias("uri"))


def navigation_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, href): distinct hrefs within a page's <nav> parts."""
    navs = pages.select("page_id", F.explode(F.regexp_extract_all(html, F.lit(r"(?s)<nav>(.*?)</nav>"), F.lit(1))).alias("nav"))
    return navs.select("page_id", F.explode(F.regexp_extract_all("nav", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
