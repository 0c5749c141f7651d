"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from lakeseek.operators import index, lsh, search
from lakeseek.plans.bindings import R
from lakeseek.plans.registry import op
from lakeseek.sources import readers, stores
from lakeseek.streaming import incremental

CELL = "struct<text:string,isNumeric:boolean,links:array<string>>"


def table_json(cells):
    """(file, value): the cells' tables as JSON files would hold them."""
    cell = F.struct("text", F.lit(False).alias("isNumeric"), "links")
    rows = cells.groupBy("table_id", "row_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_id", cell.alias("c")))), lambda x: x["c"]).alias("r"))
    tables = rows.groupBy("table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_id", "r"))), lambda x: x["r"]).alias("rows"))
    body = F.to_json(F.struct(F.col("table_id").cast("string").alias("_id"), F.col("table_id").cast("string").alias("pgId"), "rows"))
    # Every tenth one is broken, every eleventh lacks its id.
    body = F.when(F.col("table_id") % 10 == 0, F.substring(body, 1, 30)).when(F.col("table_id") % 11 == 0, F.lit('{"rows": []}')).otherwise(body)
    return tables.select(F.concat(F.col("table_id").cast("string"), F.lit(".json")).alias("file"), body.alias("value"), "table_id")


def _written(lake, df, name):
    path = stores.scratch(lake.spark, name)
    df.write.text(path)
    return lake.spark.read.text(path)


@op("src_01_scan_json_files")
def _(lake):
    path = stores.scratch(lake.spark, "tables")
    table_json(lake.cells).select("value", (F.col("table_id") % 64).alias("part")).repartition("part").write.partitionBy("part").option("compression", "none").text(path)
    found = lake.spark.read.option("recursiveFileLookup", True).text(path)
    return found.select(F.length("value").alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


@op("src_02_parse_tables", "cells", f"select table_id::varchar _id, count(distinct row_id) n_rows, count(*) n_cells, count(link) n_links from cells where table_id % 10 <> 0 and table_id % 11 <> 0 group by 1")
def _(lake):
    cells = readers.table_cells(readers.parse_tables(table_json(lake.cells)))
    return cells.groupBy(F.col("table_id").alias("_id")).agg(F.count_distinct("row_id").alias("n_rows"), F.count(F.lit(1)).alias("n_cells"), F.sum(F.size("links")).alias("n_links"))


@op("src_03_split_raw_tables", "", "select 'table-' || o_orderkey table_id, 'order ' || o_orderkey || ', ' || o_orderpriority first_cell, 2::bigint n_cols, 1::bigint n_rows from orders")
def _(lake):
    t = F.struct(F.array(F.lit("key"), F.lit("priority")).alias("title"), F.array(F.array(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.col("o_orderpriority"))).alias("data"), F.lit(2).alias("numCols"), F.lit(1).alias("numDataRows"))
    raw = lake.table("orders").select((F.col("o_orderkey") % 50).alias("file"), F.concat(F.lit("table-"), F.col("o_orderkey").cast("string")).alias("id"), t.alias("t"))
    files = raw.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "t")))).alias("value"))
    return readers.split_raw(files).select("table_id", F.concat_ws(", ", F.col("data")[0]).alias("first_cell"), F.col("numCols").alias("n_cols"), F.col("numDataRows").alias("n_rows"))


@op("src_04_query_file", "query8", "select 8::bigint query_id, * from query8")
def _(lake):
    return readers.parse_queries(stores.query_json(lake.query(8).withColumn("query_id", F.lit(8).cast("long"))), "query_id")


@op("src_05_query_set")
def _(lake):
    path = stores.scratch(lake.spark, "queries")
    for n in (1, 3, 8):
        stores.query_json(lake.query(n).withColumn("query_id", F.lit(n))).select("value").coalesce(1).write.option("compression", "none").text(f"{path}/q{n}.json")
    found = lake.spark.read.option("recursiveFileLookup", True).text(path).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]*)\.json/", 1).alias("name"))
    return readers.parse_queries(found, "name")


@op("src_06_embedding_lines", "vectors", "select uri, len(vec)::bigint dim, round(list_sum(vec), 6) total from vectors")
def _(lake):
    lines = lake.vectors.select(F.concat_ws(" ", "uri", F.transform("vec", lambda x: x.cast("string"))).alias("value"))
    return readers.parse_embeddings(_written(lake, lines, "vectors")).select("uri", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _triples(lake):
    return lake.edges.where("dst like 'http%'").select(F.format_string("<%s> <http://kg/%s> <%s> .", "src", "predicate", "dst").alias("value"))


@op("src_07_triple_subjects", "edges", "select src uri, replace(regexp_extract(src, '([^/]*)$', 1), '_', ' ') txt, count(*) n from edges where dst like 'http%' group by all")
def _(lake):
    return readers.parse_triples(_triples(lake)).groupBy("uri", F.col("text").alias("txt")).agg(F.count(F.lit(1)).alias("n"))


@op("src_08_clean_triples", "edges", "select '<' || src || '> <http://kg/' || predicate || '> <' || dst || '> .' as value from edges where dst like 'http%' and predicate <> 'rdf__type'")
def _(lake):
    return readers.clean_triples(_triples(lake).withColumn("value", F.concat("value", F.lit("é"))), "rdf__type")


@op("src_09_all_labels", "links", f"select uri, replace(replace(uri, '{R}', ''), '_', ' ') as label from links")
def _(lake):
    return lake.links.select("uri", F.replace(F.element_at(F.split("uri", "/"), -1), F.lit("_"), F.lit(" ")).alias("label"))


def _store(lake, kind="parquet"):
    store = stores.VectorStore(lake.spark, stores.scratch(lake.spark, "store"), kind)
    store.insert(lake.vectors)
    return store


DIM = "select uri, len(vec)::bigint dim from vectors"


@op("src_10_relational_store", "vectors", DIM)
def _(lake):
    return _store(lake, "orc").read().select("uri", F.size("vec").alias("dim"))


@op("src_11_migrate_store", "vectors", DIM)
def _(lake):
    return _store(lake).migrate(stores.scratch(lake.spark, "store"), "orc").read().select("uri", F.size("vec").alias("dim"))


@op("src_12_append_store", "vectors", "select uri, 2::bigint n from vectors")
def _(lake):
    store = _store(lake)
    store.insert(lake.vectors)
    return store.read().groupBy("uri").agg(F.count(F.lit(1)).alias("n"))


@op("src_13_vector_collection", "vectors", f"select uri, round(vec[1], 6) x from vectors where uri <> '{R}part_1'")
def _(lake):
    gone = lake.vectors.where(F.col("uri") == f"{R}part_1").select("uri")
    return _store(lake).remove(gone).select("uri", F.round(F.get("vec", F.lit(0)), 6).alias("x"))


@op("src_14_store_registry", "vectors", "select k kind, (select count(*) from vectors) n from (select unnest(['parquet', 'orc', 'json']) k)")
def _(lake):
    out = None
    for kind in ("parquet", "orc", "json"):
        df = _store(lake, kind).read().agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = df if out is None else out.unionByName(df)
    return out


@op("src_15_vector_lookup", "vectors", f"select uri, round(list_sum(vec), 6) total from vectors where uri = '{R}part_7'")
def _(lake):
    return _store(lake).lookup(f"{R}part_7").select("uri", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@op("src_16_vector_batch_lookup", "vectors", f"select uri, round(list_sum(vec), 6) total from vectors where uri in ('{R}part_7', '{R}part_8', '{R}none')")
def _(lake):
    return _store(lake).lookup(f"{R}part_7", f"{R}part_8", f"{R}none").select("uri", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@op("src_17_batch_insert", "vectors", "select count(*) n, count(distinct uri) n_uris from vectors")
def _(lake):
    return _store(lake).read().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uri").alias("n_uris"))


@op("src_18_hash_indexed_lookup", "linked vectors", "select uri, count(vec) n from (select distinct uri from linked) left join vectors using (uri) group by 1")
def _(lake):
    return _store(lake).lookup_all(lake.linked.select("uri").distinct()).groupBy("uri").agg(F.count("vec").alias("n"))


@op("src_19_dictionary_lookup", "vectors links", "select link, round(vec[2], 6) x from links join vectors using (uri)")
def _(lake):
    return lake.links.join(lake.vectors, "uri").select("link", F.round(F.get("vec", F.lit(1)), 6).alias("x"))


@op("src_20_text_index", "", "with t as (select doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) token from documents) select token, count(*) tf, count(distinct doc_id) df from t where token <> '' group by 1")
def _(lake):
    postings = search.text_index(lake.table("documents"), "doc_id", "text")
    return postings.groupBy("token").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def _result(lake):
    titles = lake.events.select(F.col("event_id").alias("table_id"), F.concat(F.lit("Event "), "event_type").alias("title"))
    return stores.result_json(lake.run, titles)


@op("src_21_saved_results", "run", "select query_id, table_id::varchar table_id, score from run")
def _(lake):
    return readers.parse_result(_result(lake), "query_id")


@op("src_22_judgement_files", "qrels", "select query_id::varchar query_id, table_id::varchar table_id, relevance from qrels")
def _(lake):
    path = stores.scratch(lake.spark, "qrels")
    lake.qrels.select("query_id", F.lit("0").alias("column2"), "table_id", "relevance").write.csv(path, sep="\t")
    return readers.read_qrels(lake.spark, path).select("query_id", "table_id", "relevance")


@op("src_23_keyword_queries", "", "select item_id::varchar query_id, text txt from benchmark")
def _(lake):
    lines = lake.table("benchmark").select(F.concat_ws(" ", F.col("item_id").cast("string"), "text").alias("value"))
    return readers.parse_keyword_queries(lines).select("query_id", F.col("text").alias("txt"))


@op("src_24_mention_file", "linked", "select distinct table_id::varchar table_id, uri from linked")
def _(lake):
    return readers.parse_mentions(_written(lake, stores.mention_triples(lake.linked), "mentions"))


@op("src_25_settings", "", "select 30::bigint vectors, 10::bigint band, 'orc' store")
def _(lake):
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        stores.Settings(store="orc").save(f"{d}/settings.json")
        s = stores.Settings.load(f"{d}/settings.json")
    return lake.spark.range(1).select(F.lit(s.vectors).alias("vectors"), F.lit(s.band).alias("band"), F.lit(s.store).alias("store"))


@op("src_26_page_attributes", "nav", "select page_id, count(*) n from nav group by 1")
def _(lake):
    return lake.navigation.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@op("src_27_study_parameters", "", "select user_id, count(*) n from events where event_type in ('view', 'click') group by 1")
def _(lake):
    params = lake.spark.createDataFrame([Row(value='[{"query": "view", "tables": "t"}, {"query": "click", "tables": "t"}]')])
    kinds = params.select(F.explode(F.from_json("value", "array<struct<query:string,tables:string>>")).alias("p")).select(F.col("p.query").alias("event_type"))
    return lake.events.join(F.broadcast(kinds), "event_type", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))  # one row for each parameter


@op("snk_01_save_index", "linked idf", "select 'idf' part, count(*) n from idf union all select 'postings', count(*) from linked")
def _(lake):
    path = stores.scratch(lake.spark, "index")
    stores.save_index({"postings": lake.linked, "idf": lake.idf}, path)
    held = stores.load_index(lake.spark, path, ["postings", "idf"])
    return held["idf"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("idf").alias("part"), "n").unionByName(held["postings"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("postings").alias("part"), "n"))


@op("snk_02_load_index", "linked", "select table_id, count(*) n from linked group by 1")
def _(lake):
    path = stores.scratch(lake.spark, "index")
    stores.save_index({"postings": lake.linked}, path)
    return stores.load_index(lake.spark, path, ["postings"])["postings"].groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))


@op("snk_03_mention_triples", "linked", "select distinct '<http://thetable.org/wikitables/' || table_id || '> <https://schema.org/mentions> <' || uri || '> .' as value from linked")
def _(lake):
    return stores.mention_triples(lake.linked)


@op("snk_04_type_triples", "linked", "select distinct '<http://thetable.org/wikitables/' || table_id || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <https://schema.org/Table> .' as value from linked")
def _(lake):
    return stores.type_triples(lake.linked)


@op("snk_05_stats_json", "cells", "select table_id, count(*) n_cells, count(link) n_mapped from cells group by 1")
def _(lake):
    path = stores.scratch(lake.spark, "stats")
    index.table_stats(lake.cells, lake.linked).write.json(path)
    return lake.spark.read.schema("table_id long, n_cells long, n_mapped long").json(path)


@op("snk_06_result_json", "", "select user_id query_id, count(*) n, max(round(value, 0)) best, count(distinct 'https://en.wikipedia.org/wiki/Event_' || event_type) n_urls from events group by 1")
def _(lake):
    full = "scores array<struct<tableID:string,score:double,pgTitle:string,tableURL:string>>"
    rows = _result(lake).select("query_id", F.from_json("value", full)["scores"].alias("s"))
    return rows.select("query_id", F.size("s").alias("n"), F.get("s", F.lit(0))["score"].alias("best"), F.size(F.array_distinct(F.transform("s", lambda x: x["tableURL"]))).alias("n_urls"))


@op("snk_07_top_results", "run", "select query_id, table_id::varchar table_id, score from run where query_id = 1 order by score desc, table_id::varchar limit 20")
def _(lake):
    return search.top_k(readers.parse_result(_result(lake), "query_id").where("query_id = 1"), 20)


@op("snk_08_query_files", "query3 query8", "select 3::bigint query_id, count(*) n, count(distinct tuple_id) n_tuples from query3 union all select 8, count(*), count(distinct tuple_id) from query8")
def _(lake):
    path = stores.scratch(lake.spark, "queries")
    both = lake.query(3).withColumn("query_id", F.lit(3).cast("long")).unionByName(lake.query(8).withColumn("query_id", F.lit(8).cast("long")))
    stores.query_json(both).write.parquet(path)
    return readers.parse_queries(lake.spark.read.parquet(path), "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tuple_id").alias("n_tuples"))


@op("snk_09_query_corpora", "qrels", "select query_id, event_id, event_type from events join (select distinct query_id, table_id from qrels where relevance > 0) q on event_id = q.table_id")
def _(lake):
    wanted = lake.qrels.where("relevance > 0").select("query_id", F.col("table_id").alias("event_id")).distinct()
    return lake.events.join(wanted, "event_id").select("query_id", "event_id", "event_type")


@op("snk_10_run_corpus", "run", "select event_id, event_type from events semi join (select table_id from run qualify row_number() over (partition by query_id order by score desc, table_id) <= 5) t on event_id = t.table_id")
def _(lake):
    best = search.top_k_each(lake.run, 5).select(F.col("table_id").alias("event_id"))
    return lake.events.join(best, "event_id", "left_semi").select("event_id", "event_type")


@op("snk_11_reranker_subset", "qrels", "select e.user_id::varchar query_id, '' caption, e.event_id::varchar table_id, relevance from events e join qrels q on e.event_id = q.table_id where relevance > 0")
def _(lake):
    path = stores.scratch(lake.spark, "subset")
    rows = lake.events.join(lake.qrels.where("relevance > 0"), F.col("event_id") == F.col("table_id")).select("query_id", F.lit("").alias("caption"), "table_id", "relevance")
    rows.write.csv(path, sep="\t", emptyValue="")
    return lake.spark.read.csv(path, sep="\t", schema="query_id string, caption string, table_id string, relevance double").withColumn("caption", F.coalesce("caption", F.lit("")))


@op("srch_18_incremental_insert", "cells", "select count(distinct table_id) n_tables from cells where link is not null")
def _(lake):
    path, source = stores.scratch(lake.spark, "lsh"), stores.scratch(lake.spark, "cells")
    lake.cells.repartition(3).write.parquet(source)
    cells = lake.spark.readStream.schema("table_id long, row_id long, col_id long, text string, links array<string>").option("maxFilesPerTrigger", 2).parquet(source)
    sets = lake.types.select("uri", F.col("types").alias("values"))
    q = incremental.maintain(cells, lambda batch: lsh.set_index(index.link_cells(batch, lake.links), sets, n=6, band=3), path, f"{path}-state")
    q.awaitTermination()
    return lake.spark.read.parquet(path).agg(F.count_distinct("table_id").alias("n_tables"))


