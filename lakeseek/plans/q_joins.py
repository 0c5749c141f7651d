"""Joins of links, graph, vectors, postings, candidates and judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeseek.operators import align, evaluate, index, search
from lakeseek.plans.bindings import R
from lakeseek.plans.registry import op


@op("jn_01_link_to_uri", "links", "select link, uri from links")
def _(lake):
    doubled = lake.links.withColumn("seq", F.lit(0)).unionByName(lake.links.select("link", F.concat("uri", F.lit("_other")).alias("uri"), F.lit(1).alias("seq")))
    return index.first_mappings(doubled)[0]


@op("jn_02_uri_to_link", "links", "select uri, link from links")
def _(lake):
    return index.first_mappings(lake.links.withColumn("seq", F.lit(0)))[1]


@op("jn_03_primary_topics", "links", "select link, uri from links")
def _(lake):
    return index.primary_topics(lake.edges)


@op("jn_04_bulk_links", "links", f"select link, uri from links where uri in ('{R}part_1', '{R}nation_2', '{R}supplier_3')")
def _(lake):
    asked = lake.spark.createDataFrame([(f"{R}{x}",) for x in ("part_1", "nation_2", "supplier_3", "none")], "uri string")
    return index.primary_topics(lake.edges).join(asked, "uri", "left_semi").select("link", "uri")


@op("jn_05_entity_types", "types", "select uri, string_agg(t, ',' order by t) types from types group by 1")
def _(lake):
    return lake.types.select("uri", F.array_join(F.sort_array("types"), ",").alias("types"))


@op("jn_06_entity_predicates", "predicates", "select uri, string_agg(t, ',' order by t) predicates from predicates group by 1")
def _(lake):
    return lake.predicates.select("uri", F.array_join("predicates", ",").alias("predicates"))


@op("jn_07_entity_embedding", "links vectors", "select uri, vec is not null has_vec from links left join vectors using (uri)")
def _(lake):
    return lake.links.join(lake.vectors, "uri", "left").select("uri", F.col("vec").isNotNull().alias("has_vec"))


@op("jn_08_entity_tables", "linked", "select uri, count(distinct table_id) n from linked group by 1")
def _(lake):
    return lake.linked.groupBy("uri").agg(F.count_distinct("table_id").alias("n"))


@op("jn_09_entity_locations", "linked query8", "select distinct uri, table_id, row_id, col_id from linked semi join query8 using (uri)")
def _(lake):
    return lake.linked.join(lake.query(8).select("uri").distinct(), "uri", "left_semi").select("uri", "table_id", "row_id", "col_id")


@op("jn_10_table_entities", "linked", "select table_id, string_agg(distinct uri, ',' order by uri) uris from linked group by 1")
def _(lake):
    return lake.linked.groupBy("table_id").agg(F.array_join(F.sort_array(F.collect_set("uri")), ",").alias("uris"))


PAIRS = {"pairs": ("query3 linked types", "select q, u.uri, case when q = u.uri then 1.0::double else least(0.95::double, coalesce(i::double / (a.n + b.n - i), 0)) end sim from (select distinct uri q from query3) cross join (select distinct uri from linked) u left join (select uri, count(*) n from types group by 1) a on a.uri = q left join (select uri, count(*) n from types group by 1) b on b.uri = u.uri left join (select x.uri xq, y.uri yu, count(*) i from types x join types y using (t) group by all) s on xq = q and yu = u.uri")}


@op("jn_11_entity_pairs", "pairs", "select q, uri, round(sim, 6) sim from pairs", PAIRS)
def _(lake):
    return align.pair_similarities(lake.query(3), lake.linked, search.type_similarity(lake.types)).withColumn("sim", F.round("sim", 6))


@op("jn_12_column_pairs", "pairs", "select table_id, col_id, q, round(sum(sim), 6) score from linked join pairs using (uri) group by all", PAIRS)
def _(lake):
    pairs = align.pair_similarities(lake.query(3), lake.linked, search.type_similarity(lake.types))
    return lake.linked.join(pairs, "uri").groupBy("table_id", "col_id", "q").agg(F.round(F.sum("sim"), 6).alias("score"))


@op("jn_13_candidate_corpus", "linked query1", "select table_id, count(*) n from linked where table_id in (select table_id from linked semi join query1 using (uri)) group by 1")
def _(lake):
    candidates = lake.linked.join(lake.query(1), "uri", "left_semi").select("table_id").distinct()
    return lake.linked.join(candidates, "table_id", "left_semi").groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))


@op("jn_14_containing_tables", "linked query1", "select table_id from linked semi join query1 using (uri) group by 1 having count(distinct uri) = (select count(distinct uri) from query1)")
def _(lake):
    return search.containing_tables(lake.query(1), lake.linked)


@op("jn_15_containing_rows", "linked query1", "select table_id, count(*)::double score from (select table_id, row_id from linked semi join query1 using (uri) group by all having count(distinct uri) = (select count(distinct uri) from query1)) group by 1")
def _(lake):
    return search.exact_search(lake.query(1), lake.linked)


@op("jn_16_bucket_join", "linked", "select table_id, count(distinct b) n from (select distinct table_id, substr(md5(uri), 1, 2) b from linked) where b in (select substr(md5(uri), 1, 2) from linked where table_id = (select min(table_id) from linked)) group by 1")
def _(lake):
    keyed = lake.linked.select(F.substring(F.md5("uri"), 1, 2).alias("grp"), F.lit(0).alias("bucket"), "table_id")
    first = keyed.agg(F.min("table_id").alias("table_id"))
    keys = keyed.join(F.broadcast(first), "table_id", "left_semi")  # one row
    hits = keyed.distinct().join(keys.select("grp", "bucket").distinct(), ["grp", "bucket"])
    return hits.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))


@op("jn_17_page_tables", "nav", "select href, max(page_id) last_page, count(*) n from nav group by 1")
def _(lake):
    return lake.navigation.groupBy("href").agg(F.max("page_id").alias("last_page"), F.count(F.lit(1)).alias("n"))


NAVSIM = "with n as (select page_id, count(*) m from nav group by 1), s as (select x.page_id a, y.page_id b, count(*) i from nav x join nav y on x.href = y.href and x.page_id <> y.page_id group by all), r as (select a, b, i::double / (n1.m + n2.m - i) score from s join n n1 on n1.page_id = a join n n2 on n2.page_id = b where i::double / (n1.m + n2.m - i) > 0.01) select a, b, round(score, 6) score from r union all select page_id, page_id, 1 from n where page_id not in (select a from r)"


@op("jn_18_page_similarity", "nav", NAVSIM)
def _(lake):
    return evaluate.page_similarity(lake.navigation.select(F.col("page_id").alias("page"), F.col("href").alias("attribute")), digits=6)


@op("jn_19_run_with_truth", "judged", "select query_id, table_id, score, relevance from judged")
def _(lake):
    return evaluate.judged(lake.run, lake.qrels)


@op("jn_20_map_column", "", "select event_id, coalesce(c_name, '') as name from events left join customer on c_custkey = user_id")
def _(lake):
    return lake.events.join(lake.table("customer"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.coalesce("c_name", F.lit("")).alias("name"))


@op("txt_03_wiki_linker", "cells links", "select distinct c.link, uri from cells c join links using (link)")
def _(lake):
    return lake.cells.select(F.explode("links").alias("link")).distinct().join(index.primary_topics(lake.edges), "link")


@op("udtf_03_linker", "links", "select uri, replace(link, 'http://www.', 'http://en.') link from links")
def _(lake):
    return lake.links.select("uri", F.replace("link", F.lit("http://www."), F.lit("http://en.")).alias("link"))


