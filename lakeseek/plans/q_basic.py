"""Filters, projections, ranking windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeseek.operators import evaluate, index, lsh, search
from lakeseek.plans.bindings import R, W
from lakeseek.plans.registry import op
from lakeseek.sources import readers


def raw_tables(lake):
    """Orders as raw tables: width, header rows, data rows, numeric columns."""
    o = lake.lines.groupBy("table_id").agg(F.count(F.lit(1)).cast("int").alias("numDataRows"))
    return o.select("table_id", (F.col("table_id") % 5 + 1).cast("int").alias("numCols"), (F.col("table_id") % 3).cast("int").alias("numHeaderRows"), "numDataRows", F.when(F.col("table_id") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("numericColumns"))


RAW = {"raw": ("lines", "select table_id, count(*) nrows, table_id % 5 + 1 ncols, table_id % 3 nhead, table_id % 2 = 0 has_num from lines group by 1")}


@op("flt_01_corpus_filter", "raw", "select table_id, nrows n_rows from raw where ncols >= 3 and nhead <= 1 and nrows between 2 and 6 and has_num", RAW)
def _(lake):
    return index.corpus_filter(raw_tables(lake), 3, 2, 6, numeric=True).select("table_id", F.col("numDataRows").alias("n_rows"))


@op("flt_02_disallowed_types", "types", "select uri, count(*) n from types group by 1")
def _(lake):
    return lake.types.select("uri", F.size("types").alias("n"))


@op("flt_03_first_linked_entity", "linked", "select * from linked")
def _(lake):
    # A broken link in front: the first one that maps counts.
    cells = lake.cells.withColumn("links", F.concat(F.array(F.lit("nowhere")), "links"))
    return index.link_cells(cells, lake.links)


@op("flt_04_rows_with_links", "linked", f"select table_id, row_id from linked where uri like '{R}part%'")
def _(lake):
    return lake.linked.where(F.col("uri").startswith(f"{R}part")).select("table_id", "row_id").distinct()


@op("flt_05_nonempty_tables", "lines", "select o_orderkey table_id from orders semi join lines on o_orderkey = table_id")
def _(lake):
    return lake.table("orders").select(F.col("o_orderkey").alias("table_id")).join(lake.lines.select("table_id").distinct(), "table_id", "left_semi")


@op("flt_06_embedding_coverage", "linked vectors", f"select table_id, row_id from linked left join vectors using (uri) where uri like '{R}part%' group by all having bool_and(vec is not null)")
def _(lake):
    rows = lake.linked.where(F.col("uri").startswith(f"{R}part")).join(lake.vectors, "uri", "left")
    return rows.groupBy("table_id", "row_id").agg(F.bool_and(F.col("vec").isNotNull()).alias("ok")).where("ok").select("table_id", "row_id")


@op("flt_07_vote", "linked", f"select table_id from (select distinct table_id, hash_col from (select table_id, substr(uri, {len(R) + 1}, 4) hash_col from linked)) group by 1 having count(*) >= 3")
def _(lake):
    keyed = lake.linked.select("table_id", F.substring("uri", len(R) + 1, 4).alias("grp"), F.lit(0).alias("bucket"))
    return lsh.lookup(keyed, keyed.select("grp", "bucket"), vote=3)


@op("flt_08_pages_by_tables", "lines", "select c page, count(*) n_tables from (select o_custkey c, o_orderkey, count(*) n from orders join lines on table_id = o_orderkey group by all having count(*) >= 2) group by 1 having count(*) between 2 and 10")
def _(lake):
    tables = lake.lines.groupBy("table_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    pages = tables.join(lake.table("orders"), F.col("table_id") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("page")).agg(F.count(F.lit(1)).alias("n_tables"))
    return pages.where(F.col("n_tables").between(2, 10))


@op("flt_09_queries_with_relevant", "qrels", "select * from qrels where query_id in (select query_id from qrels group by 1 having count(*) filter (relevance > 1) > 1)")
def _(lake):
    good = lake.qrels.groupBy("query_id").agg(F.count_if(F.col("relevance") > 1).alias("n")).where("n > 1")
    return lake.qrels.join(good, "query_id", "left_semi")


PREFIXES = ("/th", "/de", "/an", "/la", "/er")


@op("flt_10_namespace_links", "nav", f"select page_id, href from nav where not ({' or '.join(f'starts_with(href, {p!r})' for p in PREFIXES)})")
def _(lake):
    hit = F.lit(False)
    for p in PREFIXES:
        hit = hit | F.col("href").startswith(p)
    return lake.navigation.where(~hit)


@op("flt_11_query_filter", "", "select c_custkey query_id, count(*) n from customer join orders on o_custkey = c_custkey where c_custkey not in (7, 8, 9) group by 1 having count(*) >= 10")
def _(lake):
    n = lake.table("orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    deny = lake.spark.createDataFrame([(7,), (8,), (9,)], "query_id long")
    return n.join(deny, "query_id", "left_anti").join(lake.table("customer"), F.col("query_id") == F.col("c_custkey"), "left_semi")


@op("flt_12_quadrants", "", "select case when c_acctbal >= 4000 then 'easy' else 'hard' end || '-' || case when c_nationkey >= 12 then 'good' else 'bad' end quadrant, count(*) n from customer group by 1")
def _(lake):
    return lake.table("customer").groupBy(F.concat_ws("-", F.when(F.col("c_acctbal") >= 4000, "easy").otherwise("hard"), F.when(F.col("c_nationkey") >= 12, "good").otherwise("bad")).alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))


@op("flt_13_remove_query_tables", "run qrels", "select query_id, table_id, score from run anti join qrels using (query_id, table_id)")
def _(lake):
    return lake.run.join(lake.qrels, ["query_id", "table_id"], "left_anti").select("query_id", "table_id", "score")


@op("flt_14_coverage_split", "cells", "with c as (select table_id, count(link)::double / count(*) cov from cells group by 1) select t threshold, count(*) n from c join (select unnest([0.7::double, 0.9, 1.01]) t) on cov < t group by 1")
def _(lake):
    c = lake.cells.groupBy("table_id").agg((F.sum(F.size("links")) / F.count(F.lit(1))).alias("cov"))
    bins = F.filter(F.array(F.lit(0.7), F.lit(0.9), F.lit(1.01)), lambda t: F.col("cov") < t)
    return c.select(F.explode(bins).alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"))


@op("flt_15_invalid_entities", "linked links", "select uri from links anti join linked using (uri)")
def _(lake):
    return lake.links.select("uri").join(lake.linked.select("uri"), "uri", "left_anti")


@op("flt_16_mappable_queries", "query8 linked", "select tuple_id, bool_and(uri in (select uri from linked)) mappable from query8 group by 1")
def _(lake):
    known = lake.linked.select("uri").distinct().withColumn("known", F.lit(True))
    return lake.query(8).join(known, "uri", "left").groupBy("tuple_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("mappable"))


@op("prj_01_file_name", "", "select page_id, regexp_extract(url, '([^/]*)$', 1) file from pages")
def _(lake):
    return lake.table("pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("file"))


@op("prj_02_flatten_query", "query8", "select row_number() over (order by tuple_id, pos) - 1 as pos, uri from query8")
def _(lake):
    # A query is small: one window over it.
    return lake.query(8).select((F.row_number().over(Window.orderBy("tuple_id", "pos")) - 1).alias("pos"), "uri")


@op("prj_03_combined_tuple", "query8", "select 0::bigint tuple_id, row_number() over (order by a) - 1 as pos, uri from (select uri, min((tuple_id, pos)) a from query8 group by 1)")
def _(lake):
    return search.combined_tuple(lake.query(8))


@op("prj_04_parse_cell", "", f"select p_partkey, case when p_partkey % 2 = 0 then p_name else p_name || '|x' end txt, case when p_partkey % 2 = 0 then '{W}' || replace(p_type || ' a', ' ', '_') else '' end link from part")
def _(lake):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("["), "p_type", F.lit(" a|"), "p_name", F.lit("]"))).otherwise(F.concat("p_name", F.lit("|x")))
    return lake.table("part").select("p_partkey", readers.parse_raw_cell(raw).alias("c")).select("p_partkey", F.col("c.text").alias("txt"), "c.link")


@op("prj_05_select_rows", "lines", "select table_id, string_agg(p::varchar, ',' order by row_id) parts, '' title from lines where row_id in (0, 2) group by 1")
def _(lake):
    rows = lake.lines.groupBy("table_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_id", "p"))), lambda x: x["p"]).alias("data"))
    picked = F.filter(F.transform(F.array(F.lit(0), F.lit(2)), lambda i: F.get("data", i)), lambda x: x.isNotNull())
    return rows.select("table_id", F.array_join(F.transform(picked, lambda x: x.cast("string")), ",").alias("parts"), F.lit("").alias("title"))


@op("prj_06_display_cell", "cells", "select table_id, row_id, col_id, coalesce(regexp_extract(link, '([^/]*)$', 1), txt) shown from cells")
def _(lake):
    return lake.cells.select("table_id", "row_id", "col_id", F.coalesce(F.element_at(F.split(F.get("links", F.lit(0)), "/"), -1), "text").alias("shown"))


@op("prj_07_template_helpers", "cells", "select table_id, row_id, replace(regexp_extract(link, '([^/]*)$', 1), '_', ' ') txt, contains(link, '_') is_link from cells where col_id = 1 and row_id < 3")
def _(lake):
    last = F.element_at(F.split(F.get("links", F.lit(0)), "/"), -1)
    return lake.cells.where("col_id = 1 and row_id < 3").select("table_id", "row_id", F.replace(last, F.lit("_"), F.lit(" ")).alias("txt"), F.contains(last, F.lit("_")).alias("is_link"))


RANKED = "rank() over (partition by query_id order by score desc) + (count(*) over (partition by query_id, score) - 1) / 2.0::double"


@op("win_01_average_rank", "run", f"select query_id, table_id, {RANKED} as rank from run")
def _(lake):
    return evaluate.average_rank(lake.run, ["query_id"], "score").select("query_id", "table_id", "rank")


@op("win_02_rank_data", "run", "select query_id, sum(r) total from (select query_id, rank() over (partition by query_id order by score) + (count(*) over (partition by query_id, score) - 1) / 2.0::double r from run) group by 1")
def _(lake):
    return evaluate.average_rank(lake.run.withColumn("score", -F.col("score")), ["query_id"], "score").groupBy("query_id").agg(F.sum("rank").alias("total"))


@op("win_03_rank_delta", "run", "with a as (select query_id, table_id, score, score % 7 s2 from run), b as (select query_id, abs(rank() over (partition by query_id order by score desc) + (count(*) over (partition by query_id, score) - 1) / 2.0::double - rank() over (partition by query_id order by s2 desc) - (count(*) over (partition by query_id, s2) - 1) / 2.0::double) d from a) select query_id, round(avg(d), 6) delta from b group by 1")
def _(lake):
    two = evaluate.average_rank(evaluate.average_rank(lake.run.withColumn("s2", F.col("score") % 7), ["query_id"], "score", "a"), ["query_id"], "s2", "b")
    return two.groupBy("query_id").agg(F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("delta"))


BEST = {"best": ("linked", "select * from (select table_id, row_id, count(distinct uri) n from linked group by all) qualify rank() over (partition by table_id order by n desc) = 1")}


@op("win_04_widest_table", "best", "select c_custkey, table_id from (select o_custkey c_custkey, b.table_id, max(n) w, count(*) m from best b join orders on o_orderkey = b.table_id group by all) qualify row_number() over (partition by c_custkey order by w desc, m desc, table_id) = 1", BEST)
def _(lake):
    groups = lake.table("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("table_id"))
    return evaluate.generate_queries(lake.linked, groups, 1).select(F.col("query_id").alias("c_custkey"), "table_id").distinct()


@op("win_05_relevant_positions", "judged", "select query_id, round(avg(r), 6) mean, max(r) worst, min(r) best from (select *, row_number() over (partition by query_id order by score desc, table_id) - 1 r from judged) where relevance > 0 group by 1")
def _(lake):
    ranked = evaluate.judged(lake.run, lake.qrels).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "table_id")) - 1)
    return ranked.where("relevance > 0").groupBy("query_id").agg(F.round(F.avg("r"), 6).alias("mean"), F.max("r").alias("worst"), F.min("r").alias("best"))


@op("win_06_first_rows", "run", "select query_id, table_id from run qualify row_number() over (partition by query_id order by score desc, table_id) <= 10")
def _(lake):
    return evaluate.at_k(lake.run, 10).select("query_id", "table_id")


@op("win_07_query_blocks", "query8", "select *, (dense_rank() over (order by tuple_id) - 1) // 3 as block from query8")
def _(lake):
    return search.query_blocks(lake.query(8))


@op("win_08_query_variants", "linked", "select n_tuples, query_id, count(*) n from (select uri query_id, table_id, row_id, row_number() over (partition by uri order by table_id, row_id, col_id) r from linked) join (select unnest([1, 2, 5, 10])::bigint n_tuples) on r <= n_tuples group by all")
def _(lake):
    ranked = lake.linked.withColumn("r", F.row_number().over(Window.partitionBy("uri").orderBy("table_id", "row_id", "col_id"))).where("r <= 10")
    sizes = F.filter(F.array(*map(F.lit, (1, 2, 5, 10))), lambda n: F.col("r") <= n)
    return ranked.select(F.explode(sizes).alias("n_tuples"), F.col("uri").alias("query_id")).groupBy("n_tuples", "query_id").agg(F.count(F.lit(1)).alias("n"))


@op("top_01_result", "run", "select query_id, table_id, score from run order by score desc, table_id limit 100")
def _(lake):
    return search.top_k(lake.run, 100)


@op("top_02_sorted_map", "linked", "select uri, count(*) score from linked group by 1 order by score desc, uri limit 50")
def _(lake):
    return lake.linked.groupBy("uri").agg(F.count(F.lit(1)).alias("score")).orderBy(F.desc("score"), "uri").limit(50)


@op("top_03_limit_pushdown", "relations", "select dst, count(*) n from relations group by 1 order by n desc, dst limit 10")
def _(lake):
    return lake.relations.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(10)


@op("top_04_best_hit", "run", "select query_id, table_id from run qualify row_number() over (partition by query_id order by score desc, table_id) = 1")
def _(lake):
    return search.top_k_each(lake.run, 1).select("query_id", "table_id")


@op("top_05_hits_per_entity", "run", "select query_id, table_id, score from run qualify row_number() over (partition by query_id order by score desc, table_id) <= 10")
def _(lake):
    return search.top_k_each(lake.run, 10).select("query_id", "table_id", "score")


@op("top_06_shorter_run", "run", "select query_id, count(*) n, sum(score) total from (select * from run qualify row_number() over (partition by query_id order by score desc, table_id) <= 10) group by 1")
def _(lake):
    return evaluate.at_k(evaluate.at_k(lake.run, 100), 10).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


@op("top_07_sorted_similarity", "nav", "select href, count(*) n from nav group by 1 order by n desc, href limit 25")
def _(lake):
    return lake.navigation.groupBy("href").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "href").limit(25)


TWO = {"two": ("linked", "select table_id, list(distinct uri) filter (row_id = 0) a, list(distinct uri) filter (row_id = 1) b from linked group by 1")}


@op("set_01_intersection_union", "two", "select table_id, len(list_intersect(coalesce(a, []), coalesce(b, [])))::bigint shared, len(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))::bigint every from two", TWO)
def _(lake):
    two = lake.linked.groupBy("table_id").agg(F.collect_set(F.when(F.col("row_id") == 0, F.col("uri"))).alias("a"), F.collect_set(F.when(F.col("row_id") == 1, F.col("uri"))).alias("b"))
    return two.select("table_id", F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("every"))


@op("set_02_candidate_union", "linked query3", "select distinct table_id from linked semi join query3 using (uri)")
def _(lake):
    q, out = lake.query(3), None
    for pos in range(3):
        found = lake.linked.join(q.where(F.col("pos") == pos), "uri", "left_semi").select("table_id")
        out = found if out is None else out.union(found)
    return out.distinct()


@op("set_03_intersect_tables", "linked query1", "select table_id from linked semi join query1 using (uri) group by 1 having count(distinct uri) = (select count(distinct uri) from query1)")
def _(lake):
    return search.containing_tables(lake.query(1), lake.linked)


@op("set_04_distinct_tables", "linked", "select distinct table_id from linked")
def _(lake):
    return lake.linked.select("table_id").distinct()


@op("set_05_mixed_rankings", "run", "with a as (select query_id, table_id from run qualify row_number() over (partition by query_id order by score desc, table_id) <= 5), b as (select query_id, table_id from run qualify row_number() over (partition by query_id order by score % 7 desc, table_id) <= 5) select * from a union select * from b")
def _(lake):
    other = lake.run.withColumn("score", F.col("score") % 7)
    return evaluate.at_k(lake.run, 5).select("query_id", "table_id").union(evaluate.at_k(other, 5).select("query_id", "table_id")).distinct()


@op("set_06_top_overlap", "run", "with a as (select query_id, table_id from run qualify row_number() over (partition by query_id order by score desc, table_id) <= 10), b as (select query_id, table_id from run qualify row_number() over (partition by query_id order by score % 7 desc, table_id) <= 10), j as (select query_id, count(a.table_id) filter (b.table_id is not null) i, count(*) u from a full join b using (query_id, table_id) group by 1) select query_id, i overlap, round(i::double / u, 6) jaccard from j")
def _(lake):
    a, b = (evaluate.at_k(r, 10).select("query_id", "table_id") for r in (lake.run, lake.run.withColumn("score", F.col("score") % 7)))
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), ["query_id", "table_id"], "full")
    return both.groupBy("query_id").agg(F.sum(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1).otherwise(0)).alias("overlap"), F.count(F.lit(1)).alias("u")).select("query_id", "overlap", F.round(F.col("overlap") / F.col("u"), 6).alias("jaccard"))


@op("set_07_balanced_rows", "qrels", "with p as (select query_id, table_id, relevance from qrels where relevance > 0), n as (select query_id, count(*) m from p group by 1), x as (select q.query_id, table_id, relevance from qrels q join n using (query_id) where relevance = 0 qualify row_number() over (partition by q.query_id order by md5('3:' || table_id), table_id) <= m) select * from p union all select * from x")
def _(lake):
    pos = lake.qrels.where("relevance > 0")
    n = pos.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    ranked = lake.qrels.where("relevance = 0").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(evaluate.hash_order("table_id", 3), "table_id")))
    return pos.unionByName(ranked.join(n, "query_id").where("r <= m").select("query_id", "table_id", "relevance"))


@op("set_08_delete_keys", "linked query3", "select table_id, row_id, col_id, uri from linked anti join query3 using (uri)")
def _(lake):
    return lsh.remove(lake.linked, lake.query(3))


@op("set_09_bucket_lookup", "linked", f"select distinct table_id from linked where uri = '{R}nation_3'")
def _(lake):
    return lake.linked.where(F.col("uri") == f"{R}nation_3").select("table_id").distinct()


@op("set_10_clustered_vectors", "", "select label, count(*) n from embeddings where label <> 3 group by 1")
def _(lake):
    from lakeseek.sources import stores

    path = stores.scratch(lake.spark, "clusters")
    lake.table("embeddings").write.partitionBy("label").parquet(path)
    return lake.spark.read.parquet(path).where("label <> 3").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


