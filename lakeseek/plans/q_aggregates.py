"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeseek.operators import evaluate, index, search
from lakeseek.plans.registry import op



@op("agg_01_entity_idf", "idf", "select uri, round(idf, 6) idf from idf")
def _(lake):
    return lake.idf.select("uri", F.round("idf", 6).alias("idf"))


@op("agg_02_type_idf", "types typed", "select t \"type\", round(log2((select count(distinct src) from typed)::double / count(distinct uri)), 6) idf from types group by t")
def _(lake):
    return index.type_idf(lake.types).select("type", F.round("idf", 6).alias("idf"))


@op("agg_03_links_per_cell", "cells", "select 1::bigint as key, count(link) n from cells")
def _(lake):
    return index.histogram(lake.cells.where(F.size("links") > 0), F.size("links"))


@op("agg_04_entities_per_link", "links", "select 1::bigint as key, count(*) n from links")
def _(lake):
    per = lake.links.groupBy("link").agg(F.count_distinct("uri").alias("m"))
    return index.histogram(per, F.col("m"))


@op("agg_05_linked_cells", "cells", "select count(link) n_linked, count(*) n_cells from cells")
def _(lake):
    return lake.cells.agg(F.count_if(F.size("links") > 0).alias("n_linked"), F.count(F.lit(1)).alias("n_cells"))


@op("agg_06_distinct_mentions")
def _(lake):
    return lake.linked.agg(F.approx_count_distinct("uri", 0.01).alias("n"))


@op("agg_07_table_stats", "cells linked", "with r as (select table_id, string_agg(row_id || ':' || n, ',' order by row_id) t from (select table_id, row_id, count(*) n from linked group by all) group by 1), c as (select table_id, string_agg(col_id || ':' || n, ',' order by col_id) t from (select table_id, col_id, count(*) n from linked group by all) group by 1), e as (select table_id, count(*) m, count(distinct uri) u from linked group by 1) select table_id, count(distinct row_id) n_rows, 3::bigint n_cols, count(*) n_cells, any_value(m) n_mapped, any_value(u) n_entities, any_value(r.t) row_entities, any_value(c.t) col_entities from cells join r using (table_id) join c using (table_id) join e using (table_id) group by 1")
def _(lake):
    return index.table_stats(lake.cells, lake.linked)


@op("agg_08_column_aggregate", "linked types", "select table_id, col_id, string_agg(distinct t, ',' order by t) as vals from linked join types using (uri) group by all")
def _(lake):
    few = lake.linked
    return index.column_sets(few, lake.types, "types").select("table_id", "col_id", F.array_join("values", ",").alias("vals"))


SIM = {"sims": ("linked query3 types", f"select table_id, row_id, col_id, tuple_id, pos, case when q.uri = l.uri then 1.0::double else least(0.95::double, coalesce(i::double / (a.n + b.n - i), 0)) end sim from linked l cross join query3 q left join (select uri, count(*) n from types group by 1) a on a.uri = q.uri left join (select uri, count(*) n from types group by 1) b on b.uri = l.uri left join (select x.uri xq, y.uri yu, count(*) i from types x join types y using (t) group by all) s on xq = q.uri and yu = l.uri")}


def _rows(lake):
    from lakeseek.operators import align

    linked = lake.linked
    pairs = align.pair_similarities(lake.query(3), linked, search.type_similarity(lake.types))
    return linked, pairs, search.row_scores(lake.query(3), linked, pairs)


@op("agg_09_column_scores", "sims", "select table_id, tuple_id, pos, col_id, round(sum(sim), 6) score from sims group by all", SIM)
def _(lake):
    from lakeseek.operators import align

    linked, pairs, _ = _rows(lake)
    return align.column_scores(lake.query(3), linked, pairs).withColumn("score", F.round("score", 6))


@op("agg_10_mean_similarity", "sims", "select table_id, tuple_id, pos, round(avg(s), 6) v from (select table_id, row_id, tuple_id, pos, max(sim) s from sims group by all) group by all", SIM)
def _(lake):
    return search.tuple_vectors(_rows(lake)[2], use_max=False).withColumn("v", F.round("v", 6))


@op("agg_11_max_similarity", "sims", "select table_id, tuple_id, pos, round(max(sim), 6) v from sims group by all", SIM)
def _(lake):
    return search.tuple_vectors(_rows(lake)[2]).withColumn("v", F.round("v", 6))


@op("agg_12_mean_vector", "linked vectors", "select table_id, round(avg(vec[1]), 6) first, round(avg(vec[64]), 6) last from linked join vectors using (uri) group by 1")
def _(lake):
    v = index.mean_vectors(lake.linked, lake.vectors, ["table_id"])
    return v.select("table_id", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("vec", F.lit(63)), 6).alias("last"))


@op("agg_13_mean_of_tuples", "sims", "select table_id, round(avg(m), 6) score from (select table_id, tuple_id, max(sim) m from sims group by all) group by 1", SIM)
def _(lake):
    t = _rows(lake)[2].groupBy("table_id", "tuple_id").agg(F.max("s").alias("score"))
    return search.table_scores(t, lake.query(3)).withColumn("score", F.round("score", 6))


@op("agg_14_tuple_weights", "query8 idf", "select tuple_id, pos, round(coalesce(idf, 0) / sum(coalesce(idf, 0)) over (partition by tuple_id), 6) w from query8 left join idf using (uri)")
def _(lake):
    return search.tuple_weights(lake.query(8), lake.idf).withColumn("w", F.round("w", 6))


@op("agg_15_mapped_rows", "cells", f"select table_id, count(distinct row_id) filter (link is not null and col_id = 0) n_rows, round(count(distinct row_id) filter (link is not null and col_id = 0)::double / count(distinct row_id), 6) part from cells group by 1")
def _(lake):
    mapped = F.count_distinct(F.when((F.size("links") > 0) & (F.col("col_id") == 0), F.col("row_id")))
    return lake.cells.groupBy("table_id").agg(mapped.alias("n_rows"), F.round(mapped / F.count_distinct("row_id"), 6).alias("part"))


@op("agg_16_sum_over_tuples", "sims", "select table_id, round(sum(sim), 5) total from sims group by 1", SIM)
def _(lake):
    linked, pairs, _ = _rows(lake)
    sims = linked.join(pairs, "uri").join(lake.query(3).withColumnRenamed("uri", "q"), "q")
    return sims.groupBy("table_id").agg(F.round(F.sum("sim"), 5).alias("total"))


@op("agg_17_element_frequency", "types", "select t element, count(*) n from types group by 1")
def _(lake):
    return lake.types.select(F.explode("types").alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n"))


@op("agg_18_popular_percentile", "types", 'select t "type", n from (select t, n, row_number() over (order by n, t) r, count(*) over () every from (select t, count(*) n from types group by 1)) where r > floor(every * 0.6::double)')
def _(lake):
    return index.popular_by_percentile(lake.types, 0.6)


@op("agg_19_popular_by_table", "linked types", 'select t "type", count(distinct table_id) n from linked join types using (uri) group by 1 having count(distinct table_id)::double / (select count(distinct table_id) from linked) >= 0.2::double')
def _(lake):
    return index.popular_by_table(lake.linked, lake.types, 0.2)


@op("agg_20_reduction", "linked query1", "select round(1 - count(distinct table_id) filter (uri in (select uri from query1))::double / count(distinct table_id), 6) reduction from linked")
def _(lake):
    hit = lake.linked.join(lake.query(1).select("uri", F.lit(1).alias("hit")), "uri", "left")
    return hit.agg(F.round(1 - F.count_distinct(F.when(F.col("hit") == 1, F.col("table_id"))) / F.count_distinct("table_id"), 6).alias("reduction"))


@op("agg_21_run_counters", "linked vectors", "select count(vec) covered, count(*) - count(vec) missing from linked left join vectors using (uri)")
def _(lake):
    return lake.linked.join(lake.vectors, "uri", "left").agg(F.count("vec").alias("covered"), (F.count(F.lit(1)) - F.count("vec")).alias("missing"))


@op("agg_22_bucket_tables", "linked", "select substr(md5(uri), 1, 3) bucket, count(distinct table_id) n from linked group by 1")
def _(lake):
    return lake.linked.groupBy(F.substring(F.md5("uri"), 1, 3).alias("bucket")).agg(F.count_distinct("table_id").alias("n"))


@op("agg_23_entities_per_table", "linked", "select table_id, count(distinct uri) n from linked group by 1")
def _(lake):
    return lake.linked.groupBy("table_id").agg(F.count_distinct("uri").alias("n"))


@op("agg_24_tables_per_page", "", "select o_custkey page, count(*) n, string_agg(o_orderkey::varchar, ',' order by o_orderkey) tables from orders group by 1")
def _(lake):
    g = lake.table("orders").groupBy(F.col("o_custkey").alias("page")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("o_orderkey")).alias("t"))
    return g.select("page", "n", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("tables"))


@op("agg_25_summary", "", "select max(o_totalprice) max, min(o_totalprice) min, round(avg(o_totalprice), 4) avg, round(stddev_pop(o_totalprice), 4) std, round(median(o_totalprice), 4) median from orders")
def _(lake):
    return evaluate.summary(lake.table("orders"), "o_totalprice").select("max", "min", *(F.round(c, 4).alias(c) for c in ("avg", "std", "median")))


@op("agg_26_attribute_occurrences", "nav", "select href, count(*) n from nav group by 1")
def _(lake):
    return lake.navigation.groupBy("href").agg(F.count(F.lit(1)).alias("n"))


@op("agg_27_widest_rows", "linked", "select * from (select table_id, row_id, count(distinct uri) n from linked group by all) qualify rank() over (partition by table_id order by n desc) = 1")
def _(lake):
    return evaluate.best_rows(lake.linked)


@op("agg_28_expansion", "qrels", "with r as (select query_id, count(*) filter (relevance > 0) relevant, count(*) own from qrels group by 1) select query_id, relevant, round(relevant::double / own, 6) ratio from r")
def _(lake):
    return lake.qrels.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("relevant"), F.count(F.lit(1)).alias("own")).select("query_id", "relevant", F.round(F.col("relevant") / F.col("own"), 6).alias("ratio"))


@op("agg_29_containment", "linked query8", "select table_id, round(count(distinct uri)::double / (select count(distinct uri) from query8), 6) part from linked semi join query8 using (uri) group by 1")
def _(lake):
    q = lake.query(8).select("uri").distinct()
    n = q.agg(F.count(F.lit(1)).alias("m"))
    hits = lake.linked.join(q, "uri", "left_semi").groupBy("table_id").agg(F.count_distinct("uri").alias("n"))
    return hits.join(F.broadcast(n)).select("table_id", F.round(F.col("n") / F.col("m"), 6).alias("part"))  # n is one row


@op("agg_30_metric_by_configuration", "", "select event_type, round(avg(value), 5) mean, round(stddev_samp(value), 5) std from events group by 1")
def _(lake):
    return lake.events.groupBy("event_type").agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_samp("value"), 5).alias("std"))


@op("agg_31_mean_by_method", "", "select event_type, round(avg(value), 5) mean from events group by 1")
def _(lake):
    return lake.events.groupBy("event_type").agg(F.round(F.avg("value"), 5).alias("mean"))


@op("agg_32_mean_over_seeds", "", "select user_id, round(avg(value), 5) mean, round(stddev_pop(value), 5) std from events group by 1")
def _(lake):
    return lake.events.groupBy("user_id").agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("std"))


@op("agg_33_distinct_counts", "linked", "select count(distinct uri) n_uris, count(distinct table_id) n_tables from linked")
def _(lake):
    return lake.linked.agg(F.count_distinct("uri").alias("n_uris"), F.count_distinct("table_id").alias("n_tables"))


@op("agg_34_histogram", "", "select least(greatest(floor(value / 25)::bigint + 1, 0), 21) bin, count(*) n from events group by 1")
def _(lake):
    return lake.events.groupBy(F.expr("width_bucket(value, 0, 500, 20)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@op("agg_35_combined_runs", "run", "select table_id % 50 item, sum(score) score from run group by 1")
def _(lake):
    return lake.run.groupBy((F.col("table_id") % 50).alias("item")).agg(F.sum("score").alias("score"))


@op("agg_36_best_relevance", "qrels", "select table_id % 100 item, max(relevance) relevance from qrels group by 1")
def _(lake):
    return lake.qrels.groupBy((F.col("table_id") % 100).alias("item")).agg(F.max("relevance").alias("relevance"))


@op("agg_37_median_recall", "", "select event_type, round(median(value), 6) median from events group by 1")
def _(lake):
    return lake.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"))


@op("agg_38_runtimes", "", "select user_id, round(avg(value * 1000) / 1000, 5) as seconds, round(100 * avg(value / 500), 5) reduction from events group by 1")
def _(lake):
    return lake.events.groupBy("user_id").agg(F.round(F.avg(F.col("value") * 1000) / 1000, 5).alias("seconds"), F.round(100 * F.avg(F.col("value") / 500), 5).alias("reduction"))


@op("agg_39_capped_histogram", "lines", "select least(m, 7) as value, count(*) n from (select table_id, count(*) m from lines group by 1) group by 1")
def _(lake):
    return evaluate.capped_histogram(lake.lines.groupBy("table_id").agg(F.count(F.lit(1)).alias("m")), "m", 6)


@op("agg_40_box_plot", "", "select event_type, round(quantile_cont(value, 0.25), 6) q1, round(quantile_cont(value, 0.5), 6) q2, round(quantile_cont(value, 0.75), 6) q3 from events group by 1")
def _(lake):
    q = lake.events.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("event_type", *(F.round(F.get("q", F.lit(i)), 6).alias(f"q{i + 1}") for i in range(3)))


@op("melt_01_unpivot", "", "select c_custkey, k, v from (unpivot (select c_custkey, c_acctbal bal, c_nationkey::double nat from customer) on bal, nat into name k value v)")
def _(lake):
    c = lake.table("customer").select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_nationkey").cast("double").alias("nat"))
    return c.unpivot("c_custkey", ["bal", "nat"], "k", "v")


@op("udaf_01_column_aggregator", "linked", "select table_id, col_id, max(len(uri)) longest from linked group by all")
def _(lake):
    return lake.linked.groupBy("table_id", "col_id").agg(F.max(F.length("uri")).alias("longest"))


@op("ext_02_clustered_index", "vectors", "select substr(md5(uri), 1, 1) cluster, count(*) n from vectors group by 1")
def _(lake):
    return lake.vectors.groupBy(F.substring(F.md5("uri"), 1, 1).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


