"""Evaluation, query generation, sampling and the annotation study."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeseek.operators import evaluate, search
from lakeseek.plans.registry import op

DISC = "case when r <= 10 then 1 / log2(r + 1) else 0 end"
NDCG = {
    "ranked": ("judged", "select *, row_number() over (partition by query_id order by score desc, table_id) r, row_number() over (partition by query_id order by relevance desc, table_id) i from judged"),
    "disc": ("ranked", f"select *, {DISC} d, {DISC.replace('r ', 'i ')} e from ranked"),
    "tied": ("disc", "select *, avg(d) over (partition by query_id, score) t from disc"),
}


@op("ev_01_ndcg", "tied", "select query_id, round(coalesce(sum(relevance * t) / nullif(sum(relevance * e), 0), 0), 6) ndcg from tied group by 1", NDCG)
def _(lake):
    return evaluate.ndcg(evaluate.judged(lake.run, lake.qrels), 10).withColumn("ndcg", F.round("ndcg", 6))


@op("ev_02_ndcg_without_ties", "tied", "select query_id, round(coalesce(sum(relevance * d) / nullif(sum(relevance * e), 0), 0), 6) ndcg from tied group by 1", NDCG)
def _(lake):
    return evaluate.ndcg(evaluate.judged(lake.run, lake.qrels), 10, ties=False).withColumn("ndcg", F.round("ndcg", 6))


HITS = {"hits": ("run qrels", "select query_id, count(q.table_id) h from (select * from run qualify row_number() over (partition by query_id order by score desc, table_id) <= 10) r left join (select * from qrels where relevance > 0) q using (query_id, table_id) group by 1"), "relevant": ("qrels", "select query_id, count(*) n from qrels where relevance > 0 group by 1")}


@op("ev_03_precision", "hits", "select query_id, round(h / 10.0::double, 6) as precision from hits", HITS)
def _(lake):
    return evaluate.precision_recall(lake.run, lake.qrels, 10).select("query_id", F.round("precision", 6).alias("precision"))


@op("ev_04_recall", "hits relevant", "select query_id, round(coalesce(h::double / n, 0), 6) recall from hits left join relevant using (query_id)", HITS)
def _(lake):
    return evaluate.precision_recall(lake.run, lake.qrels, 10).select("query_id", F.round("recall", 6).alias("recall"))


@op("ev_05_relevant_at_k", "hits", "select query_id, h hits from hits", HITS)
def _(lake):
    return evaluate.precision_recall(lake.run, lake.qrels, 10).select("query_id", "hits")


@op("ev_06_auc", "run qrels", "with c as (select user_id query_id, event_id table_id from events), x as (select query_id, table_id, case when table_id % 4 = 0 then null else score end s, relevance > 0 pos from c left join run using (query_id, table_id) left join qrels using (query_id, table_id)), y as (select *, rank() over (partition by query_id order by coalesce(s, -1e308) desc) + (count(*) over (partition by query_id, coalesce(s, -1e308)) - 1) / 2.0::double r from x), g as (select query_id, count(*) n, count(*) filter (pos) p, sum(r) filter (pos) s from y group by 1) select query_id, round(1 - (s - p * (p + 1) / 2.0::double) / (p * (n - p)), 6) auc from g where p > 0 and p < n")
def _(lake):
    scored = lake.run.where("table_id % 4 <> 0")
    return evaluate.auc(scored, lake.qrels, lake.run.select("query_id", "table_id")).withColumn("auc", F.round("auc", 6))


@op("ev_07_list_precision", "hits relevant", "select query_id, round(h / 10.0::double, 6) as precision, round(coalesce(h::double / n, 0), 6) recall from hits left join relevant using (query_id)", HITS)
def _(lake):
    return evaluate.precision_recall(lake.run, lake.qrels, 10).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@op("ev_08_balanced_labels", "qrels", "with p as (select distinct query_id, table_id from qrels where relevance > 1), m as (select query_id, count(*) m from p group by 1), pl as (select event_id table_id, row_number() over (order by md5('0:' || event_id)) - 1 seat from events), n as (select count(*) n from events), s as (select query_id, m, i, (('0x' || substr(md5('0:' || query_id), 1, 8))::bigint + i) % n seat from m, n, range(100000) r(i) where i < least(2 * m, n)), f as (select query_id, table_id, m, i from s join pl using (seat) anti join p using (query_id, table_id)) select query_id, table_id, 1.0::double relevance from p union all select query_id, table_id, 0 from f qualify row_number() over (partition by query_id order by i) <= m")
def _(lake):
    positives = lake.qrels.where("relevance > 1").select("query_id", "table_id").distinct()
    return evaluate.balanced_labels(positives, lake.events.select(F.col("event_id").alias("table_id")))


W = {"w": ("nav", "select href, log2((select count(distinct page_id) from nav)::double / count(*)) w from nav group by 1"), "mass": ("nav w", "select page_id, sum(w) m from nav join w using (href) group by 1"), "shared": ("nav w", "select x.page_id a, y.page_id b, sum(w) s from nav x join nav y on x.href = y.href and x.page_id <> y.page_id join w on w.href = x.href group by all"), "rel": ("shared mass", "select a, b, s / nullif(m1.m + m2.m - s, 0) score from shared join mass m1 on m1.page_id = a join mass m2 on m2.page_id = b")}


@op("ev_09_page_relevance", "rel nav", "with r as (select * from rel where score > 0.01) select a, b, round(score, 6) score from r union all select distinct page_id, page_id, 1 from nav where page_id not in (select a from r)", W)
def _(lake):
    attributes = lake.navigation.select(F.col("page_id").alias("page"), F.col("href").alias("attribute"))
    return evaluate.page_similarity(attributes, weighted=True, digits=6)


BEST = {"best": ("linked", "select * from (select table_id, row_id, count(distinct uri) n from linked group by all) qualify rank() over (partition by table_id order by n desc) = 1"), "pick": ("best", "select c query_id, table_id from (select o_custkey c, b.table_id, max(n) w, count(*) m from best b join orders on o_orderkey = b.table_id group by all) qualify row_number() over (partition by c order by w desc, m desc, table_id) = 1")}


@op("ev_10_query_generation", "pick linked", "with t as (select query_id, table_id, row_id, row_number() over (partition by query_id order by row_id) - 1 tuple_id from pick join best using (table_id)), f as (select table_id, row_id, uri, min(col_id) c from linked group by all) select query_id, table_id, tuple_id, string_agg(uri, ',' order by c, uri) uris from t join f using (table_id, row_id) where tuple_id < 5 group by all", BEST)
def _(lake):
    groups = lake.table("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("table_id"))
    return evaluate.generate_queries(lake.linked, groups, 5).withColumn("uris", F.array_join("uris", ","))


@op("ev_11_stratified_sample", "", "select c_mktsegment, c_nationkey::bigint c_nationkey, c_custkey from customer qualify row_number() over (partition by c_mktsegment, c_nationkey order by md5('1:' || c_custkey), c_custkey) <= 3")
def _(lake):
    return evaluate.stratified_sample(lake.table("customer"), ["c_mktsegment", "c_nationkey"], "c_custkey", 3, 1).select("c_mktsegment", "c_nationkey", "c_custkey")


@op("ev_12_folds", "qrels", "select table_id, (row_number() over (partition by relevance > 0 order by md5('2:' || table_id), table_id) - 1) % 5 fold from qrels")
def _(lake):
    return evaluate.folds(lake.qrels.withColumn("c", F.col("relevance") > 0), ["c"], "table_id", 5, 2).select("table_id", "fold")


@op("ev_13_random_queries", "links", "select uri from links order by md5('4:' || uri), uri limit 50")
def _(lake):
    return lake.links.orderBy(evaluate.hash_order("uri", 4), "uri").select("uri").limit(50)


@op("ev_14_run_agreement", "run", "with a as (select query_id, table_id, score, floor(score / 10) s2 from run), b as (select query_id, rank() over (partition by query_id order by score desc) + (count(*) over (partition by query_id, score) - 1) / 2.0::double ra, rank() over (partition by query_id order by s2 desc) + (count(*) over (partition by query_id, s2) - 1) / 2.0::double rb, abs(score - 10 * s2) d from a) select query_id, round(avg(abs(ra - rb)), 6) rank_delta, round(avg(d), 6) score_delta from b group by 1")
def _(lake):
    two = lake.run.withColumn("s2", F.floor(F.col("score") / 10))
    both = evaluate.average_rank(evaluate.average_rank(two, ["query_id"], "score", "ra"), ["query_id"], "s2", "rb")
    return both.groupBy("query_id").agg(F.round(F.avg(F.abs(F.col("ra") - F.col("rb"))), 6).alias("rank_delta"), F.round(F.avg(F.abs(F.col("score") - 10 * F.col("s2"))), 6).alias("score_delta"))


@op("ev_15_stratum_caps", "lines", "select case when m < 3 then 'small' when m < 6 then 'middle' else 'large' end stratum, case when m < 3 then 20 when m < 6 then 50 else 150 end::bigint k, count(*) n from (select table_id, count(*) m from lines group by 1) group by all")
def _(lake):
    m = lake.lines.groupBy("table_id").agg(F.count(F.lit(1)).alias("m"))
    return m.groupBy(F.when(F.col("m") < 3, "small").when(F.col("m") < 6, "middle").otherwise("large").alias("stratum"), F.when(F.col("m") < 3, 20).when(F.col("m") < 6, 50).otherwise(150).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@op("ev_16_annotation_tasks", "run", "select query_id, table_id, (row_number() over (partition by query_id order by table_id) - 1) // 5 task from run")
def _(lake):
    return evaluate.annotation_tasks(lake.run.select("query_id", "table_id"))


WORK = {"tasks": ("run", "select distinct query_id, (row_number() over (partition by query_id order by table_id) - 1) // 5 task from run"), "done": ("tasks", "select query_id, task, 'u' || u \"user\" from tasks, range(4) r(u) where (query_id + task + u) % 3 = 0")}


@op("ev_17_work_assignment", "tasks done", "with n as (select query_id, task, count(distinct \"user\") n from done group by all), o as (select query_id, task, coalesce(n, 0) n from tasks left join n using (query_id, task) where coalesce(n, 0) < 3 and (query_id, task) not in (select (query_id, task) from done where \"user\" = 'u1')) select query_id, task from o qualify row_number() over (order by (n > 0)::int desc, query_id, task) <= (select ceil(count(*) / 15.0::double) from tasks)", WORK)
def _(lake):
    tasks = evaluate.annotation_tasks(lake.run.select("query_id", "table_id")).select("query_id", "task").distinct()
    done = tasks.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("(query_id + task + u) % 3 = 0").select("query_id", "task", F.concat(F.lit("u"), F.col("u").cast("string")).alias("user"))
    return evaluate.assign_work(tasks, done, "u1")


@op("ev_18_progress", "tasks done", "select count(*) n_tasks, count(d.query_id) n_done, min(case when d.query_id is null then t.query_id * 1000 + t.task end) next_task from tasks t left join (select distinct query_id, task from done) d using (query_id, task)", WORK)
def _(lake):
    tasks = evaluate.annotation_tasks(lake.run.select("query_id", "table_id")).select("query_id", "task").distinct()
    done = tasks.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("(query_id + task + u) % 3 = 0").select("query_id", "task", F.lit(1).alias("d")).distinct()
    return tasks.join(done, ["query_id", "task"], "left").agg(F.count(F.lit(1)).alias("n_tasks"), F.count("d").alias("n_done"), F.min(F.when(F.col("d").isNull(), F.col("query_id") * 1000 + F.col("task"))).alias("next_task"))


@op("ev_19_comparison_coverage", "linked vectors", "select table_id, round(count(vec)::double / count(*), 6) coverage from linked left join vectors using (uri) group by 1")
def _(lake):
    return lake.linked.join(lake.vectors, "uri", "left").groupBy("table_id").agg(F.round(F.count("vec") / F.count(F.lit(1)), 6).alias("coverage"))


@op("ev_20_exploration_summary", "judged", "select query_id, string_agg(event_type || ':' || relevance::bigint, ',' order by r) top from (select j.*, event_type, row_number() over (partition by query_id order by score desc, table_id) r from judged j join events on event_id = table_id) where r <= 5 group by 1")
def _(lake):
    top = search.top_k_each(evaluate.judged(lake.run, lake.qrels), 5).join(lake.events.select(F.col("event_id").alias("table_id"), "event_type"), "table_id")
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(":", "event_type", F.col("relevance").cast("long").cast("string")).alias("x")))), lambda s: s["x"]), ",").alias("top"))


@op("ev_21_random_order", "run", "select query_id, table_id, row_number() over (partition by query_id order by md5('9:' || table_id), table_id) as at from run")
def _(lake):
    return lake.run.select("query_id", "table_id", F.row_number().over(Window.partitionBy("query_id").orderBy(evaluate.hash_order("table_id", 9), "table_id")).alias("at"))


@op("ev_22_comparison_frame", "hits relevant", "select query_id, metric, round(v, 6) v from (unpivot (select query_id, h / 10.0::double as precision, coalesce(h::double / n, 0) recall from hits left join relevant using (query_id)) on precision, recall into name metric value v)", HITS)
def _(lake):
    m = evaluate.precision_recall(lake.run, lake.qrels, 10)
    return m.unpivot("query_id", ["precision", "recall"], "metric", "v").withColumn("v", F.round("v", 6))


@op("ev_23_wider_queries", "nav", "select page_id, href from nav semi join (select href from nav group by 1 having count(*) > 1) using (href)")
def _(lake):
    wide = lake.navigation.groupBy("href").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return lake.navigation.join(wide, "href", "left_semi").select("page_id", "href")


@op("ev_24_relevant_pages", "qrels", "select query_id, count(*) n from qrels where relevance > 0 group by 1")
def _(lake):
    return lake.qrels.where("relevance > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
