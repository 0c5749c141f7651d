"""Scalar functions, over vectors, sets and strings of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeseek.functions import similarity as sim
from lakeseek.operators import index
from lakeseek.plans.registry import op
from lakeseek.sources import stores

VP = {"vp": ("", "select a.vec_id a, b.vec_id b, a.embedding::double[] v, b.embedding::double[] w from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")}
COS = "(list_dot_product(v, w) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(w, w)))"


def _vp(lake):
    e = lake.table("embeddings")
    v = e.select(F.col("vec_id").alias("a"), F.col("embedding").cast("array<double>").alias("v"))
    w = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").cast("array<double>").alias("w"))
    return v.join(w, "a")


def _vector(name, expr, column):
    @op(name, "vp", f"select a, round({expr}, 6) x from vp", VP)
    def _(lake):
        return _vp(lake).select("a", F.round(column(), 6).alias("x"))


cos = lambda: sim.cosine(F.col("v"), F.col("w"))
_vector("fn_01_cosine", COS, cos)
_vector("fn_02_norm_cosine", f"({COS} + 1) / 2", lambda: sim.norm_cosine(cos()))
_vector("fn_03_abs_cosine", f"abs({COS})", lambda: sim.abs_cosine(cos()))
_vector("fn_04_angular", f"1 - acos({COS}) / pi()", lambda: sim.angular(cos()))
_vector("fn_15_dot", "list_dot_product(v, w)", lambda: sim.dot(F.col("v"), F.col("w")))
_vector("fn_12_hadamard", "v[1] * w[1] + v[64] * w[64]", lambda: F.get(sim.hadamard(F.col("v"), F.col("w")), F.lit(0)) + F.get(sim.hadamard(F.col("v"), F.col("w")), F.lit(63)))
_vector("fn_09_weighted_distance", "sqrt(0.5 * pow(v[1] - w[1], 2) + 0.25 * pow(v[2] - w[2], 2) + 0.25 * pow(v[3] - w[3], 2))", lambda: sim.weighted_distance(F.slice("v", 1, 3), F.slice("w", 1, 3), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))))
_vector("fn_10_distance_similarity", "1 / (1 + abs(v[1] - w[1]))", lambda: sim.distance_similarity(F.abs(F.get("v", F.lit(0)) - F.get("w", F.lit(0)))))
_vector("fn_11_cosine_to_ones", "list_sum(v) / (sqrt(list_dot_product(v, v)) * 8)", lambda: sim.cosine_to_ones(F.col("v")))
_vector("fn_14_hamming", "len(list_filter(range(1, 65), lambda i: (v[i] > 0) <> (w[i] > 0)))::double", lambda: sim.hamming(F.transform("v", lambda x: x > 0), F.transform("w", lambda x: x > 0)).cast("double"))
_vector("udf_01_similarity", COS, cos)

PP = {
    "pp": ("types", "select x.uri a, y.uri b from (select distinct uri from types where uri like '%/part_%') x join (select distinct uri from types where uri like '%/part_%') y on y.uri = regexp_replace(x.uri, '[0-9]+$', '') || (regexp_extract(x.uri, '([0-9]+)$', 1)::bigint + 1)"),
    "pj": ("pp types tidf", "select a, b, (select count(*) from types where uri = a and t in (select t from types where uri = b)) i, 1 z from pp"),
    "each": ("pp types", "select a, b, t, bool_or(w = 1) ina, bool_or(w = 2) inb from (select a, b, t, 1 w from pp join types on uri = a union all select a, b, t, 2 from pp join types on uri = b) group by all"),
}


def _pp(lake):
    t = lake.types.where(F.contains("uri", F.lit("/part_"))).withColumn("k", F.regexp_extract("uri", "([0-9]+)$", 1).cast("long"))
    a = t.select(F.col("uri").alias("a"), F.col("types").alias("ta"), (F.col("k") + 1).alias("k"))
    return a.join(t.select(F.col("uri").alias("b"), F.col("types").alias("tb"), "k"), "k")


@op("fn_05_jaccard", "each", "select a, b, round(count(*) filter (ina and inb)::double / count(*), 6) x from each group by all", PP)
def _(lake):
    return _pp(lake).select("a", "b", F.round(sim.jaccard(F.col("ta"), F.col("tb")), 6).alias("x"))


@op("fn_06_weighted_jaccard", "each tidf", "select a, b, round(sum(idf) filter (ina and inb) / sum(idf), 6) x from each join tidf using (t) group by all", PP)
def _(lake):
    w = index.type_idf(lake.types)
    each = _pp(lake).select("a", "b", "ta", "tb", F.explode(F.array_union("ta", "tb")).alias("type")).join(w, "type")
    m = each.groupBy("a", "b").agg(F.first("ta").alias("ta"), F.first("tb").alias("tb"), F.map_from_entries(F.collect_list(F.struct("type", "idf"))).alias("w"))
    x = F.round(sim.weighted_jaccard(F.col("ta"), F.col("tb"), F.col("w")), 6)
    return m.select("a", "b", F.when(F.size(F.array_intersect("ta", "tb")) > 0, x).alias("x"))


@op("fn_07_predicate_jaccard", "predicates", "with s as (select 'http://dbpedia.org/resource/supplier_1' q), c as (select uri, count(*) n, count(*) filter (t in (select t from predicates, s where uri = q)) i from predicates group by 1) select uri, round(i::double / (n + (select count(*) from predicates, s where uri = q) - i), 6) x from c")
def _(lake):
    one = lake.predicates.where("uri = 'http://dbpedia.org/resource/supplier_1'").select(F.col("predicates").alias("p"))
    return lake.predicates.join(F.broadcast(one)).select("uri", F.round(sim.jaccard(F.col("predicates"), F.col("p")), 6).alias("x"))  # one row


@op("fn_08_adjusted", "", "select p_partkey, case when p_size = 1 then 1.0::double else least(0.95::double, p_size / 20.0::double) end x from part")
def _(lake):
    return lake.table("part").select("p_partkey", sim.adjusted(F.col("p_size") == 1, F.col("p_size") / 20).alias("x"))


@op("fn_13_log2", "", "select p_partkey, round(log2(p_retailprice), 6) x from part")
def _(lake):
    return lake.table("part").select("p_partkey", F.round(F.log2("p_retailprice"), 6).alias("x"))


@op("fn_16_concat_digits", "", "select p_partkey, p_partkey + p_size::bigint * pow(10, ceil(log10(p_partkey + 1)))::bigint x from part")
def _(lake):
    return lake.table("part").select("p_partkey", sim.concat_digits(F.col("p_size").cast("long"), F.col("p_partkey")).alias("x"))


@op("fn_17_fletcher", "", "with r as (select p_partkey, p_partkey % 997 a, p_size::bigint b, (p_partkey * 7) % 251 c from part), s as (select p_partkey, a % 255 s1, (a + b) % 255 s2, (a + b + c) % 255 s3 from r) select p_partkey, (((s1 + s2 + s3) % 255) * 256 + s3) % 1024 x from s")
def _(lake):
    values = F.array(F.col("p_partkey") % 997, F.col("p_size").cast("long"), (F.col("p_partkey") * 7) % 251)
    return lake.table("part").select("p_partkey", sim.fletcher(values, 1024).alias("x"))


@op("fn_18_bit_band", "", "select p_partkey, (p_partkey % 2 + 2 * (p_size % 2) + 4 * ((p_partkey // 2) % 2) + 8 * ((p_size // 2) % 2))::bigint % 11 x from part")
def _(lake):
    bits = F.array(F.col("p_partkey") % 2, F.col("p_size").cast("long") % 2, F.floor(F.col("p_partkey") / 2) % 2, F.floor(F.col("p_size") / 2) % 2)
    return lake.table("part").select("p_partkey", sim.bit_band(bits, 11).alias("x"))


def _string(name, expr, column, table="pages", key="page_id"):
    @op(name, "", f"select {key}, {expr} x from {table}")
    def _(lake):
        return lake.table(table).select(key, column().alias("x"))


_string("fn_19_prefix_strip", "case when starts_with(url, 'http://') then substr(url, 8) else url end", lambda: index.strip_prefix(F.col("url"), "http://"))
_string("fn_20_uri_label", "replace(regexp_extract(url, '([^/]*)$', 1), '_', ' ')", lambda: F.replace(F.element_at(F.split("url", "/"), -1), F.lit("_"), F.lit(" ")))
_string("fn_21_host_rewrite", "replace(url, 'http://www.', 'http://en.')", lambda: F.replace("url", F.lit("http://www."), F.lit("http://en.")))
_string("fn_23_page_url", "'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_')", lambda: stores.page_url(F.col("p_name")), "part", "p_partkey")
_string("fn_24_string_predicates", "(contains(url, 'page') and starts_with(url, 'http') and not ends_with(url, '/'))", lambda: F.contains("url", F.lit("page")) & F.col("url").startswith("http") & ~F.col("url").endswith("/"))
_string("fn_25_href_pattern", "len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::bigint", lambda: F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))))
_string("fn_27_json_field", "json_extract_string(props, '$.k')", lambda: F.get_json_object("props", "$.k"), "events", "event_id")
_string("fn_28_decimal_test", "try_cast(replace(p_name, 'small ', '1') as double) is not null", lambda: F.replace("p_name", F.lit("small "), F.lit("1")).try_cast("double").isNotNull(), "part", "p_partkey")
_string("fn_29_category_title", "substr(p_name, 10)", lambda: F.substring("p_name", 10, 1 << 20), "part", "p_partkey")


@op("fn_22_quotes", "", "select count(*) n from customer where c_name = 'O''Brien'")
def _(lake):
    return lake.table("customer").where(F.col("c_name") == "O'Brien").agg(F.count(F.lit(1)).alias("n"))


@op("fn_26_navigation_links", "nav", "select page_id, href from nav")
def _(lake):
    return lake.navigation


@op("udf_02_hash_function", "", "select p_partkey, (p_partkey % 255 * 256 + p_partkey % 255) % 64 x from part")
def _(lake):
    return lake.table("part").select("p_partkey", sim.fletcher(F.array("p_partkey"), 64).alias("x"))


@op("udf_03_distance", "", "select p_partkey, ((p_partkey % 2 <> p_size % 2)::int + (p_partkey % 3 <> p_size % 3)::int)::bigint x from part")
def _(lake):
    mods = lambda c: F.array(F.col(c).cast("long") % 2, F.col(c).cast("long") % 3)
    return lake.table("part").select("p_partkey", sim.hamming(mods("p_partkey"), mods("p_size")).alias("x"))


@op("ext_01_driver_plugin", "vectors", "select count(*) n from vectors")
def _(lake):
    store = stores.VectorStore(lake.spark, stores.scratch(lake.spark, "plugin"), "json")
    store.insert(lake.vectors)
    return store.read().agg(F.count(F.lit(1)).alias("n"))
