"""Rankings, retrieval metrics, query generation and sampling, and the annotation study.

run: query_id, table_id, score. qrels: query_id, table_id, relevance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(df: DataFrame, by: list[str], score: str, out: str = "rank") -> DataFrame:
    """Rank by falling score, ties at their mean."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, score))
    return df.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(F.col(score).desc())) + (ties - 1) / 2)


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with relevance, 0 where it isn't judged."""
    return run.join(qrels.select("query_id", "table_id", "relevance"), ["query_id", "table_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def ndcg(run: DataFrame, k: int, ties: bool = True) -> DataFrame:
    """(query_id, ndcg) of a judged run: gains over log2(rank + 1), ideal order below; tied scores share the mean of their ranks' discounts, or stand in order of table_id."""
    q = Window.partitionBy("query_id")
    order = q.orderBy(F.col("score").desc(), "table_id")
    discount = lambda r: F.when(r <= k, 1 / F.log2(r + 1)).otherwise(0.0)
    d = run.withColumn("r", F.row_number().over(order)).withColumn("d", discount(F.col("r")))
    if ties:
        d = d.withColumn("d", F.avg("d").over(Window.partitionBy("query_id", "score")))
    d = d.withColumn("i", discount(F.row_number().over(q.orderBy(F.col("relevance").desc(), "table_id"))))
    return d.groupBy("query_id").agg(F.coalesce(F.try_divide(F.sum(F.col("relevance") * F.col("d")), F.sum(F.col("relevance") * F.col("i"))), F.lit(0.0)).alias("ndcg"))


def at_k(run: DataFrame, k: int) -> DataFrame:
    return run.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "table_id"))).where(F.col("_r") <= k).drop("_r")


def precision_recall(run: DataFrame, qrels: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(query_id, hits, precision, recall) of the first k tables; relevant: relevance above `least`."""
    relevant = qrels.where(F.col("relevance") > least)
    hits = at_k(run, k).join(relevant, ["query_id", "table_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    n = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    every = run.select("query_id").distinct().join(hits, "query_id", "left").join(n, "query_id", "left")
    h = F.coalesce("hits", F.lit(0)).cast("long")
    return every.select("query_id", h.alias("hits"), (h / k).alias("precision"), F.coalesce(F.try_divide(h, F.col("n")), F.lit(0.0)).alias("recall"))


def auc(run: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, auc): relevant tables' ranks, ties and unscored tables at their mean rank. corpus: query_id, table_id."""
    rows = corpus.join(run, ["query_id", "table_id"], "left").join(qrels.where("relevance > 0").select("query_id", "table_id", F.lit(1).alias("pos")), ["query_id", "table_id"], "left")
    rows = average_rank(rows.withColumn("score", F.coalesce("score", F.lit(float("-inf")))), ["query_id"], "score")
    g = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("pos").alias("p"), F.sum(F.when(F.col("pos") == 1, F.col("rank"))).alias("s"))
    p, n = F.col("p"), F.col("n")
    return g.where((p > 0) & (p < n)).select("query_id", (1 - (F.col("s") - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


#: Pages that one row of a class is paired with, about, before the class is dealt to further slices.
SLICE = 4_096


def page_similarity(attributes: DataFrame, weighted: bool = False, least: float = 0.01, digits: int | None = None) -> DataFrame:
    """(a, b, score) for pages a <> b with (IDF-weighted) Jaccard above `least`, rounded to `digits`; pages without any such partner have themselves, 1. attributes: page, attribute.

    Pages with the same attributes are a class, known by the SHA-256 of their sorted set. Classes are compared, by an equi-join on attributes, and a class stands
    for its pages: pairs of pages are first listed as they are returned, and no shuffle carries them. For that a page's rows are as many as its class has
    similar classes, and a class that many rows ask for is dealt by hash into slices.
    """
    sets = attributes.groupBy("page").agg(F.sort_array(F.collect_set("attribute")).alias("set")).select("page", "set", F.sha2(F.to_json("set"), 256).alias("class"))
    pages = sets.agg(F.count("page").alias("pages"))
    sets = sets.where(F.size("set") > 0)
    classes = sets.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.first("set").alias("set"))
    members = sets.select("page", "class")
    attrs = classes.select("class", "n", F.explode("set").alias("attribute"))
    occ = attrs.groupBy("attribute").agg(F.sum("n").alias("occ")).join(F.broadcast(pages))  # pages is one row
    w = F.log2(F.col("pages") / F.col("occ")) if weighted else F.lit(1.0)
    attrs = attrs.join(occ.select("attribute", w.alias("w")), "attribute")
    mass = attrs.groupBy("class", "n").agg(F.sum("w").alias("mass"))
    both = attrs.select("class", "attribute", "w").join(attrs.select("attribute", F.col("class").alias("other")), "attribute").groupBy("class", "other").agg(F.sum("w").alias("shared"))
    both = both.join(mass, "class").join(mass.select(F.col("class").alias("other"), F.col("n").alias("n2"), F.col("mass").alias("mass2")), "other")
    score = F.coalesce(F.try_divide(F.col("shared"), F.col("mass") + F.col("mass2") - F.col("shared")), F.lit(0.0))
    met = both.withColumn("score", score).where(F.col("score") > least)
    # A class of one page has no pair with itself.
    met = met.where((F.col("class") != F.col("other")) | (F.col("n") > 1))
    n_slices = F.floor((F.sum("n").over(Window.partitionBy("other")) - 1) / SLICE) + 1
    met = met.select("class", "other", F.col("score") if digits is None else F.round("score", digits).alias("score"), n_slices.alias("slices"))
    asks = members.join(met, "class").select(F.col("page").alias("a"), "other", "score", F.pmod(F.xxhash64("page"), F.col("slices")).alias("slice"))
    slices = met.groupBy("other").agg(F.first("slices").alias("slices"))
    asked = members.withColumnRenamed("class", "other").join(slices, "other").select(F.col("page").alias("b"), "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    # Small as they are, both sides keep their partitions: few tasks would list all pairs.
    n = int(attributes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asks, asked = (df.repartition(n, "other", "slice") for df in (asks, asked))
    scored = asks.join(asked, ["other", "slice"]).where("a <> b").select("a", "b", "score")
    alone = members.join(met.select("class").distinct(), "class", "left_anti")
    return scored.unionByName(alone.select(F.col("page").alias("a"), F.col("page").alias("b"), F.lit(1.0).alias("score")))


def best_rows(linked: DataFrame) -> DataFrame:
    """(table_id, row_id, n): a table's rows with the most distinct entities."""
    n = linked.groupBy("table_id", "row_id").agg(F.count_distinct("uri").alias("n"))
    return n.withColumn("r", F.rank().over(Window.partitionBy("table_id").orderBy(F.col("n").desc()))).where("r = 1").drop("r")


def generate_queries(linked: DataFrame, groups: DataFrame, n_tuples: int, least_width: int = 1) -> DataFrame:
    """(query_id, table_id, tuple_id, uris): of each group's tables the one with the widest best rows, then the most of them; its first rows. groups: query_id, table_id."""
    rows = best_rows(linked)
    tables = rows.groupBy("table_id").agg(F.max("n").alias("width"), F.count(F.lit(1)).alias("m")).where(F.col("width") >= least_width)
    pick = groups.join(tables, "table_id").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("width"), F.desc("m"), "table_id"))).where("r = 1").select("query_id", "table_id")
    chosen = pick.join(rows, "table_id").withColumn("tuple_id", F.row_number().over(Window.partitionBy("query_id").orderBy("row_id")) - 1).where(F.col("tuple_id") < n_tuples)
    first = linked.groupBy("table_id", "row_id", "uri").agg(F.min("col_id").alias("c"))
    tuples = chosen.join(first, ["table_id", "row_id"]).groupBy("query_id", "table_id", "tuple_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "uri"))), lambda x: x["uri"]).alias("uris"))
    return tuples


def hash_order(key: Column | str, seed: int = 0) -> Column:
    """A fixed random order, the same in any engine: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")).cast("binary"))


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(key, seed), key))).where(F.col("_r") <= n).drop("_r")


def folds(df: DataFrame, classes: list[str], key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds fold 0..k-1, dealt evenly within each class."""
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy(*classes).orderBy(hash_order(key, seed), key)) - 1) % k)


def balanced_labels(positives: DataFrame, corpus: DataFrame, seed: int = 0) -> DataFrame:
    """(query_id, table_id, relevance): each query's positives, and as many other tables of the corpus. positives: query_id, table_id; corpus: table_id.

    The others are a query's run of the corpus in hash order from a place that its name fixes, so no pair of query and corpus is made.
    """
    placed = corpus.select("table_id").distinct().withColumn("at", F.row_number().over(Window.orderBy(hash_order("table_id", seed))) - 1)
    n = corpus.select("table_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    want = positives.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(n))  # n is one row
    # Twice as many places as needed: at most m of them are positives themselves.
    start = F.conv(F.substring(hash_order("query_id", seed), 1, 8), 16, 10).cast("long")
    seats = want.select("query_id", "m", F.explode(F.sequence(F.lit(0), F.least(2 * F.col("m"), F.col("n")) - 1)).alias("i"), ((start + F.col("i")) % F.col("n")).alias("at"))
    free = seats.join(placed, "at").join(positives, ["query_id", "table_id"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("i"))).where("r <= m")
    return positives.select("query_id", "table_id", F.lit(1.0).alias("relevance")).unionByName(free.select("query_id", "table_id", F.lit(0.0).alias("relevance")))


def annotation_tasks(tables: DataFrame, size: int = 5) -> DataFrame:
    """Adds task: a query's tables in chunks. tables: query_id, table_id."""
    return tables.withColumn("task", F.floor((F.row_number().over(Window.partitionBy("query_id").orderBy("table_id")) - 1) / size))


def assign_work(tasks: DataFrame, done: DataFrame, user: str, workers: int = 15, most: int = 3) -> DataFrame:
    """(query_id, task): what a user gets next: partly assigned tasks first, then new ones, ceil(tasks / workers). tasks: query_id, task; done: query_id, task, user."""
    share = tasks.select("query_id", "task").distinct().agg(F.ceil(F.count(F.lit(1)) / workers).alias("share"))
    n = done.groupBy("query_id", "task").agg(F.count_distinct("user").alias("n"))
    open_ = tasks.select("query_id", "task").distinct().join(n, ["query_id", "task"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < most)
    open_ = open_.join(done.where(F.col("user") == user).select("query_id", "task").distinct(), ["query_id", "task"], "left_anti")
    ranked = open_.withColumn("r", F.row_number().over(Window.orderBy(F.when(F.col("n") > 0, 0).otherwise(1), "query_id", "task"))).join(F.broadcast(share))  # share is one row
    return ranked.where("r <= share").select("query_id", "task")


def summary(df: DataFrame, column: str, by: list[str] | None = None, sample: bool = False) -> DataFrame:
    """max, min, mean, std and median of a column."""
    std = F.stddev_samp(column) if sample else F.stddev_pop(column)
    return df.groupBy(*(by or [])).agg(F.max(column).cast("double").alias("max"), F.min(column).cast("double").alias("min"), F.avg(column).alias("avg"), std.alias("std"), F.percentile(column, 0.5).alias("median"))


def capped_histogram(df: DataFrame, column: str, cap: int) -> DataFrame:
    """(value, n); values above the cap are counted at cap + 1."""
    return df.groupBy(F.least(F.col(column), F.lit(cap + 1)).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
