"""Table search: exact, analogous, by PageRank and by keywords, with pre-filtering.

query: tuple_id, pos, uri (one query). Every search returns (table_id, score); top_k ranks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions import similarity as sim
from lakeseek.operators import align


def top_k(results: DataFrame, k: int) -> DataFrame:
    """The k best tables; equal scores by table_id."""
    return results.orderBy(F.col("score").desc(), "table_id").limit(k)


def top_k_each(results: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "table_id") -> DataFrame:
    """The k best of each query, with their rank."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), tie))).where(F.col("rank") <= k)


def exact_search(query: DataFrame, linked: DataFrame) -> DataFrame:
    """Tables with rows that hold all of the query's entities, scored by the number of such rows."""
    asked = query.select("uri").distinct()
    n = asked.agg(F.count(F.lit(1)).alias("n"))
    rows = linked.join(asked, "uri", "left_semi").groupBy("table_id", "row_id").agg(F.count_distinct("uri").alias("m"))
    return rows.join(F.broadcast(n)).where("m = n").groupBy("table_id").agg(F.count(F.lit(1)).cast("double").alias("score"))  # n is one row


def containing_tables(query: DataFrame, linked: DataFrame) -> DataFrame:
    """(table_id): tables with all of the query's entities anywhere."""
    asked = query.select("uri").distinct()
    n = asked.agg(F.count(F.lit(1)).alias("n"))
    met = linked.join(asked, "uri", "left_semi").groupBy("table_id").agg(F.count_distinct("uri").alias("m"))
    return met.join(F.broadcast(n)).where("m = n").select("table_id")  # n is one row


def pairwise_rows(query: DataFrame, linked: DataFrame) -> DataFrame:
    """(a, b, tables, rows): for each two query entities, in how many tables and rows they stand together."""
    asked = linked.join(query.select("uri").distinct(), "uri", "left_semi").select("table_id", "row_id", "uri").distinct()
    both = asked.alias("x").join(asked.alias("y"), ["table_id", "row_id"]).where("x.uri < y.uri")
    return both.groupBy(F.col("x.uri").alias("a"), F.col("y.uri").alias("b")).agg(F.count_distinct("table_id").alias("tables"), F.count(F.lit(1)).alias("rows"))


def type_similarity(types: DataFrame, adjusted: bool = True, weights: DataFrame | None = None, column: str = "types", query: DataFrame | None = None):
    """A similarity for analogous_search: (weighted) Jaccard of two entities' sets. types: uri, <column>; weights: type, idf. Where the query is given, its entities' sets are broadcast."""

    def add(pairs: DataFrame) -> DataFrame:
        asked = types.select(F.col("uri").alias("q"), F.col(column).alias("u"))
        if query is not None:
            asked = F.broadcast(asked.join(F.broadcast(query.select(F.col("uri").alias("q")).distinct()), "q", "left_semi"))
        both = pairs.join(types.select(F.col("uri"), F.col(column).alias("t")), "uri", "left").join(asked, "q", "left")
        empty = F.array().cast("array<string>")
        t, u = F.coalesce("t", empty), F.coalesce("u", empty)
        if weights is None:
            s = sim.jaccard(t, u)
            both = both.withColumn("s", s)
        else:
            each = both.select("q", "uri", F.explode_outer(F.array_union(t, u)).alias("type"), t.alias("t"), u.alias("u")).join(weights, "type", "left")
            w = F.when(F.col("idf") == -1, 0.0).otherwise(F.coalesce("idf", F.lit(0.0)))
            shared = F.array_contains("t", F.col("type")) & F.array_contains("u", F.col("type"))
            both = each.groupBy("q", "uri").agg(F.coalesce(F.try_divide(F.sum(F.when(shared, w).otherwise(0.0)), F.sum(w)), F.lit(0.0)).alias("s"))
        s = sim.adjusted(F.col("q") == F.col("uri"), F.col("s")) if adjusted else F.col("s")
        return both.select("q", "uri", s.alias("sim"))

    return add


def vector_similarity(vectors: DataFrame, kind: str = "norm", adjusted: bool = False):
    """A similarity for analogous_search: cosine of two entities' vectors (norm, abs or angular); null where a vector lacks."""
    shape = {"norm": sim.norm_cosine, "abs": sim.abs_cosine, "angular": sim.angular}[kind]

    def add(pairs: DataFrame) -> DataFrame:
        both = pairs.join(vectors.select("uri", F.col("vec").alias("v")), "uri", "left").join(vectors.select(F.col("uri").alias("q"), F.col("vec").alias("w")), "q", "left")
        s = F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), shape(sim.cosine(F.col("v"), F.col("w"))))
        return both.select("q", "uri", (sim.adjusted(F.col("q") == F.col("uri"), s) if adjusted else s).alias("sim"))

    return add


def row_scores(query: DataFrame, linked: DataFrame, pairs: DataFrame, single_column: bool = False, coverage: bool = False, widths: DataFrame | None = None) -> DataFrame:
    """(table_id, row_id, tuple_id, pos, s): a row's similarity to each query entity.

    Any column: the best of the row. Single column: that of the column the entity is assigned to, 0 if its cell isn't linked. Each row with a linked cell has
    a value for each tuple and place. widths (table_id, n_cols) are the tables' own; where none are given, a table ends at its last linked column. coverage drops a (tuple, row) unless all of its entities have vectors.
    """
    q = query.select("tuple_id", "pos", F.col("uri").alias("q"))
    sims = linked.join(pairs, "uri").join(q, "q").select("table_id", "row_id", "col_id", "tuple_id", "pos", "sim")
    if single_column:
        scores = align.column_scores(query, linked, pairs)
        if widths is None:
            widths = linked.groupBy("table_id").agg((F.max("col_id") + 1).alias("n_cols"))
        to = align.assign(scores, query, widths).withColumnRenamed("col_id", "to")
        s = F.max(F.when(F.col("col_id") == F.col("to"), F.coalesce("sim", F.lit(0.0))))
        sims = sims.join(to, ["table_id", "tuple_id", "pos"])
    else:
        s = F.max("sim")
    out = sims.groupBy("table_id", "row_id", "tuple_id", "pos").agg(F.coalesce(s, F.lit(0.0)).alias("s"), F.bool_and(F.col("sim").isNotNull()).alias("covered"))
    if coverage:
        out = out.withColumn("covered", F.bool_and("covered").over(Window.partitionBy("table_id", "row_id", "tuple_id"))).where("covered")
    return out.drop("covered")


def tuple_vectors(rows: DataFrame, use_max: bool = True) -> DataFrame:
    """(table_id, tuple_id, pos, v): best (0 at least) or mean similarity over a table's rows."""
    v = F.greatest(F.max("s"), F.lit(0.0)) if use_max else F.avg("s")
    return rows.groupBy("table_id", "tuple_id", "pos").agg(v.alias("v"))


def tuple_weights(query: DataFrame, idf: DataFrame) -> DataFrame:
    """(tuple_id, pos, w): a tuple's IDFs over their sum; equal weights where no entity has one."""
    q = query.join(idf, "uri", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    t = Window.partitionBy("tuple_id")
    return q.select("tuple_id", "pos", F.when(F.sum("idf").over(t) > 0, F.col("idf") / F.sum("idf").over(t)).otherwise(1 / F.count(F.lit(1)).over(t)).alias("w"))


def tuple_scores(vectors: DataFrame, weights: DataFrame, measure: str = "euclidean") -> DataFrame:
    """(table_id, tuple_id, score): weighted distance to the all-ones vector as similarity, or cosine to it."""
    if measure == "euclidean":
        d = F.sqrt(F.sum(F.col("w") * (F.col("v") - 1) * (F.col("v") - 1)))
        return vectors.join(F.broadcast(weights), ["tuple_id", "pos"]).groupBy("table_id", "tuple_id").agg(sim.distance_similarity(d).alias("score"))  # weights: a row for each query entity
    norm = F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.sqrt(F.count(F.lit(1)))
    return vectors.groupBy("table_id", "tuple_id").agg(F.coalesce(F.try_divide(F.sum("v"), norm), F.lit(0.0)).alias("score"))


def table_scores(tuples: DataFrame, query: DataFrame) -> DataFrame:
    """(table_id, score): mean over all query tuples; a tuple that scored no row counts 0."""
    n = query.agg(F.count_distinct("tuple_id").alias("n"))
    return tuples.groupBy("table_id").agg(F.sum("score").alias("s")).join(F.broadcast(n)).select("table_id", (F.col("s") / F.col("n")).alias("score"))  # n is one row


#: Distinct rows of similarities that are sent to all executors, at most; beyond it each cell carries its own.
MOST_KINDS = 65_536


def _scored_tables(tuples: list[tuple[list[int], list[int], list[float]]], lut: np.ndarray | None, lanes: int, measure: str):
    """Rows (table_id, col_id, kind, n_cols) sorted by table -> (table_id, score): columns' sums and bests, the assignment, and the tuples' scores.

    tuples: the lane asked for at each place (`lanes`, of zeros, at a place left out), the places held and their weights. kind: a row of lut, or the similarities themselves. n_cols: null
    where a table ends at its last linked column. Of a table that goes on in the next batch only its columns' sums and bests are kept.
    """

    def finished(tables, widths, of, col, sums, bests):
        score = np.zeros(len(widths))
        place = np.empty(len(widths), np.int64)
        for n in np.unique(widths).tolist():
            at = np.flatnonzero(widths == n)
            place[at] = np.arange(len(at))
            own = (widths[of] == n) & (col < n)
            total, best = np.zeros((2, len(at), n, lanes + 1))
            total[place[of[own]], col[own]], best[place[of[own]], col[own]] = sums[own], np.maximum(bests[own], 0)
            for lane, held, w in tuples:
                v = np.zeros((len(at), len(held)))
                if len(lane) <= n:
                    to = align.assignments(total[:, :, lane].transpose(0, 2, 1))[:, held]
                    v = best[np.arange(len(at))[:, None], to, np.array(lane)[held]]
                if measure == "euclidean":
                    score[at] += 1 / (np.sqrt((np.array(w) * (v - 1) ** 2).sum(1)) + 1)
                else:
                    norm = np.sqrt((v * v).sum(1)) * np.sqrt(len(held))
                    score[at] += np.divide(v.sum(1), norm, out=np.zeros(len(at)), where=norm > 0)
        return pa.RecordBatch.from_arrays([tables, pa.array(score / len(tuples))], names=["table_id", "score"])

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(0), run_end_type=pa.int64())
            tables, ends = runs.values, runs.run_ends.to_numpy()
            of, col = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), batch.column(1).to_numpy().astype(np.int64)
            kind = batch.column(2)
            row = lut[kind.to_numpy()] if lut is not None else np.ascontiguousarray(kind.flatten().to_numpy()).reshape(batch.num_rows, lanes)
            sums = bests = np.concatenate((row, np.zeros((len(row), 1))), 1)
            given = pc.fill_null(batch.column(3), 0).to_numpy().astype(np.int64)[np.concatenate(([0], ends[:-1]))]
            if last is not None:
                if not last[0].equals(tables.slice(0, 1)):
                    yield finished(*last)
                else:
                    of, col = np.concatenate((last[2], of)), np.concatenate((last[3], col))
                    sums, bests = np.concatenate((last[4], sums)), np.concatenate((last[5], bests))
            # One entry for each table's column.
            order = np.lexsort((col, of))
            of, col = of[order], col[order]
            starts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (col[1:] != col[:-1]))))
            of, col, sums, bests = of[starts], col[starts], np.add.reduceat(sums[order], starts), np.maximum.reduceat(bests[order], starts)
            ends = np.zeros(len(tables), np.int64)
            np.maximum.at(ends, of, col + 1)
            widths = np.where(given > 0, given, ends)
            here, n = of < len(tables) - 1, len(tables) - 1
            if n:
                yield finished(tables.slice(0, n), widths[:n], of[here], col[here], sums[here], bests[here])
            last = (tables.slice(n, 1), widths[n:], of[~here] - n, col[~here], sums[~here], bests[~here])
        if last is not None:
            yield finished(*last)

    return run


def column_search(query: DataFrame, cells: DataFrame, pairs: DataFrame, idf: DataFrame, measure: str = "euclidean", widths: DataFrame | int | None = None, save=None) -> DataFrame:
    """(table_id, score): analogous search in single columns, by the best similarity of the column that an entity is assigned to.

    cells: table_id, col_id, uri; pairs: q, uri, sim, of each query entity with each uri that counts. Which row a cell is in makes no difference to a column's sum and best, so a cell is
    shuffled twice: by uri to get the number of its row of similarities, and by table with that number only. A table's cells are read in one task, its columns' sums and bests kept.
    The query, its weights and at most MOST_KINDS distinct rows of similarities go to the driver. save(df), if given, cuts the lineage.
    """
    asked = sorted((r.tuple_id, r.pos, r.uri) for r in query.select("tuple_id", "pos", "uri").distinct().collect())
    if not asked:
        return cells.select("table_id", F.lit(0.0).alias("score")).limit(0)
    weights = {(r.tuple_id, r.pos): r.w for r in tuple_weights(query, idf).collect()}
    names = sorted({u for _, _, u in asked})
    at: dict = {}
    for t, p, u in asked:
        at.setdefault(t, {})[p] = names.index(u)
    tuples = [([own.get(p, len(names)) for p in range(max(own) + 1)], sorted(own), [weights[t, p] for p in sorted(own)]) for t, own in at.items()]
    each = [F.coalesce(F.max(F.when(F.col("q") == u, F.col("sim"))), F.lit(0.0)) for u in names]
    wide = pairs.groupBy("uri").agg(F.array(*each).alias("sims"))
    wide = save(wide) if save else wide
    kinds = sorted(tuple(r.sims) for r in wide.select("sims").distinct().limit(MOST_KINDS + 1).collect())
    spark = query.sparkSession
    lut = None
    if len(kinds) <= MOST_KINDS:
        lut = np.array(kinds, float).reshape(len(kinds), len(names))
        known = spark.createDataFrame([(list(k), i) for i, k in enumerate(kinds)], "sims array<double>, kind int")
        wide = wide.join(F.broadcast(known), "sims").select("uri", "kind")  # MOST_KINDS rows at most
    else:
        wide = wide.withColumnRenamed("sims", "kind")
    held = cells.select("table_id", F.col("col_id").cast("int").alias("col_id"), "uri").join(wide, "uri").select("table_id", "col_id", "kind")
    if isinstance(widths, DataFrame):
        held = held.join(widths.select("table_id", F.col("n_cols").cast("int").alias("n_cols")), "table_id")
        held = held.repartition("table_id").sortWithinPartitions("table_id")
    else:
        held = held.repartition("table_id").sortWithinPartitions("table_id").withColumn("n_cols", F.lit(widths).cast("int"))
    return held.mapInArrow(_scored_tables(tuples, lut, len(names), measure), f"table_id {dict(cells.dtypes)['table_id']}, score double")


def analogous_search(query: DataFrame, linked: DataFrame, similarity, idf: DataFrame, *, single_column: bool = False, use_max: bool = True, measure: str = "euclidean", coverage: bool = False, candidates: DataFrame | None = None, widths: DataFrame | None = None) -> DataFrame:
    """Tables by the similarity of their rows to the query's tuples. candidates (table_id) restrict the corpus before anything is scored; widths (table_id, n_cols) are for single_column."""
    if candidates is not None:
        linked = linked.join(candidates, "table_id", "left_semi")
    pairs = align.pair_similarities(query, linked, similarity)
    if single_column and use_max and not coverage:
        return column_search(query, linked, pairs, idf, measure, widths)
    rows = row_scores(query, linked, pairs, single_column, coverage, widths)
    return table_scores(tuple_scores(tuple_vectors(rows, use_max), tuple_weights(query, idf), measure), query)


# Keywords


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token) of lower-cased runs of letters and digits."""
    return docs.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("token")).where("token <> ''")


def text_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf, len): postings with their document's length."""
    tf = tokens(docs, key, text).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(tf.groupBy(key).agg(F.sum("tf").alias("len")), key)


def bm25(index: DataFrame, queries: DataFrame, key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score): Okapi BM25 of each query's distinct tokens. queries: query_id, text."""
    lengths = index.select(key, "len").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    asked = tokens(queries, "query_id", "text").distinct()
    df = index.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    hits = index.join(df, "token").join(asked, "token").join(F.broadcast(lengths))  # lengths is one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return hits.groupBy("query_id", key).agg(F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))).alias("score"))


def bm25_tables(index: DataFrame, query: DataFrame, labels: DataFrame, key: str, size: int = 10, merge: str = "sum") -> DataFrame:
    """(table_id, score): the `size` best documents of each query entity's label, summed by document or (merge="none") appended."""
    asked = query.select("uri").distinct().join(labels, "uri").select(F.col("uri").alias("query_id"), F.col("label").alias("text"))
    hits = top_k_each(bm25(index, asked, key), size, tie=key)
    return hits.groupBy(F.col(key).alias("table_id")).agg(F.sum("score").alias("score")) if merge == "sum" else hits.select(F.col(key).alias("table_id"), "score")


def link_mentions(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """(mention, uri): the entity whose label scores best for each distinct mention. labels: uri, label."""
    asked = mentions.select("mention").distinct()
    scored = bm25(text_index(labels, "uri", "label"), asked.select(F.col("mention").alias("query_id"), F.col("mention").alias("text")), "uri")
    return top_k_each(scored.withColumn("score", F.round("score", 9)), 1, tie="uri").select(F.col("query_id").alias("mention"), "uri")


# Pre-filter


def query_blocks(query: DataFrame, least: int = 8, rows: int = 3) -> DataFrame:
    """Adds block: tuples in threes where there are at least `least`, else all in block 0."""
    n = query.agg(F.count_distinct("tuple_id").alias("n"))
    place = F.dense_rank().over(Window.orderBy("tuple_id"))
    return query.withColumn("_at", place).join(F.broadcast(n)).withColumn("block", F.when(F.col("n") >= least, F.floor((F.col("_at") - 1) / rows)).otherwise(0).cast("long")).drop("_at", "n")  # n is one row


def prefilter(query: DataFrame, lookup, least: int = 8, rows: int = 3, hits: int = 2) -> DataFrame:
    """(table_id): candidates that lookup((block, pos, uri)) -> (block, table_id) finds with each column's entities merged; long queries need `hits` blocks."""
    blocks = query_blocks(query, least, rows)
    found = lookup(blocks.select("block", "pos", "uri").distinct()).select("block", "table_id").distinct()
    need = blocks.agg(F.when(F.count_distinct("block") > 1, hits).otherwise(1).alias("need"))
    return found.groupBy("table_id").agg(F.count(F.lit(1)).alias("m")).join(F.broadcast(need)).where("m >= need").select("table_id")  # need is one row


# Personalised PageRank


def edge_ratio(degree, n_nodes, n_edges: float = 98_900_215.0):
    """Degree over the graph's mean; above 1 it grows by its logarithm."""
    r = degree / (F.lit(n_edges) / n_nodes)
    return F.when(r > 1, 1 + F.log10(r)).otherwise(r)


def seed_weights(query: DataFrame, degrees: DataFrame, n_nodes, idf: DataFrame, n_edges: float = 98_900_215.0) -> DataFrame:
    """(tuple_id, uri, weight): half the edge ratio, half the IDF over its mean in the query."""
    q = query.select("tuple_id", "uri").distinct().join(degrees, "uri", "left").join(idf, "uri", "left")
    ratio = F.coalesce(F.try_divide(F.col("idf"), F.avg("idf").over(Window.partitionBy())), F.lit(0.0))
    return q.select("tuple_id", "uri", (0.5 * edge_ratio(F.coalesce("degree", F.lit(0)), n_nodes, n_edges) + 0.5 * ratio).alias("weight"))


def combined_tuple(query: DataFrame) -> DataFrame:
    """All tuples' distinct entities as one tuple, in order of first appearance."""
    first = query.groupBy("uri").agg(F.min(F.struct("tuple_id", "pos")).alias("at"))
    return first.select(F.lit(0).cast("long").alias("tuple_id"), (F.row_number().over(Window.orderBy("at")) - 1).cast("long").alias("pos"), "uri")


def particle_filtering(seeds: DataFrame, edges: DataFrame, particles: float = 200.0, threshold: float = 0.005, damping: float = 0.85, depth: int = 3, save=None) -> DataFrame:
    """(tuple_id, node, score): weighted seeds send `particles` along edges in equal parts; a node keeps what it gets and passes on `damping` of it, unless it is below
    threshold * particles; `depth` rounds. edges: src, dst, taken both ways. Each round is one join on src; save(df), if given, cuts the lineage after each.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = both.join(both.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "src")
    total = F.sum("weight").over(Window.partitionBy("tuple_id"))
    at = seeds.select("tuple_id", F.col("uri").alias("node"), (F.lit(particles) * F.col("weight") / total).alias("p"))
    held = at
    for _ in range(depth):
        live = at.where(F.col("p") >= threshold * particles)
        at = live.join(both, live["node"] == both["src"]).groupBy("tuple_id", F.col("dst").alias("node")).agg(F.sum(damping * F.col("p") / F.col("degree")).alias("p"))
        at = save(at) if save else at
        held = held.unionByName(at)
    return held.groupBy("tuple_id", "node").agg(F.sum("p").alias("score"))


def ppr_search(seeds: DataFrame, edges: DataFrame, table_nodes: DataFrame, k: int = 100, **more) -> DataFrame:
    """(table_id, score): a tuple's k best nodes, of them the tables, summed over tuples. table_nodes: node, table_id."""
    scored = particle_filtering(seeds, edges, **more)
    best = top_k_each(scored.withColumn("score", F.round("score", 9)), k, by="tuple_id", tie="node")
    return best.join(table_nodes, "node").groupBy("table_id").agg(F.sum("score").alias("score"))
