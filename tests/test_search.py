"""Search, hashing, alignment and evaluation on small tables made by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lakeseek.operators import align, evaluate, index, lsh, search
from lakeseek.sources import readers, stores


@pytest.fixture(scope="module")
def lake(spark):
    linked = spark.createDataFrame([(1, 0, 0, "u1"), (1, 0, 1, "u2"), (1, 1, 0, "u2"), (1, 1, 1, "u3"), (2, 0, 0, "u1"), (3, 0, 0, "u2"), (3, 0, 1, "u3")], "table_id long, row_id long, col_id long, uri string")
    types = spark.createDataFrame([("u1", ["t1", "t2", "t3"]), ("u2", ["t2"]), ("u3", ["t1", "t2"])], "uri string, types array<string>")
    return linked, types


def query(spark, *tuples):
    return spark.createDataFrame([(i, p, u) for i, t in enumerate(tuples) for p, u in enumerate(t)], "tuple_id long, pos long, uri string")


def test_idf(lake):
    linked, types = lake
    got = dict(index.entity_idf(linked, 3).collect())
    assert got["u1"] == pytest.approx(1.176091, abs=1e-6)
    assert dict(index.type_idf(types).collect())["t3"] == pytest.approx(1.584963, abs=1e-6)


def test_popular(lake):
    linked, types = lake
    names = lambda df: {r[0] for r in df.collect()}
    assert names(index.popular_by_percentile(types, 0.0)) == {"t1", "t2", "t3"}
    assert names(index.popular_by_percentile(types, 0.6)) == {"t1", "t2"}
    assert names(index.popular_by_percentile(types, 1.0)) == set()
    assert names(index.popular_by_table(linked, types, 0.8)) == {"t1", "t2"}
    with pytest.raises(ValueError):
        index.popular_by_percentile(types, 1.5)


def test_exact_search(spark, lake):
    assert [tuple(r) for r in search.exact_search(query(spark, ["u2", "u3"]), lake[0]).orderBy("table_id").collect()] == [(1, 1.0), (3, 1.0)]
    assert search.exact_search(query(spark, ["u1", "u3"]), lake[0]).count() == 0


def test_analogous_search_by_hand(spark, lake):
    linked, types = lake
    idf = spark.createDataFrame([("u1", 1.0), ("u2", 3.0)], "uri string, idf double")
    got = dict(search.analogous_search(query(spark, ["u1", "u2"]), linked, search.type_similarity(types), idf).collect())
    assert got[1] == pytest.approx(1.0)  # its first row is the query's tuple
    # Table 2 holds u1 only: v = [1, 1/3], w = [1/4, 3/4].
    assert got[2] == pytest.approx(1 / (1 + (0.75 * (2 / 3) ** 2) ** 0.5))
    # Table 3 holds u2 and u3: v = [max(1/3, 2/3), 1].
    assert got[3] == pytest.approx(1 / (1 + (0.25 * (1 / 3) ** 2) ** 0.5))


def test_coverage_drops_rows(spark, lake):
    vectors = spark.createDataFrame([("u1", [1.0, 0.0]), ("u2", [0.0, 1.0])], "uri string, vec array<double>")
    q = query(spark, ["u1"])
    pairs = align.pair_similarities(q, lake[0], search.vector_similarity(vectors))
    rows = {(r.table_id, r.row_id) for r in search.row_scores(q, lake[0], pairs, coverage=True).collect()}
    assert rows == {(1, 0), (2, 0)}


def test_assignment_against_enumeration(spark):
    rng = random.Random(3)
    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        s = [[float(rng.randint(0, 4)) for _ in range(m)] for _ in range(n)]
        best = [-1] * n if n > m else list(min(itertools.permutations(range(m), n), key=lambda p: (-sum(s[i][c] for i, c in enumerate(p)), p)))
        assert align.best_assignment(s) == best
    assert align.best_assignment([[3.0, 2.0, 0.0], [3.0, 1.0, 0.0]]) == [1, 0]


def test_assignment_in_spark_agrees(spark, lake):
    linked, types = lake
    q = query(spark, ["u1", "u2"], ["u3"])
    pairs = align.pair_similarities(q, linked, search.type_similarity(types))
    scores = align.column_scores(q, linked, pairs)
    narrow = {tuple(r) for r in align.assign_narrow(scores, q, 2).select("table_id", "tuple_id", "pos", "col_id").collect()}
    wide = {tuple(r) for r in align.assign_columns(scores, linked.select("table_id").distinct().withColumn("n_cols", F.lit(2)), q).collect()}
    assert narrow == wide and narrow


def test_lsh_finds_the_query_table(spark, lake):
    linked, types = lake
    sets = types.select("uri", F.col("types").alias("values"))
    keyed = lsh.set_index(linked, sets, n=6, band=3, buckets=300)
    keys = keyed.where("uri = 'u1'").select("grp", "bucket")
    assert {1, 2} <= {r[0] for r in lsh.lookup(keyed, keys, vote=2).collect()}
    assert lsh.remove(keyed, spark.createDataFrame([("u1",)], "uri string")).where("uri = 'u1'").count() == 0


def test_shingles(spark):
    got = spark.range(1).select(lsh.shingles(F.array(F.lit("t1"), F.lit("t2"), F.lit("t3")), 2)).first()[0]
    assert sorted(got) == ["t1|t2", "t1|t3", "t2|t1", "t2|t3", "t3|t1", "t3|t2"]
    assert spark.range(1).select(lsh.shingles(F.array(F.lit("t1")), 1)).first()[0] == ["t1"]


def test_prefilter_splits_long_queries(spark):
    blocks = search.query_blocks(query(spark, *[[f"u{i}"] for i in range(8)]))
    assert [r[0] for r in blocks.orderBy("tuple_id").select("block").collect()] == [0, 0, 0, 1, 1, 1, 2, 2]
    assert search.query_blocks(query(spark, ["a"], ["b"])).select("block").distinct().collect()[0][0] == 0


def test_page_rank_keeps_mass_near_the_seeds(spark):
    edges = spark.createDataFrame([("a", "t"), ("t", "b"), ("b", "c")], "src string, dst string")
    got = {r.node: r.score for r in search.particle_filtering(spark.createDataFrame([(0, "a", 1.0)], "tuple_id long, uri string, weight double"), edges, depth=2).collect()}
    assert got["a"] > got["t"] > got["b"] and "c" not in got
    assert got["t"] == pytest.approx(170.0)


def judged(spark, gains, scores):
    return spark.createDataFrame([(1, i, float(s), float(g)) for i, (g, s) in enumerate(zip(gains, scores, strict=True))], "query_id long, table_id long, score double, relevance double")


def test_ndcg(spark):
    ndcg = lambda run, k, **more: evaluate.ndcg(run, k, **more).first()["ndcg"]
    run = judged(spark, [3, 2, 0, 1], [0.9, 0.5, 0.5, 0.1])
    assert ndcg(run, 10) == pytest.approx(0.957946, abs=1e-6)
    assert ndcg(run, 2) == pytest.approx(0.851959, abs=1e-6)
    run = judged(spark, [2, 1, 1, 0, 0, 0, 0], [1, 0.4, 0.5, 0, 1, 2, 0])
    assert ndcg(run, 10) == pytest.approx(0.622326, abs=1e-6)
    assert ndcg(judged(spark, [3, 2, 1], [9, 8, 7]), 10) == 1.0


def test_auc(spark):
    run = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (1, "c", 0.5)], "query_id long, table_id string, score double")
    qrels = spark.createDataFrame([(1, t, 1.0) for t in "abf"], "query_id long, table_id string, relevance double")
    corpus = spark.createDataFrame([(1, t) for t in "abcdef"], "query_id long, table_id string")
    assert evaluate.auc(run, qrels, corpus).first()["auc"] == pytest.approx(0.722222, abs=1e-6)


def test_readers(spark):
    bad = spark.createDataFrame([('{"_id": "a", "rows": [[{"text": "x", "isNumeric": false, "links": ["l"]}]]}',), ("{",), ('{"rows": []}',)], "value string")
    assert [r.links for r in readers.table_cells(readers.parse_tables(bad)).collect()] == [["l"]]
    lines = spark.createDataFrame([("http://a/b 1 2.5",), ("no 1",), ("",)], "value string")
    assert [tuple(r) for r in readers.parse_embeddings(lines).collect()] == [("http://a/b", [1.0, 2.5])]
    cell = spark.createDataFrame([("[A page|text]",), ("plain",)], "c string").select(readers.parse_raw_cell(F.col("c")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in cell] == [("text", "http://www.wikipedia.org/wiki/A_page"), ("plain", "")]


def test_stores_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("iriA", [1.0, 1.0]), ("iriB", [2.0, 2.0])], "uri string, vec array<double>")
    for kind in ("parquet", "orc", "json"):
        store = stores.VectorStore(spark, str(tmp_path / kind), kind)
        store.insert(rows)
        assert store.lookup("iriB").first()["vec"] == [2.0, 2.0]
        assert store.lookup("none").count() == 0
    stores.Settings(band=5).save(str(tmp_path / "s.json"))
    assert stores.Settings.load(str(tmp_path / "s.json")).band == 5
    with pytest.raises(ValueError):
        stores.VectorStore(spark, "x", "csv9")


def _same(pairs):
    return pairs.withColumn("sim", F.when(F.col("q") == F.col("uri"), 1.0).otherwise(0.0))


@pytest.mark.parametrize(("width", "asked"), [(5, ["c3", "c4"]), (12, ["c11", "c2", "c10", "c0"]), (2, ["c1", "c0"]), (3, ["c2"]), (2, ["c0", "c1", "c0x"])])
def test_single_column_search_of_any_width(spark, width, asked):
    """Each row holds one entity a column; the query asks for some of them, in any order."""
    linked = spark.createDataFrame([(t, r, c, f"c{c}" if t == 0 else f"d{c}") for t in range(2) for r in range(3) for c in range(width)], "table_id long, row_id long, col_id int, uri string")
    query = spark.createDataFrame([(0, i, u) for i, u in enumerate(asked)], "tuple_id int, pos int, uri string")
    idf = spark.createDataFrame([(u, 1.0) for u in asked], "uri string, idf double")
    got = {r.table_id: r.score for r in search.analogous_search(query, linked, _same, idf, single_column=True).collect()}
    scores = align.column_scores(query, linked, align.pair_similarities(query, linked, _same))
    to = {(r.table_id, r.pos): r.col_id for r in align.assign(scores, query, linked.groupBy("table_id").agg((F.max("col_id") + 1).alias("n_cols"))).collect()}
    if len(asked) > width:  # no assignment: no cell counts
        assert set(to.values()) == {-1} and got.get(0, 0.0) == got.get(1, 0.0)
    else:
        assert got[0] == pytest.approx(1.0) and got[1] < 0.6
        assert [to[0, i] for i in range(len(asked))] == [int(u[1:]) for u in asked]
