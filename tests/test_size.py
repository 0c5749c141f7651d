"""What plans shuffle, and that leaner plans give the same."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lakeseek.llm import jaccard_join, toxicity
from lakeseek.operators import align, evaluate, search


def shuffled(spark, df):
    """The rows of df, and how many rows its shuffles wrote."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = [tuple(r) for r in df.collect()]
    return rows, written() - before


def _plain(held, weighted, least=0.01):
    """page -> attributes, to the pairs."""
    import math

    occ = {}
    for s in held.values():
        for x in s:
            occ[x] = occ.get(x, 0) + 1
    w = {x: math.log2(len(held) / n) if weighted else 1.0 for x, n in occ.items()}
    mass = {p: sum(w[x] for x in s) for p, s in held.items()}
    out = {}
    for a in held:
        for b in held:
            shared = sum(w[x] for x in held[a] & held[b])
            whole = mass[a] + mass[b] - shared
            if a != b and whole > 0 and shared / whole > least:
                out[a, b] = shared / whole
    alone = {p for p, s in held.items() if s} - {a for a, _ in out}
    return out | {(p, p): 1.0 for p in alone}


@pytest.mark.parametrize("weighted", [False, True])
def test_pages_against_all_pairs(spark, monkeypatch, weighted):
    monkeypatch.setattr(evaluate, "SLICE", 7)
    rng = random.Random(5)
    kinds = [frozenset(rng.sample("abcdefghij", rng.randint(1, 4))) for _ in range(8)] + [frozenset("z"), frozenset(["a,b"]), frozenset(['"', "\\"])]
    held = {p: kinds[p % 8] for p in range(60)} | {100 + i: k for i, k in enumerate(kinds[8:])}
    rows = [(p, x) for p, s in held.items() for x in s] * 2 + [(200, None)]
    got = evaluate.page_similarity(spark.createDataFrame(rows, "page long, attribute string"), weighted).collect()
    want = _plain(held | {200: frozenset()}, weighted)
    assert len(got) == len(want)
    assert {(r.a, r.b): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_alike_pages_are_not_shuffled_as_pairs(spark):
    pages = spark.range(400).select(F.col("id").alias("page"), F.explode(F.array(F.lit("x"), F.concat(F.lit("y"), F.col("id") % 2))).alias("attribute"))
    rows, moved = shuffled(spark, evaluate.page_similarity(pages))
    assert len(rows) == 400 * 399
    assert moved < 20_000  # before: over 159,600, a row for each pair


def test_matrices_are_solved_together(spark):
    """Shapes mixed in a batch, ties, a missing cell and a null score; few calls of Python for many tables."""
    rng = random.Random(8)
    rows, want = [], {}
    for t in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        s = [[float(rng.randint(0, 3)) for _ in range(m)] for _ in range(n)]
        rows += [(t, 0, p, c, None if x == 0 and rng.random() < 0.5 else x, n, m) for p, r in enumerate(s) for c, x in enumerate(r) if x or rng.random() < 0.7 or (p, c) == (0, 0)]
        want[t] = [-1] * n if n > m else list(min(itertools.permutations(range(m), n), key=lambda o: (-sum(s[i][c] for i, c in enumerate(o)), o)))
    held = spark.createDataFrame(rows, "table_id long, tuple_id int, pos long, col_id int, score double, w long, n_cols int")
    made = align._wide(held)
    got = {}
    for r in made.orderBy("table_id", "pos").collect():
        got.setdefault(r.table_id, []).append(r.col_id)
    assert got == want
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()  # before: a call for each table


def test_cells_are_not_shuffled_for_each_query_entity(spark):
    """Twenty entities asked for, in a tuple of seventeen and one of four that shares one with it: more than stand in one row."""
    linked = spark.range(400).select((F.col("id") % 50).alias("table_id"), (F.col("id") / 50).cast("long").alias("row_id"), F.lit(0).cast("long").alias("col_id"), F.concat(F.lit("u"), F.col("id")).alias("uri"))
    asked = [(0, p, f"q{p}") for p in range(17)] + [(1, p, f"q{16 + p}") for p in range(4)]
    query = spark.createDataFrame(asked, "tuple_id long, pos long, uri string")
    pairs = linked.select("uri").crossJoin(query.select(F.col("uri").alias("q")).distinct()).withColumn("sim", (F.substring("q", 2, 9).cast("double") + F.substring("uri", 2, 9).cast("double")) / 1000).localCheckpoint()
    got, moved = shuffled(spark, align.column_scores(query, linked, pairs))
    want = {(t, i, p): sum((int(q[1:]) + x) / 1000 for x in range(400) if x % 50 == t) for i, p, q in asked for t in range(50)}
    assert {(r[0], r[1], r[2]): round(r[4], 6) for r in got} == {k: round(v, 6) for k, v in want.items()} and len(got) == len(want)
    assert moved < 5_000  # before: over 16,400, a row for each table, column and entity, and as many pairs


@pytest.mark.parametrize(("kinds", "measure", "fixed"), [(65_536, "euclidean", None), (3, "cosine", None), (65_536, "euclidean", 6)])
def test_single_column_search_moves_a_cell_twice(spark, monkeypatch, kinds, measure, fixed):
    """Against the scores of rows: tables of several widths, one of many cells; similarities that are null or below 0; more of them than are sent to all executors; tables cut by batches."""
    monkeypatch.setattr(search, "MOST_KINDS", kinds)
    rng = random.Random(4)
    shape = {t: (rng.randint(1, 5), rng.randint(1, 3)) for t in range(60)} | {60: (3, 150)}
    cells = [(t, r, c, f"u{rng.randint(0, 40)}") for t, (w, n) in shape.items() for r in range(n) for c in range(w) if rng.random() < 0.9]
    linked = spark.createDataFrame(cells, "table_id long, row_id long, col_id long, uri string").localCheckpoint()
    query = spark.createDataFrame([(0, 0, "u1"), (0, 1, "u2"), (0, 2, "u3"), (1, 0, "u4"), (2, 0, "u1"), (2, 2, "u5")], "tuple_id long, pos long, uri string")
    idf = spark.createDataFrame([("u1", 1.0), ("u2", 3.0), ("u4", 2.0)], "uri string, idf double")
    sims = [(f"u{q}", f"u{u}", 1.0 if q == u else None if (q + u) % 7 == 0 else ((q * 13 + u * 5) % 11 - 3) / 10) for q in range(1, 6) for u in range(41)]
    pairs = spark.createDataFrame(sims, "q string, uri string, sim double").localCheckpoint()
    widths = linked.select("table_id").distinct().withColumn("n_cols", F.lit(fixed)) if fixed else None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got, moved = shuffled(spark, search.column_search(query, linked, pairs, idf, measure, widths=fixed))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = search.row_scores(query, linked, pairs, True, False, widths)
    plain = search.table_scores(search.tuple_scores(search.tuple_vectors(rows), search.tuple_weights(query, idf), measure), query)
    want, before = shuffled(spark, plain)
    assert {t: round(s, 9) for t, s in got} == {t: round(s, 9) for t, s in want} and len(got) == len(want)
    assert moved < 2 * len(cells) + 400 < before  # before: a row for each cell and query entity


def test_single_column_query_at_size(spark):
    """lineitem is numbered by no window, and its cells are neither paired with the query's entities nor looked up twice."""
    import __spark_entry__

    sf = "/root/testdata/sf0.01"
    cells = spark.read.parquet(f"{sf}/lineitem.parquet").count() * 3
    _, moved = shuffled(spark, __spark_entry__.queries()["srch_09_single_column"](spark, sf))
    assert moved < 2.5 * cells  # before: over 20 for each cell


@pytest.mark.parametrize(("block", "askers"), [(2048, 512), (37, 23)])
def test_crowds_are_not_rows_for_each_set_and_group(spark, monkeypatch, block, askers):
    """400 texts each just below the threshold to all others, and one near copy of every twentieth."""
    monkeypatch.setattr(jaccard_join, "GROUP", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", block, raising=False)
    monkeypatch.setattr(jaccard_join, "ASKERS", askers, raising=False)
    base = [f"w{i}" for i in range(100)]
    texts = {i: " ".join(base + [f"own{i}x{j}" for j in range(6)]) for i in range(400)}
    texts |= {1000 + i: texts[i] + " more" for i in range(0, 400, 20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).localCheckpoint()
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    got = jaccard_join.jaccard_classes(docs, 3, 90).collect()  # most of its shuffles run as it is built
    moved = written() - before
    assert {(r[0], r[2]) for r in got} == {(i, i % 1000) for i in texts}
    assert moved < 250_000  # before: 431,090, a row for each set and group among them


def test_columns_bound_as_one_by_one():
    rng = random.Random(6)
    import numpy as np

    draw = lambda n: np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
    groups = []
    for i in range(40):
        sets = [draw(rng.choice((5, 40, 300))) for _ in range(3)]
        width = max(jaccard_join._width(len(s)) for s in sets)
        groups.append((sets, ((i, 0), min(map(len, sets)), jaccard_join._bits(np.concatenate(sets), width).tobytes())))
    columns = jaccard_join.Columns([g for _, g in groups])
    for sets, (key, _, _) in groups:
        for s in sets:
            own = np.concatenate((s[: max(1, len(s) * 19 // 20)], draw(len(s) // 30)))
            assert key in columns.open_to(len(own), jaccard_join._bits(own, jaccard_join._width(len(own))).tobytes(), 80)
    far = draw(300)
    assert len(columns.open_to(300, jaccard_join._bits(far, jaccard_join._width(300)).tobytes(), 80)) < 10


def test_toxicity_counts_and_backs_off_once_a_run(monkeypatch):
    """Counts as letter by letter; a shorter run that many longer ones end with is looked up once."""
    import pyarrow as pa

    rng = random.Random(9)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    rows = pa.RecordBatch.from_arrays([pa.array([" ".join(words[i : i + 10]) for i in range(0, 3000, 10)]), pa.array([i % 2 for i in range(300)])], names=["text", "toxic"])
    want = {}
    for i, w in enumerate(words):
        x = toxicity._letters(w)
        for j in range(1, len(x)):
            for o in range(min(toxicity.ORDER, j + 1)):
                pair = want.setdefault(x[j - o : j + 1], [0, 0])
                pair[1 - i // 10 % 2] += 1
    got = {g: [a, b] for batch in toxicity._word_counts([rows]) for g, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    assert got == want
    calls, real = [], toxicity.Model.backoff
    monkeypatch.setattr(toxicity.Model, "backoff", lambda self, g: calls.append(g) or real(self, g))
    model = toxicity.Model({g: tuple(p) for g, p in got.items()})
    values = [model.value(w) for w in words]
    assert len(calls) == len(set(calls)) and values == [model.value(w) for w in words]  # before: once for each longer run
