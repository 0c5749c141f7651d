"""Every operator and stage on awkward tables: nulls in any column, empty and very long texts, repeated rows, clashing columns, no rows."""

import pytest

import corpus_pipeline
from lakeseek.llm import context_tree, flac, jaccard_join, language, mixing, pieces, shards, spans, toxicity
from lakeseek.llm.queries import piece_model

WORDS = "the quick brown fox jumps over a lazy dog while seven bright birds sing near old quiet rivers".split()
LONG = " ".join(f"{w}{i}" for i in range(4000) for w in WORDS[:5])
PASSAGE = ". ".join(" ".join(WORDS[i : i + 9]).capitalize() for i in (0, 4, 8, 2, 6, 1)) + "."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, row string, size double, score string, copies int, positions string, mark long, k string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, PASSAGE, "en", "a"), (2, "Intro words here. " + PASSAGE + " And more.", "en", "a"), (3, None, "en", "b"), (4, "", None, None), (5, LONG, "en", "b"), (6, LONG, None, "a"), (6, LONG, None, "a"), (None, PASSAGE, "en", None), (None, None, None, None), (7, "1234 !!! 56", "fr", "c"), (8, "été à la maison où il pleut ▁ encore\x00\n\n fin", "fr", "c"), (9, "été à la maison où il neige", "fr", "c"), (7, "another text with the same id", "en", "a")]
    return spark.createDataFrame([(i, t, g, s, None, 1, "r", 2.0, "s", 3, "p", 4, "k") for i, t, g, s in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (5, 0), (None, 1), (9, None), (8, 1), (8, 0)], "doc_id long, toxic int")


def run(name, docs, labels):
    return {
        "jaccard": lambda: jaccard_join.jaccard_classes(docs, 3, 90), "spans": lambda: spans.dedup_spans(docs), "tree": lambda: context_tree.score_texts(docs), "flac": lambda: flac.flac_digests(docs),
        "toxic": lambda: toxicity.score_toxicity(docs, labels), "digests": lambda: pieces.piece_digests(docs, piece_model()), "encode": lambda: pieces.encode_pieces(docs, piece_model()),
        "shards": lambda: shards.uniform_shards(docs, 4), "mix": lambda: mixing.mix_plan(docs), "language": lambda: language.identify_languages(docs),
    }[name]()


NAMES = ["jaccard", "spans", "tree", "flac", "toxic", "digests", "encode", "shards", "mix", "language"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(docs, labels, name):
    got = run(name, docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(none, labels, name):
    assert run(name, none, labels.limit(0)).count() == 0


def test_jaccard_results(docs):
    got = [tuple(r) for r in jaccard_join.jaccard_classes(docs, 3, 90).collect()]
    assert (3, 0, 3) in got and (4, 0, 4) in got and (None, 0, None) in got
    assert {c for i, _, c in got if i in (5, 6)} == {5}


def test_spans_results(docs):
    got = {(r.doc_id, r.text) for r in spans.dedup_spans(docs).collect()}
    assert (1, PASSAGE) in got and (3, None) in got and (4, "") in got
    second = next(t for i, t in got if i == 2)
    assert second.startswith("Intro words here.") and second.endswith("And more.") and len(second) < 120
    assert (None, "") in got  # all of it stands in document 1


def test_stages(spark, docs, none):
    for start in (docs, none):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, "")
            if name != "tokens":
                assert out.columns == start.columns, name
            rows = out.collect()
            now = spark.createDataFrame(rows, out.schema)
        assert (len(rows) > 0) == (start is docs)
        assert all(r.round_trip or "▁" in (r.text or "") for r in rows)
