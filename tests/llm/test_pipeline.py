"""Each stage of the pipeline against a plain version of it, on one table."""

import random
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from lakeseek.llm import mixing
from lakeseek.llm.queries import piece_model
from test_operators import classes_by_force, edited, pieces_of, targets_by_force

RNG = random.Random(21)
WORDS = {g: ["".join(RNG.choice(parts) for _ in range(RNG.randint(2, 4))) for _ in range(150)] for g, parts in (("aa", ["ka", "mi", "to", "ru", "se"]), ("bb", ["qux", "wol", "fje", "bry"]))}


def prose(g, sentences):
    return " ".join(" ".join(RNG.choice(WORDS[g]) for _ in range(RNG.randint(4, 8))).capitalize() + "." for _ in range(sentences))


@pytest.fixture(scope="module")
def rows():
    out = [(g, prose(g, RNG.randint(3, 12))) for g in ("aa", "bb") for _ in range(30)]
    passage = prose("aa", 9)
    out += [("aa", prose("aa", 2) + " " + passage + " " + prose("aa", 2)) for _ in range(4)]
    base = prose("bb", 20)
    out += [("bb", edited(RNG, base, rate)) for rate in (0, 0, 0.002, 0.004, 0.01, 0.3)]
    out += [("aa", "12 34 !!"), ("bb", ""), ("aa", None), ("aa", "zzzy zzyz zyzz xxxv vvvx xvxv"), (None, prose("bb", 4))]
    RNG.shuffle(out)
    return [(i, t, g, f"s{i % 4}", len(t or "")) for i, (g, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_language(spark, docs, rows):
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    grams = {g: Counter(w[i : i + o] for _, t, x, _, _ in rows if x == g and t for v in t.lower().replace(".", " ").split() if v.isalpha() for w in (f"_{v}_",) for o in (3, 4) for i in range(len(w) - o + 1)) for g in WORDS}
    want = set()
    for i, t, _, _, _ in rows:
        own = [w[j : j + o] for v in (t or "").lower().replace(".", " ").split() if v.isalpha() for w in (f"_{v}_",) for o in (3, 4) for j in range(len(w) - o + 1)]
        share = max((sum(x in grams[g] for x in own) / len(own) for g in grams), default=0) if own else 0
        if share >= corpus_pipeline.LEAST_SHARE:
            want.add(i)
    # No language is so small here that the floor or a false positive decides.
    assert got == want and 0 < len(want) < len(rows)


def test_near_copies(spark, docs, rows):
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    want = {i for i, _, first in classes_by_force([(i, t or "") for i, t, *_ in rows], 5, 80) if i == first}
    assert got == want and len(want) < len(rows)


def test_passages(spark, docs, rows):
    got = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, docs, "").collect()}
    seen, want = set(), {}
    for i, t, *_ in sorted(rows):
        held, counts = pieces_of(t or "")
        gone, own = set(), []
        for a in range(len(held)):
            b = a + 3
            while b <= len(held) and sum(counts[a:b]) < 20:
                b += 1
            if b <= len(held):
                run = tuple(held[a:b])
                if run in seen or run in own:
                    gone |= set(range(a, b))
                own.append(run)
        seen |= set(own)
        want[i] = " ".join(p for j, p in enumerate(held) if j not in gone)
    kept = {i: " ".join(t.lower().split()) for i, t in got.items() if t is not None}
    texts = {i: t for i, t, *_ in rows}
    assert kept == {i: w for i, w in want.items() if texts[i] is not None and (w or not pieces_of(texts[i])[0])}
    assert sum(kept[i] != " ".join((texts[i]).lower().split()) for i in kept) >= 3


def test_mixing(spark, docs, rows):
    got = corpus_pipeline.mixing(spark, docs, "").collect()
    sizes, taken, copies = Counter(), Counter(), Counter(r.doc_id for r in got)
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    for r in got:
        taken[r.source] += len((r.text or "").split())
    most = max(len((t or "").split()) for _, t, *_ in rows)
    assert all(abs(taken[s] - x) <= most for s, x in targets_by_force(sizes).items()) and max(copies.values()) <= 3
    assert {tuple(r) for r in got} <= {tuple(r) for r in rows}


def test_rows_alike_in_id_and_text_are_not_merged(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (2, "e f", "x"), (2, "e f", "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = [(r.doc_id, r.source, r.copies) for r in mixing.mix_plan(df).collect()]
    got = Counter((r.doc_id, r.source) for r in mixing.curriculum(df).collect())
    want = Counter()
    for i, s, n in plan:
        want[i, s] += n
    assert got == +want and len(plan) == len(rows) and {(1, "x"), (1, "y")} <= set(got)


def test_tokens(spark, docs, rows):
    with open(piece_model(), "rb") as f:
        sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    texts = {i: t or "" for i, t, *_ in rows}
    for r in corpus_pipeline.tokens(spark, docs, "").collect():
        assert r.ids == [*sp.encode(texts[r.doc_id]), sp.eos_id()] and r.round_trip and r.n_tokens == len(r.ids)
        assert b"".join(texts[r.doc_id].encode()[a:b] for a, b in zip(r.begins, r.ends)) == texts[r.doc_id].encode()
