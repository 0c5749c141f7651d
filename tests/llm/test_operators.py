"""The operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lakeseek.llm import context_tree, flac, jaccard_join, language, mixing, pieces, shards, spans, toxicity, vector_graph
from lakeseek.llm.common import components
from lakeseek.llm.queries import piece_model
from lakeseek.llm.shingles import Parts

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice(["th", "an", "er", "on", "re", "ing", "ou", "st"]) for _ in range(RNG.randint(1, 4))) for _ in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, rate):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < rate else w for w in text.split())


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(1), []
    for i in range(60):
        rows.append(prose(rng, rng.randint(3, 120)))
    base = prose(rng, 150)
    rows += [edited(rng, base, rate) for rate in (0, 0, 0.005, 0.01, 0.01, 0.02, 0.02, 0.03, 0.03, 0.04, 0.05, 0.1) for _ in range(8)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, "en", f"s{i % 5}", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def classes_by_force(rows, k, percent):
    sets, top = {}, {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        top[i] = i

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            n = len(a & b)
            if i < j and a and b and 100 * n >= percent * (len(a) + len(b) - n):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent", "cells"), [(3, 90, 0), (5, 80, 10**6)])
def test_jaccard_classes(docs, k, percent, cells, monkeypatch):
    for name, value in (("GROUP", 6), ("TURN", 5), ("BATCH", 20), ("MOST_CELLS", cells)):
        monkeypatch.setattr(jaccard_join, name, value)
    want = classes_by_force([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    assert {tuple(r) for r in jaccard_join.jaccard_classes(docs, k, percent).collect()} == want


def test_similar_sets_share_a_signature():
    rng = random.Random(2)
    for percent in (80, 90):
        parts = Parts(percent)
        for _ in range(1500):
            n = rng.randint(1, 80)
            a = {rng.getrandbits(63) for _ in range(n)}
            b = set(a)
            for _ in range(rng.randint(0, 1 + n * (100 - percent) // 100)):
                b.discard(rng.choice(sorted(b))) if rng.random() < 0.5 and len(b) > 1 else b.add(rng.getrandbits(63))
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = (parts.signatures(np.array(sorted(s), np.uint64)) for s in (a, b))
                c = [parts.size_class(len(s)) for s in (a, b)]  # keys of the smaller one's class
                one, two = (x[c[0] - min(c)], y[c[1] - min(c)])
                assert len(set(one[0].tolist()) & set(two[0].tolist())) >= max(one[1], two[1]) >= 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    near, want = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a in sorted(near):
        if a in want:
            continue
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = a
                todo += near[x]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got.get(x, x) == c for x, c in want.items())


def pieces_of(text):
    """A text's pieces by plain steps: lower-cased words joined by a space, and their counts."""
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n\s*|(?<=[。！？])", text.lower()):
        words, at = sentence.split(), 0
        h = [xxhash.xxh3_128_intdigest(w) & (2**64 - 1) for w in words]
        for i in range(1, len(words) + 1):
            near = [h[j] for j in range(max(0, i - spans.REACH), min(len(h), i + spans.REACH + 1)) if j != i]
            least = i < len(words) and len(words) > spans.PIECE and h[i] <= min(near) and h[i] < min(h[max(0, i - spans.REACH) : i])
            if i == len(words) or least or (len(words) > spans.PIECE and i - at == spans.LONGEST):
                out.append(words[at:i])
                at = i
    return [" ".join(p) for p in out], [len(p) for p in out]


def test_spans_against_force(spark):
    rng = random.Random(4)
    passage = ". ".join(prose(rng, rng.randint(4, 14)) for _ in range(7)) + "."
    texts = [". ".join(prose(rng, rng.randint(2, 12)) for _ in range(6)) + "." for _ in range(12)]
    texts[3] = texts[3][:40] + passage + texts[3][40:]
    texts[7] = texts[7][:55] + passage + " " + passage
    texts[9] = passage
    seen, gone = {}, {}
    powers = spans.Powers()
    for i, t in enumerate(texts):
        held, counts = pieces_of(t)
        for a in range(len(held)):
            b = a + spans.RUN
            while b <= len(held) and sum(counts[a:b]) < spans.MIN_WORDS:
                b += 1
            if b <= len(held):
                if tuple(held[a:b]) in seen:
                    gone.setdefault(i, set()).update(range(a, b))
                seen.setdefault(tuple(held[a:b]), i)
        assert len(spans.piece_spans([t])[0]) == len(held)
        assert len(spans.Words().look([t]).runs(powers)[0]) == len({a for a in range(len(held)) if any(sum(counts[a:b]) >= spans.MIN_WORDS for b in range(a + spans.RUN, len(held) + 1))})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in spans.dedup_spans(df).collect()}
    assert {i: r.n_removed for i, r in got.items() if r.n_removed} == {i: len(g) for i, g in gone.items()}
    assert set(gone) == {7, 9} and got[3].text == texts[3] and len(got[9].text.split()) < 14


def test_spans_in_text_without_sentences(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(200)]
    texts = [" ".join([*(word() for _ in range(7)), *passage, *(word() for _ in range(after))]) for after in (10, 13)]
    got = {r.doc_id: r for r in spans.dedup_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    left = got[1].text.split()
    assert got[0].text == texts[0] and left[:4] == texts[1].split()[:4] and left[-4:] == texts[1].split()[-4:]
    assert sum(w in passage for w in left) <= 24
    for t in (*texts, "ha " * 300, "x " + "A B. " * 40, "一二。三四！ 五\n\n六 \x00\u00b6\x01 v. \n w\u2003x\r\n" * 9, "", " \n "):
        held, counts = pieces_of(t)
        found = spans.piece_spans([t])[0]
        assert [" ".join(t[a:b].lower().split()) for a, b in found] == held and max(counts, default=0) <= spans.LONGEST


def test_spans_of_one_id_in_two_texts(spark, monkeypatch):
    rng = random.Random(15)
    passage = ". ".join(prose(rng, 12) for _ in range(6)) + "."
    rows = [(4, "First one. " + passage), (4, "The other. " + passage), (4, "The other. " + passage), (5, passage), (None, passage)]
    for chars in (3_000_000, 1):  # in one batch, and each text in its own
        monkeypatch.setattr(spans, "BATCH_CHARS", chars)
        got = sorted((r.doc_id or 9, len(r.text.split())) for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
        whole = len(rows[0][1].split())
        assert sum(n == whole for i, n in got if i == 4) in (1, 2) and sum(n <= 2 for i, n in got if i == 4) in (1, 2)
        assert [n for i, n in got if i != 4] == [0, 0]


def test_context_tree_is_a_distribution_and_beats_its_parts():
    text = b"the cat sat on the mat and the cat ran to the rat " * 20
    code, of = context_tree._codes(context_tree._stretches(text))
    grams = []
    for d in range(context_tree.DEPTH + 1):
        g, where = np.unique(code & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
        grams.append((g >> 8, g & 255, np.bincount(where).astype(float)))
    tree = context_tree.Tree(grams)
    total = sum(len(k) for k in context_tree._stretches(text)) + text.count(b" ") - 1
    assert len(code) == total == len(text) + 1
    for logs in tree.logs:
        assert np.abs((10.0 ** logs.astype(float)).sum(1) - 1).max() < 1e-5
    length = lambda t, x: -math.fsum(t.score(context_tree._stretches(x))) * math.log2(10) / (len(x) + 1)
    assert length(tree, b"the cat ran to the mat") < 0.6 * length(context_tree.Tree(grams[:1]), b"the cat ran to the mat")


def whole_tree(texts):
    """The tree of all contexts seen KEEP times, in one place."""
    code = np.concatenate([context_tree._codes(context_tree._stretches(t))[0] for t in texts])
    grams, kept = [], None
    for d in range(context_tree.DEPTH + 1):
        g, n = np.unique(code & ((1 << (8 * (d + 1))) - 1), return_counts=True)
        context, of = np.unique(g >> 8, return_inverse=True)
        keep = np.bincount(of, n)[of] >= context_tree.KEEP
        grams.append((g[keep] >> 8, g[keep] & 255, n[keep].astype(float)))
    return context_tree.Tree(grams)


def scored_and_whole(spark, rows):
    got = {r["doc_id"]: r["score"] for r in context_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tree = whole_tree([t.encode().lower() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1])
    return got, {i: math.fsum(tree.score(context_tree._stretches(t.encode().lower()))) for i, t in rows}


def test_rare_contexts_keep_their_counts_in_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(context_tree, "BLOCK", 200_000)
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoin", k=rng.randint(2, 5))) for _ in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=2500)) + (" Zyxwvu\u00e9q" if i % 8 == 0 else "")) for i in range(70)]
    got, want = scored_and_whole(spark, rows)  # the rare word makes up less than 2^-16 of the bytes
    assert max(abs(got[i] - want[i]) / abs(want[i]) for i, _ in rows) < 1e-5
    plain = {i: t.removesuffix(" Zyxwvu\u00e9q") for i, t in rows}
    tree = whole_tree([t.encode().lower() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1])
    cost = [math.fsum(tree.score(context_tree._stretches(plain[i].encode().lower()))) - got[i] for i, _ in rows if i % 8 == 0]
    assert max(cost) < 12  # an unknown word of nine bytes costs about 20


def test_contexts_cross_words(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("ab cd", "xb ef")) for _ in range(60))) for i in range(60)] + [(100 + i, t) for i in range(10) for t in (["ab cd " * 30, "ab ef " * 30][i % 2],)]
    got, want = scored_and_whole(spark, rows[:60] + rows[60:])
    assert max(abs(got[i] - want[i]) / abs(want[i]) for i, _ in rows) < 1e-5
    tree = whole_tree([t.encode() for i, t in rows[:60]])
    length = lambda x: -math.fsum(tree.score(context_tree._stretches(x)))
    assert length(b"ab cd ab cd ab cd") < 0.5 * length(b"ab ef ab ef ab ef")  # the same words, in the wrong order


def test_base_score(spark, docs):
    got = {r.doc_id: r for r in context_tree.score_texts(docs).collect()}
    counts, rows = Counter(), [(r.doc_id, r.text) for r in docs.collect()]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    for i, t in rows:
        if fold(i) != 1:
            counts.update([*t.split(), ""])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        tokens = [*t.split(), ""]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(counts[x] > 0 for x in tokens), n, fold(i) == 1)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens))
        assert r.score < 0


@pytest.mark.parametrize("payload", [b" " * 192, bytes(range(192)), b"\xff\x00" * 480, b"plain words of a text. " * 400])
def test_flac_round_trip(payload):
    payload = flac.padded(payload)
    media = flac.encode([payload])[0]
    assert (flac.decode([media])[0].astype(np.uint8) ^ 0x80).tobytes() == payload
    broken = bytearray(media)
    broken[-5] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        flac.decode([bytes(broken)])


def test_flac_without_seek_points():
    payload = flac.padded(b"some words to be stored, again and again " * 60)
    media = flac.encode([payload])[0]
    n = int.from_bytes(media[43:46], "big")
    bare = media[:4] + bytes([0x80]) + media[5:42] + media[46 + n :]
    assert (flac.decode([bare])[0].astype(np.uint8) ^ 0x80).tobytes() == payload


def test_flac_blocks(spark, docs):
    stored = flac.store_flac(docs.limit(5))
    back = {}
    for r in flac.read_blocks(stored, block=200).orderBy("doc_id", "first_sample").collect():
        assert r.first_sample == len(back.get(r.doc_id, b"")) and r.n_samples == len(r.pcm)
        back[r.doc_id] = back.get(r.doc_id, b"") + r.pcm
    for r in stored.collect():
        assert bytes(b ^ 0x80 for b in back[r.doc_id]) == flac.padded(r.text.encode())


def test_toxicity_on_held_out(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(5, 80)) + (" vilexi scumor " if i % 4 == 0 else " ") + prose(rng, 20)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).where("held_out").collect()
    assert len(got) > 40 and sum(r.predicted == (r.doc_id % 4 == 0) for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_pieces_equal_the_library():
    import sentencepiece

    with open(piece_model(), "rb") as f:
        model = f.read()
    sp, encoder, rng = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Encoder(model), random.Random(7)
    texts = ["", " ", "a  b", "\n\n a", "a\n b ", "</s><0x41>▁a", "ﬁ\x00 y", "日本 é²."] + ["".join(rng.choice([" ", "a", "the", "\n", "é", "日", "▁", "\t", ".", "ing", "**", "1", "²"]) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    for t, (ids, written, decoded, begins, ends) in zip(texts, encoder.batch(texts), strict=True):
        want = sp.encode(t)
        assert (np.frombuffer(ids, np.int32).tolist(), written, decoded) == (want, " ".join(map(str, want)), sp.decode(want)), t
        if want:
            assert begins[0] == 0 and ends[-1] == len(t.encode()) and list(begins[1:]) == list(ends[:-1])


def test_characters_map_takes_the_longest_prefix():
    # A double array by hand for: "a" -> "x", "ab" -> "yz". Units: value, label and offset as the format packs them.
    units = {0: (1 << 10), 1 ^ ord("a"): ord("a") | (1 << 8) | ((200 ^ (1 ^ ord("a"))) << 10)}
    node = (1 ^ ord("a")) ^ (units[1 ^ ord("a")] >> 10)
    units[node] = 0 | (1 << 31)
    child = node ^ ord("b")
    units[child] = ord("b") | (1 << 8) | ((300 ^ child) << 10)
    units[child ^ (300 ^ child)] = 2 | (1 << 31)
    table = np.zeros(512, "<u4")
    for i, u in units.items():
        table[i] = u
    blob = np.array([table.nbytes], "<u4").tobytes() + table.tobytes() + b"x\0yz\0"
    chars = pieces.CharsMap(blob)
    assert chars.longest(b"abc", 0) == (2, b"yz") and chars.longest(b"ac", 0) == (1, b"x") and chars.longest(b"b", 0) is None


def test_vector_links_against_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    v = np.concatenate([c + rng.normal(size=(12, 16)) * s for c, s in zip(centres, np.linspace(0.05, 0.6, 40), strict=True)])
    v[5] = v[6]
    rows = [(i, [float(x) for x in r], i % 2) for i, r in enumerate(v)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 0), (1003, [float(x) for x in v[0]], None), (1004, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = v.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(len(v))[:, None] % 2 == np.arange(len(v))[None] % 2)
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in vector_graph.near_vectors(df).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.9 * near.sum() > 0
    assert all(got[i].n_links <= n for i, n in enumerate(near.sum(1)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(1000, 1005))
    usable = vector_graph._usable(df, "vec_id", "embedding", "label").groupBy("label", "vec").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    assert vector_graph.audit(df, vector_graph.graph_links(usable)) >= 0.9


def test_crowds_apart_and_crowds_within_a_crowd(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    far = unit(rng.normal(size=(3, 32)))
    # One crowd of two crowds, cosine about 0.95 between them, and two crowds apart: all 120 candidates of a vector lie in its own.
    at = np.stack([far[0], unit(far[0] + 0.32 * unit(rng.normal(size=32))), far[1], far[2]])
    vecs = np.concatenate([unit(c + 0.015 * rng.normal(size=(150, 32))) for c in at])
    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, label int, embedding array<double>")
    links = vector_graph.graph_links(rows.selectExpr("vec_id id", "struct(label) label", "embedding vec")).cache()
    want = np.argwhere(np.triu(vecs @ vecs.T >= 0.93, 1))
    got = {(r["a"], r["b"]) for r in links.collect()}
    assert len(want) > 4 * 150 * 149 / 2 and len(got) >= 0.999 * len(want)
    assert vector_graph.audit(rows, links) >= 0.999


def test_oversized_cells_are_dealt_into_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "CELL", 20)
    rng = np.random.default_rng(9)
    v = np.concatenate([np.ones((150, 8)) + rng.normal(size=(150, 8)) * 0.01, rng.normal(size=(30, 8))])
    df = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = vector_graph.near_vectors(df).where("vec_id < 150").collect()
    assert sum(r.n_links for r in got) >= 0.9 * 150 * 149 and {r.component_id for r in got} == {0}


def test_shards(spark, docs):
    got = shards.uniform_shards(docs, 7).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in shards.uniform_shards(docs.repartition(2), 7).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 16, zlib.crc32(text[r.doc_id].encode())) for r in got)


def test_communication_matrix():
    counts, sizes = [5, 0, 9, 4], [6, 6, 6]
    m = np.array(shards.communication_matrix(counts, sizes, 1))
    assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes and (m >= 0).all()


def targets_by_force(sizes, most=3.0):
    names = sorted(sizes)
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        level = (total - sum(most * sizes[n] for n in full)) / sum(weight[n] for n in names if n not in full)
        over = {n for n in names if n not in full and level * weight[n] > most * sizes[n]}
        if not over:
            return {n: most * sizes[n] if n in full else level * weight[n] for n in names}
        full |= over


def test_mixing(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randint(0, 60)), f"s{min(int(rng.expovariate(0.6)), 6)}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets_by_force(sizes)
    got = [r.asDict() for r in mixing.mix_plan(df).collect()]
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 30
    assert all(r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"]) for r in got)
    again = {(r.doc_id, r.taken) for r in mixing.mix_plan(df.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    taken = Counter(r.doc_id for r in mixing.curriculum(df).collect())
    assert all(taken[r["doc_id"]] == r["copies"] for r in got)


def test_language_on_held_out(spark):
    rng = random.Random(11)
    words = {"xx": [w + "ix" for w in VOCABULARY], "yy": ["qu" + w[::-1] for w in VOCABULARY]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(15)), g) for i in range(120) for g in (("xx", "yy")[i % 2],)]
    df = spark.createDataFrame([*rows, (500, "12 !", "xx"), (501, None, "yy")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify_languages(df).collect()}
    assert all(got[i].lang_pred == g for i, _, g in rows)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (500, 501))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())


def test_digest_queries_agree_with_operators(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in flac.flac_digests(docs).collect():
        payload = flac.padded(texts[r.doc_id].encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    encoded = {r.doc_id: r for r in pieces.encode_pieces(docs, piece_model()).collect()}
    for r in pieces.piece_digests(docs, piece_model()).collect():
        e = encoded[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest())
        assert e.decoded == texts[r.doc_id] and e.ends[-1] == len(texts[r.doc_id].encode())


def test_hypergeometric_of_any_size():
    rng, other = np.random.default_rng(3), np.random.default_rng(4)
    for good, bad, draws in ((5, 9, 6), (400, 700, 300), (10**6, 3 * 10**6, 20_000)):
        own = np.array([shards.hypergeometric(good, bad, draws, rng) for _ in range(4000)])
        want = other.hypergeometric(good, bad, draws, 40_000)
        assert abs(own.mean() - want.mean()) < 5 * want.std() / math.sqrt(4000) and abs(own.std() / want.std() - 1) < 0.06
    sizes, counts = [10**10 + i for i in range(7)], [9 * 10**9, 3 * 10**10, 4 * 10**9]
    counts.append(sum(sizes) - sum(counts))
    m = np.array(shards.communication_matrix(counts, sizes, 1))
    assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes and (m >= 0).all()


def test_shards_are_uniform(spark):
    """Each document's shard over many seeds, and hot rows that are alike in all."""
    df = spark.createDataFrame([(i, f"t {i}") for i in range(12)] + [(None, "")] * 300, "doc_id long, text string")
    seen = Counter()
    for seed in range(8):
        got = shards.uniform_shards(df, 4, seed).collect()
        assert Counter(r.shard for r in got) == {s: 78 for s in range(4)}
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(78)) for s in range(4))
        seen.update(r.shard for r in got if r.doc_id is not None)
    assert all(10 <= seen[s] <= 40 for s in range(4))  # 24 each expected


def test_a_repeated_vector_row_is_no_other_vector(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (6, [0.0, 1.0], 0), (7, [0.0, 1.0], 0)]
    got = [(r.vec_id, r.n_links, r.component_id) for r in vector_graph.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()]
    assert sorted(got) == [(5, 0, 5), (5, 0, 5), (6, 1, 6), (7, 1, 6)]
