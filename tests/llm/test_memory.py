"""What a Python worker holds at once."""

import random
import tracemalloc

import pyarrow as pa

from lakeseek.llm import context_tree, spans


def _peak(run, batches) -> float:
    tracemalloc.start()
    try:
        for _ in run(iter(batches)):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _texts(n: int, words: int) -> list[str]:
    rng = random.Random(3)
    known = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(2000)]
    return [" ".join(rng.choices(known, k=words)) + "." for _ in range(n)]


def test_counting_a_block_holds_few_chunks(monkeypatch):
    monkeypatch.setattr(context_tree, "CHUNK", 100_000)
    texts = _texts(120, 1500)
    rows = pa.RecordBatch.from_arrays([pa.array([0] * 120, pa.int64()), pa.array([int(i % 5 == 1) for i in range(120)], pa.int32()), pa.array(texts)], names=["block", "held_out", "text"])
    assert _peak(context_tree._counted(64), [rows]) < 400 * 100_000  # before: 448


def test_runs_of_a_batch_hold_no_words_of_other_texts(monkeypatch):
    monkeypatch.setattr(spans, "BATCH_CHARS", 600_000)
    texts = _texts(120, 1500)
    rows = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array(range(120), pa.int64()), pa.array(texts)], names=["doc", "mark", "text"])
    assert _peak(spans._keyed(64), [rows]) < 25 * 600_000  # before: 33
