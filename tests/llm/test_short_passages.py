"""Passages that rows share and that are too short for op8 to remove: they show in n_shared."""

import random

import numpy as np
import pyarrow as pa
import pytest

from foldlog.llm import run_length_index

LEAST, SURE = 128, 255


def longest_shared(texts, among):
    """Which texts have a string of so many bytes in common with another row."""
    return {n: {i for i, x in enumerate(texts) if any({x[k : k + n] for k in range(len(x) - n + 1)} & {y[k : k + n] for k in range(len(y) - n + 1)} for j, y in enumerate(texts) if j != i)} for n in among}


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(words))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (52, 55, 58)]
    assert all(SURE <= len(p) < 400 for p in passages)
    rows = [f"{prose(rng, 40)}\n{passages[i % 3]}\n{prose(rng, 70)}" for i in range(9)]  # a passage of over 50 words
    rows += [f"{prose(rng, 60)} {passages[0][:n]} {prose(rng, 60)}" for n in (100, 120, 180, 254)]  # a part of one
    own = prose(rng, 54)
    rows += [f"{own}\n{prose(rng, 30)}\n{own}", prose(rng, 200), prose(rng, 20), "ü" * 90, "", None]  # repeats of its own only; none; short ones
    copy = prose(rng, 90)
    return [*rows, copy, copy, "short " * 5, "short " * 5]


def test_short_passages_show_and_stay(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = run_length_index.remove_repeats(docs)
    named = docs.select("doc_id", *run_length_index.keys("text")).join(found, ["h1", "h2"])
    rows = {r["doc_id"]: r for r in named.collect()}
    shown = {i for i, r in rows.items() if r["n_shared"] > 0}
    wanted = longest_shared([(t or "").encode() for t in texts], (LEAST, SURE))
    assert set(range(9)) <= wanted[SURE] <= shown <= wanted[LEAST]
    assert {i for i, r in rows.items() if r["n_removed"]} == {19, 20}  # only whole copies have 400 bytes in common
    assert rows[19]["n_shared"] == rows[20]["n_shared"] == len(set(run_length_index.marks_of(np.frombuffer(texts[19].encode(), dtype=np.uint8), np.array([0, len(texts[19])]))[1].tolist()))


@pytest.mark.parametrize("steps", [1, 3, 28])
def test_marks_meet_within_and_across_steps(texts, steps):
    data = [(i, t or "") for i, t in enumerate(texts)]
    distinct = {t: (i, sum(u == t for _, u in data)) for i, t in data}
    rows = [(i, t, m) for t, (i, m) in distinct.items()]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k::steps], strict=True)], names=["id", "text", "m"]) for k in range(min(steps, len(rows)))]
    blocks = list(run_length_index._cut_marks(7)(iter(batches)))
    got = {}
    for shard in range(7):
        for out in run_length_index._met(b.filter(pa.array([s == shard for s in b.column(0).to_pylist()])) for b in blocks):
            for i, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                got[i] = got.get(i, 0) + n
    marks = {i: set(run_length_index.marks_of(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))[1].tolist()) for i, t, _ in rows}
    wanted = {i: len(marks[i] if m > 1 else marks[i] & set().union(*(x for j, x in marks.items() if j != i))) for i, _, m in rows}
    assert got == {i: n for i, n in wanted.items() if n}


def test_marks_are_dealt_out_evenly():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([prose(random.Random(9), 40_000)]), pa.array([1])], names=["id", "text", "m"])
    (block,) = run_length_index._cut_marks(8)(iter([batch]))
    sizes = [len(b) for b in block.column("marks").to_pylist()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * min(sizes)
