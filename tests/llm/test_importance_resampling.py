"""Weighted draws against brute force, and the tournament against a plain sort."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from foldlog.llm import importance_resampling as ir

cloudpickle.register_pickle_by_value(sys.modules[__name__])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute(rows, target, percent=5):
    found = [(i, *buckets(t)) for i, t in rows]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for x in target for b in buckets(x)[1])
    total, wanted = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total / ((s[b] + 1) * wanted)))
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


def corpus(n=900):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "Der", "le", "x9", "ünï", "日本", "a" * 60, "kernel", "KERNEL"]) + rng.choice(["", "s", "é", "7"])
    rows = [(None, "Some words of a text that has no id, but is as long as the others are: one two three four five six seven eight nine."), (1, None), (2, ""), (3, " .,;\n"), (4, "w" * 5_000), (5, " ".join(word() for _ in range(25_000)))]
    return rows + [(k, " ".join(word() + rng.choice(["", ".", "-x", ","]) for _ in range(rng.randrange(60)))) for k in range(6, n)]


@pytest.mark.parametrize("span_rows", [ir.SPAN_ROWS, 40])
def test_draws(spark, span_rows):
    rows, target = corpus(), ["The kernel, le noyau 日本", None, "", "x9 " * 30 + "a" * 60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = ir.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=20, span_rows=span_rows)
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()), key=repr) == brute(rows, target, 20)


def test_empty_tables_ties_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ir.resample(none, none.select("text")).count() == 0
    text = "same words " * 15
    rows = [(7, text, k) for k in range(200)] + [(None, text, 0)] * 10 + [(8, "few", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `Rank` int").repartition(4)
    found = ir.resample(docs, none.select("text"), percent=50, span_rows=20).collect()
    ranks = sorted(r["rank"] for r in found if r["rank"] is not None)
    assert len(found) == 211 and ranks == list(range(1, 106))
    assert len({(r["weight"], r["score"]) for r in found if r["doc_id"] == 7}) == 1


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 40])
def test_a_tournament_merges_runs(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), rng.randrange(5), i * 1000 + j) for j in range(rng.randrange(30))) for i in range(k)]
    assert list(ir.Losers(runs)) == sorted(x for r in runs for x in r)


def test_runs_are_found_as_they_come():
    rows = [(1, 1, 1), (1, 1, 2), (1, 2, 0), (3, 0, 0), (2, 9, 9), (2, 9, 8), (4, 4, 4)]
    runs = ir.sorted_runs([np.array(c) for c in zip(*rows, strict=True)])
    assert [len(r) for r in runs] == [4, 1, 2] and [x for r in runs for x in r] == rows


def test_buckets_are_those_of_a_plain_crc():
    texts = [t or "" for _, t in corpus(60)]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    n, found = ir.feature_buckets(data, np.cumsum([0] + [len(t.encode()) for t in texts]))
    for r, t in enumerate(texts):
        words, wanted = buckets(t)
        assert n[r] == words and [b for row, bucket in found for b in bucket[row == r].tolist()] == wanted
