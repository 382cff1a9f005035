"""Repeated windows of words against brute force, at every size of bucket."""

import random
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from foldlog.llm import super_kmer

cloudpickle.register_pickle_by_value(sys.modules[__name__])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda k: [rng.choice("abcdefgh") + rng.choice("xyzé") + rng.choice(["", "q", "日"]) for _ in range(k)]
    phrase, passage, page = prose(12), prose(60), prose(140)
    rows = [(None, " ".join(page)), (0, None), (1, ""), (2, " \n\t "), (3, " ".join(prose(49))), (90, " ".join(page)), (90, " ".join(page)), (90, " ".join(passage + page)), (4, "a " * 200), (91, "a " * 70)]
    for k in range(5, 60):
        words = prose(rng.randrange(30, 90)) + rng.choice([[], phrase, passage, page[:70], page[30:]]) + prose(rng.randrange(40)) + (phrase if k % 2 else []) + prose(rng.randrange(60))
        rows.append((rng.choice([k, k, k, k + 1]), (" " if k % 3 else "\n").join(words)))
    near = prose(130)
    for k in range(100, 130):
        words = list(near)
        words[rng.randrange(130)] = "changed"
        rows.append((k, " ".join(words)))
    rows += [(200, " ".join(prose(20_000) + passage)), (201, "w" * 5000 + " " + " ".join(page))]
    return rows


def brute(rows, size):
    least = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                least[g] = min(i, least.get(g, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and least[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


order = lambda rows: sorted(rows, key=repr)


@pytest.mark.parametrize(("size", "group_bytes", "words"), [(50, super_kmer.GROUP_BYTES, 65_000), (50, 600, 10), (50, 1, 0), (8, 200, 65_000)])
def test_repeated_windows_go(spark, monkeypatch, size, group_bytes, words):
    monkeypatch.setattr(super_kmer, "VOCABULARY", words)
    monkeypatch.setattr(super_kmer, "RANKED_BYTES", 2_000)
    rows = corpus(size + group_bytes)
    found = super_kmer.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=size, group_bytes=group_bytes)
    wanted = brute(rows, size)
    assert order((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found.collect()) == order(wanted)
    assert sum(w[2] for w in wanted) > 2_000


def test_nothing_and_clashing_names(spark):
    assert super_kmer.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "a", 7, "row"), (2, text + " more", "b", 8, "spans")]
    given = spark.createDataFrame(rows, "doc_id long, text string, key string, doc long, `Spans` string")
    found = {r["doc_id"]: r for r in super_kmer.dedup(given.withColumnRenamed("key", "n_words")).collect()}
    assert (found[2]["kept"], found[2]["n_removed"], found[2]["n_words"], found[2]["doc"], found[2]["Spans"]) == ("more", 60, 61, 8, "spans")
    assert found[1]["kept"] == text


def test_windows_are_ranked_exactly():
    rng = np.random.default_rng(5)
    known = np.zeros(0, dtype=np.uint64)
    texts = [" ".join(rng.choice(["a", "bb", "c"], size=int(rng.integers(6, 40)))) for _ in range(40)]
    strings, windows, wanted = [], [], []
    for t in texts:
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        words = super_kmer.kit.Words(data, np.array([0, len(data)]), lower=False)
        strings += super_kmer.Packer(words, known).strings(np.array([0]), np.array([len(words.starts)]))
        windows.append(len(words.starts) - 5)
        wanted += [tuple(t.split()[k : k + 6]) for k in range(windows[-1])]
    _, rank = super_kmer.rank_windows(strings, np.array(windows), 6)
    names = {}
    assert all(names.setdefault(r, w) == w for r, w in zip(rank.tolist(), wanted, strict=True)) and len(names) == len(set(wanted))


def test_equal_windows_meet_in_one_bucket_at_every_level():
    rng = random.Random(9)
    words = [rng.choice("abcdefghij") for _ in range(3_000)]
    text = " ".join(words + ["!"] + words[500:900] + ["?"] + words[:300])
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    made = super_kmer.kit.Words(data, np.array([0, len(data)]), lower=False)
    every = text.split()
    large = []
    for _ in range(len(super_kmer.REACH)):
        p = super_kmer.Pieces(made, 50, large)
        of = {}
        for a, b, key in zip(p.first.tolist(), p.end.tolist(), p.key.tolist(), strict=True):
            for k in range(a, b - 49):
                assert of.setdefault(tuple(every[k : k + 50]), key) == key
        assert sum((p.end - p.first - 49).tolist()) == len(every) - 49
        large.append(np.unique(p.key)[::2])
        if len(large) == len(super_kmer.REACH):
            break
