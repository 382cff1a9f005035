"""Every order of five filters against a plain walk through the orders, and the registered query against its SQL."""

import itertools
import random
import re
from collections import Counter

import duckdb

from foldlog.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, mask int"


def corpus():
    rng = random.Random(8)
    prose = lambda n, k: " ".join(rng.choice("abcdefghij") + str(rng.randrange(k)) for _ in range(n))
    rows = [(None, None, "a", 1), (None, "shared " * 3, "a", 1), (1, "", None, 1), (2, None, "", 1), (3, "shared " * 3, "b", 1), (4, "W" * 100, "b", 1), (4, "W" * 100, "b", 1), (5, prose(30_000, 5), "c", 1)]
    for k in range(6, 160):
        text = prose(rng.choice([150, 199, 200, 250]), rng.choice([3, 5, 400]))
        text += rng.choice(["", "", " #", " a|b", " €"]) + rng.choice(["", " X" * 40])
        rows.append((k, text if k % 5 else rows[-1][1], rng.choice(["a", "b", "quiet", None]), k))
    labels = [(k, k % 3 % 2, k % 4 % 2) for k in range(3, 150, 2)] + [(7, None, None), (9, 0, 0), (9, 1, 1), (None, 1, 1)]
    return rows, labels


def failures(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, part, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        yield i, part or "", {f for f, x in fails.items() if x}


def brute(rows, labels):
    good, toxic = ({i for i, *l in labels if i is not None and l[k] == 1} for k in (0, 1))
    docs, out, shapley = list(failures(rows)), {}, Counter()
    parts = {p for _, p, _ in docs}
    for part, order in itertools.product(parts, itertools.permutations("ABCDE")):
        here = [(i, f) for i, p, f in docs if p == part]
        alive = here
        for step, f in enumerate(order, 1):
            gone, stay = [x for x in alive if f in x[1]], [x for x in alive if f not in x[1]]
            out[part, "".join(order), step] = [f, len(stay), len(gone), sum(f in x[1] for x in here) - len(gone), sum(x[1] == {f} for x in here), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
            shapley[part, f] += len(gone)
            alive = stay
    return {k: (*v, shapley[k[0], v[0]]) for k, v in out.items()}


def found(frame):
    names = ("filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in frame.collect()}


def test_audit(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    marked = filter_audit.labelled(filter_audit.flags(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = found(filter_audit.audit(marked))
    assert got == brute(rows, labels) and len(got) == 5 * 600


def test_nothing_and_other_filters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert filter_audit.audit(filter_audit.labelled(filter_audit.flags(empty), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
    rows = [("p", True, None, True, False), ("p", False, True, None, True), ("q", None, None, None, None)]
    got = found(filter_audit.audit(spark.createDataFrame(rows, "part string, x boolean, y boolean, good boolean, toxic boolean"), ("x", "y")))
    assert {k: v[:3] for k, v in got.items()} == {
        ("p", "xy", 1): ("x", 1, 1), ("p", "xy", 2): ("y", 0, 1), ("p", "yx", 1): ("y", 1, 1), ("p", "yx", 2): ("x", 0, 1),
        ("q", "xy", 1): ("x", 1, 0), ("q", "xy", 2): ("y", 1, 0), ("q", "yx", 1): ("y", 1, 0), ("q", "yx", 2): ("x", 1, 0),
    }


def test_the_oracle_takes_nulls_alike():
    rows, labels = corpus()
    rows = [r for r in rows if r[0] is not None and r[0] != 4]
    labels = [x for x in labels if x[0] not in (7, 9)]
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR, mask INT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    db.sql("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    db.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    names = ("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = db.sql(f"SELECT {', '.join(names)} FROM ({filter_audit.ORACLE})").fetchall()
    assert {r[:3]: r[3:] for r in got} == brute(rows, labels)
