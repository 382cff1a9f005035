"""Text operators against brute force on small tables that hold the awkward cases."""

import base64
import hashlib
import itertools
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foldlog.llm import byte_bpe, decontaminate, line_dedup, ngram_join, ngram_trie, pii, pu_quality, quality_rules, registry, run_length_index, sharding

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base, passage = prose(120), ". ".join(prose(9) for _ in range(8))
    texts = [None, "", " \n\t", "one", "one two three four", "ONE two three four", "x" * 3000, "ab" * 700, "日本語 テキスト 🎉 ok"]
    texts += [base, base, base.upper(), prose(30) + ".\n" + passage + "\n" + prose(5), prose(40) + "\n" + passage]
    for k in range(n):
        words = base.split() if k % 3 == 0 else prose(rng.randrange(1, 200)).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        texts.append(text + ("\n" + passage if k % 7 == 0 else "") + ("\n" + texts[k % 9] if k % 11 == 0 and texts[k % 9] else ""))
    return [(i, t, "en", f"s{i % 3 if i % 4 else 0}", len(t or "")) for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---------------------------------------------------------------- 1

def links(rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_components(docs, monkeypatch):
    wanted = links(ROWS)
    assert {r["doc"]: (r["n"], r["component"]) for r in ngram_join.link(docs).collect()} == wanted
    # with every shingle that stands twice put last
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 2)
    monkeypatch.setattr(ngram_join, "CELL_SHINGLES", 40)
    assert {r["doc"]: (r["n"], r["component"]) for r in ngram_join.link(docs).collect()} == wanted


def test_members_of_a_group_link_without_its_first(spark):
    rows = []
    for k in range(12):
        a, b, c, d, e = (f"{x}{k}" for x in "abcde")
        rows += [(3 * k + 1, f"{a} {b} {c} {d} {e} f"), (3 * k + 2, f"{a} {b} {c} {d} {e} g"), (3 * k + 3, f"{a.upper()} {b} {c} {d} {e} g")]
    found = {r["doc"]: (r["n"], r["component"]) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == links(rows)


def test_members_link_although_their_group_s_first_is_apart(spark):
    p = [f"p373x{k}" for k in range(7)]
    a, b, c = [f"a373x{k}" for k in range(5)], [f"b373x{k}" for k in range(5)], "c373"
    rows = [(1, " ".join(p + a)), (2, " ".join(p + b)), (3, " ".join([*p, *b[:4], c]))]
    found = {r["doc"]: (r["n"], r["component"]) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == links(rows) and found[2][1] == found[3][1] == 2


@pytest.mark.parametrize("cell", [25, 4_000_000])
def test_near_copies_of_short_texts(spark, monkeypatch, cell):
    monkeypatch.setattr(ngram_join, "CELL_SHINGLES", cell)
    rng = random.Random(21)
    rows = []
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(rng.choice([8, 13, 30, 45]))]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice([f"f{family}z{k}" for k in range(3)])
            rows.append((len(rows), " ".join(own[: len(own) - rng.randrange(3)])))
    found = {r["doc"]: (r["n"], r["component"]) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == links(rows)


@pytest.mark.parametrize("more", [1, 2, 8])
def test_refuted_pairs_leave_no_link_out(spark, monkeypatch, more):
    """Families at the threshold: many pairs pass the bitmaps and fail the sets."""
    monkeypatch.setattr(ngram_join, "MORE", more)
    rng = random.Random(5)
    rows = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(60)]
        for _ in range(16):
            own = list(base)
            for _ in range(rng.choice([1, 2, 2, 3, 4])):
                own[rng.randrange(len(own))] = f"z{rng.randrange(9)}"
            rows.append((len(rows), " ".join(own)))
    found = {r["doc"]: (r["n"], r["component"]) for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == links(rows)


def test_one_row_of_each_component_stays(spark, none):
    base = "a b c d e f g h i j k l m n o p"
    rows = [(None, base), (None, base), (7, base + " q"), (7, base + " q"), (3, "other words stand here alone today"), (None, "words that nobody else has at all"), (4, None), (5, "")]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("component", F.lit("x"))
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.stage(spark, given, "").collect()), key=repr)
    assert kept == sorted([(7, base + " q"), (3, rows[4][1]), (None, rows[5][1]), (4, None), (5, "")], key=repr)
    assert ngram_join.stage(spark, given, "").columns == given.columns and ngram_join.stage(spark, none, "").count() == 0


def test_rows_without_an_id_have_their_set_sizes(spark):
    rows = [(None, "a b c d e f g h"), (None, "a b"), (None, ""), (None, None), (1, "a b c d e f g h"), (None, "a b c d e a b c d e"), (None, "x " * 20_000)]
    found = ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc"] is None, r["n"], r["component"] is None) for r in found) == sorted([(True, 4, True), (True, 1, True), (True, 0, True), (True, 0, True), (False, 4, False), (True, 5, True), (True, 1, True)])


def test_jaccard_of_nothing_and_of_null_ids(spark, none):
    assert ngram_join.link(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r[0] or 0, r[2] or 0) for r in ngram_join.link(rows).collect()) == [(0, 0), (2, 2), (2, 2), (3, 2)]


# ---------------------------------------------------------------- 2

def test_rules_match_their_sql(spark, docs, none):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(ROWS, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    wanted = {r[0]: r[1:] for r in con.sql(quality_rules.ORACLE).fetchall()}
    names = con.sql(quality_rules.ORACLE).columns
    found = {r["doc_id"]: tuple(r[c] for c in names[1:]) for r in quality_rules.clean(docs).collect()}
    assert found == wanted
    assert quality_rules.clean(none).count() == 0
    rng = random.Random(11)
    bits = ["a | b", "Start » x", "https://q.r", "www.s.t u", "1/2/3", "12:30", "x", "Conditions d'utilisation", "POLÍTICA DE PRIVACIDAD", "hier KLICKEN", "word " * 13, "end.", "!! ??", "/ > •", "\n", "\n"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    con.register("more", pd.DataFrame(rows, columns=["doc_id", "text"]))
    sql = quality_rules.ORACLE.replace("FROM documents", "FROM more")
    found = {r["doc_id"]: tuple(r[c] for c in names[1:]) for r in quality_rules.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {r[0]: r[1:] for r in con.sql(sql).fetchall()}


@pytest.mark.parametrize("line, fails", [("home | news | about", True), ("Copyright 2020 All Rights Reserved by us.", True), ("WHAT!! NOW!!", True), ("a### b$$$ c%%%", True), ("a plain sentence with its end.", False), ("one two three four five six seven eight nine ten eleven twelve", True), ("a | b c d e f g h i j k l m.", False), ("Start » News › Sport", True), ("https://a.b/c www.d.e", True), ("see https://a.b/c there", False), ("12/03/2020 14:22 7", True), ("in 2020 they left.", False), ("TODOS LOS DERECHOS RESERVADOS", True), ("Politique de confidentialitÉ", True), ("Términos de uso del sitio", True)])
def test_line_rules(line, fails):
    assert quality_rules.line_fails(line, line.encode().split()) == fails


# ---------------------------------------------------------------- 3

def plain_words(text):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", lower(text)).split()


def overlap(doc, item):
    """Brute force over all diagonals: (equal words, first word) of the best, None if the item is not in the text."""
    best, n = None, len(item)
    for shift in range(1 - n, len(doc)):
        same = [0 <= shift + k < len(doc) and doc[shift + k] == item[k] for k in range(n)]
        if n > 12:
            runs = [(sum(1 if x else -2 for x in same[i:j]), i - j, -j, i, j) for i in range(n) for j in range(i + 1, n + 1)]
            _, _, _, i, j = max(runs)
        else:
            i, j = 0, n
        matched = sum(same[i:j])
        if matched and matched >= (12 if n > 12 else n - 1 if n >= 5 else n):
            at = shift + i + same[i:j].index(True)
            if best is None or (matched, -at) > (best[0], -best[1]):
                best = matched, at
    return best


def test_contaminations(spark, docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    items = {k: [rng.choice(words) for _ in range(n)] for k, n in enumerate([30, 13, 14, 12, 11, 10, 9, 7, 5, 4, 3, 2, 1, 20])}
    rows = []
    for i in range(160):
        item = list(items[rng.choice(list(items))])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            item[rng.randrange(len(item))] = "changed"
        cut = item[rng.choice([0, 0, 1, 4]) :] if len(item) > 5 else item
        text = " ".join([rng.choice(words[:40]) for _ in range(rng.randrange(6))] + cut + [rng.choice(words[:40]) for _ in range(rng.randrange(6))])
        rows.append((i, text.upper() + "!" if i % 3 else text.replace(" ", ", ")))
    every = [" ".join("changed" if k % period == phase else w for k, w in enumerate(items[0])) for period in (4, 5, 6) for phase in range(period)]
    rows += [(1000 + k, t) for k, t in enumerate(every)] + [(2000, None), (2001, ""), (2002, "!?")]
    bench = [(k, " ".join(x)) for k, x in items.items()] + [(50, None), (51, ""), (52, " ".join(items[0])), (None, "w1 w2 w3")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__text", F.lit("t")).withColumn("row", F.lit(1)).withColumn("__hits", F.lit(0)).withColumn("hits", F.lit(0))
    found = decontaminate.contaminations(given, bench)
    assert found.columns == ["doc_id", "text", "__text", "row", "__hits", "hits"]
    hits = {(r["doc_id"], h["item_id"]): (h["matched"], h["first_word"]) for r in found.collect() for h in r["hits"]}
    wanted = {(i, k): overlap(plain_words(t), x) for i, t in rows for k, x in [*items.items(), (52, items[0])]}
    assert hits == {k: v for k, v in wanted.items() if v} and len(hits) > 100
    assert decontaminate.contaminations(docs, bench.limit(0)).where(F.size("hits") > 0).count() == 0


def test_a_large_benchmark_takes_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    bench = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(5)], "item_id long, text string")
    rows = spark.createDataFrame([(1, "x a0 b0 c0 d0 e0 f0 a4 b4 c4 d4 zz f4"), (2, "a1 b2")], "doc_id long, text string")
    assert {r["doc_id"]: [(h["item_id"], h["matched"]) for h in r["hits"]] for r in decontaminate.contaminations(rows, bench).collect()} == {1: [(0, 6), (4, 5)], 2: []}


def test_masks_leave_no_accepted_overlap_out():
    ways = {"M" * n for n in (10, 11, 12)} | {"M" * i + "X" + "M" * (n - 1 - i) for n in (10, 11, 12) for i in range(n)}

    def follow(way, equal, worth):
        if equal == 12:
            ways.add(way)
            return
        follow(way + "M", equal + 1, worth + 1)
        if worth > 2:
            follow(way + "X", equal, worth - 2)

    follow("", 0, 0)
    fits = lambda mask, way: any(all(way[o + k] == "M" for k, x in enumerate(mask) if x == "1") for o in range(len(way) - len(mask) + 1))
    assert len(ways) == 763 and all(any(fits(mask, way) for mask in decontaminate.MASKS) for way in ways)


# ---------------------------------------------------------------- 4

def test_ids_are_those_of_a_public_library(docs, none):
    import tiktoken

    path, pattern = byte_bpe.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: (list(memoryview(bytes(r["ids"])).cast("I")), bytes(r["decoded"])) for r in byte_bpe.round_trip(docs, path, pattern).collect()}
    assert found == {i: (public.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS}
    assert byte_bpe.decode(byte_bpe.encode(none, path, pattern), path, pattern).count() == 0
    apart = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in apart.collect()} == {i: (t or "").encode() for i, t, *_ in ROWS}


# ---------------------------------------------------------------- 5

def placed_by_hand(rows, n_shards, seed=17):
    """id to (shard, slot): all rows sorted by their fractional rank in their stratum, then cut."""
    from fractions import Fraction

    size, crc = (lambda t: len((t or "").encode()) + 16), (lambda t: zlib.crc32((t or "").encode()))
    strata = {}
    for i, t, s in rows:
        digest = hashlib.md5(f"{seed}:{'null' if i is None else i}:{size(t)}:{crc(t)}".encode()).hexdigest()
        strata.setdefault("n" if s is None else f"s{s}", []).append((digest, i))
    places = sorted((Fraction(2 * r - 1, 2 * len(own)), key, r, i) for key, own in strata.items() for r, (_, i) in enumerate(sorted(own), 1))
    shards = [k * n_shards // len(rows) for k in range(len(rows))]
    return {p[3]: (s, k - shards.index(s)) for k, (p, s) in enumerate(zip(places, shards, strict=True))}


def test_rows_of_one_id_spread_and_equal_rows_are_all_placed(spark):
    rows = [(None, f"text {k % 60}", None if k % 3 else "hot") for k in range(90)] + [(None, None, "hot")] * 9 + [(1, "", "hot"), (1, "", "hot")]
    found = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("clash")), 4, bucket_rows=5).collect()
    slots = sorted((r["shard"], r["slot"]) for r in found)
    assert [sum(s == k for s, _ in slots) for k in range(4)] in ([26, 25, 25, 25], [25, 25, 25, 26]) and len(set(slots)) == len(rows)
    assert all(abs(sum(r["stratum"] == "hot" for r in found if r["shard"] == k) - 41 / 4) < 2 for k in range(4))


def test_shards_are_even_and_mixed(spark, docs, none, tmp_path):
    found = sharding.interleave(docs, 5, bucket_rows=7).collect()
    by = {k: [r for r in found if r["shard"] == k] for k in range(5)}
    sizes = [len(v) for v in by.values()]
    assert sum(sizes) == len(ROWS) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    for s in {r[3] for r in ROWS}:
        share = sum(r[3] == s for r in ROWS) / 5
        assert all(abs(sum(r["stratum"] == s for r in v) - share) < 2 for v in by.values())
    assert {r["id"]: (r["size"], r["text_crc32"]) for r in found} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS}
    again = {r["id"]: (r["shard"], r["slot"]) for r in sharding.interleave(docs.repartition(7), 5, bucket_rows=1000).collect()}
    assert again == {r["id"]: (r["shard"], r["slot"]) for r in found}
    assert again == placed_by_hand([(i, t, s) for i, t, _, s, *_ in ROWS], 5)
    assert sharding.interleave(none, 5).count() == 0
    sharding.write_shards(docs.withColumn("shard", F.lit("clash")), f"file://{tmp_path}/shards", 3)
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == len(ROWS)


# ---------------------------------------------------------------- 6

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def personal(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark, none):
    rng = random.Random(3)
    pieces = ["a@b.cd", "x.y@z", "_d@e.f", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (569) 555-7279", "+12", "é🎉", " ", ".", "-", "7", "+", "007.0.0.001", "my card "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + [None, "", "9" * 50_000, "a" * 100_000, "a@" + "b." * 20_000 + "c", "1.2.3.4 " * 3_000, "+1" * 10_000, "1 2-" * 10_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in pii.BASE] for r in pii.find(rows).collect()}
    assert found == {i: personal(t) for i, t in enumerate(texts)}
    assert pii.find(none).count() == 0


def test_confirmed_and_scored_kinds(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32.", "GB82WEST12345698765433", "my ssn is 123-45-6789", "part 123-45-6789", "pay by card 4111111111111111", "x 4111111111111111"]
    found = [[(s["kind"], s["score"]) for s in r["pii"]] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert found == [[("iban", 0.95)], [], [("ssn", 0.6)], [], [("card", 0.95)], [("card", 0.65)]]


def test_an_iban_is_as_long_as_its_country_says(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000.", "DE89370400440532013000X", "konto NO93 8601 1117 947 SEPA OK", "GB82 WEST 1234 5698 7654 32 AND MORE", "ZZ89370400440532013000"]
    rows = spark.createDataFrame([(i, t, "user's own") for i, t in enumerate(texts)], "doc_id long, text string, __pii_iban string")
    found = pii.find(rows).orderBy("doc_id").collect()
    assert [[t[s["start"] : s["end"]] for s in r["pii"]] for r, t in zip(found, texts)] == [["DE89 3704 0044 0532 0130 00"], ["DE89370400440532013000"], [], ["NO93 8601 1117 947"], ["GB82 WEST 1234 5698 7654 32"], []]
    assert {r["__pii_iban"] for r in found} == {"user's own"}


def test_kinds_that_context_decides(spark):
    token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    cases = [
        (f'token = "{token}" x', ["secret"]), (f"commit {token} of may", []), ("secret " + "a" * 40, []), (f"Contraseña: {token}", ["secret"]), ("CONTRASEÑA " + token, ["secret"]),
        ("born 04/07/1981 in", ["birth"]), ("on 04/07/1981 in", []), ("geboren am 4.7.1981", ["birth"]), ("né le 1981-07-04", ["birth"]), ("birth 44/07/1981", []), ("dob 1.2.2003.4.5.6", []),
        ("Passport C1234567.", ["passport"]), ("part C1234567", []), ("pasaporte XC123456", ["passport"]), ("passport C12345678901", []), ("Steuer 123-45-6789", ["ssn"]),
        ("born" + "x" * 41 + " 04/07/1981", []), ("", []), (None, []),
    ]
    found = pii.find(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[s["kind"] for s in r["pii"] if s["kind"] not in pii.BASE] for r in found] == [kinds for _, kinds in cases]
    assert [cases[0][0][s["start"] : s["end"]] for s in found[0]["pii"]] == [token]


# ---------------------------------------------------------------- 7

def plain_patience(a, b):
    """Equal ends, then lines that stand once on either side, then the same between; difflib where none does."""
    import difflib

    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in plain_patience(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 == b.count(x)]
    if not once:
        return [(m.a + t, m.b + t) for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks() for t in range(m.size)]
    best = [once[i] for i in line_dedup.increasing([j for _, j in once])]
    out, i, j = [], 0, 0
    for x, y in [*best, (len(a), len(b))]:
        out += [(i + p, j + q) for p, q in plain_patience(a[i:x], b[j:y])] + [(x, y)]
        i, j = x + 1, y + 1
    return out[:-1]


def deduplicated(rows, rare):
    """Brute force: every document against the earlier holders of its seeds, turn by turn. rows: id, text."""
    told = {}
    for i, t in rows:
        lines = [x for x in t.split("\n") if WORD.search(x)]
        runs = []
        for k in range(len(lines)):
            n = next((n for n in range(1, 6) if k + n <= len(lines) and sum(len(WORD.findall(x)) for x in lines[k : k + n]) >= 5), None)
            if n:
                runs.append((k, tuple(lines[k : k + n])))
        told[i] = (lines, [(k, r) for k, r in runs if sum(r == q for _, q in runs) == 1])
    holders = {}
    for i in sorted(told):
        for _, r in told[i][1]:
            holders.setdefault(r, []).append(i)
    out = {}
    for i, t in rows:
        lines, runs = told[i]
        gone = set()
        pointer = {k: 0 for k, r in runs}
        turn = 0
        while True:
            open_ = [(k, r) for k, r in runs if not set(range(k, k + len(r))) <= gone or turn == 0]
            if turn == 0:
                ask = [(k, r) for k, r in open_ if len(holders[r]) <= rare]
            else:
                for k, r in open_:
                    if turn > 1 or len(holders[r]) <= rare:
                        pointer[k] += 1
                ask = open_
            partners = {holders[r][pointer[k]] for k, r in ask if pointer[k] < len(holders[r]) and holders[r][pointer[k]] < i}
            if turn and not partners:
                break
            for e in partners:
                match = sorted(plain_patience(lines, told[e][0]))
                while match:
                    n = next((n for n in range(1, len(match)) if match[n] != (match[n - 1][0] + 1, match[n - 1][1] + 1)), len(match))
                    block, match = [x for x, _ in match[:n]], match[n:]
                    if sum(len(WORD.findall(lines[x])) for x in block) >= 5:
                        gone |= set(block)
            turn += 1
        kept, k, all_lines = [], 0, t.split("\n")
        for line in all_lines:
            if WORD.search(line):
                if k not in gone:
                    kept.append(line)
                k += 1
            elif not ((k == 0 or k - 1 in gone) and (k == len(lines) or k in gone) and lines and (k > 0 or 0 in gone) and gone):
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def test_alignment():
    a, b = list("xabcabcz"), list("yabcqabcz")
    assert line_dedup.align(a, b) == sorted(plain_patience(a, b))
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(12))] for _ in range(2))
        found = line_dedup.align(a, b)
        assert found == sorted(plain_patience(a, b)) and all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(found))
    assert line_dedup.increasing([5, 1, 2, 9, 3]) == [1, 2, 4]
    assert line_dedup.blocks([(0, 0), (1, 1), (3, 2), (4, 9)], [2, 2, 9, 6, 1]) == [(3, 4)]
    assert line_dedup.shorten("\na\n\nb\n\nc\n", [(0, 2)]) == ("\nc\n", 7, 4) and line_dedup.shorten("\na\n", [(0, 1)])[0] == ""


def test_later_documents_lose_shared_blocks(spark, docs, none):
    line = lambda k: f"this is a seed line number {k} of many"
    verse = "\n".join(f"short {k}" for k in range(9))
    a, b = "\n".join(["head", line(1), "x", line(2), line(3), "tail"]), "\n".join(["own words stand in this line", line(1), "x", line(2), "y"])
    rows = [(1, a), (2, b), (3, a), (3, a), (4, None), (None, line(3)), (5, ""), (6, verse), (7, "own\n" + verse), (8, "only four words here"), (9, "only four words here")]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("links", F.lit(1)).withColumn("__doc", F.lit(2)).withColumn("__text", F.lit("t")).withColumn("spans", F.lit("s"))
    found = line_dedup.dedup(given)
    assert found.columns == [*given.columns, *line_dedup.OUT.fieldNames()]
    kept = sorted(((r["doc_id"], r["deduped"]) for r in found.collect()), key=repr)
    assert kept == sorted([(1, a), (2, "own words stand in this line\ny"), (3, ""), (3, ""), (4, None), (None, ""), (5, ""), (6, verse), (7, "own"), (8, rows[9][1]), (9, rows[9][1])], key=repr)
    assert line_dedup.dedup(none).count() == 0
    staged = line_dedup.stage(spark, given, "")
    assert staged.columns == given.columns and sorted(r["doc_id"] for r in staged.collect()) == [1, 2, 4, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("rare", [2, 64])
def test_lines_meet_every_earlier_holder(spark, docs, monkeypatch, rare):
    monkeypatch.setattr(line_dedup, "RARE", rare)
    line = lambda k: f"this is a seed line number {k} of many" if k % 3 else f"short {k}"
    crossed = [(1, "\n".join(map(line, [2, 4, 1, 5]))), (2, "\n".join(map(line, [1, 5]))), (3, "\n".join(map(line, [1, 5, 2, 4])))]
    assert {r["doc_id"]: r["deduped"] for r in line_dedup.dedup(spark.createDataFrame(crossed, "doc_id long, text string")).collect()}[3] == ""
    rng = random.Random(8)
    rows = [(i, "\n".join(line(k) if k else "" for k in (rng.sample(range(16), rng.randrange(3, 12)) + [rng.randrange(16)]))) for i in range(40)]
    rows += [(100 + i, t) for i, t, *_ in ROWS if t is not None]
    found = {r["doc_id"]: r["deduped"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == deduplicated(rows, rare)


# ---------------------------------------------------------------- 8

def repeats(rows, w=400):
    seen = {}
    data = {i: (t or "").encode() for i, t, *_ in rows}
    for x in data.values():
        for k in range(len(x) - w + 1):
            seen[x[k : k + w]] = seen.get(x[k : k + w], 0) + 1
    out = {}
    for i, x in data.items():
        gone = bytearray(len(x))
        for k in range(len(x) - w + 1):
            if seen[x[k : k + w]] > 1:
                gone[k : k + w] = b"\1" * w
        out[i] = (len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(x, gone) if not g))
    return out


@pytest.mark.parametrize("variants", [1, 1000])
def test_repeated_passages(spark, docs, none, monkeypatch, variants):
    monkeypatch.setattr(run_length_index, "VARIANTS", variants)
    found = run_length_index.remove_repeats(docs)
    named = docs.select("doc_id", *run_length_index.keys("text")).join(found, ["h1", "h2"])
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in named.collect()} == repeats(ROWS)
    assert run_length_index.remove_repeats(none).count() == 0


def test_matches_of_the_index():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    index = run_length_index.RunLengthIndex(strings)
    assert index.run_lengths.sum() == sum(map(len, strings))
    suffixes = [s[k:] for s in strings for k in range(len(s))]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert index.matches().tolist() == [max(common(a, b) for j, b in enumerate(suffixes) if j != i) for i, a in enumerate(suffixes)]


@pytest.mark.parametrize("reaches", [2, 8, 377])
def test_only_contexts_that_can_match_are_indexed(monkeypatch, reaches):
    monkeypatch.setattr(run_length_index, "REACHES", reaches, raising=False)
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base, phrase, rows = prose(3000), prose(150), []
    for _ in range(12):  # near copies
        copy = list(base[rng.randrange(300) :])
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = "X"
        rows.append("".join(copy))
    lone = [prose(400) + phrase + prose(400) for _ in range(60)]  # a phrase in common, no window
    rows = [(i, t) for i, t in enumerate(rows + lone)]
    data = np.frombuffer("".join(t for _, t in rows).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t) for _, t in rows)])
    kinds = {}
    for i, anchor, digest, first, last in zip(*(x.tolist() for x in run_length_index.contexts_of(data, offsets)), strict=True):
        kinds.setdefault(anchor, {}).setdefault(digest, []).append((i, first, last + 400))
    gone = {i: bytearray(len(t)) for i, t in rows}
    contexts = []
    for anchor, of in sorted(kinds.items()):
        for places in of.values():
            i, first, end = places[0]
            contexts.append((anchor - (anchor >> 63 << 64), i, first, len(places), rows[i][1][first:end].encode()))
            for i, first, end in places if len(places) > 1 else ():
                gone[i][first:end] = b"\1" * (end - first)
    given = []
    plain = run_length_index.RunLengthIndex
    monkeypatch.setattr(run_length_index, "RunLengthIndex", lambda strings: given.extend(strings) or plain(strings))
    monkeypatch.setattr(run_length_index, "INDEX_BYTES", 40_000)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*contexts, strict=True)], names=["anchor", "id", "first", "c", "context"])
    for out in run_length_index._marked(iter([batch])):
        for i, start, end in zip(*(c.to_pylist() for c in out.columns), strict=True):
            gone[i][start:end] = b"\1" * (end - start)
    wanted = repeats(rows)
    assert {i: (sum(g), len(re.findall(b"\1+", bytes(g)))) for i, g in gone.items()} == {i: w[1:3] for i, w in wanted.items()}
    assert sum(w[1] for i, w in wanted.items() if i < 12) > 20_000 and not any(w[1] for i, w in wanted.items() if i >= 12)
    meeting = [c for c in contexts if c[1] >= 12 and len(kinds[c[0] % (1 << 64)]) > 1]
    assert len(meeting) > 20 and not {c[4] for c in meeting} & set(given)


# ---------------------------------------------------------------- 9

def test_scores_tell_good_from_bad(spark, none):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "slowly", "under", "light"]) + rng.choice(["", "", ","]) for _ in range(60)) + "."
    bad = lambda: " | ".join(rng.choice(["BUY!!", "menu$$$", "click###"]) for _ in range(60))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 400, 2)] + [(1, None)], "doc_id long, quality int")
    rows = pu_quality.featured(docs)
    found = {r["doc_id"]: r["score"] for r in pu_quality.score(rows, pu_quality.fit(rows, labels)).collect()}
    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((found[i] >= 0.3) == (i % 5 != 0) for i in out) / len(out) > 0.9 and all(0 <= s <= 1 for s in found.values())
    model = pu_quality.fit(pu_quality.featured(none), labels.limit(0))
    assert {r["score"] for r in pu_quality.score(rows, model).collect()} == {0.5}


def test_risk_and_its_slope_by_differences():
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    p, u, w = rng.normal(size=(7, 4)), rng.normal(size=(9, 4)), rng.normal(size=4)
    p, counts = p + w, rng.integers(1, 5, 9).astype(float)
    loss = lambda z: math.log(1 + math.exp(-z))

    def plain(w, prior):
        as_positive = sum(loss(x @ w) for x in p) / len(p)
        bracket = sum(c * loss(-(x @ w)) for x, c in zip(u, counts)) / counts.sum() - prior * sum(loss(-(x @ w)) for x in p) / len(p)
        return prior * as_positive, bracket

    many = np.repeat(u, counts.astype(int), axis=0)
    mean = lambda at: pu_quality.Sums(*(x / len(many) for x in pu_quality.unlabelled_sums(many, at)))
    for prior, k in ((0.02, 1.0), (0.97, 1.0), (0.97, 0.3)):
        found, inner, way, curve = pu_quality.risk(w, p, mean(w), prior, k)
        first, bracket = plain(w, prior)
        assert math.isclose(found, first + k * bracket, rel_tol=1e-9, abs_tol=1e-12) and math.isclose(inner, bracket, abs_tol=1e-12)
        step = [[(y - x) / 2e-6 for x, y in zip(plain(w - d, prior), plain(w + d, prior))] for d in np.eye(4) * 1e-6]
        assert np.allclose(way, [a + k * b for a, b in step], atol=1e-6)
        bent = np.stack([(pu_quality.risk(w + d, p, mean(w + d), prior, k)[2] - pu_quality.risk(w - d, p, mean(w - d), prior, k)[2]) / 2e-5 for d in np.eye(4) * 1e-5])
        assert np.allclose(curve, bent, atol=1e-6)
    assert {prior for prior in (0.02, 0.97) if plain(w, prior)[1] < 0} == {0.97}  # both sides of the bend


def test_every_unlabelled_text_counts(spark, docs):
    data = [(t or "").encode() for _, t, *_ in ROWS]
    whole = pu_quality.features(np.frombuffer(b"".join(data), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
    found = pu_quality._summed(pu_quality.featured(docs).select("x"), lambda x: np.append(x.sum(axis=0), (x * x).sum()))
    assert found[-1] == len(ROWS) and np.allclose(found[:-2], whole.sum(axis=0), rtol=1e-5) and np.isclose(found[-2], (whole**2).sum(), rtol=1e-5)


def test_the_fit_is_the_minimum_and_holds_for_a_million_distinct_rows():
    rng = np.random.default_rng(6)
    n, prior = 1_000_000, 0.8
    good = rng.random(n) < prior
    x = rng.normal(size=(n, pu_quality.FEATURES))
    x[:, 3] += np.where(good, 1.5, -1.5)
    x[:, 7] += np.where(good, -1.0, 1.0)
    wide = lambda x: pu_quality._wide(x, np.zeros(pu_quality.FEATURES), np.ones(pu_quality.FEATURES))
    p, parts, calls = wide(x[good][:6_000]), np.array_split(x, 40), []

    def evaluate(w):
        calls.append(w)
        sums = [pu_quality.unlabelled_sums(wide(part), w) for part in parts]
        return pu_quality.Sums(*(sum(s[k] for s in sums) / n for k in range(3)))

    w = pu_quality.learn(p, evaluate, prior)
    score, rank = wide(x) @ w, np.empty(n)
    rank[np.argsort(score)] = np.arange(n)
    auc = (rank[good].mean() - (good.sum() - 1) / 2) / (n - good.sum())
    assert auc > 0.98 and len(calls) <= pu_quality.PASSES and ((score > 0) == good).mean() > 0.93
    assert pu_quality.risk(w, p, evaluate(w), prior)[1] >= 0


def test_scores_are_those_of_a_plain_fit(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["plain", "word.", "line,", "Text"] if i % 4 else ["BUY!!", "$$$", "|", "more"]) for _ in range(rng.randrange(1, 50)))) for i in range(300)] + [(300, None), (301, "w " * 20_000)]
    labels = {i: int(i % 4 > 0) for i in range(0, 300, 3)}
    made = pu_quality.featured(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    found = {r["doc_id"]: r["score"] for r in pu_quality.score(made, pu_quality.fit(made, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"))).collect()}
    inside = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    x = {i: pu_quality.features(np.frombuffer((t or "").encode(), dtype=np.uint8), np.array([0, len((t or "").encode())]))[0].astype(np.float32).astype(float) for i, t in rows}
    u = np.array([x[i] for i in inside])
    mean, scale = u.mean(axis=0), np.maximum(u.std(axis=0), 1e-3)
    prior = np.mean([labels[i] for i in inside if i in labels])
    p = pu_quality._wide(np.array([x[i] for i in inside if labels.get(i) == 1]), mean, scale)
    all_ = pu_quality._wide(u, mean, scale)
    w = pu_quality.learn(p, lambda w: pu_quality.Sums(*(v / len(all_) for v in pu_quality.unlabelled_sums(all_, w))), prior)
    for i, row in x.items():
        assert abs(found[i] - 1 / (1 + np.exp(-np.clip(pu_quality._wide(row[None], mean, scale)[0] @ w, -30, 30)))) < 1e-4


def test_repeated_labels_and_ids_change_nothing(spark):
    rows = [(i, ("plain words, written well. " if i % 3 else "BUY!! $$$ | ") * 9) for i in range(120)] + [(None, "no id"), (None, None)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 120, 2)]
    make = lambda r, l: pu_quality.fit(pu_quality.featured(spark.createDataFrame(r, "doc_id long, text string")), spark.createDataFrame(l, "doc_id long, quality int"))
    once, twice = make(rows, labels), make(rows, labels + labels + [(None, 1)])
    assert once.prior == twice.prior and (once.weights == twice.weights).all()
    assert np.isfinite(make(rows + rows, labels).weights).all()


# ---------------------------------------------------------------- 10

@pytest.mark.parametrize("vocabulary", [1_000, 20])
def test_language_model(docs, none, vocabulary):
    import math
    from collections import Counter

    tokens = {i: [*WORD.findall(lower(t)), None] for i, t, *_ in ROWS}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    single = Counter(w for i, x in tokens.items() if not out[i] for w in x)
    pairs = Counter(p for i, x in tokens.items() if not out[i] for p in zip([0, *x[:-1]], x))
    n, v, texts = sum(single.values()), len(single), sum(not o for o in out.values())
    context = single | Counter({0: texts})
    for r in ngram_trie.score_texts(docs, vocabulary=vocabulary).collect():
        x = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(x), sum(w in single for w in x), n)
        assert math.isclose(r["base_score"], sum(math.log10((single[w] + 1) / (n + v + 1)) for w in x), rel_tol=1e-9)
        chance = lambda w: max(single[w], 1) / (n + 1)
        exact = sum(math.log10((pairs[a, b] + ngram_trie.MU * chance(b)) / (context[a] + ngram_trie.MU)) for a, b in zip([0, *x[:-1]], x))
        assert abs(exact - r["score"]) < 0.03 * len(x)
    assert ngram_trie.score_texts(none).count() == 0


def test_language_model_rows_without_ids_and_repeated_ones(spark):
    rows = [(None, "a b a b"), (None, None), (1, "a b c " * 900), (1, "a b c " * 900), (2, "z" * 50_000), (2, "")]
    for vocabulary in (0, 100):
        given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("kept out"))
        found = ngram_trie.score_texts(given, vocabulary=vocabulary).collect()
        assert sorted(r["n_tokens"] for r in found) == [1, 1, 2, 5, 2701, 2701] and not any(r["held_out"] for r in found if r["doc_id"] is None)
        one, two = (r["score"] for r in found if r["n_tokens"] == 2701)
        assert one == two and all(-60_000 < r["score"] < 0 for r in found)


def test_elias_fano():
    import numpy as np

    from foldlog.llm.elias_fano import EliasFano, Trie, arrays_in, mapped

    rng = np.random.default_rng(4)
    for universe in (1, 50, 10**6, 1 << 40, 1 << 64):
        values = np.sort(rng.integers(0, universe, 700, dtype=np.uint64))
        found = EliasFano.read(arrays_in(mapped(EliasFano.of(values, universe).arrays())))
        assert (found.get(np.arange(700)) == values).all()
        asked = rng.integers(0, universe, 500, dtype=np.uint64)
        at, equal = found.successor(np.concatenate([asked, values[::7]]))
        both = np.concatenate([asked, values[::7]])
        assert (at == np.searchsorted(values, both)).all() and (equal == np.isin(both, values)).all()
    pairs = {(int(a), int(b)): float(a % 7) for a, b in rng.integers(0, 90, (2_000, 2))}
    keys = np.array(sorted(pairs), dtype=np.uint64)
    for some in (len(keys), 0):
        built = Trie.build(keys[:some, 0], keys[:some, 1].astype(np.int64), np.array([pairs[tuple(k)] for k in keys[:some].tolist()]))
        for trie in (Trie(built), Trie(bytes(built))):
            hit, value = trie.find(np.arange(95, dtype=np.uint64), np.full(95, 95), np.tile(np.arange(95), 95))
            grid = [(a, b) for a in range(95) for b in range(95)]
            assert hit.tolist() == [bool(some) and g in pairs for g in grid]
            assert all(abs(v - pairs[g]) <= 6 / 255 for v, g in zip(value.tolist(), grid, strict=True) if some and g in pairs)


# ---------------------------------------------------------------- columns of any name

def test_columns_with_clashing_names_are_kept(spark, none):
    path, pattern = byte_bpe.public_vocabulary()
    given = spark.createDataFrame([(1, "a plain text"), (None, None)], "doc_id long, text string")
    for name in ("row", "__text", "__ids", "__whole", "whole", "given", "kept", "n_tokens", "n_words"):
        given = given.withColumn(name, F.lit(7))
    for found, own in ((quality_rules.clean(given), {*quality_rules.OUT.fieldNames(), "kept", "base_failed"}), (byte_bpe.round_trip(given, path, pattern), {"n_tokens"})):
        first = found.where("doc_id = 1").first()
        assert all(first[c] == 7 for c in given.columns[2:] if c not in own) and found.count() == 2
    assert quality_rules.stage(spark, given, "").columns == given.columns
    assert byte_bpe.stage(spark, given, "").where("doc_id = 1").first()["exact"] and byte_bpe.stage(spark, none, "").count() == 0


# ---------------------------------------------------------------- all together

def test_the_pipeline_agrees_with_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, a, b, c) for i, t, a, b, c in ROWS if t]
    item = " ".join(f"leak{k}" for k in range(20))
    long = ". ".join(" ".join(f"v{(7 * i + k) % 90}x{i}" for k in range(8)) for i in range(12)) + "."
    rows += [(500, long, "en", "s", 1), (501, long + " More " + item + ".", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    kept = {}
    for i, t, *_ in rows:
        words = WORD.findall(t)
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
        text, chars = quality_rules.judge(t)[5], quality_rules.judge(t)[4]
        if len(words) >= 20 and 100 * len(covered) <= 30 * len(words) and 2 * chars <= sum(map(len, words)):
            kept[i] = text
    left = {i: t for i, t in deduplicated(list(kept.items()), line_dedup.RARE).items() if WORD.search(t)}
    named = links([(i, t) for i, t in left.items()])
    left = {i: t for i, t in left.items() if named[i][1] == i and "leak0" not in t}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()} != {} and set(found) == set(left)
    assert all(r["exact"] for r in found.values()) and all(found[i]["text"] == t for i, t in left.items())


def test_all_are_registered():
    assert [k.split("_")[0] for k in registry.queries()] == [f"op{n}" for n in range(1, 11)] + ["pipeline"]
    assert set(registry.oracle_sql()) <= set(registry.queries())
