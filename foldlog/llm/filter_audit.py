"""How filters interact: what each removes at each place of each order, from one CUBE over their failure flags.

``audit`` takes a table with a boolean column for each filter (true: the row fails it), a part, and marks to be counted among the
lost rows. Rows are counted by flags and part, and a SQL CUBE over these counts has a row for each subset of the flags and each
combination of their values; those where all selected flags are false are the survivors of the subset. A step of an order leads from the subset
of the filters before it to the same with its own, so two rows of survivors, joined, tell what it removes. The table is read once, whatever the
number of orders; counts are merged before they travel, so neither a hot part nor a hot flag is in one place.

``flags`` judges texts by five rules: A under MIN_WORDS words (``[^\\x20\\x09-\\x0D]+``, case-sensitive); B fewer distinct words than half;
C more than 2 % of the code points in A-Z; D any of ``#$%&*|``; E the same text as a document of smaller id, anywhere in the table. For E, the least id of
each text is found by a grouped minimum and met again by id and text together, so copies of one text never meet in one task.

Defined cases: a null text is empty: it fails A only (and E, if it is not the first). A null part is the empty string and one with it. A
row without an id is no one's smaller document and passes E; it has no label. Rows of one id and text are no copies of each
other. Labels: null is neither good nor toxic; of repeated ones any that says so counts. A null flag passes. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldlog.llm import kit

MIN_WORDS = 200
FILTERS = ("A", "B", "C", "D", "E")
_WHITE = "[ \\t\\n\\u000B\\f\\r]+"
_COUNTS = ("n", "good", "toxic")


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part and A to E for each row of docs (doc_id, text, source)."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, _WHITE), "")
    read = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), *kit.digests(text), text.alias("text"), words.alias("words"))
    length = F.length("text")
    judged = read.select(
        "doc_id", "part", "h1", "h2", (F.size("words") < MIN_WORDS).alias("A"), (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("B"),
        (100 * (length - F.length(F.regexp_replace("text", "[A-Z]", ""))).cast("long") > 2 * length.cast("long")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    judged = kit.Scratch(docs.sparkSession, "filter-audit").cut(judged, "judged")
    first = judged.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    return judged.join(first, ["doc_id", "h1", "h2"], "left").select("doc_id", "part", "A", "B", "C", "D", (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with booleans good and toxic by doc_id."""
    own = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    return rows.join(own, "doc_id", "left")


def survivors(rows: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """part, mask (the bits of a subset of the filters) and how many rows fail none of these: n, good, toxic; zeros included."""
    passing = [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in filters]
    one = lambda name: F.coalesce(F.col(name), F.lit(False)).cast("long")
    counts = rows.groupBy("part", *passing).agg(F.count("*").alias("n"), F.sum(one("good")).alias("good"), F.sum(one("toxic")).alias("toxic"))
    chosen = sum(((1 - F.grouping(f).cast("int")) * (1 << k) for k, f in enumerate(filters)), F.lit(0))
    cube = counts.cube("part", *filters).agg(chosen.alias("mask"), F.grouping("part").alias("all_parts"), *(F.sum(c).alias(c) for c in _COUNTS))
    alive = cube.where((F.col("all_parts") == 0) & reduce(and_, (~F.coalesce(F.col(f), F.lit(False)) for f in filters))).select("part", "mask", *_COUNTS)
    grid = alive.where("mask = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("mask"))
    return grid.join(alive, ["part", "mask"], "left").fillna(0, list(_COUNTS))


def orders(spark, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """Every step of every order: filter_order, step, filter, and the masks that it lies between."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    full = sum(bit.values())
    rows = [("".join(o), k + 1, o[k], sum(bit[f] for f in o[:k]), sum(bit[f] for f in o[: k + 1]), bit[o[k]], full - bit[o[k]], full) for o in permutations(filters) for k in range(len(o))]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int, own int, others int, full int")


def audit(rows: DataFrame, filters: tuple[str, ...] = FILTERS) -> DataFrame:
    """A row for each part, order and step. rows: part, a boolean a filter, booleans good and toxic."""
    spark = rows.sparkSession
    alive = kit.Scratch(spark, "filter-audit").cut(survivors(rows, filters), "survivors")

    def at(mask: str, prefix: str) -> DataFrame:
        return alive.select("part", F.col("mask").alias(mask), *(F.col(c).alias(f"{prefix}_{c}") for c in _COUNTS))

    own = at("own", "own").select("part", "own", "own_n")
    others, full, whole = (at(m, m).select("part", m, f"{m}_n") for m in ("others", "full", "whole"))
    steps = at("before", "before").join(F.broadcast(orders(spark, filters)), "before").join(at("after", "after"), ["part", "after"])
    steps = steps.join(own, ["part", "own"]).join(others, ["part", "others"]).join(full, ["part", "full"]).join(whole.where("whole = 0"), "part")
    lost = lambda c: F.col(f"before_{c}") - F.col(f"after_{c}")
    steps = steps.select(
        "part", "filter_order", "step", "filter", F.col("after_n").alias("kept"), lost("n").alias("removed"), (F.col("whole_n") - F.col("own_n") - lost("n")).alias("redundant"),
        (F.col("others_n") - F.col("full_n")).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    shares = steps.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return steps.join(shares, ["part", "filter"])


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = audit(labelled(flags(docs.select("doc_id", "text", "source")), labels.select("doc_id", "quality", "toxic")))
    return found.select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


_PASSES = " AND ".join(f"NOT (contains(substr(filter_order, 1, {{k}}), '{f}') AND {f})" for f in FILTERS)
ORACLE = f"""
    WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    firsts AS (SELECT body, min(doc_id) AS least FROM texts GROUP BY body),
    marked AS (
      SELECT t.doc_id, part, len(w) < {MIN_WORDS} AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * len(regexp_extract_all(body, '[A-Z]')) > 2 * length(body) AS C,
        regexp_matches(body, '[#$%&*|]') AS D, coalesce(t.doc_id > least, false) AS E, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
      FROM texts t JOIN firsts USING (body) LEFT JOIN labels l ON l.doc_id = t.doc_id),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    perms AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    steps AS (SELECT filter_order, k::INT AS step, substr(filter_order, k, 1) AS filter FROM perms, (SELECT unnest(generate_series(1, 5)) AS k)),
    kinds AS (SELECT part, A, B, C, D, E, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY ALL),
    judged AS (
      SELECT *, ({_PASSES.format(k="step - 1")}) AS arrives, CASE filter WHEN 'A' THEN A WHEN 'B' THEN B WHEN 'C' THEN C WHEN 'D' THEN D ELSE E END AS fails,
        A::INT + B::INT + C::INT + D::INT + E::INT AS failures FROM kinds, steps),
    summed AS (
      SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (arrives AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (arrives AND fails), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (NOT arrives AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND failures = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (arrives AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (arrives AND fails), 0)::BIGINT AS toxic_lost
      FROM judged GROUP BY ALL)
    SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM summed"""
