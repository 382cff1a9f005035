"""Line-first cleaning: rules judge each line, failed lines go, and a text that loses too much is rejected.

A line with a word (``[^\\x20\\x09-\\x0D]+``) fails as
- navigation, if of its words one in five at least is a separator (one of SEPARATORS);
- links, if more than half of its words are web addresses;
- numbers, if each of its words is a number, date or time;
- symbols, if it has as many of ``#*$%&|<>`` as half its words, at least two;
- shouting, if it has a doubled ``!!`` or ``??`` for every third word at least;
- punctuation, if it has 12 words or more and none of ``. ! ? … 。 :`` anywhere;
- boilerplate, if one of the phrases of BOILERPLATE (English, German, French, Spanish) stands in it, whatever the case.
A text is kept if it has 20 words at least, repeated 8-word windows cover at most 30 % of its words, and the lines
removed hold at most half of its words' characters.

Defined cases: a null or empty text has no words and is not kept; its cleaned text is empty. Lines without a word are
left as they are. Repeated rows get the same verdict. Other columns are kept; those named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog.llm import kit

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?…。:"
#: Words that part the entries of a menu or a path.
SEPARATORS = ("|", "»", "›", "·", "•", "/", ">")
#: Phrases that mark boilerplate lines.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "sign up for", "subscribe to our",
    "enable javascript", "accept cookies", "powered by", "back to top", "share this page", "lorem ipsum",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "newsletter abonnieren", "nach oben", "cookies akzeptieren",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "cliquez ici", "haut de page", "accepter les cookies",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "haga clic aquí", "volver arriba", "aceptar cookies",
)
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 20, 30, 50
#: Letters beyond ASCII stand with their capitals, so that either engine's folding finds the same.
_PHRASES = "|".join("".join(c if c < "\x80" else f"[{c}{c.upper()}]" for c in p) for p in BOILERPLATE)
_PHRASE = re.compile(_PHRASES, re.IGNORECASE | re.ASCII)
_BARS = tuple(s.encode() for s in SEPARATORS)
_LINK = (b"http://", b"https://", b"www.")
_NUMBER = re.compile(rb"[0-9][0-9.,:/-]*")

OUT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars")] + [T.StructField("cleaned", T.StringType())])


def line_fails(line: str, words: list[bytes]) -> bool:
    n = len(words)
    bars = sum(map(words.count, _BARS))
    if bars and 5 * bars >= n:
        return True
    if 2 * sum(w.startswith(_LINK) for w in words) > n:
        return True
    if _NUMBER.fullmatch(words[0]) and all(map(_NUMBER.fullmatch, words)):
        return True
    symbols = sum(map(line.count, SYMBOLS))
    if symbols >= 2 and 2 * symbols >= n:
        return True
    loud = line.count("!!") + line.count("??")
    if loud and 3 * loud >= n:
        return True
    if n >= 12 and not any(c in line for c in ENDS):
        return True
    return _PHRASE.search(line) is not None


def _chars(words: list[bytes]) -> int:
    return len(b"".join(words).decode())


def judge(text: str) -> tuple[int, int, int, int, int, str]:
    """word_chars, dup lines, lines, failed lines, characters lost and the cleaned text."""
    seen: set[str] = set()
    kept, dup, n_lines, failed, lost = [], 0, 0, 0, 0
    for line in text.split("\n"):
        words = line.encode().split()
        if not words:
            kept.append(line)
            continue
        n_lines += 1
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_fails(line, words):
            failed += 1
            lost += _chars(words)
        else:
            kept.append(line)
    word_chars = len(text) - sum(map(text.count, WHITE))
    return word_chars, dup, n_lines, failed, lost, "\n".join(kept) if failed else text


def repeat_words(words: kit.Words, size: int = 8) -> np.ndarray:
    """For each row, its words that lie in a window of ``size`` words found twice or more in the row."""
    found, at = kit.windows(words, size)
    n = len(words.bounds) - 1
    covered = np.zeros(len(words.starts) + 1, dtype=np.int64)
    where = np.searchsorted(at, words.bounds)
    for r in range(n):
        lo, hi = where[r], where[r + 1]
        if hi - lo < 2:
            continue
        own = found[lo:hi]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(hi - lo, dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            first = at[lo:hi][twice]
            np.add.at(covered, first, 1)
            np.add.at(covered, first + size, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return np.add.reduceat(np.append(inside, False).astype(np.int64), np.minimum(words.bounds[:-1], len(inside))) * (np.diff(words.bounds) > 0) if n else np.zeros(0, dtype=np.int64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = OUT.fieldNames()
    for batch in batches:
        for lo, hi, data, offsets in kit.text_steps(batch, 1):
            words = kit.Words(data, offsets, lower=False)
            repeats = repeat_words(words)
            counts = np.diff(words.bounds)
            texts = batch.column(1)[lo:hi].to_pylist()
            rows = []
            for text, n, again in zip(texts, counts.tolist(), repeats.tolist(), strict=True):
                text = text or ""
                word_chars, dup, n_lines, failed, lost, cleaned = judge(text)
                rows.append((n, word_chars, sum(map(text.count, SYMBOLS)), dup, again, n_lines, failed, lost, cleaned))
            own = [pa.array([r[i] for r in rows], type=pa.string() if name == "cleaned" else pa.int64()) for i, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *own], names=["row", *names])


def clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the counts of OUT, ``cleaned``, ``base_failed`` and ``kept``."""
    rest = [c for c in df.columns if c not in {*OUT.fieldNames(), "base_failed", "kept"}]
    given = df.select(kit.packed(df, rest), F.col(text_col).alias("text"))
    found = given.transform(kit.through, _measure, T.StructType([given.schema["row"], *OUT.fields])).select(*kit.unpacked(rest), *OUT.fieldNames())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are kept, with their failed lines gone. n_chars follows, if there."""
    found = clean(docs.select(kit.packed(docs, [c for c in docs.columns if c != "text"]).alias("whole"), "text")).where("kept")
    return kit.with_text(found, docs, F.col("cleaned"))


_LINE = "regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')"
_BARS_SQL = ", ".join(f"'{s}'" for s in SEPARATORS)
_PHRASES_SQL = _PHRASES.replace("'", "''")
_ANY = "[#*$%&|<>]"


def lines_sql(docs: str) -> str:
    """DuckDB: a CTE list that ends with ``judged``: a row for each document of the table or view ``docs``."""
    return f"""
    texts AS (SELECT doc_id, coalesce(text, '') AS body FROM {docs}),
    tokens AS (SELECT doc_id, body, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
    grams AS (
      SELECT doc_id, i, hash(list_slice(w, i, i + 7)) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM tokens WHERE len(w) >= 8)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
    again AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(generate_series(0, 7)) AS j) GROUP BY doc_id),
    lines AS (SELECT doc_id, n, line FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM texts)),
    worded AS (SELECT doc_id, n, line, {_LINE} AS w, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) AS k FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
    marked AS (
      SELECT doc_id, n, line, k, length(array_to_string(w, '')) AS chars, (
          (len(list_filter(w, lambda x: x IN ({_BARS_SQL}))) > 0 AND 5 * len(list_filter(w, lambda x: x IN ({_BARS_SQL}))) >= len(w))
          OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '^(https?://|www\\.)'))) > len(w)
          OR len(list_filter(w, lambda x: NOT regexp_full_match(x, '[0-9][0-9.,:/-]*'))) = 0
          OR (len(regexp_extract_all(line, '{_ANY}')) >= 2 AND 2 * len(regexp_extract_all(line, '{_ANY}')) >= len(w))
          OR (len(regexp_extract_all(line, '!!')) + len(regexp_extract_all(line, '\\?\\?')) > 0
              AND 3 * (len(regexp_extract_all(line, '!!')) + len(regexp_extract_all(line, '\\?\\?'))) >= len(w))
          OR (len(w) >= 12 AND NOT regexp_matches(line, '[.!?…。:]'))
          OR regexp_matches(line, '(?i){_PHRASES_SQL}')) AS fails
      FROM worded),
    by_doc AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (fails) AS n_failed_lines, count(*) FILTER (k > 1) AS n_dup_lines, coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS lost_chars FROM marked GROUP BY doc_id),
    measured AS (
      SELECT t.doc_id, body, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(body, '{_ANY}'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines,
        coalesce(lost_chars, 0)::BIGINT AS lost_chars
      FROM tokens t LEFT JOIN by_doc b ON t.doc_id = b.doc_id LEFT JOIN again a ON t.doc_id = a.doc_id),
    judged AS (
      SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept FROM measured)
    """


ORACLE = f"WITH {lines_sql('documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_failed_lines, lost_chars FROM judged"
