"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. A pattern cuts the text in the pieces between its matches (``split``) and lists the
matches (``regexp_extract_all``); the lengths of both, summed up, give code-point offsets. Patterns are possessive
and start only where a run of their first class starts or where the last match ended, which finds the same leftmost
matches in time linear in the text and with a flat stack, however long a run is.

Kinds: the base kinds ``email ip card phone`` are kept whenever their own test holds (parts at most 255, Luhn over
16 to 19 digits, 8 to 15 digits); a match that fails is dropped without a retry inside it. ``iban`` needs mod-97 and
15 to 34 characters. Four kinds have no checksum, and their scores reach the threshold only with a context word in
English, German, French or Spanish nearby: ``ssn`` (3-2-4 digits), ``birth`` (a calendar date), ``passport`` (letters
and digits) and ``secret`` (24 characters or more without a gap, with letters and digits among them).
Score: what the kind's confirmation is worth, plus ``CONTEXT_GAIN`` if a context word stands within
``CONTEXT_CHARS`` characters, no further than the next match of that kind.

Defined cases: a null or empty text has no spans; spans of different kinds may overlap; ties cannot occur within a
kind; repeated rows are scored alike; further columns are kept, but those named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldlog.llm import kit

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "birth", "passport", "secret")
_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
CONTEXT_CHARS, CONTEXT_GAIN, THRESHOLD = 40, 0.3, 0.5
_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]))"
#: How long an IBAN is, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20,
    "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}
_IBANS = "|".join(
    rf"(?:{'|'.join(c for c in IBAN_LENGTHS if IBAN_LENGTHS[c] == n)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n in sorted(set(IBAN_LENGTHS.values()))
)
#: kind: what a text must hold to be searched, pattern, context words, score without context
RULES: dict[str, tuple[str, str, str, float]] = {
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "mail|contact|write|reply|kontakt|schreib|courriel|correo|escrib", 0.7),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "address|host|server|login|client|adress|servidor|serveur|cliente", 0.6),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", "card|visa|master|credit|payment|amex|karte|zahlung|carte|paiement|tarjeta|pago", 0.65),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "phone|call|tel|mobile|fax|whatsapp|handy|anruf|appel|portable|llam|móvil", 0.6),
    "iban": (r"[A-Z]{2}[0-9]{2}", rf"(?<![A-Za-z0-9])(?:{_IBANS})(?![A-Za-z0-9])", "iban|account|bank|transfer|konto|compte|virement|cuenta|banco", 0.65),
    "ssn": (r"[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "ssn|social|security|tax|steuer|sozial|sécurité|fiscal|seguridad", 0.3),
    "birth": (
        r"[0-9][./-][0-9]", rf"(?<![0-9./-])(?:{_DAY}[./]{_MONTH}[./]{_YEAR}|{_YEAR}-{_MONTH}-{_DAY})(?![0-9./-]*[0-9])",
        "born|birth|dob|geboren|geburt|née|né le|naissance|nacid|nacimiento", 0.3,
    ),
    "passport": (r"[A-Z][0-9]{6}", r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,8}(?![A-Za-z0-9])", "passport|reisepass|ausweis|passeport|pasaporte", 0.3),
    "secret": (r"[A-Za-z0-9_-]{24}", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+", "token|secret|api.?key|password|passwort|kennwort|mot de passe|contraseña|clave", 0.3),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    worth = lambda i: F.when((n - i) % 2 == 0, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"\A{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}\z")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        return let(F.regexp_replace(found, " ", ""), mod97)
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    return F.lit(True)


def _starts(pieces: Column, found: Column) -> Column:
    """Where each match starts. Sums are taken in blocks, so that a text with very many matches stays cheap."""
    block = 128
    lengths = F.zip_with(pieces, found, lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("long"))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    firsts = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: add(F.slice(xs, b * block + 1, block)))
    return let(
        lengths,
        lambda xs: let(
            firsts(xs),
            lambda sums: let(
                F.transform(F.sequence(F.lit(1), F.size(sums)), lambda b: add(F.slice(sums, F.lit(1), b - 1))),
                lambda bases: F.transform(
                    found,
                    lambda _m, i: F.element_at(bases, F.floor(i / block).cast("int") + 1) + add(F.slice(xs, F.floor(i / block).cast("int") * block + 1, i % block)) + F.length(F.get(pieces, i)),
                ),
            ),
        ),
    )


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _spans_of(kind: str, text: Column) -> Column:
    needs, pattern, context, worth = RULES[kind]
    near = rf"(?iu)(?:{context})"

    def with_pieces(both: Column) -> Column:
        pieces, found = both["pieces"], both["found"]

        def span(m: Column, i: Column, start: Column) -> Column:
            close = F.concat(F.right(F.get(pieces, i), F.lit(CONTEXT_CHARS)), F.lit("\n"), F.left(F.get(pieces, i + 1), F.lit(CONTEXT_CHARS)))
            score = F.lit(worth) + F.when(close.rlike(near), CONTEXT_GAIN).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), F.round(score, 2).alias("score"), confirmed(kind, m).alias("ok"))

        made = let(_starts(pieces, found), lambda starts: F.transform(found, lambda m, i: span(m, i, F.get(starts, i))))
        kept = F.filter(made, lambda s: s["ok"] & (F.lit(kind in BASE) | (s["score"] >= THRESHOLD)))
        return F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    there = text.contains(needs) if needs == "@" else text.rlike(needs)
    return F.when(there, let(both, lambda b: F.when(F.size(b["found"]) > 0, with_pieces(b)))).cast(_SPAN)


def find(df: DataFrame, text_col: str = "text", out: str = "pii", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """df with an array ``out`` of (kind, start, end, score): by kind as listed, then by start; end is exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [kit.unused(f"__{out}_{k}", df) for k in kinds]
    parts = df.withColumns({n: F.coalesce(_spans_of(k, text), F.array().cast(_SPAN)) for n, k in zip(names, kinds, strict=True)})
    return parts.withColumn(out, F.concat(*names)).drop(*names)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(_listed(F.filter("pii", lambda s: s["kind"].isin(*BASE))).cast("binary"), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
