"""Operator 2: personal data spans, in DataFrame functions only.

Regular expressions propose spans, checksum validators (Luhn, mod-97) confirm them, and context
words near a proposal raise its score: up to CONTEXT_CHARS characters before it and BEHIND_CHARS
behind it, whatever other proposals stand there. Four base kinds (email, ip, card, phone) are
kept whenever their own validator passes; further kinds are kept from a score of THRESHOLD on.

Offsets without a Python UDF: splitting a text by a pattern gives the stretches between the
matches, extracting gives the matches, and running sums of their lengths are the offsets. Every
pattern is possessive or anchored at the start of its run, so that matching a text of any length
takes linear time and no stack.

Defined cases: a null or empty text has no spans. Null doc_ids and repeated rows are kept as
they are, one result row per input row. An empty table gives no rows. Columns of the input other
than the text are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.6
CONTEXT_CHARS = 40
BEHIND_CHARS = 20
BLOCK = 256
SPAN = "struct<kind:string,start:int,end:int,score:double>"


@dataclass(frozen=True)
class Detector:
    """kind; cheap test that skips most texts; pattern; validator (a function of the match's column);
    score of a confirmed proposal; words nearby that raise it and by how much."""

    kind: str
    hint: str
    pattern: str
    valid: object
    score: float = 1.0
    context: str = ""
    bonus: float = 0.0


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def luhn(m: Column, least: int, most: int) -> Column:
    d = digits(m)
    return F.length(d).between(least, most) & F.call_function("luhn_check", d)


def mod97(m: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count from 10; the remainder is 1."""
    s = F.regexp_replace(m, "\\x20", "")
    moved = F.concat(F.substring(s, 5, 1000), F.substring(s, 1, 4))
    code = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    step = lambda a, c: F.when(c >= "A", (a * 100 + code(c)) % 97).otherwise((a * 10 + code(c)) % 97)
    return F.length(s).between(15, 34) & (F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1)


IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
NATIONAL_ID = "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
DETECTORS = (
    Detector("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True)),
    Detector("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    Detector("card", r"[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", lambda m: luhn(m, 16, 19)),
    Detector("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(8, 15)),
    Detector("iban", r"[A-Z]{2}[0-9]{2}", IBAN, mod97, 0.8, "iban|account|konto|cuenta|compte", 0.2),
    Detector("short_card", r"[0-9][ -]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++", lambda m: luhn(m, 13, 15), 0.4, "card|visa|amex|karte|tarjeta|carte", 0.5),
    Detector("national_id", r"[0-9]-[0-9]{2}-[0-9]", r"[0-9]++(?:-[0-9]++)++", lambda m: m.rlike(NATIONAL_ID) & ~m.rlike("^(?:000|666|9..)|-00-|-0000$"), 0.4, "ssn|social security|tax id|national id", 0.5),
)
BASE_KINDS = tuple(d.kind for d in DETECTORS[:4])


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable isn't expanded by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(lengths: Column) -> Column:
    """Sums of the entries before each entry, and the total last; copies the array at every step."""
    return F.aggregate(
        lengths,
        F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("all")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"] + n)).alias("all")),
        lambda a: a["all"],
    )


def _running(lengths: Column) -> Column:
    """_sums by blocks of BLOCK entries, so that a text with very many matches stays cheap."""

    def summed(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, joined)

    def joined(blocks: Column) -> Column:
        bases = _sums(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)))
        return _let(bases, lambda base: F.concat(F.flatten(F.zip_with(blocks, F.slice(base, 1, F.size(blocks)), lambda x, at: F.transform(F.slice(_sums(x), 1, F.size(x)), lambda n: n + at))), F.slice(base, -1, 1)))

    return _let(lengths, lambda x: F.when(F.size(x) <= BLOCK, _sums(x)).otherwise(summed(x)))


def proposals(text: Column, d: Detector) -> Column:
    """Confirmed spans of one kind, in order: array of SPAN."""
    parts = F.struct(F.split(text, d.pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(d.pattern), F.lit(0)).alias("hit"))

    def located(p: Column) -> Column:
        gaps = _running(F.transform(p["gap"], F.length))
        hits = _running(F.transform(p["hit"], F.length))
        start = F.zip_with(F.slice(gaps, 2, F.size(p["hit"])), F.slice(hits, 1, F.size(p["hit"])), lambda g, h: g + h)
        # a window has one character more at its far end, which tells whether a word is cut there
        word = rf"\b(?:{d.context})\b"
        before = lambda s: F.substring(F.concat(F.lit(" "), text), F.greatest(s - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s, F.lit(CONTEXT_CHARS)) + 1)
        behind = lambda e: F.concat(F.substring(text, e + 1, F.lit(BEHIND_CHARS + 1)), F.when(F.length(text) - e <= BEHIND_CHARS, " ").otherwise(""))
        near = lambda s, e: F.when(F.lower(before(s)).rlike(f"(?!^){word}") | F.lower(behind(e)).rlike(rf"{word}(?!\z)"), d.bonus).otherwise(0.0)
        score = lambda h, s: (F.lit(d.score) + near(s, s + F.length(h))) if d.context else F.lit(d.score)
        scored = lambda h, s: F.when(d.valid(h), score(h, s)).otherwise(0.0)
        spans = F.zip_with(p["hit"], start, lambda h, s: F.struct(F.lit(d.kind).alias("kind"), s.alias("start"), (s + F.length(h)).alias("end"), scored(h, s).alias("score")))
        return F.filter(spans, lambda x: x["score"] >= THRESHOLD)

    none = F.array().cast(f"array<{SPAN}>")
    found = _let(parts, lambda p: F.when(F.size(p["hit"]) > 0, located(p)).otherwise(none))
    hint = text.contains(d.hint) if d.hint == "@" else text.rlike(d.hint)
    return F.when(text.isNotNull() & hint, found).otherwise(none)


def spans(text: Column) -> Column:
    """All spans of a text by kind as listed in DETECTORS, then start."""
    return F.concat(*(proposals(text, d) for d in DETECTORS))


def _written(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and pii (array of SPAN) of each row."""
    return docs.select("doc_id", spans(F.col("text")).alias("pii"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find()'s spans."""
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("pii")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each span in the text replaced by its kind in brackets, e.g. [email]; overlapping spans give one replacement.

    A null text stays null; a text without spans stays as it is; other columns are untouched.
    """
    whole = F.col(text)
    found = F.array_sort(F.transform(spans(whole), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    step = lambda a, x: F.when(
        x["start"] >= a["at"],
        F.struct(x["end"].alias("at"), F.concat(a["out"], F.array(F.substring(whole, a["at"] + 1, x["start"] - a["at"]), F.concat(F.lit("["), x["kind"], F.lit("]")))).alias("out")),
    ).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out")))
    rest = lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(whole, a["at"] + 1, F.length(whole)))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return docs.withColumn(text, _let(found, lambda s: F.when(F.size(s) > 0, F.aggregate(s, start, step, rest)).otherwise(whole)))
