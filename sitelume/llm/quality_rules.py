"""Operator 7: quality rules by line-first cleaning, in DataFrame functions only.

Each line that has words is judged on its own, and fails as

    punctuation   too many symbol characters; an ellipsis at its end; a list entry (a bullet before it)
                  or a fragment of a few words without punctuation at its end
    navigation    cells or menu entries divided by bars
    boilerplate   a short line that says a phrase of licence, cookie and rights notices or a call to
                  action, in English, German, French or Spanish

Failing lines are removed, and a document that loses too large a share of its text is rejected. The
base rules (too few words, too many repeated word windows) reject first.

All of it is computed within the row, so nothing is shuffled and no group can be hot. Lines are
searched for symbols or bars only where the text has any, and for phrases only if short. Windows of
three words are compared by their 64-bit hash together with sorting; a document without any equal
pair of windows never gets to the sort.

Defined cases: a null text has no words and no lines, and is rejected; an empty one likewise. Null
doc_ids and repeated rows stay, one result row per input row. An empty table gives no rows. Other
columns are not touched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
WINDOW = 3
PLACE_BITS = 24
PLACES = 1 << PLACE_BITS  # a longer text's windows are all sorted by their whole hash
MOST_REMOVED = 0.3  # share of a text's non-space characters
MOST_SYMBOLS = 0.1  # of a line's non-space characters
SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BARS = "|»›•"
ENDS = ".!?:;…\"'”’»)]。！？"  # a line that ends so is a sentence's or a clause's end
ELLIPSES = ("...", "…")
BULLET = r"^(?:[•‣▪◦*+–-]|[0-9]{1,3}[.)])[\x20\t]"
MOST_FRAGMENT_WORDS = 6  # longer lines may be prose that is wrapped
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MOST_BOILERPLATE_CHARS = 120  # longer lines are prose that mentions such words
#: Lower-case phrases; none is part of a longer word.
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "licensed under", "released under", "subscribe to our", "sign up for", "log in to", "click here", "share this", "share on", "read more",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookie-richtlinie", "lizenziert unter", "newsletter abonnieren", "jetzt anmelden", "hier klicken", "weiterlesen", "mehr erfahren",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "sous licence", "abonnez-vous", "cliquez ici", "lire la suite", "en savoir plus",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "bajo la licencia", "suscríbete", "haga clic aquí", "leer más",
)


def _phrases() -> str:
    """One pattern for PHRASES, by first letters: a search tries a few branches a word, not all phrases."""
    by_first: dict[str, list[str]] = {}
    for p in PHRASES:
        by_first.setdefault(p[0], []).append(p[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"


BOILERPLATE = _phrases()


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text that isn't null."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def repeated_words(words: Column) -> Column:
    """Words within windows of three that the text has more than once."""
    n = F.size(words)
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW)))), F.lit(1), n - WINDOW + 1)

    def counted(h: Column) -> Column:
        # hashes without their low bits, in which their places stand: plain numbers, so that the sort is cheap
        packed = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-PLACES).cast("long")).bitwiseOR(i.cast("long")))
        high = lambda s, i: F.shiftright(F.get(s, i), PLACE_BITS)

        def alike(s: Column) -> Column:
            twice = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: high(s, i - 1) == high(s, i))
            both = F.flatten(F.transform(twice, lambda i: F.array(F.get(s, i - 1), F.get(s, i))))
            return F.array_distinct(F.transform(both, lambda x: x.bitwiseAND(F.lit(PLACES - 1).cast("long")).cast("int")))

        some_of = _let(F.sort_array(packed), alike)
        every = F.sequence(F.lit(0), F.size(h) - 1)
        places = F.when(F.size(h) < PLACES, some_of).otherwise(every)
        placed = F.sort_array(F.transform(places, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i"))))  # the few of them, by their whole hash

        def starts(s: Column) -> Column:
            same = lambda x, i: (i > 0) & (F.get(s, i - 1)["h"] == x["h"]) | (i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        covered = lambda p: F.aggregate(
            p,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
            lambda a: a["n"],
        )
        return _let(placed, lambda s: covered(starts(s)))

    some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), counted(h)).otherwise(0))
    return F.when(n > WINDOW, some).otherwise(0)


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))


def contains_any(text: Column, characters: str) -> Column:
    out = F.lit(False)
    for c in characters:
        out = out | F.contains(text, F.lit(c))
    return out


def says_phrase(lowered: Column) -> Column:
    return lowered.rlike(rf"(?<![\pL\pN_]){BOILERPLATE}(?![\pL\pN_])")


def fails(line: Column, text: Column) -> Column:
    """Whether a line breaks a rule. text: struct of symbols and bars, whether the whole text has any."""

    def of(bare: Column) -> Column:
        ended = F.contains(F.lit(ENDS), F.right(bare, F.lit(1)))
        fragment = bare.rlike(BULLET) | (F.size(F.split(bare, SPACE)) <= MOST_FRAGMENT_WORDS)
        torn = F.endswith(bare, F.lit(ELLIPSES[0])) | F.endswith(bare, F.lit(ELLIPSES[1])) | (~ended & fragment)
        symbolic = text["symbols"] & (symbols(bare) > MOST_SYMBOLS * letters(bare))
        navigation = text["bars"] & (F.size(F.split(bare, f"[{BARS}]")) > 3)
        boilerplate = (F.length(bare) <= MOST_BOILERPLATE_CHARS) & says_phrase(F.lower(bare))
        return (bare != "") & (torn | symbolic | navigation | boilerplate)

    return _let(F.btrim(line, F.lit(BLANKS)), of)


def verdict(text: Column) -> Column:
    """Struct of the base figures, clean (the text without failing lines), kept and base_failed, computed once."""

    def figures(x: Column) -> Column:
        lines = x["lines"]
        chars = F.length(F.array_join(x["words"], ""))
        full = F.filter(lines, lambda l: F.btrim(l, F.lit(BLANKS)) != "")
        repeated = F.when(F.size(F.array_distinct(lines)) < F.size(lines), _let(full, lambda f: F.size(f) - F.size(F.array_distinct(f)))).otherwise(0)
        failing = F.filter(lines, lambda l: fails(l, x))
        clean = F.filter(lines, lambda l: ~fails(l, x))
        lost = _let(failing, lambda f: F.when(F.size(f) > 0, F.struct(letters(F.array_join(f, "\n")).alias("n"), F.array_join(clean, "\n").alias("clean"))).otherwise(F.struct(F.lit(0).alias("n"), x["text"].alias("clean"))))
        return F.struct(
            F.size(x["words"]).alias("n_words"), chars.alias("word_chars"), F.when(x["symbols"], symbols(x["text"])).otherwise(0).alias("n_symbols"),
            repeated.alias("n_dup_lines"), repeated_words(x["words"]).alias("n_repeat_words"), lost.alias("lost"),
        )

    def judged(q: Column) -> Column:
        failed = (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"].cast("long") > MOST_REPEATED_PERCENT * q["n_words"].cast("long"))
        removed = q["lost"]["n"]
        return F.struct(*(q[c].alias(c) for c in FIGURES), q["lost"]["clean"].alias("clean"), removed.alias("removed_chars"), failed.alias("base_failed"), (~failed & (removed <= MOST_REMOVED * q["word_chars"])).alias("kept"))

    asked = lambda t: F.struct(
        t.alias("text"), words_of(t).alias("words"), F.split(t, "\n", -1).alias("lines"),
        contains_any(t, SYMBOLS).alias("symbols"), contains_any(t, BARS).alias("bars"),
    )
    return _let(_let(_let(text, asked), figures), judged)


def rules(docs: DataFrame) -> DataFrame:
    """Figures and verdict per document."""
    q = F.col("_q")
    judged = docs.select("doc_id", F.explode(F.array(verdict(F.coalesce("text", F.lit(""))))).alias("_q"))
    return judged.select("doc_id", *(q[c].cast("long").alias(c) for c in FIGURES), q["base_failed"].alias("base_failed"), q["kept"].alias("kept"), q["removed_chars"].cast("long").alias("removed_chars"))


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their cleaned text; n_chars, where there is one, follows the text.

    The verdict is exploded, empty for rejected documents: a filter would be pushed below the
    projection and have the verdict computed twice.
    """
    judged = F.filter(F.array(verdict(F.coalesce("text", F.lit("")))), lambda q: q["kept"])
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.explode(judged).alias("q"))
    clean_text = F.col("q.clean")
    n_chars = F.length(clean_text).cast(dict(docs.dtypes).get("n_chars", "long"))
    return rows.select(*({"text": clean_text, "n_chars": n_chars}.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
