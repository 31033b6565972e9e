"""Text functions with the null and white-space rules of the audit: null, empty and blank mean missing."""

from __future__ import annotations

from functools import lru_cache
from html import unescape as html_unescape
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER_NULL = ""


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The string, or an empty one."""
    return F.coalesce(col(c), F.lit(""))


def materialised(df: DataFrame, *kept: str, **columns: Column) -> DataFrame:
    """The kept columns and computed ones, each computed once per row.

    A one-row generator stands between: filters on its output aren't pushed below it, where they
    would have the expressions computed again for each of their uses.
    """
    row = F.struct(*kept, *(c.alias(name) for name, c in columns.items()))
    return df.select(F.explode(F.array(row)).alias("_row")).select("_row.*")


#: White space as strings are stripped of it: ASCII, separators, next line and the Unicode spaces.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text(c), F.lit(_SPACES))


def folded(c: Column | str) -> Column:
    return F.lower(strip(c))


def words(c: Column | str) -> Column:
    """Number of white-space separated words. The text is computed once, as a lambda's variable."""
    counted = lambda bare: F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+")))
    return F.get(F.transform(F.array(strip(c)), counted), F.lit(0))


def regex_words(c: Column | str) -> Column:
    """Number of words of letters, numbers, marks and underscores, with apostrophes and hyphens between them."""
    return F.size(F.regexp_extract_all(text(c), F.lit(r"[\pL\pN\pM_](?:[\pL\pN\pM_'-]*[\pL\pN\pM_])?"), F.lit(0)))


def present(c: Column | str) -> Column:
    return strip(c) != ""


def number(c: Column | str) -> Column:
    """A count that is zero where missing or not a number."""
    return F.coalesce(col(c).try_cast("int"), F.lit(0))


def items(c: Column | str, kind: str) -> Column:
    """The array, or an empty one of that type."""
    return F.coalesce(col(c), F.array().cast(kind))


def banker(c: Column) -> Column:
    """Round half to even, as an integer."""
    return F.bround(c, 0).cast("int")


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


# ---- regex forms of a page's simple fields, for scans that need no tree

_SKIPPED = r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>|<!--.*?-->"


#: Between entries of the table of names, and between a name and its text.
_ENTRY, _TEXT = "\x01", "\x02"
COMMON = ("amp", "nbsp", "lt", "gt", "quot", "#39", "copy", "middot")
_REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]+|&"


@lru_cache(maxsize=1)
def _names() -> tuple[str, int]:
    """The names of HTML 5 with their texts as one string, and the length of the longest name that needs no semicolon."""
    return _ENTRY.join(f"{k}{_TEXT}{v}" for k, v in html5.items()), max(len(k) for k in html5 if not k.endswith(";"))


@lru_cache(maxsize=1)
def _low_numbers() -> tuple[str, ...]:
    """What the references of the numbers below 160 stand for: some of them aren't their own."""
    return tuple(html_unescape(f"&#{n};") for n in range(160))


def _numbered(n: Column) -> Column:
    """The character of a number (null: too large a one) of a reference."""
    code = F.lpad(F.hex(n), 8, "0")
    plane_end = n.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE
    without = plane_end | n.between(0xFDD0, 0xFDEF)
    other = F.when(n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(without, "").otherwise(F.decode(F.unhex(code), "UTF-32"))
    return F.when(n < 160, F.element_at(F.array(*map(F.lit, _low_numbers())), (n + 1).cast("int"))).otherwise(other)


def _decoded(piece: Column) -> Column:
    table, longest = _names()
    names = F.str_to_map(F.lit(table), F.lit(_ENTRY), F.lit(_TEXT))  # folded into one literal
    said = F.substring(piece, 2, 1 << 20)
    digits = lambda skipped: F.regexp_replace(F.substring(piece, skipped + 1, 1 << 20), "^0+|;", "")
    # longer numbers are beyond all characters, and beyond conv()
    numeral = lambda skipped, base: F.when(F.length(digits(skipped)) <= 8, F.conv(F.concat(F.lit("0"), digits(skipped)), base, 10).cast("long"))
    prefixes = F.reverse(F.sequence(F.lit(2), F.least(F.lit(longest), F.greatest(F.lit(2), F.length(said) - 1))))
    known = lambda n: names[F.substring(said, F.lit(1), n)]
    n = F.get(F.filter(prefixes, lambda k: known(k).isNotNull()), F.lit(0))
    shorter = F.when(n.isNotNull(), F.concat(known(n), F.substring(said, n + 1, F.length(said)))).otherwise(piece)
    named = F.coalesce(names[said], shorter)
    out = F.when(~F.startswith(piece, F.lit("&")) | (piece == "&"), piece)
    for name in COMMON:  # most of all references: a few comparisons in place of a search of all names
        out = out.when(piece == f"&{name};", html_unescape(f"&{name};"))
    return out.when(piece.rlike("^&#[xX]"), _numbered(numeral(3, 16))).when(F.startswith(piece, F.lit("&#")), _numbered(numeral(2, 10))).otherwise(named)


def unescape(c: Column) -> Column:
    """All character references, named and numbered, with and without a semicolon, as HTML 5 has them; text without any stays as it is."""
    pieces = lambda x: F.regexp_extract_all(x, F.lit(_REFERENCE), F.lit(0))
    decoded = lambda x: F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(pieces(x), _decoded), "")).otherwise(x)
    return F.get(F.transform(F.array(c), decoded), F.lit(0))  # the text is computed once, as a lambda's variable


def visible_text(html: Column | str) -> Column:
    """Text with scripts, styles, comments and tags replaced by blanks; title included."""
    return unescape(F.regexp_replace(F.regexp_replace(text(html), _SKIPPED, " "), r"(?s)<[^>]*>", " "))


def html_title(html: Column | str) -> Column:
    inner = F.regexp_extract(text(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return strip(F.regexp_replace(unescape(inner), r"(?U)\s+", " "))


def html_language(html: Column | str) -> Column:
    return F.regexp_extract(text(html), r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([^"'\s>]*)""", 1)


def html_headings(html: Column | str, level: int) -> Column:
    """Texts of the headings of a level, blank ones left out."""
    found = F.regexp_extract_all(text(html), F.lit(rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}\s*>"), F.lit(1))
    plain = F.transform(found, lambda x: strip(F.regexp_replace(unescape(F.regexp_replace(x, r"(?s)<[^>]*>", " ")), r"(?U)\s+", " ")))
    return F.filter(plain, lambda x: x != "")


def html_hrefs(html: Column | str) -> Column:
    """href values of anchors in order."""
    return F.regexp_extract_all(text(html), F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"']+)["']"""), F.lit(1))


def sha256(c: Column | str) -> Column:
    return F.sha2(text(c).cast("binary"), 256)
