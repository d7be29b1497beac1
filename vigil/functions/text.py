"""String helpers with the white-space and first-match semantics the rules need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def filled(c: Column) -> Column:
    """Null for empty text, so that coalesce can treat both as missing."""
    return F.nullif(c, F.lit(""))


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(c, F.lit(pattern)), F.lit(False))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(c, pattern, group)


def cut_first(c: Column, pattern: str) -> Column:
    """Without the first match; the text itself if there is none."""
    at = F.regexp_instr(c, F.lit(pattern))
    rest = F.concat(F.substr(c, F.lit(1), at - 1), F.substr(c, at + F.length(first_match(c, pattern))))
    return F.when(at > 0, rest).otherwise(c)


def prefix(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def visible_text(html: Column) -> Column:
    """What a reader sees: no script-like blocks, comments or tags, single spaces."""
    s = F.regexp_replace(html, r"(?isU)<(script|style|noscript|template)\b.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def xml_text(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def xml_attribute(c: Column) -> Column:
    return F.replace(F.replace(xml_text(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))


def first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """Array items whose key no earlier item has, in order."""
    return bound(F.transform(items, key), lambda ks: F.filter(items, lambda x, i: F.array_position(ks, F.get(ks, i)) == i + 1))


def iso_time(c: Column) -> Column:
    """ISO 8601 text to a timestamp; null for empty or bad text."""
    ok = F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?$"))
    return F.when(ok, c.try_cast("timestamp"))
