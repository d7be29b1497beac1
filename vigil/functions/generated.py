"""Rules for generated text: markers, clean-up, refusal and layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions import fixed
from vigil.functions.text import bound, cut_first, first_match, first_of_each, prefix, strip


def used_indices(text: Column, total: Column) -> Column:
    """struct(text, indices): the first source marker cut out, its numbers in 1..total, first copies, in order."""
    raw = F.split(first_match(text, fixed.USED_SOURCES, 1), ",")
    numbers = F.transform(F.filter(F.transform(raw, strip), lambda t: F.rlike(t, F.lit(r"^\d{1,9}$"))), lambda t: t.cast("int"))
    kept = F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= total)))
    return F.struct(strip(cut_first(text, fixed.USED_SOURCES)).alias("text"), kept.alias("indices"))


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, fixed.USED_SOURCES_STRIP, "")


def score_and_reason(text: Column) -> Column:
    """struct(text, score, reason): both marker lines cut out; 0 and empty if missing."""
    score = F.coalesce(F.try_to_number(F.nullif(first_match(text, fixed.SCORE_LINE, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return bound(
        F.struct(cut_first(text, fixed.SCORE_LINE).alias("rest"), score.alias("score")),
        lambda s: F.struct(strip(cut_first(s["rest"], fixed.REASON_LINE)).alias("text"), s["score"].alias("score"), strip(first_match(s["rest"], fixed.REASON_LINE, 1)).alias("reason")),
    )


def sanitize(text: Column) -> Column:
    """Without opening chatter, markdown, stray scripts and capitals; spacing repaired."""
    text = cut_first(text, fixed.META_PREFIX)
    steps = [
        (fixed.BOLD, "$1"), (fixed.UNDERSCORE, "$1"), (fixed.ITALIC, "$1"), (fixed.HEADER, ""), (fixed.RULE, ""),
        (fixed.HANJA, ""), (fixed.KANA, ""), (fixed.CAPS, ""), (" {2,}", " "),
        (r"(?U)\s+([.,!?。、])", "$1"), (r"(?U)([가-힣])\s+([가-힣])", "$1 $2"), (r"\n{3,}", "\n\n"),
    ]
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    return strip(text)


def tidy(text: Column) -> Column:
    """One paragraph without repeated sentences; the tail from its marker on stays as it is."""

    def of(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(fixed.TAIL))
        body = F.when(at > 0, F.substr(t, F.lit(1), at - 1)).otherwise(t)
        tail = F.when(at > 0, F.substr(t, at)).otherwise("")
        body = strip(F.regexp_replace(body, r"(?U)\s*\n+\s*", " "))
        sentences = F.transform(F.split(body, r"(?U)(?<=[.!?])\s+"), strip)
        key = lambda s: F.regexp_replace(s, "[^0-9A-Za-z가-힣]", "")
        kept = first_of_each(F.filter(sentences, lambda s: key(s) != ""), key)
        joined = F.array_join(kept, " ")
        return F.when(tail == "", joined).otherwise(strip(F.concat(joined, F.lit("\n"), strip(tail))))

    return bound(text, of)


def is_no_fit(text: Column) -> Column:
    """The first line is the refusal marker, or is short and ends in a refusal."""
    first = F.regexp_extract(strip(text), r"^[^\n\r\x0b\x0c\x1c-\x1e\x85  ]*", 0)

    def of(line: Column) -> Column:
        mark = F.replace(F.upper(F.regexp_replace(line, fixed.NO_FIT_WRAP, "")), F.lit(" "), F.lit(""))
        marked = F.startswith(mark, F.lit(fixed.NO_FIT_MARKS[0])) | F.startswith(mark, F.lit(fixed.NO_FIT_MARKS[1]))
        return marked | ((F.length(line) <= 40) & F.rlike(line, F.lit(fixed.NO_FIT_PROSE)))

    return bound(first, of)


def from_text(raw: Column, body: Column, category: Column, body_chars: int = 2500, least: int = 80) -> Column:
    """One post retold: struct(no_fit, category, body, text, volatility_score, poetic_reason).

    raw: what the generator returned for the post; null if it failed.
    """
    kind = F.when(category.isin("kindness", "critique"), category).otherwise("critique")
    source = prefix(strip(F.coalesce(body, F.lit(""))), body_chars)
    empty = (F.length(source) < least) | raw.isNull() | (strip(raw) == "") | is_no_fit(raw)
    header = F.when(kind == "kindness", fixed.STORY_HEADERS["kindness"]).otherwise(fixed.STORY_HEADERS["critique"])

    def of(parsed: Column) -> Column:
        clean = tidy(sanitize(parsed["text"]))
        return bound(clean, lambda c: outcome(F.coalesce(empty | (strip(c) == ""), F.lit(True)), c, parsed))

    def outcome(skip: Column, clean: Column, parsed: Column) -> Column:
        pick = lambda c, other: F.when(skip, F.lit(other)).otherwise(c)
        return F.struct(
            skip.alias("no_fit"), kind.alias("category"), pick(clean, "").alias("body"),
            pick(F.concat(header, F.lit("\n\n"), strip(clean)), "").alias("text"),
            pick(parsed["score"], 0).alias("volatility_score"), pick(parsed["reason"], "").alias("poetic_reason"),
        )

    return bound(score_and_reason(strip_markers(F.coalesce(raw, F.lit("")))), of)


def retry_wait(message: Column) -> Column:
    """Seconds a rate-limit message asks for, and half a second; 5 without such a text."""
    found = first_match(message, r"try again in (\d+\.?\d*)s", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("double") + 0.5, F.lit(5.0))
