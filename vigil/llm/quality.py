"""Quality rules: a threshold table compiled into one projection.

``measures`` gives the length, symbol, stop-word and line figures of a text as
columns, ``compile_rules`` turns a table of thresholds over them into one boolean
expression. Everything is built from Spark functions; there is no join, no
shuffle and no user function.

Defined results: a null or empty text has no words, so all its figures are 0, it
fails the base rule and is not kept; a ratio with denominator 0 is 0; repeated
rows give repeated rows; columns beside the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = "[ \\t-\\r]+"
LETTER_WORD = "(?<![^ \\t-\\r])[^\\p{L} \\t-\\r]*+\\p{L}"  # only a word's start can match, so the cost is linear
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to a in is it that for was on are with as be at by this have from or an not".split(),
    "fr": "le la les de des du et en un une que qui dans pour par sur au est pas plus".split(),
    "de": "der die das und in zu den von mit ist im nicht ein eine als auch auf dem für des".split(),
    "es": "el la los las de que y en un una por con para del se no es al lo su".split(),
}


class Rule(NamedTuple):
    """``numerator / denominator`` must lie in [least, most]; no denominator: the figure itself."""

    name: str
    numerator: str
    denominator: str | None
    least: float | None
    most: float | None


RULES = [
    Rule("words", "n_words", None, 20, 1_000_000),
    Rule("mean word length", "word_chars", "n_words", 2, 20),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.1),
    Rule("stop words per word", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("words with a letter", "n_letter_words", "n_words", 0.7, None),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it, even inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def repeated_words(words: Column, n: int = 8) -> Column:
    """Words that lie in an n-word window found at least twice, each word once.

    Windows are compared by a hash of their words' hashes, made by doubling (n is a
    power of two); a text without two equal hashes, the usual case, ends there. Else
    the windows are sorted by hash and equal neighbours, compared word by word, mark
    their words. No step copies an array for each window, so the cost is linear.
    """

    def marked(h: Column, w: Column) -> Column:
        entries = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of(e: Column) -> Column:
            def same(j: Column, k: Column) -> Column:
                a, b = F.get(e, j), F.get(e, k)
                equal = a["h"] == b["h"]
                for at in range(n):
                    equal = equal & (F.get(words, a["i"] + at) == F.get(words, b["i"] + at))
                return F.coalesce(equal, F.lit(False))

            hit = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            at = F.array_sort(F.transform(hit, lambda j: F.get(e, j)["i"]))
            start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-n).alias("last"))
            return F.aggregate(at, start, lambda s, p: F.struct((s["sum"] + F.least(F.lit(n), p - s["last"])).alias("sum"), p.alias("last")), lambda s: s["sum"])

        return let(entries, of)

    def windows(h: Column, width: int = 1) -> Column:
        """Hashes of all n-word windows, from those of windows of ``width`` words."""
        if width == n:
            return F.slice(h, F.lit(1), F.size(h) - (n - 1))
        return let(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + width))), lambda wider: windows(wider, 2 * width))

    none = F.lit(0).cast("long")
    return F.when(F.size(words) < 2, none).otherwise(
        let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda h: F.when(F.size(h) <= n, none).otherwise(let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(marked(h, w)))),
        )
    )


def measures(text: Column) -> dict[str, Column]:
    """Figures of a text by name, all long."""
    text = F.coalesce(text, F.lit(""))
    words = F.col("__q_words")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    stop = sorted({v for ws in STOP_WORDS.values() for w in ws for v in (w, w.capitalize())})
    out = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(text, WHITE, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": let(lines, lambda x: F.size(x)),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop))),
        "n_letter_words": F.regexp_count(text, F.lit(LETTER_WORD)),
        "n_repeat_words": repeated_words(words),
    }
    return {k: c.cast("long") for k, c in out.items()}


def compile_rules(rules: list[Rule]) -> Column:
    """One boolean over the columns of ``measures``: does every rule hold?"""
    verdict = F.lit(True)
    for r in rules:
        value = F.col(r.numerator).cast("double")
        if r.denominator:
            value = F.when(F.col(r.denominator) == 0, 0.0).otherwise(value / F.col(r.denominator))
        if r.least is not None:
            verdict = verdict & (value >= r.least)
        if r.most is not None:
            verdict = verdict & (value <= r.most)
    return verdict


def judge(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, the figures of ``measures``, base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word
    windows. kept: not base_failed, and every rule of the table holds.
    """
    base = docs.select(*keep, F.col(text).alias("__q_text")).withColumn("__q_words", word_array(F.coalesce(F.col("__q_text"), F.lit(""))))
    found = base.select(*keep, *[c.alias(k) for k, c in measures(F.col("__q_text")).items()])
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
