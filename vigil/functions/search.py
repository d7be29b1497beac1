"""Rules for search results, which are arrays of struct(title, url, content)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions import fixed
from vigil.functions.text import filled, matches, prefix, strip


def looks_like_news(item: Column) -> Column:
    url = F.lower(F.coalesce(item["url"], F.lit("")))
    listed = F.lit(False)
    for part in fixed.NEWS_URL_PARTS:
        listed = listed | F.contains(url, F.lit(part))
    return listed | matches(item["title"], fixed.NEWS_PATTERN) | matches(prefix(item["content"], 200), fixed.NEWS_PATTERN)


def looks_off_topic(item: Column) -> Column:
    """A good deed search found trouble; a rescue told anywhere in the text keeps it."""
    title, content = F.coalesce(item["title"], F.lit("")), F.coalesce(item["content"], F.lit(""))
    whole = lambda c: F.concat(title, F.lit(" "), c)
    return matches(whole(prefix(content, 200)), fixed.OFF_TOPIC) & ~matches(whole(content), fixed.RESCUE)


def normalize(results: Column) -> Column:
    """Results with an http address; the title defaults to it, the content is cut at 600."""
    ok = F.filter(results, lambda r: F.coalesce(F.startswith(r["url"], F.lit("http")), F.lit(False)))
    return F.transform(ok, lambda r: F.struct(F.coalesce(filled(r["title"]), r["url"]).alias("title"), r["url"].alias("url"), prefix(F.coalesce(r["content"], F.lit("")), 600).alias("content")))


def ladder(limited: Column, open_web: Column, off_topic: Column) -> Column:
    """The first non-empty of: no news and on topic, on topic, the unrestricted search."""
    base = normalize(limited)
    topical = F.filter(base, lambda r: ~(off_topic & looks_off_topic(r)))
    fresh = F.filter(topical, lambda r: ~looks_like_news(r))
    wide = F.coalesce(normalize(open_web), F.slice(base, 1, 0))
    return F.when(F.size(fresh) > 0, fresh).when(F.size(topical) > 0, topical).otherwise(wide)


def rich(results: Column, least: int = 80) -> Column:
    """Results with enough text; all if none has."""
    kept = F.filter(results, lambda r: F.length(strip(F.coalesce(r["content"], F.lit("")))) >= least)
    return F.when(F.size(kept) > 0, kept).otherwise(results)


def context(results: Column) -> Column:
    """The numbered lines that a prompt shows."""

    def lines(r: Column, i: Column) -> Column:
        content = strip(F.replace(F.coalesce(r["content"], F.lit("")), F.lit("\n"), F.lit(" ")))
        head = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] " + fixed.CONTEXT_TITLE), r["title"])
        return F.when(content == "", head).otherwise(F.concat(head, F.lit("\n" + fixed.CONTEXT_BODY), content))

    return F.when(F.size(results) > 0, F.array_join(F.transform(results, lines), "\n")).otherwise(fixed.NO_RESULTS)


def clean_title(title: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), fixed.TITLE_PREFIX, ""), fixed.TITLE_SUFFIX, "")
    return prefix(strip(s), 150)


def coverage_query(title: Column, content: Column) -> Column:
    """What to search the news for: enough content, else a long enough title, else null."""
    text = strip(F.replace(prefix(F.coalesce(content, F.lit("")), 200), F.lit("\n"), F.lit(" ")))
    name = clean_title(title)
    return prefix(F.when(F.length(text) >= 20, text).when(F.length(name) >= 8, name), 300)


def chosen(results: Column, indices: Column) -> Column:
    """The result named first; the first result if none is named; null without results."""
    return F.coalesce(F.get(results, F.get(indices, F.lit(0)) - 1), F.get(results, F.lit(0)))
