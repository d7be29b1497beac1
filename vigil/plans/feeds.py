"""Atom feeds: which stories, and the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.config import PENDING, Config
from vigil.functions import fixed
from vigil.functions.text import strip, xml_attribute, xml_text


def _newest(stories: DataFrame, by: str, n: int) -> DataFrame:
    return stories.orderBy(F.col(by).desc_nulls_last(), "id").limit(n)


def feed_all(stories: DataFrame, cfg: Config = Config()) -> DataFrame:
    return _newest(stories, "created_at", cfg.feed_size)


def feed_archived(stories: DataFrame, cfg: Config = Config()) -> DataFrame:
    return _newest(stories.where((F.col("arweave_tx_id") != PENDING) & F.col("arweave_tx_id").isNotNull()), "archived_at", cfg.feed_size)


def feed_extreme(stories: DataFrame, cfg: Config = Config()) -> DataFrame:
    return _newest(stories.where(F.col("gap_score").isin("extreme", "high")), "created_at", cfg.feed_size)


def feed_deleted(stories: DataFrame, checks: DataFrame, cfg: Config = Config()) -> DataFrame:
    gone = checks.where("status = 'deleted'").select(F.col("story_id").alias("__s")).distinct()
    return _newest(stories.join(gone, stories["id"] == F.col("__s"), "left_semi"), "created_at", cfg.feed_size)


def entry_parts(stories: DataFrame, base_url: str) -> DataFrame:
    """id, entry_link, entry_title, summary, signals and content_html of each story."""
    body = F.coalesce(F.col("body"), F.lit(""))
    first = strip(F.substring_index(body, "\n", 1))
    label = F.when(F.col("category") == "kindness", fixed.ENTRY_LABELS["kindness"]).otherwise(fixed.ENTRY_LABELS["other"])
    title = F.concat(F.lit("["), label, F.lit("] "), F.substring(first, 1, 80), F.when(F.length(first) > 80, "…").otherwise(""))
    tx = F.col("arweave_tx_id")
    archived = F.coalesce((tx != "") & (tx != PENDING), F.lit(False))
    signals = F.array_compact(F.array(F.when(F.coalesce(F.col("from_capture"), F.lit(False)), fixed.ENTRY_CAPTURED), F.when(archived, fixed.ENTRY_ARCHIVED)))
    shown = F.array_join(signals, " · ")
    head = F.when(F.size(signals) > 0, F.concat(F.lit("<p><strong>"), shown, F.lit("</strong></p>"))).otherwise("")
    text = F.concat(F.lit("<p>"), F.replace(xml_text(body), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))
    cites = F.lit("")
    if "citations" in stories.columns:
        item = lambda c: F.concat(F.lit('<li><a href="'), xml_attribute(c["uri"]), F.lit('">'), xml_text(F.coalesce(c["title"], c["uri"])), F.lit("</a></li>"))
        cites = F.when(F.size("citations") > 0, F.concat(F.lit(f"<p>{fixed.ENTRY_SOURCES}</p><ul>"), F.array_join(F.transform("citations", item), ""), F.lit("</ul>"))).otherwise("")
    original = F.when(F.coalesce(F.col("arweave_url") != "", F.lit(False)), F.concat(F.lit('<p><a href="'), xml_attribute(F.col("arweave_url")), F.lit(f'">{fixed.ENTRY_ORIGINAL}</a></p>'))).otherwise("")
    return stories.withColumns({
        "entry_link": F.concat(F.lit(f"{base_url}/#story="), F.col("id").cast("string")), "entry_title": title,
        "summary": F.substring(first, 1, 200), "signals": shown, "content_html": F.concat(head, text, cites, original),
    })


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def atom(stories: DataFrame, base_url: str, feed_id: str, title: str, subtitle: str, as_of: Column, author: str = "Vigil", order: str = "created_at") -> DataFrame:
    """One row with the feed document of at most feed_size stories."""
    now = _iso(as_of)
    s = entry_parts(stories, base_url)
    lines = lambda *parts: F.concat_ws("\n", *parts)
    tag = lambda name, c: F.concat(F.lit(f"    <{name}>"), xml_text(c), F.lit(f"</{name}>"))
    published = F.coalesce(_iso(F.col("created_at")), now)
    entry = lines(
        F.lit("  <entry>"), tag("id", F.col("entry_link")), tag("title", F.col("entry_title")),
        F.concat(F.lit('    <link href="'), xml_attribute(F.col("entry_link")), F.lit('" rel="alternate" type="text/html"/>')),
        tag("published", published), tag("updated", F.coalesce(_iso(F.col("archived_at")), published)),
        F.concat(F.lit('    <category term="'), xml_attribute(F.coalesce(F.col("category"), F.lit("unknown"))), F.lit('"/>')),
        tag("summary", F.col("summary")),
        F.concat(F.lit('    <content type="html">'), xml_text(F.col("content_html")), F.lit("</content>")), F.lit("  </entry>"),
    )
    rows = s.select(F.struct((-F.unix_micros(F.col(order).cast("timestamp"))).alias("o"), F.col("id").alias("id"), entry.alias("xml")).alias("e"), published.alias("p"))
    all_rows = rows.agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["xml"]).alias("entries"), F.max("p").alias("updated"))
    url = F.lit(f"{base_url}/feed/{feed_id}.xml")
    head = lines(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom">'),
        F.concat(F.lit("  <title>"), xml_text(F.lit(title)), F.lit("</title>")), F.concat(F.lit("  <subtitle>"), xml_text(F.lit(subtitle)), F.lit("</subtitle>")),
        F.concat(F.lit('  <link href="'), xml_attribute(url), F.lit('" rel="self" type="application/atom+xml"/>')),
        F.concat(F.lit('  <link href="'), xml_attribute(F.lit(base_url + "/")), F.lit('" rel="alternate" type="text/html"/>')),
        F.concat(F.lit("  <id>"), xml_text(url), F.lit("</id>")), F.concat(F.lit("  <updated>"), F.coalesce(F.col("updated"), now), F.lit("</updated>")),
        F.concat(F.lit("  <author><name>"), xml_text(F.lit(author)), F.lit("</name></author>")),
    )
    return all_rows.select(F.concat_ws("\n", head, F.array_join("entries", "\n"), F.lit("</feed>")).alias("xml"), F.size("entries").alias("entries"))
