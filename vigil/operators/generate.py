"""From search results and generated text to story rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.config import Config
from vigil.functions import generated, search
from vigil.functions.text import filled, strip

RESULT = "struct<title:string,url:string,content:string>"


def news_count(results: Column) -> Column:
    """How many results of a news search have an address; null if the search failed."""
    return F.when(results.isNotNull(), F.size(F.filter(results, lambda r: r["url"].isNotNull())))


def gap_score() -> Column:
    """The gap between community and news, which is not measured: always none."""
    return F.lit("none")


def attempts(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """rows with ``made``, what the attempt gives, and ``accepted``.

    rows: id, attempt (from 0), category, query, limited and open_web (results of both
    searches), raw (the generator's answer or null) and news (results of the news search
    or null). With the gate on, a refusal or a low score is not accepted.
    """
    found = rows.withColumn("__r", search.ladder(F.col("limited"), F.col("open_web"), F.col("category") == "kindness"))
    found = found.withColumn("__best", search.rich(F.col("__r"))).withColumn("__used", generated.used_indices(F.col("raw"), F.size("__best")))
    found = found.withColumn("__parsed", generated.score_and_reason(F.col("__used.text"))).withColumn("__one", search.chosen(F.col("__best"), F.col("__used.indices")))
    gap_query = search.coverage_query(F.col("__one.title"), F.col("__one.content"))
    gap = F.struct(F.size("__r").cast("long").alias("community_count"), news_count(F.col("news")).cast("long").alias("news_count"), gap_score().alias("gap_score"), gap_query.alias("gap_query"))
    made = F.struct(
        generated.sanitize(F.col("__parsed.text")).alias("body"),
        F.array(F.struct(F.col("__one.title").alias("title"), F.col("__one.url").alias("uri"))).alias("citations"),
        F.array("query").alias("search_queries"), F.when(gap_query.isNotNull() & F.col("news").isNotNull(), gap).alias("gap"),
        F.col("__parsed.score").alias("volatility_score"), F.col("__parsed.reason").alias("poetic_reason"),
    )
    fits = (F.size("__best") > 0) & F.col("raw").isNotNull()
    if cfg.gate:
        fits = fits & ~generated.is_no_fit(F.col("raw")) & (F.col("__parsed.score") >= cfg.gate_score)
    return found.select(*rows.columns, made.alias("made"), F.coalesce(fits, F.lit(False)).alias("accepted"))


def generate(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each id and category: its first accepted attempt, or no_fit with the last query.

    With the gate on there are ``relevance_attempts`` attempts, without it one.
    """
    tried = attempts(rows.where(F.col("attempt") < (cfg.relevance_attempts if cfg.gate else 1)), cfg)
    first = F.min_by(F.when(F.col("accepted"), F.col("made")), F.when(F.col("accepted"), F.col("attempt")))
    found = tried.groupBy("id", "category").agg(first.alias("m"), F.max_by("query", "attempt").alias("last"))
    return found.select(
        "id", "category", "m.body", F.coalesce("m.citations", F.array().cast("array<struct<title:string,uri:string>>")).alias("citations"),
        F.coalesce("m.search_queries", F.array("last")).alias("search_queries"), "m.gap",
        F.coalesce("m.volatility_score", F.lit(0)).alias("volatility_score"), F.coalesce("m.poetic_reason", F.lit("")).alias("poetic_reason"), F.col("m").isNull().alias("no_fit"),
    )


def story_rows(made: DataFrame, scored: bool = True) -> DataFrame:
    """Rows to insert as stories, of what was generated and has a text.

    scored: with score and reason, as stories asked for have them; those hunted on a schedule do not.
    """
    kept = made.where(~F.col("no_fit") & filled(strip(F.col("body"))).isNotNull())
    columns = ["category", "body", "citations", "search_queries", F.lit(0).alias("vote_count"), "gap.gap_score", "gap.community_count", "gap.news_count"]
    return kept.select("id", *columns, *(["poetic_reason", "volatility_score"] if scored else []))
