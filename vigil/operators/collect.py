"""Which new feed items to capture, and what a capture stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.config import Config
from vigil.functions import fixed
from vigil.functions.risk import predict
from vigil.functions.text import filled
from vigil.operators.schedule import next_interval, seconds_after
from vigil.operators.verdict import decide
from vigil.sources import feeds


def per_feed_top(items: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The first items of each feed by position."""
    turn = F.row_number().over(Window.partitionBy("feed").orderBy("position"))
    return items.withColumn("__turn", turn).where(F.col("__turn") <= cfg.items_per_feed).drop("__turn")


def new_items(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items whose url no captured post has; repeats among the items stay."""
    return items.join(known.select(F.col("url").alias("__u")).distinct(), items["url"] == F.col("__u"), "left_anti")


def round_robin(items: DataFrame, cfg: Config = Config(), by: str = "feed") -> DataFrame:
    """One item of each feed in turn, best predicted score first, until the budget of attempts is spent; by: the feeds' order."""
    turn = F.row_number().over(Window.partitionBy("feed").orderBy(F.col("score").desc_nulls_last(), "position"))
    ranked = items.withColumn("round", turn).where(F.col("round") <= cfg.capture_budget)
    return ranked.orderBy("round", by, "feed", "position").limit(cfg.capture_budget)


def skip_refused(fetches: DataFrame) -> DataFrame:
    """Feeds whose server does not refuse robots."""
    return fetches.where(~F.coalesce(F.col("http_code").isin(fixed.BOT_BLOCK_CODES), F.lit(False)))


def parsed(fetches: DataFrame) -> DataFrame:
    """Items of fetched feeds (source, feed, raw, http_code), each source's payload read in its own way; refused and failed fetches have none."""
    open_ = skip_refused(fetches.where("raw is not null"))
    boards = ["clien.net", "bobaedream.co.kr"]
    xml = feeds.parse_xml(open_.where(~F.col("source").isin(boards) | F.col("source").isNull()))
    return xml.unionByName(feeds.parse_clien(open_.where(F.col("source") == boards[0]))).unionByName(feeds.parse_bobae(open_.where(F.col("source") == boards[1])))


def discovered(items: DataFrame, known: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The new ones among the first items of each feed, with the score that their title and summary predict."""
    nothing = F.lit(None)
    score = predict(F.col("title"), F.coalesce("summary", F.lit("")), F.coalesce("url", F.lit("")), nothing.cast("string"), nothing.cast("double"))["score"]
    return new_items(per_feed_top(items, cfg), known).withColumn("score", score)


def poll(fetches: DataFrame, known: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """One poll of all feeds: the items to capture, with their round and score, and the totals of each feed.

    fetches: source, feed, raw, http_code and turn, the feed's place among the feeds. Feeds
    take turns in that order, riskiest new items first, until the budget is spent.
    """
    order = fetches.select("source", "feed", "turn").distinct()
    found = discovered(parsed(fetches), known, cfg).join(order, ["source", "feed"])
    chosen = round_robin(found, cfg, by="turn")
    return chosen, poll_totals(found, chosen)


def captured(items: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """Rows for captured posts from items with an ``obs`` struct (its ``text`` included): verdict without
    baseline, risk score, stamps and first schedule."""
    obs = F.col("obs")
    rows = items.withColumn("__v", decide(obs, F.col("url"), F.lit(None).cast("struct<captured:boolean,final_url:string,len:int,hash:string,del_match:boolean,blk_match:boolean>"), cfg))
    v = F.col("__v")
    kept = (obs["net"] == "ok") & F.coalesce(obs["text"] != "", F.lit(False))
    source = F.coalesce(filled(obs["text"]), F.col("summary"), F.lit(""))
    nothing = F.lit(None)
    score = predict(F.col("title"), source, F.col("url"), nothing.cast("string"), nothing.cast("double"))["score"]
    step = next_interval(v["status"], F.lit(1), F.lit(0), cfg)
    hard = (v["status"] == "deleted") & F.coalesce(v["http_code"].isin(fixed.HARD_CODES), F.lit(False))
    return rows.select(
        *[c for c in items.columns if c != "obs"], v["status"].alias("status"), v["http_code"].alias("http_code"), v["reason"].alias("reason"),
        as_of.alias("last_checked"), F.lit(1).alias("check_count"), step["error_count"].alias("error_count"),
        seconds_after(as_of, step["seconds"]).alias("next_check_at"), obs["text_hash"].alias("content_hash"),
        F.when(kept, obs["text"]).alias("body_text"), F.when(kept, as_of).alias("captured_at"),
        v["baseline"].alias("baseline"), F.when(v["baseline"].isNotNull(), as_of).alias("baseline_at"),
        F.when(v["status"] == "deleted", as_of).alias("deleted_at"), F.when(hard, as_of).alias("hard_deleted_at"), score.alias("volatility_score"),
    )


def poll_totals(discovered: DataFrame, chosen: DataFrame) -> DataFrame:
    """feed, discovered (its new items) and chosen."""
    a = discovered.groupBy("feed").agg(F.count("*").alias("discovered"))
    b = chosen.groupBy("feed").agg(F.count("*").alias("chosen"))
    return a.join(b, "feed", "full_outer").fillna(0, ["discovered", "chosen"])
