"""How many votes a story needs: a base from recent voters, lowered by hard evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.config import PENDING, Config
from vigil.functions import fixed


def base_threshold(votes: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """One row: threshold, active_voters, dynamic."""
    if not cfg.dynamic:
        return votes.sparkSession.range(1).select(F.lit(cfg.default_threshold).cast("long").alias("threshold"), F.lit(0).cast("long").alias("active_voters"), F.lit(False).alias("dynamic"))
    recent = votes.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(cfg.active_days)))
    voters = recent.agg(F.count_distinct("user_id").alias("active_voters"))
    scaled = F.lit(cfg.min_threshold) + F.expr(f"active_voters div {cfg.voters_per_vote}")
    return voters.select(F.greatest(F.lit(1), F.least(F.lit(cfg.max_threshold), scaled)).cast("long").alias("threshold"), "active_voters", F.lit(True).alias("dynamic"))


def citation_signals(checks: DataFrame) -> DataFrame:
    """story_id, citation_count, deleted, blocked, hard_deleted, hard_blocked."""
    gone, refused = F.col("status") == "deleted", F.col("status") == "blocked"
    return checks.groupBy("story_id").agg(
        F.count_distinct("url").alias("citation_count"),
        F.count_if(gone).alias("deleted"),
        F.count_if(refused).alias("blocked"),
        F.count_if(gone & F.col("http_code").isin(fixed.HARD_CODES)).alias("hard_deleted"),
        F.count_if(refused & (F.col("http_code") == 403)).alias("hard_blocked"),
    )


def effective(base: Column, deleted: Column, blocked: Column) -> Column:
    """struct(threshold, urgency): two fewer after a hard deletion, one fewer after a hard block."""
    one = F.lit(1).cast("long")
    pair = lambda n, u: F.struct(n.cast("long").alias("threshold"), F.lit(u).alias("urgency"))
    return F.when(deleted >= 1, pair(F.greatest(one, base - 2), "high")).when(blocked >= 1, pair(F.greatest(one, base - 1), "medium")).otherwise(pair(base, "normal"))


def with_threshold(stories: DataFrame, checks: DataFrame, votes: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """stories with citation signals (0 without citations), threshold and urgency."""
    signals = citation_signals(checks).withColumnRenamed("story_id", "__story")
    joined = stories.join(signals, stories["id"] == F.col("__story"), "left").drop("__story")
    joined = joined.fillna(0, ["citation_count", "deleted", "blocked", "hard_deleted", "hard_blocked"])
    base = base_threshold(votes, as_of, cfg).select(F.col("threshold").alias("__base"))
    joined = joined.join(F.broadcast(base))  # one row
    return joined.withColumn("__e", effective(F.col("__base"), F.col("hard_deleted"), F.col("hard_blocked"))).select(*[c for c in joined.columns if c != "__base"], F.col("__base").alias("base_threshold"), "__e.threshold", "__e.urgency")


def vote_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("story_id").agg(F.count("*").alias("votes"))


def story_signals(stories: DataFrame, checks: DataFrame, votes: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """Every story's real votes, signals, threshold and whether it is archived: one job for all."""
    out = with_threshold(stories, checks, votes, as_of, cfg)
    counts = vote_counts(votes).withColumnRenamed("story_id", "__story")
    out = out.join(counts, out["id"] == F.col("__story"), "left").drop("__story").fillna(0, ["votes"])
    tx = F.col("arweave_tx_id")
    return out.withColumn("archived", F.coalesce(tx.isNotNull() & (tx != "") & (tx != PENDING), F.lit(False)))


def archive_due(signals: DataFrame) -> DataFrame:
    """Stories with enough votes that are not archived."""
    return signals.where((F.col("votes") >= F.col("threshold")) & ~F.col("archived"))
