"""Dashboard counts and daily series, one scan for each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.config import PENDING, Config
from vigil.operators.constraints import CHECK_STATUS
from vigil.operators.threshold import base_threshold


def _counts(table: DataFrame, **conditions: Column) -> DataFrame:
    return table.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])


def dashboard(stories: DataFrame, checks: DataFrame, votes: DataFrame, posts: DataFrame, snapshots: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """One row with every count of the dashboard."""
    day = as_of - F.make_dt_interval(F.lit(1))
    true, col = F.lit(True), F.col
    parts = [
        _counts(
            stories, stories_total=true, stories_archived=col("archived_at").isNotNull(), kindness=col("category") == "kindness", critique=col("category") == "critique",
            gap_extreme=col("gap_score") == "extreme", gap_high=col("gap_score") == "high", gap_medium=col("gap_score") == "medium",
            stories_24h=col("created_at") >= day, archives_24h=col("archived_at") >= day, promoted_total=col("from_capture"),
        ),
        _counts(checks, citations_total=true, **{f"citations_{s}": col("status") == s for s in CHECK_STATUS}),
        _counts(votes, votes_total=true),
        _counts(
            posts, captured_total=true, captured_hard_deleted=col("hard_deleted_at").isNotNull(), **{f"captured_{s}": col("status") == s for s in CHECK_STATUS},
            **{f"promotion_{s}": col("promotion_status") == s for s in ("promoted", "blocked_pii", "pending_review", "skipped")},
        ),
        _counts(snapshots, **{f"wayback_{s}": col("status") == s for s in ("queued", "pending", "success", "error")}),
        base_threshold(votes, as_of, cfg).select(col("threshold").alias("threshold_base"), "active_voters"),
    ]
    row = reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # every part is one row
    return row.withColumns({
        "stories_pending": F.greatest(F.lit(0).cast("long"), col("stories_total") - col("stories_archived")),
        "gap_high_or_extreme": col("gap_high") + col("gap_extreme"),
    })


def pending_recent(stories: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row: unarchived stories of the last days."""
    tx = F.col("arweave_tx_id")
    return _counts(stories, pending=(tx.isNull() | (tx == PENDING)) & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))))


def timeseries(stories: DataFrame, checks: DataFrame, votes: DataFrame, as_of: Column, days: int = 30, cfg: Config = Config()) -> DataFrame:
    """date and the day's stories, archives, deletions and votes, for the last days, empty ones included."""
    n = max(1, min(days, cfg.series_max_days))
    today = F.to_date(as_of)
    found = F.coalesce(F.col("deleted_at"), F.col("last_checked")) if "deleted_at" in checks.columns else F.col("last_checked")
    sources = {
        "stories": stories.select(F.to_date("created_at").alias("date")),
        "archives": stories.where("archived_at is not null").select(F.to_date("archived_at").alias("date")),
        "deletions": checks.where("status = 'deleted'").select(F.to_date(found).alias("date")),
        "votes": votes.select(F.to_date("created_at").alias("date")),
    }
    inside = F.col("date").between(F.date_sub(today, n - 1), today)
    marked = reduce(DataFrame.unionByName, [df.where(inside).withColumn("kind", F.lit(k)) for k, df in sources.items()])
    counted = marked.groupBy("date").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in sources])
    spine = stories.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, n - 1), today)).alias("date"))
    return spine.join(counted, "date", "left").fillna(0, list(sources)).withColumn("date", F.col("date").cast("string"))
