"""Stories that were never archived and that nobody wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.config import Config
from vigil.operators.threshold import vote_counts


def orphans(stories: DataFrame, votes: DataFrame, as_of: Column, cfg: Config = Config(), check_cache: bool = False) -> DataFrame:
    """Unclaimed stories older than the limit with no more real votes (and cached ones) than allowed."""
    old = stories.where(F.col("arweave_tx_id").isNull() & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(cfg.orphan_days))))
    counts = vote_counts(votes).withColumnRenamed("story_id", "__s")
    counted = old.join(counts, old["id"] == F.col("__s"), "left")
    few = F.coalesce(F.col("votes"), F.lit(0)) <= cfg.orphan_votes
    if check_cache:
        few = few & (F.coalesce(F.col("vote_count"), F.lit(0)) <= cfg.orphan_votes)
    return counted.where(few).select(*stories.columns)


def without(table: DataFrame, key: str, deleted: DataFrame) -> DataFrame:
    """The rows of a table that a deletion of stories leaves."""
    return table.join(deleted.select(F.col("id").alias("__d")), table[key] == F.col("__d"), "left_anti")
