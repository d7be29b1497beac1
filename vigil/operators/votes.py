"""Votes: outcomes of incoming ones and the cached count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(incoming: DataFrame, votes: DataFrame, stories: DataFrame) -> DataFrame:
    """incoming (id, story_id, user_id) with an outcome: missing_story, duplicate or accepted.

    The first of a user's votes for a story counts (by created_at, id) if no stored vote does.
    """
    known = stories.select(F.col("id").alias("__s")).distinct()
    had = votes.select(F.col("story_id").alias("__vs"), F.col("user_id").alias("__vu")).distinct()
    turn = F.row_number().over(Window.partitionBy("story_id", "user_id").orderBy("created_at", "id"))
    rows = incoming.withColumn("__turn", turn)
    rows = rows.join(known, rows["story_id"] == F.col("__s"), "left")
    rows = rows.join(had, (rows["story_id"] == F.col("__vs")) & (rows["user_id"] == F.col("__vu")), "left")
    outcome = F.when(F.col("__s").isNull(), "missing_story").when(F.col("__vs").isNotNull() | (F.col("__turn") > 1), "duplicate").otherwise("accepted")
    return rows.select(*incoming.columns, outcome.alias("outcome"))


def refresh_cache(stories: DataFrame, counts: DataFrame) -> DataFrame:
    """vote_count only ever rises to the counted votes."""
    c = counts.select(F.col("story_id").alias("__s"), F.col("votes").alias("__v"))
    joined = stories.join(c, stories["id"] == F.col("__s"), "left")
    raised = F.greatest(F.coalesce(F.col("vote_count"), F.lit(0)).cast("long"), F.coalesce("__v", F.lit(0)))
    return joined.select(*[raised.alias(x) if x == "vote_count" else F.col(x) for x in stories.columns])


def already_voted(pairs: DataFrame, votes: DataFrame) -> DataFrame:
    """pairs (story_id, user_id) with voted: does such a vote exist?"""
    had = votes.select("story_id", "user_id").distinct().withColumn("voted", F.lit(True))
    return pairs.join(had, ["story_id", "user_id"], "left").fillna(False, ["voted"])
