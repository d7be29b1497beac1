"""Distinct voters of sliding windows from one sketch a day, exact where a threshold hangs on it.

A day's voters are one HyperLogLog row, and a window of days is the union of its rows, so a
series of thresholds never reads the votes again. An estimate far enough from the next
multiple of ``voters_per_vote`` (``SIGMAS`` standard errors and one) gives the threshold that the
count gives; the days for which it is not are counted exactly, all in one job over the votes
of their windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.config import Config

LG, SIGMAS = 12, 6


def daily_sketches(votes: DataFrame) -> DataFrame:
    """day and sketch: the day's voters. Rows of new days can be added; a day that grows is unioned with its row."""
    return votes.where("user_id is not null and created_at is not null").groupBy(F.to_date("created_at").alias("day")).agg(F.hll_sketch_agg(F.col("user_id").cast("string"), F.lit(LG)).alias("sketch"))


def merged_sketches(*tables: DataFrame) -> DataFrame:
    """One row a day of tables that may have the same days."""
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("day").agg(F.hll_union_agg("sketch").alias("sketch"))


def _threshold(voters: Column, cfg: Config) -> Column:
    scaled = F.lit(cfg.min_threshold) + F.floor(voters / cfg.voters_per_vote)
    return F.greatest(F.lit(1), F.least(F.lit(cfg.max_threshold), scaled)).cast("long")


def thresholds(sketches: DataFrame, votes: DataFrame, first: Column, last: Column, cfg: Config = Config()) -> DataFrame:
    """day, active_voters, exact and threshold at the beginning of each day from first to last: of the voters in the ``active_days`` before it.

    active_voters is an estimate where exact is false; the threshold is that of the count in any case.
    """
    spark, span = sketches.sparkSession, cfg.active_days
    days = spark.range(1).select(F.explode(F.sequence(first.cast("date"), last.cast("date"))).alias("day"))
    of = days.withColumn("__d", F.explode(F.sequence(F.date_sub("day", span), F.date_sub("day", 1))))
    part = of.join(sketches.select(F.col("day").alias("__d"), "sketch"), "__d").groupBy("day").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
    known = days.join(part, "day", "left").fillna(0, ["about"])
    per, most = cfg.voters_per_vote, (cfg.max_threshold - cfg.min_threshold) * cfg.voters_per_vote
    slack = F.lit(1.0) + F.col("about") * (SIGMAS * 1.04 / (1 << LG) ** 0.5)
    low, high = F.floor(F.greatest(F.lit(0.0), F.col("about") - slack) / per), F.floor((F.col("about") + slack) / per)
    unsure = (low != high) & (F.col("about") - slack < most)
    marked = known.withColumn("unsure", unsure)
    edge = marked.where("unsure").select("day")  # a row for a day
    cast = votes.where("user_id is not null").select(F.to_date("created_at").alias("__d"), "user_id").where(F.col("__d").between(F.date_sub(first.cast("date"), span), F.date_sub(last.cast("date"), 1)))
    ends = cast.withColumn("day", F.explode(F.sequence(F.date_add("__d", 1), F.date_add("__d", span)))).join(F.broadcast(edge), "day", "left_semi")
    counted = ends.groupBy("day").agg(F.count_distinct("user_id").alias("exactly"))
    voters = F.when(F.col("unsure"), F.coalesce("exactly", F.lit(0))).otherwise(F.col("about"))
    return marked.join(F.broadcast(counted), "day", "left").select("day", voters.alias("active_voters"), F.col("unsure").alias("exact"), _threshold(voters, cfg).alias("threshold"))
