"""When to check again, what is due, and how long a retry waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.config import Config
from vigil.functions import fixed


def seconds_after(at: Column, seconds: Column) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def _doubled(base: int, times: Column, most: int) -> Column:
    """base * 2**times, at most ``most``; times is held in 0..20."""
    n = F.greatest(F.lit(0), F.least(times.cast("int"), F.lit(20)))
    return F.least(F.lit(base).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), n), F.lit(most).cast("long"))


def next_interval(status: Column, check_count: Column, error_count: Column, cfg: Config = Config()) -> Column:
    """struct(seconds, error_count): rarer checks of what stays alive, back-off on errors."""
    checks, errors = F.coalesce(check_count, F.lit(0)), F.coalesce(error_count, F.lit(0)).cast("int")
    alive, failed, gone = status.isin("live", "unchecked"), status == "error", status.isin("deleted", "blocked")
    seconds = F.when(alive, _doubled(cfg.live_min, checks - 1, cfg.live_max)).when(failed, _doubled(cfg.error_base, errors, cfg.error_max)).when(gone, F.lit(cfg.soft)).otherwise(F.lit(cfg.live_min))
    count = F.when(alive | gone, F.lit(0)).when(failed, errors + 1).otherwise(errors)
    return F.struct(seconds.cast("long").alias("seconds"), count.cast("int").alias("error_count"))


def with_next_check(df: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """df (status, check_count, error_count) with next_check_at and the new error_count."""
    step = next_interval(F.col("status"), F.col("check_count"), F.col("error_count"), cfg)
    return df.withColumn("__s", step).withColumns({"next_check_at": seconds_after(as_of, F.col("__s.seconds")), "error_count": F.col("__s.error_count")}).drop("__s")


def in_queue(status: Column, http_code: Column) -> Column:
    """Everything but hard deletions; a deleted row without a code is not known to be soft, so it is out."""
    return (status != "deleted") | ((status == "deleted") & ~http_code.isin(fixed.HARD_CODES))


def recheck_queue(checks: DataFrame, as_of: Column, cfg: Config = Config(), keys: tuple[str, ...] = ("story_id", "url")) -> DataFrame:
    """The next batch that is due, longest overdue first; ties by key."""
    due = checks.where(in_queue(F.col("status"), F.col("http_code")) & (F.col("next_check_at") <= F.date_trunc("second", as_of)))
    return due.orderBy(F.col("next_check_at").asc_nulls_first(), *keys).limit(cfg.check_batch)


def fallback_queue(checks: DataFrame, cfg: Config = Config(), keys: tuple[str, ...] = ("story_id", "url")) -> DataFrame:
    """Without schedule columns: the longest unchecked first."""
    return checks.where(in_queue(F.col("status"), F.col("http_code"))).orderBy(F.col("last_checked").asc_nulls_first(), *keys).limit(cfg.check_batch)


def backoff_ready(attempts: Column, last: Column, as_of: Column, cfg: Config = Config()) -> Column:
    """Has an upload waited long enough for its next try?"""
    wait = _doubled(cfg.retry_base, F.coalesce(attempts, F.lit(0)) - 1, cfg.retry_max)
    elapsed = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    return last.isNull() | (elapsed >= wait * 1_000_000)
