"""The queue of snapshots asked from an outside archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.config import Config
from vigil.functions import fixed
from vigil.functions.urls import is_untrackable
from vigil.operators.merge import insert_ignore, upsert
from vigil.operators.schedule import seconds_after


def candidates(urls: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Distinct addresses worth a snapshot; none if the queue is off."""
    nothing = F.lit(None)
    good = F.coalesce(F.col("url") != "", F.lit(False)) & ~is_untrackable(F.col("url"), nothing.cast("int"), nothing.cast("string"))
    return urls.select("url").distinct().where(good & F.lit(cfg.wayback_enabled))


def enqueue(queue: DataFrame, urls: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    rows = candidates(urls, cfg).select("url", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), as_of.alias("created_at"))
    return insert_ignore(queue, rows, ["url"])


def to_poll(queue: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    due = queue.where((F.col("status") == "pending") & (F.col("next_poll_at") <= F.date_trunc("second", as_of)))
    return due.orderBy(F.col("next_poll_at").asc_nulls_first(), "id").limit(cfg.poll_budget)


def polled(rows: DataFrame, answers: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """rows after their job answers (job_id, status, timestamp, snapshot_url, reason); rows without a job stay."""
    a = answers.select(*[F.col(c).alias(f"__{c}") for c in ("job_id", "status", "timestamp", "snapshot_url", "reason")])
    joined = rows.join(a, rows["job_id"] == F.col("__job_id"), "left")
    said = F.coalesce(F.col("__status"), F.lit("pending"))
    job = F.coalesce(F.col("job_id") != "", F.lit(False))
    done, failed = job & (said == "success"), job & (said == "error")
    out = {
        "status": F.when(done, "success").when(failed, "error").otherwise(F.col("status")),
        "snapshot_timestamp": F.when(done, F.col("__timestamp")), "snapshot_url": F.when(done, F.col("__snapshot_url")),
        "reason": F.when(failed, F.col("__reason")),
        "next_poll_at": F.when(job & ~done & ~failed, seconds_after(as_of, F.lit(cfg.poll_backoff))).otherwise(F.col("next_poll_at")),
    }
    return joined.withColumns(out).drop("__job_id", "__status", "__timestamp", "__snapshot_url", "__reason")


def to_submit(queue: DataFrame, capacity: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Queued rows within the budget: our own and what the service reports (available, daily_remaining; nulls are ignored)."""
    budget = capacity.select(F.least(F.lit(cfg.submit_budget), F.col("available"), F.col("daily_remaining")).alias("__budget"))
    first = queue.where("status = 'queued'").orderBy(F.col("created_at").asc_nulls_first(), "id").limit(cfg.submit_budget)
    turn = F.row_number().over(Window.orderBy(F.col("created_at").asc_nulls_first(), "id"))  # over submit_budget rows
    return first.withColumn("__turn", turn).join(F.broadcast(budget), F.col("__turn") <= F.col("__budget")).drop("__turn", "__budget")


def submitted(rows: DataFrame, answers: DataFrame, as_of: Column, cfg: Config = Config(), by: str = "url") -> DataFrame:
    """rows after their requests. answers: url, job_id, error, snapshot_url, timestamp (of a snapshot found instead).

    by: what an answer names its request by. A queue that holds an address in several rows asks for
    each of them, so its answers name the row (``id``).
    """
    a = answers.select(*[F.col(c).alias(f"__{c}") for c in (by, "job_id", "error", "snapshot_url", "timestamp")])
    joined = rows.join(a, rows[by] == F.col(f"__{by}"), "left")
    tries = F.coalesce(F.col("attempts"), F.lit(0)) + 1
    job, found = F.col("__job_id").isNotNull(), F.col("__snapshot_url").isNotNull()
    worn = tries >= cfg.submit_attempts
    out = {
        "status": F.when(job, "pending").when(found, "success").when(worn, "error").otherwise("queued"),
        "attempts": tries.cast("int"),
        "job_id": F.col("__job_id"),
        "next_poll_at": F.when(job, seconds_after(as_of, F.lit(cfg.poll_backoff))),
        "snapshot_url": F.when(~job, F.col("__snapshot_url")), "snapshot_timestamp": F.when(~job & found, F.col("__timestamp")),
        "reason": F.when(~job & found, fixed.SNAPSHOT_FOUND).when(~job, F.substring(F.coalesce("__error", F.lit("save_failed")), 1, 200)),
    }
    return joined.withColumns(out).drop(f"__{by}", "__job_id", "__error", "__snapshot_url", "__timestamp")


def process(queue: DataFrame, jobs: DataFrame, capacity: DataFrame, answers: DataFrame, as_of: Column, cfg: Config = Config(), by: str = "url") -> tuple[DataFrame, DataFrame]:
    """One round of the queue's only consumer: due jobs are polled, then queued addresses submitted within the budget.

    jobs: as ``polled`` takes them; capacity: as ``to_submit``; answers, by: as ``submitted``.
    Returns the queue after the round and one row with ``polled`` (jobs that ended) and
    ``submitted`` (requests accepted or met by a snapshot). An off queue stays as it is.
    """
    if not cfg.wayback_enabled:
        return queue, queue.sparkSession.range(1).select(F.lit(0).cast("long").alias("polled"), F.lit(0).cast("long").alias("submitted"))
    asked = polled(to_poll(queue, as_of, cfg), jobs, as_of, cfg).where("job_id <> ''").select("id", "status", "next_poll_at", "reason", "snapshot_timestamp", "snapshot_url")
    sent = submitted(to_submit(queue, capacity, cfg), answers, as_of, cfg, by).select("id", "status", "attempts", "job_id", "next_poll_at", "reason", "snapshot_timestamp", "snapshot_url")
    ended = asked.agg(F.count_if(F.col("status").isin("success", "error")).alias("polled"))
    taken = sent.agg(F.count_if(F.col("status").isin("pending", "success")).alias("submitted"))
    return upsert(upsert(queue, asked, ["id"]), sent, ["id"]), ended.join(F.broadcast(taken))  # one row each
