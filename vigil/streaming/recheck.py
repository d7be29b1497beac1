"""Continuous rechecks: a stream of fetched pages against the stored snapshot of checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vigil.config import Config
from vigil.operators.signals import Counts, triggered
from vigil.operators.verdict import apply_verdicts, decide
from vigil.store import scope, written


def recheck(checks: DataFrame, observations: DataFrame, as_of: Column, cfg: Config = Config(), first_hard: bool = False, carry: str | None = None) -> DataFrame:
    """The checks that were observed (url, obs), after their verdicts; unobserved ones are not returned. carry: a field of obs to keep as a column."""
    seen = observations.select(F.col("url").alias("__u"), F.col("obs").alias("__obs"))
    rows = checks.join(seen, checks["url"] == F.col("__u"))
    base = F.when(F.col("baseline_at").isNotNull(), F.struct(
        F.lit(True).alias("captured"), F.col("baseline_final_url").alias("final_url"), F.col("baseline_len").alias("len"),
        F.col("baseline_hash").alias("hash"), F.col("baseline_del_match").alias("del_match"), F.col("baseline_blk_match").alias("blk_match"),
    ))
    rows = rows if carry is None else rows.withColumn(carry, F.col(f"__obs.{carry}"))
    rows = rows.withColumn("verdict", decide(F.col("__obs"), F.col("url"), base, cfg)).drop("__u", "__obs")
    return apply_verdicts(rows, as_of, cfg, first_hard)


def start(
    observations: DataFrame, snapshot: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], as_of: Callable[[], Column], checkpoint: str, cfg: Config = Config(),
    counts: Counts | None = None, sources: Callable[[], tuple[DataFrame, DataFrame]] | None = None, due: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Every micro-batch of observations is checked against the current snapshot and stored under its batch id.

    store must replace what it holds for a batch id, so that a batch that runs again
    after a failure counts once. With ``counts`` (the evidence counted so far), ``sources``
    (the stories and votes) and ``due``, what a batch changed is added to the counts, and the
    stories that its newly gone checks make due for the archive are handed to ``due``.
    """

    def each(batch: DataFrame, number: int) -> None:
        with scope():
            rows = written(recheck(snapshot(), batch, as_of(), cfg), "rechecked")
            store(rows, number)
            if counts is not None and sources is not None and due is not None:
                due(triggered(rows, counts, number, *sources(), as_of(), cfg), number)

    return observations.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
