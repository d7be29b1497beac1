"""The snapshot queue fed by a stream: one consumer with a budget that asks once for an address.

Each micro-batch takes in new addresses and runs one round of ``wayback.process``. What it
leaves is a table of its own under its batch id, so a batch that has ended and runs again
does nothing. Rows that have ended move to a table of their own, and the live queue, which
every round writes anew, holds only what waits. Before the service is asked, the addresses
are written under the batch id; if the batch breaks off after that, the same addresses are
handed over again, marked as repeated, and no others, so the caller looks up what became of
them instead of asking a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from vigil.config import Config
from vigil.operators import wayback

QUEUE = "id string, url string, status string, attempts int, job_id string, created_at timestamp_ntz, next_poll_at timestamp_ntz, reason string, snapshot_timestamp string, snapshot_url string"
ENDED = ["success", "error"]


class Queue:
    """The tables of a queue below a path, a folder for each batch: asked, changed (by the answers), ended and live, in this order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, table: str, number: int) -> str:
        return f"{self.path}/{table}/batch={number}"

    def _there(self, table: str, number: int) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(table, number) + "/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def _stored(self, rows: DataFrame, table: str, number: int) -> DataFrame:
        rows.select(*_names()).write.mode("overwrite").parquet(self._folder(table, number))
        return self.spark.read.schema(QUEUE).parquet(self._folder(table, number))

    def live(self, number: int) -> DataFrame:
        """What waits after a batch; nothing before the first."""
        return self.spark.read.schema(QUEUE).parquet(self._folder("live", number)) if number >= 0 else self.spark.createDataFrame([], QUEUE)

    def ended(self, number: int) -> DataFrame:
        """All that ended up to a batch."""
        if number < 0:
            return self.spark.createDataFrame([], QUEUE)
        return self.spark.read.schema(QUEUE + ", batch long").parquet(f"{self.path}/ended").where(F.col("batch") <= number).drop("batch")

    def round(self, number: int, urls: DataFrame, ask: Callable, poll: Callable, capacity: Callable[[], DataFrame], as_of: Column, cfg: Config = Config()) -> bool:
        """One micro-batch; False if it had ended before.

        urls: column url. ask(rows, repeated): answers to requests for rows, as ``wayback.submitted`` takes them;
        poll(rows): job answers, as ``wayback.polled``; capacity(): as ``wayback.to_submit``.
        """
        if self._there("live", number):
            return False
        known = self.ended(number - 1).select("url")
        new = urls.join(known, "url", "left_anti")
        queue = wayback.enqueue(self.live(number - 1), new, as_of, cfg).withColumn("id", F.coalesce("id", F.sha1("url")))  # from what batches before left, so it is the same again
        repeated = self._there("asked", number)
        if repeated:
            asked = self.spark.read.schema(QUEUE).parquet(self._folder("asked", number))
        else:
            asked = self._stored(wayback.to_submit(queue, capacity(), cfg) if cfg.wayback_enabled else queue.limit(0), "asked", number)
        due = wayback.to_poll(queue, as_of, cfg) if cfg.wayback_enabled else queue.limit(0)
        sent = wayback.submitted(asked, ask(asked, repeated), as_of, cfg).select(*_names())
        polled = wayback.polled(due, poll(due), as_of, cfg).select(*_names())
        changed = self._stored(sent.unionByName(polled), "changed", number)
        after = queue.select(*_names()).join(changed.select("id"), "id", "left_anti").unionByName(changed)
        self._stored(after.where(F.col("status").isin(ENDED)), "ended", number)
        self._stored(after.where(~F.col("status").isin(ENDED)), "live", number)
        return True


def _names() -> list[str]:
    return [part.split()[0] for part in QUEUE.split(", ")]


def start(urls: DataFrame, queue: Queue, ask: Callable, poll: Callable, capacity: Callable[[], DataFrame], as_of: Callable[[], Column], checkpoint: str, cfg: Config = Config()) -> StreamingQuery:
    """The consumer of a stream of addresses (column url); a batch that runs again changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        queue.round(number, batch, ask, poll, capacity, as_of(), cfg)

    return urls.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
