"""The schedule as a queue of timers: what is due comes out when its time has passed, without a scan of the checks.

A key's entry is when it is due and what it carries (its counts, say); the state holds the entries
of a bucket of keys together, and a batch reads the buckets in which something is due. A row
with a later stamp replaces the entry and its timer; one with an earlier or equal stamp is a
replay and changes nothing; one without a time takes the key out of the queue. As the
watermark passes the time, the entry comes out once, and the key rests until a row with a
later stamp comes. Time is that of the rows: a tick (a row of a key of its own) moves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vigil.config import Config
from vigil.operators.schedule import in_queue
from vigil.streaming.frames import FRAMES, Alarm, bucket, packed, unpacked

OUT = "key string, due long, stamp long, payload string"


COLUMNS = ["key", "stamp", "due", "payload"]


class _Queue(StatefulProcessor):
    """The entries of a bucket of keys: frames of rows as they came, made one frame when the bucket's timer rings."""

    def init(self, handle) -> None:
        self.frames = handle.getListState("frames", "frame binary")
        self.number = handle.getValueState("number", "n int")
        self.alarm = Alarm(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = self._newest(new.loc[~new["tick"], COLUMNS].sort_values("due", ascending=False))
        if not len(new):
            return iter(())
        self.frames.appendValue(packed(new))
        number = (self.number.get() or (0,))[0] + 1
        if number > FRAMES:
            self.frames.put([packed(self._newest(unpacked(self.frames.get())))])
            number = 1
        self.number.update((number,))
        if (new["due"] >= 0).any():
            self.alarm.by(int(self._timer(new.loc[new["due"] >= 0, "due"]).min()))
        return iter(())

    @staticmethod
    def _newest(rows: pd.DataFrame) -> pd.DataFrame:
        """Of each key the row with the latest stamp, of equal stamps the first."""
        return rows.sort_values("stamp", ascending=False, kind="stable").drop_duplicates("key")

    @staticmethod
    def _timer(due: pd.Series) -> pd.Series:
        """The first whole second that is not before it, in milliseconds: a batch asks what is due by the second."""
        return -(-due // 1_000_000) * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.rang()
        held = self._newest(unpacked(self.frames.get()))
        timer = self._timer(held["due"])
        out = (held["due"] >= 0) & (timer <= timerValues.getCurrentWatermarkInMs())
        yield held.loc[out, ["key", "due", "stamp", "payload"]]
        later = timer[(held["due"] >= 0) & ~out]
        held.loc[out, "due"] = -1
        self.frames.put([packed(held)])
        self.number.update((1,))
        if len(later):
            self.alarm.by(int(later.min()))


def due_rows(entries: DataFrame, ticks: DataFrame) -> DataFrame:
    """A stream of what becomes due: key, due (microseconds), stamp and payload.

    entries: key, stamp and due (timestamps; due null: not in the queue) and payload (text).
    ticks: a column ``at``, whose largest value is the time until which entries come out.
    Entries have no event time of their own, so none is too late, however old its stamp.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    none, none_due = F.lit(None), F.lit(-1).cast("long")
    rows = entries.where("key is not null and stamp is not null").select(none.cast("timestamp").alias("time"), F.col("key").cast("string").alias("key"), micros("stamp").alias("stamp"), F.coalesce(micros("due"), none_due).alias("due"), F.col("payload").cast("string").alias("payload"), F.lit(False).alias("tick"))
    clock = ticks.where("at is not null").select(F.col("at").cast("timestamp").alias("time"), F.lit("").alias("key"), micros("at").alias("stamp"), none_due.alias("due"), none.cast("string").alias("payload"), F.lit(True).alias("tick"))
    return rows.unionByName(clock).withWatermark("time", "0 seconds").withColumn("bucket", bucket("key")).groupBy("bucket").transformWithStateInPandas(_Queue(), OUT, "append", "eventTime")


def entries_of(checks: DataFrame, keys: tuple[str, ...] = ("story_id", "url")) -> DataFrame:
    """Checks (last_checked as their stamp, next_check_at, status, http_code, check_count, error_count) as entries of the queue."""
    queued = F.coalesce(in_queue(F.col("status"), F.col("http_code")), F.lit(False))
    named = F.to_json(F.struct(*keys))
    return checks.select(named.alias("key"), F.col("last_checked").alias("stamp"), F.when(queued, F.col("next_check_at")).alias("due"), F.to_json(F.struct("status", "http_code", "check_count", "error_count")).alias("payload"))


def opened(due: DataFrame, schema: str) -> DataFrame:
    """What came out of the queue (``due_rows``) with its keys' columns (of the schema), next_check_at, status, http_code, check_count and error_count; key and stamp."""
    read = due.withColumn("k", F.from_json("key", schema)).withColumn("p", F.from_json("payload", "status string, http_code int, check_count int, error_count int"))
    return read.select("k.*", F.timestamp_micros("due").cast("timestamp_ntz").alias("next_check_at"), "p.*", "key", "stamp")


def next_batch(due: DataFrame, taken: DataFrame, schema: str, cfg: Config = Config()) -> DataFrame:
    """Of all that came out and was not taken (key, stamp) the next batch to check, longest overdue first, ties by key, as ``opened`` gives it."""
    names = [part.split()[0] for part in schema.split(", ")]
    left = due.join(taken.select("key", "stamp").distinct(), ["key", "stamp"], "left_anti")
    return opened(left, schema).orderBy("next_check_at", *names).limit(cfg.check_batch)
