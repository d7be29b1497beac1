"""Streams taken in event-time order: each row with the row before it, however late it comes.

Rows of a key wait in its state until the watermark has passed them, and are then walked in
order of time and number. A row that is seen again, or that comes after its place has been
walked, changes nothing, so a stream may be replayed. The state of a key is what waits,
the last row walked and the first mark: it grows with the allowed delay, not with the stream.
Keys are dealt to buckets, whose rows are walked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vigil.config import Config
from vigil.functions.text import bound
from vigil.operators.verdict import BASELINE, based_on, decide, newly_gone
from vigil.streaming.frames import Alarm, bucket, packed, unpacked

OUT = "key string, at long, seq long, payload string, before string, held string, before_held string"
# Fixed value: the only state store that keeps timers and lists.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InOrder(StatefulProcessor):
    """The rows of a bucket of keys: frames of what waits, and one of each key's last row walked."""

    def init(self, handle) -> None:
        self.waiting = handle.getListState("waiting", "frame binary")
        self.last = handle.getValueState("last", "frame binary")
        self.alarm = Alarm(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        self.waiting.appendValue(packed(new[["key", "at", "seq", "payload", "mark"]]))
        self.alarm.by(int(new["at"].min()) // 1000 + 1)  # just after the first row's time
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.alarm.rang()
        rows = unpacked(self.waiting.get()).drop_duplicates(["key", "at", "seq"], keep="last")
        later = rows[rows["at"] >= passed]
        last = self.last.get()
        known = unpacked([last]) if last is not None else rows.iloc[:0].assign(held=None)
        walked, known = self._walk(rows[rows["at"] < passed], known)
        yield walked
        self.last.update(packed(known))
        if len(later):
            self.waiting.put([packed(later)])
            self.alarm.by(int(later["at"].min()) // 1000 + 1)
        else:
            self.waiting.clear()

    @staticmethod
    def _walk(due: pd.DataFrame, known: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The due rows after the last ones known of their keys, and the last rows then."""
        rows = pd.concat([known.assign(new=False), due.assign(held=None, new=True)], ignore_index=True).astype({"held": object, "mark": object})
        rows = rows.sort_values(["key", "at", "seq", "new"], ignore_index=True)  # the known row before its replay
        late = rows["new"] & (~rows["new"])[::-1].groupby(rows["key"][::-1]).cummax()[::-1]  # a known row comes after or is it
        again = rows["new"] & rows.duplicated(["key", "at", "seq"])
        rows = rows[~late & ~again].reset_index(drop=True)
        same = rows["key"] == rows["key"].shift()
        # the first mark that is not null of the rows before; a known row brings the one it held
        mark = rows["held"].where(rows["held"].notna(), rows["mark"])
        first = mark.where(mark.notna() & (mark.notna().groupby(rows["key"]).cumsum() == 1))
        reached = first.groupby(rows["key"]).ffill().shift().where(same, None)
        rows["held"] = reached.where(rows["new"], rows["held"])
        rows["before"] = rows["payload"].shift().where(same, None)
        rows["before_held"] = rows["held"].shift().where(same, None)
        kept = rows.drop_duplicates("key", keep="last")[["key", "at", "seq", "payload", "mark", "held"]]
        return rows.loc[rows["new"], ["key", "at", "seq", "payload", "before", "held", "before_held"]], kept


def in_order(rows: DataFrame, key: str, at: str, seq: str, payload: Column, mark: Column | None = None, delay: str = "0 seconds") -> DataFrame:
    """A stream's rows, each once, as the watermark passes them: key, at (microseconds), seq and payload, before
    (the payload of the key's row before), held (the first mark that is not null of the rows before) and before_held.

    payload and mark are structs and come out as JSON text. Order is by at, then seq, a whole
    number. Rows later than the delay are left out, as are rows without key, time or number.
    """
    chosen = rows.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("time"), F.col(seq).cast("long").alias("seq"), F.to_json(payload).alias("payload"), (F.lit(None) if mark is None else F.to_json(mark)).cast("string").alias("mark"))
    timed = chosen.where("key is not null and time is not null and seq is not null").withWatermark("time", delay).withColumn("at", F.unix_micros("time"))
    return timed.withColumn("bucket", bucket("key")).groupBy("bucket").transformWithStateInPandas(_InOrder(), OUT, "append", "eventTime")


def transitions(log: DataFrame, key: str, at: str, seq: str, delay: str = "0 seconds") -> DataFrame:
    """``verdict.transitions`` over a stream: key, at, seq, status, previous_status and newly_gone."""
    status = lambda c: F.get_json_object(c, "$.status")
    found = in_order(log, key, at, seq, F.struct("status"), delay=delay)
    named = found.select(F.col("key").alias(key), F.timestamp_micros("at").cast("timestamp_ntz").alias(at), F.col("seq").alias(seq), status("payload").alias("status"), status("before").alias("previous_status"))
    return named.withColumn("newly_gone", newly_gone(F.col("status"), F.col("previous_status")))


def verdicts(observations: DataFrame, delay: str = "0 seconds", cfg: Config = Config()) -> DataFrame:
    """``verdict.judge_log`` over a stream of (url, at, seq, obs): each observation against the baseline that the
    stream has captured before it, which is part of the state, as are the last observation and its baseline."""
    obs_type = observations.schema["obs"].dataType
    fresh = decide(F.col("obs"), F.col("url"), F.lit(None).cast(f"struct<captured:boolean,{BASELINE[7:]}"), cfg)["baseline"]
    found = in_order(observations, "url", "at", "seq", F.struct("obs"), fresh, delay)
    read = lambda c: F.from_json(c, f"obs {obs_type.simpleString()}")["obs"]
    base = lambda c: based_on(F.from_json(c, BASELINE[7:-1].replace(":", " ")))
    judged = bound(F.struct(read(F.col("payload")).alias("obs"), base(F.col("held")).alias("base")), lambda x: decide(x["obs"], F.col("key"), x["base"], cfg))
    earlier = bound(F.struct(read(F.col("before")).alias("obs"), base(F.col("before_held")).alias("base")), lambda x: decide(x["obs"], F.col("key"), x["base"], cfg)["status"])
    out = found.select(F.col("key").alias("url"), F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "seq", judged.alias("v"), F.when(F.col("before").isNotNull(), earlier).alias("previous_status"))
    return out.select("url", "at", "seq", "v.status", "v.http_code", "v.reason", "previous_status", newly_gone(F.col("v.status"), F.col("previous_status")).alias("newly_gone"))
