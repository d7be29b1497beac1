"""Sliding-log rate limits, which remember admitted requests only.

A denied request leaves no trace, so the verdicts of a key depend on each other in
order. In batch, rows are dealt by key and sorted by time, and each task walks its rows
with the times of at most ``limit`` admitted ones per key in memory: a key is never
collected, however many rows it has. As a stream, the same times are the key's state.

A scope that many keys share can hold all rows, so ``two_level`` cuts its time line. The
log that a walk carries is all that its past leaves, ``overall`` requests at most. Each range
of rows is first walked from an empty log; then those whose predecessor left another log
than they began with are walked again from that, until none is. A range's log seldom
depends on how it began, as a window without it forgets it, so few ranges are walked again;
that it is right does not hang on that, as the first k ranges are right after k rounds.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from vigil import store


def admit(times: deque, now: float, limit: int, window: float) -> tuple[bool, int]:
    """(allowed, seconds to wait) of a request; drops times before the window, does not record it."""
    while times and times[0] < now - window:
        times.popleft()
    if len(times) < limit:
        return True, 0
    return False, max(1, int(times[0] + window - now) + 1 if times else int(window))


def _walk(requests: DataFrame, deal: str, columns: list[str], step) -> DataFrame:
    schema = StructType([*requests.schema.fields]).add("allowed", "boolean").add("retry", "long").add("gate", "string")
    known = requests.withColumn("__s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in parts:
            out = []
            for row in zip(frame[deal], frame["__s"], *[frame[c] for c in columns]):
                if state is None or row[0] != current:
                    current, state = row[0], {}
                out.append(step(state, *row))
            done = frame.drop(columns="__s")
            done["allowed"], done["retry"], done["gate"] = zip(*out) if out else ([], [], [])
            yield done

    return known.repartition(F.col(deal)).sortWithinPartitions(deal, "__s", "event_id").mapInPandas(walk, schema)


def by_key(requests: DataFrame, limit: int, window: int, key: str = "key") -> DataFrame:
    """requests (event_id, key, ts) with allowed, retry and gate ('' or 'key')."""

    def step(state, k, now):
        times = state.setdefault("times", deque())
        ok, retry = admit(times, now, limit, window)
        if ok:
            times.append(now)
        return ok, retry, "" if ok else "key"

    return _walk(requests, key, [], step)


class _Log:
    """The admitted requests of a scope within the window, whole and by key; times in microseconds."""

    def __init__(self, entries: list[tuple[int, str]]):
        self.whole: deque = deque()
        self.keys: dict[str, deque] = {}
        for at, key in entries:
            self._add(at, key)

    def _add(self, at: int, key: str) -> None:
        self.whole.append((at, key))
        self.keys.setdefault(key, deque()).append(at)

    def forget(self, before: int) -> None:
        while self.whole and self.whole[0][0] < before:
            _, key = self.whole.popleft()
            self.keys[key].popleft()
            if not self.keys[key]:
                del self.keys[key]

    def take(self, now: int, key: str, per_key: int, overall: int, window: int) -> tuple[bool, int, str]:
        self.forget(now - window)
        for times, limit, gate in ((self.keys.get(key, ()), per_key, "key"), (self.whole, overall, "scope")):
            if len(times) >= limit:
                first = (times[0] if gate == "key" else times[0][0]) if times else now - 1_000_000
                return False, max(1, (first + window - now) // 1_000_000 + 1), gate
        self._add(now, key)
        return True, 0, ""


def two_level(requests: DataFrame, per_key: int, overall: int, window: int, key: str = "key", scope: str = "scope", pieces: int | None = None) -> DataFrame:
    """Both a key's and its scope's limit must allow a request; only then do both record it, and the key's denial wins.

    requests (event_id, key, scope, ts) with allowed, retry and gate ('', 'key' or 'scope'). pieces: into how many ranges
    of scope and time the rows are cut; without it as many as Spark's shuffles have.
    """
    with store.scope():
        order = [F.col(scope), F.col("__s"), F.col("event_id")]
        known = requests.withColumn("__s", F.unix_micros(F.col("ts").cast("timestamp")))
        dealt = known.repartitionByRange(pieces, *order) if pieces else known.repartitionByRange(*order)
        rows = store.written(dealt.withColumn("__piece", F.spark_partition_id()), "requests")
        named = StructType([*requests.schema.fields]).add("allowed", "boolean").add("retry", "long").add("gate", "string").add("__piece", "integer").add("__log", "string")

        def walked(begins: dict[int, tuple]) -> DataFrame:
            """The rows of these pieces, each begun with a log (scope, entries), and a last row with the logs of its first and last scope."""

            def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                piece = current = first = log = None
                last = 0

                def end() -> pd.DataFrame:
                    log.forget(last - window * 1_000_000)
                    row = dict.fromkeys(named.names) | {"__piece": piece, "__log": json.dumps([first, current, list(log.whole)])}
                    return pd.DataFrame({k: pd.Series([x], dtype=object) for k, x in row.items()})

                for frame in parts:
                    out, ends = [], []
                    for p, s, now, k in zip(frame["__piece"], frame[scope].map(_named), frame["__s"], frame[key].map(_named)):
                        if p != piece:
                            if piece is not None:
                                ends.append(end())
                            piece, current, first = p, None, s
                        if log is None or s != current:
                            held = begins.get(p) if current is None else None
                            log = _Log(held[1] if held is not None and held[0] == s else [])
                            current = s
                        out.append(log.take(now, k, per_key, overall, window * 1_000_000))
                        last = now
                    done = frame.drop(columns="__s")
                    done["allowed"], done["retry"], done["gate"] = zip(*out) if out else ([], [], [])
                    done["__log"] = None
                    yield done[named.names]
                    yield from ends
                if piece is not None:
                    yield end()

            mine = rows.where(F.col("__piece").isin(list(begins))) if len(begins) < total else rows
            return store.written(mine.repartition("__piece").sortWithinPartitions("__piece", *order).mapInPandas(walk, named), "walked", keep=True)

        found = sorted(r[0] for r in rows.select("__piece").distinct().collect())  # a row for each piece
        total, begins, ends, tables = len(found), {p: None for p in found}, {}, []
        again = dict(begins)
        while again:
            table = walked(again)
            tables.append((table, set(again)))
            begins |= again
            for r in table.where("__log is not null").select("__piece", "__log").collect():  # a log for each piece, of ``overall`` requests at most
                ends[r["__piece"]] = json.loads(r["__log"])
            again = {}
            for before, p in zip(found, found[1:]):
                left = (ends[before][1], [tuple(e) for e in ends[before][2]]) if ends[before][1] == ends[p][0] else None
                left = left if left and left[1] else None
                if left != begins[p]:
                    again[p] = left
        out, seen = [], set()
        for table, walked_pieces in reversed(tables):
            own = sorted(walked_pieces - seen)
            seen |= walked_pieces
            if own:
                out.append(table.where(F.col("__log").isNull() & F.col("__piece").isin(own)).drop("__piece", "__log"))
        return reduce(DataFrame.unionByName, out) if out else requests.limit(0).select("*", F.lit(True).alias("allowed"), F.lit(0).cast("long").alias("retry"), F.lit("").alias("gate"))


def _named(value) -> str | None:
    return None if pd.isna(value) else str(value)


def stream(requests: DataFrame, limit: int, window: int, key: str = "key") -> DataFrame:
    """``by_key`` over a stream: the admitted times of each key are its state, forgotten when a window has passed.

    Rows of one micro-batch are taken in order of time; event_id breaks ties. Of a key's rows of a
    micro-batch the times and ids, 16 bytes each, are in memory; ``start`` holds the log only.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    chosen = requests.select("event_id", F.col(key).cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))

    def step(group, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0] if state.exists else [])
        parts = [(f["s"].to_numpy(), f["event_id"].to_numpy()) for f in frames]
        s, events = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((events, s))
        for k in range(0, len(order), 10_000):
            out = []
            for i in order[k : k + 10_000]:
                ok, retry = admit(times, s[i], limit, window)
                if ok:
                    times.append(float(s[i]))
                out.append((events[i], group[0], ok, retry))
            yield pd.DataFrame(out, columns=["event_id", "key", "allowed", "retry"])
        state.update((list(times),))
        state.setTimeoutDuration(window * 1000)

    return chosen.groupBy("key").applyInPandasWithState(step, "event_id long, key string, allowed boolean, retry long", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def carried(requests: DataFrame, logs: DataFrame | None, limit: int, window: int, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """``by_key`` of a batch after earlier ones, and the logs after it: key and times, admitted ones within a window of the key's last.

    logs: those after the batch before. Rows are walked sorted, so a key's batch may be of any size.
    """
    new = requests.withColumn("__s", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("__old", F.lit(False))
    if logs is not None:
        old = logs.select(F.col("key").alias(key), F.explode("times").alias("__s")).withColumn("__old", F.lit(True))
        new = new.unionByName(old, allowMissingColumns=True)
    schema = StructType([*requests.schema.fields]).add("__s", "long").add("__old", "boolean").add("allowed", "boolean").add("retry", "long").add("gate", "string")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, times = None, deque()
        for frame in parts:
            out = []
            for k, now, old in zip(frame[key].map(_named), frame["__s"], frame["__old"]):
                if k != current:
                    current, times = k, deque()
                ok, retry = (True, 0) if old else admit(times, now / 1e6, limit, window)
                if ok:
                    times.append(now / 1e6)
                out.append((ok, retry, "" if ok else "key"))
            frame["allowed"], frame["retry"], frame["gate"] = zip(*out) if out else ([], [], [])
            yield frame[schema.names]

    walked = store.written(new.repartition(F.col(key)).sortWithinPartitions(key, F.desc("__old"), "__s", "event_id").mapInPandas(walk, schema), "walked", keep=True)
    last = walked.groupBy(key).agg(F.max("__s").alias("__last"))
    kept = walked.where("allowed").join(last, key).where(F.col("__s") >= F.col("__last") - window * 1_000_000)
    after = kept.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list("__s")).alias("times"))  # ``limit`` at most
    return walked.where("not __old").drop("__s", "__old"), after


def start(requests: DataFrame, limit: int, window: int, logs: str, out: Callable[[DataFrame, int], None], checkpoint: str, key: str = "key") -> StreamingQuery:
    """``by_key`` over a stream by micro-batches, with bounded memory: each one's verdicts go to ``out`` under its batch id, which
    must replace what it holds for that id, and the logs after it to a folder of its own below the path ``logs``."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with store.scope():
            before = spark.read.schema("key string, times array<long>").parquet(f"{logs}/{number - 1}") if number else None
            verdicts, after = carried(batch, before, limit, window, key)
            after.select(F.col("key").cast("string").alias("key"), "times").write.mode("overwrite").parquet(f"{logs}/{number}")
            out(verdicts, number)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
