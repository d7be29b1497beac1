"""The queue of timers against a scan of the checks, over simulated days of rechecks."""

import random

from pyspark.sql import functions as F

from vigil import store
from vigil.config import Config
from vigil.operators import schedule
from vigil.streaming import run, timers

KEYS = "story_id long, url string"
CHECKS = f"{KEYS}, status string, http_code int, check_count int, error_count int, last_checked timestamp_ntz, next_check_at timestamp_ntz"
START = 1_704_067_200
STATES = [("live", 200), ("deleted", 404), ("deleted", 200), ("deleted", None), ("blocked", 403), ("error", 503), ("unchecked", None)]


def _time(seconds):
    return F.timestamp_micros(F.lit(int((START + seconds) * 1_000_000))).cast("timestamp_ntz")


def _checks(spark, n):
    rng = random.Random(2)
    rows = [(k % 11, f"u{k}", *rng.choice(STATES), rng.randrange(4), rng.randrange(3), rng.randrange(86_400_000_000)) for k in range(n)]
    df = spark.createDataFrame(rows, f"{KEYS}, status string, http_code int, check_count int, error_count int, us long")
    seen = F.timestamp_micros(F.col("us") + (START - 86_400) * 1_000_000).cast("timestamp_ntz")
    df = df.withColumn("last_checked", seen).drop("us")
    return schedule.with_next_check(df, F.col("last_checked")).select(*[c.split()[0] for c in CHECKS.split(", ")])


def _listed(df):
    return [tuple(map(str, r)) for r in df.select("story_id", "url", "next_check_at", "status").collect()]


def test_simulated_days_are_those_of_the_scan(spark, tmp_path):
    cfg = Config(check_batch=9)
    source, ticks, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/ticks", f"file://{tmp_path}/out", f"file://{tmp_path}/c"
    checks = store.written(_checks(spark, 70), "plain")  # the plain version's table
    timers.entries_of(checks).coalesce(1).write.parquet(f"{source}/start")
    entry = spark.read.parquet(f"{source}/start").schema
    taken = spark.createDataFrame([], "key string, stamp long")
    for cycle in range(1, 7):
        now = _time(cycle * 20_000 + 0.5)
        spark.range(1).select(now.alias("at")).write.parquet(f"{ticks}/{cycle}")
        stream = spark.readStream.option("recursiveFileLookup", "true")
        due = run.finished(timers.due_rows(stream.schema(entry).parquet(source), stream.schema("at timestamp_ntz").parquet(ticks)), "due", checkpoint, out)
        batch = timers.next_batch(due, taken, KEYS, cfg)
        want = schedule.recheck_queue(checks, now, cfg)
        assert _listed(batch) == _listed(want) and len(_listed(want)) == 9
        # what was checked is live, gone or in error by its name, and comes back with its new time
        kind = F.pmod(F.xxhash64("url", F.lit(cycle)), F.lit(4))
        checked = want.withColumns({"status": F.when(kind == 0, "error").when(kind == 1, "deleted").otherwise("live"), "http_code": F.when(kind == 0, 500).when(kind == 1, 410).otherwise(200), "check_count": F.col("check_count") + 1, "last_checked": now})
        checked = store.written(schedule.with_next_check(checked, now).select(checks.columns), "plain")
        checks = store.written(checks.join(checked, ["story_id", "url"], "left_anti").unionByName(checked), "plain")
        taken = store.written(taken.unionByName(batch.select("key", "stamp")), "plain")
        timers.entries_of(checked).coalesce(1).write.parquet(f"{source}/{cycle}")
        timers.entries_of(checked).coalesce(1).write.parquet(f"{source}/{cycle}-again")  # a replay


def test_entries_that_are_replaced_or_leave(spark, tmp_path):
    rows = [("a", 0, 100, "1"), ("b", 0, 100, "1"), ("c", 0, 5000, "1"), ("d", 0, None, "1"), (None, 0, 5, "1"), ("e", 7, 50, "new"), ("f", 0, 100, "1")]
    df = spark.createDataFrame(rows, "key string, stamp int, due int, payload string")
    more = spark.createDataFrame([("a", 10, 4000, "2"), ("b", 10, None, "2"), ("e", 3, 60, "old"), ("f", 0, 100, "1")], df.schema)
    timed = lambda t: t.select("key", *[F.timestamp_seconds(F.col(c) + START).cast("timestamp_ntz").alias(c) for c in ("stamp", "due")], "payload")
    timed(df).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    source = lambda: spark.readStream.schema(timed(df).schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    tick = lambda n, s: spark.range(1).select(_time(s).alias("at")).write.parquet(f"{tmp_path}/ticks/{n}")
    ticks = lambda: spark.readStream.schema("at timestamp_ntz").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/ticks")
    out = lambda: sorted((r.key, r.due // 1_000_000 - START, r.payload) for r in run.finished(timers.due_rows(source(), ticks()), "due", f"file://{tmp_path}/c", f"file://{tmp_path}/out").collect())
    tick(0, 20)
    assert out() == []
    timed(more).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    assert out() == []
    tick(1, 200)
    assert out() == [("e", 50, "new"), ("f", 100, "1")]
    tick(2, 10_000)
    assert out() == [("a", 4000, "2"), ("c", 5000, "1"), ("e", 50, "new"), ("f", 100, "1")]
