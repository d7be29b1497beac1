"""Streams in event-time order against the same log as a batch: late rows, replays and several runs."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import verdict
from vigil.streaming import ordered, run

LOG = "url string, last_checked timestamp_ntz, story_id long, status string"


def _log(spark, n=400):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        rows.append((f"u{rng.randrange(9)}", 1_000_000 * (k // 3) + rng.randrange(3), k, rng.choice(["live", "live", "deleted", "blocked", "error", None])))
    df = spark.createDataFrame(rows, "url string, us long, story_id long, status string")
    return df.select("url", F.timestamp_micros(F.col("us") + 1_704_067_200_000_000).cast("timestamp_ntz").alias("last_checked"), "story_id", "status")


def _write(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}")


def _rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_transitions_of_a_stream_are_those_of_the_log(spark, tmp_path):
    log = _log(spark).cache()
    want = _rows(verdict.transitions(log, ("url",), ("last_checked", "story_id")).select("url", "last_checked", "story_id", "status", "previous_status", "newly_gone"))
    source, out, checkpoint = f"{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/c"
    stream = lambda: ordered.transitions(spark.readStream.schema(LOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source), "url", "last_checked", "story_id", "60 seconds")
    # a third of the rows come up to 60 seconds late, in a file after theirs
    late = F.pmod(F.xxhash64("story_id"), F.lit(3)) == 0
    for part in range(6):
        inside = (F.unix_micros(F.col("last_checked").cast("timestamp")) - 1_704_067_200_000_000) / 30_000_000
        _write(log.where((F.floor(inside) == part) & ~late | (F.floor(inside) == part - 1) & late), source, f"a{part}")
    first = run.finished(stream(), "transitions", checkpoint, out)
    seen = first.count()
    assert 0 < seen < len(want) and set(_rows(first)) <= set(want)
    _write(log, source, "again")  # everything once more
    assert run.finished(stream(), "transitions", checkpoint, out).count() == seen
    _write(spark.sql("select 'end' as url, timestamp_ntz'2025-01-01' as last_checked, -1L as story_id, 'live' as status"), source, "end")
    _write(log, source, "once more")
    found = run.finished(stream(), "transitions", checkpoint, out).where("url <> 'end'")
    assert _rows(found) == want


def _observations(spark):
    rng = random.Random(7)
    rows = []
    for k in range(300):
        code = rng.choice([200, 200, 200, 404, 500])
        rows.append((f"https://u{rng.randrange(12)}.kr/p", k * 777, k, "ok" if code == 200 else "http", code, rng.choice([1000, 900, 100]), rng.choice(["a", "b", "c"]), rng.random() < 0.15, rng.random() < 0.2))
    df = spark.createDataFrame(rows, "url string, ms long, seq long, net string, http_code int, text_len int, text_hash string, del_match boolean, blk_match boolean")
    none = F.lit(None).cast("string")
    obs = F.struct("net", "http_code", none.alias("final_url"), "text_len", "text_hash", "del_match", "blk_match", F.lit("x").alias("del_snip"), F.lit("y").alias("blk_snip"), F.lit(False).alias("bot_challenge"), none.alias("reason"))
    return df.select("url", F.timestamp_millis(F.col("ms") + 1_704_067_200_000).cast("timestamp_ntz").alias("at"), "seq", obs.alias("obs"))


def test_verdicts_of_a_stream_are_those_of_the_log(spark, tmp_path):
    log = _observations(spark).cache()
    want = _rows(verdict.judge_log(log))
    assert {"live", "deleted", "blocked", "error"} == {r[3] for r in want}
    source = f"{tmp_path}/in"
    for part in (1, 0, 2):  # the first two swapped
        _write(log.where(F.col("seq") % 3 == part), source, f"p{part}")
    end = log.limit(1).withColumns({"url": F.lit("end"), "at": F.lit("2025-01-01").cast("timestamp_ntz"), "seq": F.lit(0).cast("long")})
    _write(log.unionByName(end), source, "zz")
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(source)
    found = run.finished(ordered.verdicts(stream, "1 day"), "verdicts").where("url <> 'end'")
    assert _rows(found) == want


def test_baseline_is_the_first_live_observation(spark):
    """By a plain walk over each url's observations."""
    log = _observations(spark)
    rows = sorted(log.collect(), key=lambda r: (r.url, r.seq))
    base, before = {}, {}
    got = {r.seq: r for r in verdict.judge_log(log).collect()}
    for r in rows:
        o, b = r.obs, base.get(r.url)
        if o.net == "http":
            status = "deleted" if o.http_code == 404 else "error"
        elif b is None:
            status = "deleted" if o.del_match else "live"
            if status == "live":
                base[r.url] = o
        elif o.text_hash == b.text_hash:
            status = "live"
        elif o.del_match and not b.del_match:
            status = "deleted"
        elif o.blk_match and not b.blk_match:
            status = "blocked"
        else:
            status = "deleted" if b.text_len >= 800 and o.text_len < 0.35 * b.text_len else "live"
        gone = ("deleted", "blocked")
        assert (got[r.seq].status, got[r.seq].previous_status, got[r.seq].newly_gone) == (status, before.get(r.url), status in gone and before.get(r.url) not in gone)
        before[r.url] = status


@pytest.mark.parametrize("bad", ["url", "last_checked", "story_id"])
def test_rows_without_place_are_left_out(spark, tmp_path, bad):
    log = _log(spark, 9)
    _write(log.unionByName(log.limit(1).withColumn(bad, F.lit(None).cast(log.schema[bad].dataType))), f"{tmp_path}/in", "a")
    stream = spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    last = log.agg(F.max("last_checked")).first()[0]
    assert run.finished(ordered.transitions(stream, "url", "last_checked", "story_id"), "odd").count() == sum(r.last_checked < last.replace(microsecond=0) for r in log.collect())
