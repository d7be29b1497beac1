"""Limiters against a plain fold, and streams against batch."""

from collections import defaultdict, deque

from pyspark.sql import functions as F

from vigil.streaming import limiter, recheck, windows


def _requests(spark):
    rows = [(i, f"k{i * 7 % 3}", "s", i * 13 % 97) for i in range(60)]
    return spark.createDataFrame(rows, "event_id long, key string, scope string, s int").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s)")).drop("s"), rows


def _fold(rows, per, overall, window):
    times, out = defaultdict(deque), {}
    for event, key, scope, s in sorted(rows, key=lambda r: (r[3], r[0])):
        gates = [(key, per), *([(("all", scope), overall)] if overall else [])]
        for g, _ in gates:
            while times[g] and times[g][0] < s - window:
                times[g].popleft()
        out[event] = all(len(times[g]) < n for g, n in gates)
        if out[event]:
            for g, _ in gates:
                times[g].append(s)
    return out


def test_limits(spark):
    df, rows = _requests(spark)
    got = {r.event_id: r for r in limiter.by_key(df, 2, 20).collect()}
    assert {i: r.allowed for i, r in got.items()} == _fold(rows, 2, 0, 20)
    assert all(r.retry > 0 for r in got.values() if not r.allowed)
    both = {r.event_id: r.allowed for r in limiter.two_level(df, 2, 3, 20).collect()}
    assert both == _fold(rows, 2, 3, 20)


def test_edges():
    assert limiter.admit(deque([10.0]), 20.0, 1, 10) == (False, 1)  # exactly at the cut-off still counts
    assert limiter.admit(deque([9.9]), 20.0, 1, 10) == (True, 0)
    assert limiter.admit(deque(), 20.0, 0, 10) == (False, 10)


def test_stream_equals_batch(spark, tmp_path):
    df, rows = _requests(spark)
    source = str(tmp_path / "in")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    q = limiter.stream(stream, 2, 20).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.allowed for r in spark.table("limits").collect()} == _fold(rows, 2, 0, 20)


def test_window_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    q = windows.tumbling(stream, late="1 day").writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, windows.tumbling(events).collect()))


def test_recheck(spark, tmp_path):
    none = "cast(null as string)"
    checks = spark.sql(f"select 'https://a.kr/1' as url, 'live' as status, 3 as check_count, 0 as error_count, timestamp_ntz'2024-01-01' as baseline_at, 'https://a.kr/1' as baseline_final_url, 1000 as baseline_len, 'h' as baseline_hash, false as baseline_del_match, false as baseline_blk_match")
    seen = spark.sql(f"select 'https://a.kr/1' as url, named_struct('net', 'http', 'http_code', 404, 'final_url', {none}, 'text_len', cast(null as int), 'text_hash', {none}, 'del_match', false, 'blk_match', false, 'del_snip', {none}, 'blk_snip', {none}, 'bot_challenge', false, 'reason', {none}) as obs")
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    out = recheck.recheck(checks, seen, now, first_hard=True).first()
    assert (out.status, out.check_count, out.newly_gone, out.previous_status, out.baseline_hash) == ("deleted", 4, True, "live", "h")
    assert str(out.hard_deleted_at) == str(out.deleted_at) == "2024-02-01 00:00:00" and str(out.next_check_at) == "2024-02-01 01:00:00"
    source = str(tmp_path / "obs")
    seen.write.parquet(source)
    stored = {}
    q = recheck.start(spark.readStream.schema(seen.schema).parquet(source), lambda: checks, lambda df, n: stored.__setitem__(n, df.collect()), lambda: now, str(tmp_path / "c"))
    q.awaitTermination(120)
    assert [r.status for rows in stored.values() for r in rows] == ["deleted"]
