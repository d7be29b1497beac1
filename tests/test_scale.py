"""Queries on tables that are larger or stranger than the driver's: repeated addresses, more partitions, small batches."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import same
from vigil import catalogue


@pytest.fixture
def copies(data, tmp_path):
    """A folder of the driver's tables and a function that repeats one with shifted keys."""
    import os

    for name in os.listdir(data):
        os.symlink(f"{data}/{name}", tmp_path / name)

    def repeated(table, **shifts):
        os.unlink(tmp_path / f"{table}.parquet")
        keys = ", ".join(f"{k} + n * {by} AS {k}" for k, by in shifts.items())
        duckdb.sql(f"COPY (SELECT * REPLACE ({keys}) FROM '{data}/{table}.parquet', range(3) t(n)) TO '{tmp_path}/{table}.parquet'")
        return str(tmp_path)

    return repeated


def _as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in "orders lineitem events documents pages labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return same(catalogue.queries()[name](spark, folder).toPandas(), con.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["wayback_submitted", "wayback_consumed", "wayback_totals"])
def test_an_address_in_several_rows_of_the_queue(name, spark, copies):
    assert _as_sql(spark, copies("pages", page_id=10_000), name)


def test_observed_pages_are_whole_and_may_lack_an_address(spark, data, tmp_path):
    long = "CASE WHEN page_id % 5 = 2 THEN html || repeat('<p>one more</p> ', 6000) || '<p>deleted post</p>' ELSE html END AS html"
    duckdb.sql(f"COPY (SELECT * REPLACE ({long}, CASE WHEN page_id % 3 > 0 THEN url END AS url) FROM '{data}/pages.parquet') TO '{tmp_path}/pages.parquet'")
    for name in "orders lineitem events documents labels conversations".split():
        (tmp_path / f"{name}.parquet").symlink_to(f"{data}/{name}.parquet")
    assert _as_sql(spark, str(tmp_path), "page_observations")


def test_streams_hand_keys_to_python_by_buckets(spark, tmp_path):
    """A call for each bucket's rows, not for each key."""
    from vigil.streaming import ordered, timers

    spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("2024-01-01").cast("timestamp_ntz").alias("stamp"), F.lit("2024-01-02").cast("timestamp_ntz").alias("due"), F.lit("p").alias("payload")).write.parquet(f"{tmp_path}/in")
    entries = spark.readStream.schema("key string, stamp timestamp_ntz, due timestamp_ntz, payload string").parquet(f"{tmp_path}/in")
    clock = entries.select(F.col("due").alias("at"))
    log = entries.select("key", "stamp", F.lit(1).alias("seq"), F.lit("live").alias("status"))
    for stream in (timers.due_rows(entries, clock), ordered.transitions(log, "key", "stamp", "seq")):
        plan = stream._jdf.queryExecution().analyzed().toString()
        assert "pmod(xxhash64(key" in plan and "TransformWithStateInPySpark" in plan


def test_checks_are_dealt_once_and_in_more_parts_as_they_grow(spark, copies, monkeypatch):
    from vigil import bridge

    folder = copies("lineitem", l_orderkey=1_000_000)
    monkeypatch.setattr(bridge, "PART_BYTES", 1 << 14)
    found = catalogue.queries()["citation_signals"](spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and found.rdd.getNumPartitions() > 4
    for name in ("citation_signals", "delta_signals", "delta_archive_due", "story_detail", "recheck_round"):
        assert _as_sql(spark, folder, name)


def test_details_of_stories_send_no_row_by_story_and_address(spark, data):
    import re

    from vigil import bridge
    from vigil.plans import listing

    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        plan = catalogue.queries()["story_detail"](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    keys = re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)
    assert keys and all("," not in k for k in keys)
    assert bridge.view(spark, data, "citation_checks", 1 << 12).rdd.getNumPartitions() > bridge.view(spark, data, "citation_checks").rdd.getNumPartitions()
    at = F.lit("2024-01-31").cast("timestamp_ntz")
    story = spark.createDataFrame([(1, [("a", "u"), ("b", None), ("c", "v"), ("d", "u")]), (2, []), (3, None), (4, [("e", "u")])], "id long, citations array<struct<title:string,uri:string>>")
    story = story.select("*", F.lit(None).cast("string").alias("arweave_tx_id"), F.lit(None).cast("string").alias("arweave_url"))
    checks = spark.createDataFrame([(1, "u", "deleted", 404), (1, "v", "live", 200), (1, "v", "error", 503), (1, "x", "live", 200), (1, None, "live", 200), (9, "u", "live", 200)], "story_id long, url string, status string, http_code int")
    snapshots = spark.createDataFrame([("u", "success", "s1"), ("u", "success", "s2"), ("u", "pending", None), ("w", "success", "s3"), (None, "success", "s4")], "url string, status string, snapshot_url string")
    votes = spark.createDataFrame([], "user_id long, created_at timestamp_ntz")
    got = {r.id: r for r in listing.story_detail(story, checks, snapshots, votes, at).collect()}
    shown = {k: r.citations and [(c.pos, c.title, c.uri, c.track_status, c.track_http_code, c.track_check_count, c.untrackable, c.archive_status, c.archive_url) for c in r.citations] for k, r in got.items()}
    u = ("success", "s2")
    assert shown[1] == [(0, "a", "u", "deleted", 404, None, False, *u), (1, "b", None, "unchecked", None, None, False, None, None), (2, "c", "v", "error", 503, None, True, None, None), (2, "c", "v", "live", 200, None, False, None, None), (3, "d", "u", "deleted", 404, None, False, *u)]
    assert shown[2] is None and shown[3] is None and shown[4] == [(0, "e", "u", "unchecked", None, None, False, *u)]
    assert (got[1].citation_count, got[1].deleted, got[1].urgency, got[4].urgency) == (3, 1, "high", "normal")


def test_feeds_go_to_python_by_bytes(spark, data):
    from vigil.sources import feeds

    catalogue.queries()["poll_feeds"](spark, data).count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= feeds.BYTES_AT_ONCE


def test_canonical_json_is_that_of_python_without_python(spark):
    import json

    from vigil.operators import archive

    odd = "".join(map(chr, range(1, 128))) + "\u0085\u2028가😀\\n\\\\\"/"
    rows = [(1, ([odd, None, ""], (True, None), "b\nc", 2**60)), (2, ([], None, None, None)), (3, None)]
    df = spark.createDataFrame(rows, "id int, d struct<z:array<string>,a:struct<y:boolean,b:int>,`ü`:string,n:long>")
    found = archive.canonical_json(df, "d")
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.canonical for r in found.collect()}
    want = lambda d: json.dumps({"z": d[0], "a": d[1] and dict(zip("yb", d[1])), "ü": d[2], "n": d[3]}, sort_keys=True, ensure_ascii=False)
    assert got == {1: want(rows[0][1]), 2: want(rows[1][1]), 3: None}
