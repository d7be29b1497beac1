"""Counts kept by rounds against the counts of all checks; the trigger against the whole signals; a stream that runs a batch again."""

import random

from pyspark.sql import functions as F

from vigil.operators import signals, threshold
from vigil.streaming import recheck

NOW = "2024-01-31"
STATES = [("live", 200), ("unchecked", None), ("deleted", 404), ("deleted", 200), ("deleted", None), ("blocked", 403), ("blocked", 200), ("error", 503), (None, None)]
_now = lambda: F.lit(NOW).cast("timestamp_ntz")
CHECKS = "story_id long, url string, status string, http_code int"


def _rechecked(spark, before, rng, n):
    rows = []
    for key in rng.sample(sorted(before), n):
        old, new = before[key], rng.choice(STATES)
        rows.append((*key, *new, *old, new[0] in ("deleted", "blocked") and old[0] not in ("deleted", "blocked")))
        before[key] = new
    return spark.createDataFrame(rows, f"{CHECKS}, previous_status string, previous_code int, newly_gone boolean")


def _all(df):
    return sorted(tuple(r[c] for c in ["story_id", *signals.COUNTS]) for r in df.collect())


def test_rounds_add_up_to_all_checks(spark):
    rng = random.Random(3)
    checks = {(s, f"u{s}x{k}"): rng.choice(STATES) for s in range(40) for k in range(rng.randint(1, 6))}
    table = lambda: spark.createDataFrame([(*k, *v) for k, v in checks.items()], CHECKS)
    counts = signals.Counts(spark)
    counts.add(signals.count_rows(table()), 0)
    stories = spark.createDataFrame([(s, "tx" if s % 9 == 0 else "__pending__" if s % 9 == 1 else None) for s in range(45)], "id long, arweave_tx_id string")
    votes = spark.createDataFrame([(s, f"v{k}") for s in range(45) for k in range(s % 5)], "story_id long, user_id string").withColumn("created_at", _now())
    for number in range(1, 4):
        rows = _rechecked(spark, checks, rng, 30)
        found = signals.triggered(rows, counts, number, stories, votes, _now())
        whole = threshold.citation_signals(table())
        assert _all(counts.of()) == _all(whole)
        due = threshold.archive_due(threshold.story_signals(stories, table(), votes, _now())).join(rows.where("newly_gone").select(F.col("story_id").alias("id")).distinct(), "id", "left_semi")
        columns = ["id", "votes", "threshold", "urgency", *signals.COUNTS]
        assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, due.select(columns).collect()))
        counts.add(signals.changes(rows), number)  # the round again
        assert _all(counts.of()) == _all(whole)
    some = spark.createDataFrame([(3,), (7,), (7,), (None,), (99,)], "story_id long")
    assert _all(counts.of(some)) == [r for r in _all(counts.of()) if r[0] in (3, 7)]
    assert _all(counts.compacted().of()) == _all(counts.of())


def test_new_checks_and_empty_rounds(spark):
    none = spark.createDataFrame([], CHECKS)
    counts = signals.Counts(spark)
    counts.add(signals.count_rows(none), 0)
    assert counts.of().count() == 0
    new = spark.createDataFrame([(1, "a", "deleted", 404), (1, "b", "live", 200), (2, "c", "blocked", 403)], CHECKS)
    counts.add(signals.changes(new, known=False), 1)
    counts.add(signals.changes(none, known=False), 2)
    assert _all(counts.of()) == [(1, 2, 1, 0, 1, 0), (2, 1, 0, 1, 0, 1)]


def test_stream_hands_on_what_is_due(spark, tmp_path):
    none = F.lit(None).cast("string")
    checks = spark.createDataFrame([(1, "https://a.kr/1", "live", 200), (1, "https://a.kr/2", "live", 200), (2, "https://a.kr/2", "live", 200), (3, "https://a.kr/3", "deleted", 404)], CHECKS)
    checks = checks.withColumns({"check_count": F.lit(1), "error_count": F.lit(0), "baseline_at": F.lit(None).cast("timestamp_ntz"), **{f"baseline_{c}": none for c in ("final_url", "hash")}, "baseline_len": F.lit(0), "baseline_del_match": F.lit(False), "baseline_blk_match": F.lit(False)})
    obs = F.struct(F.lit("http").alias("net"), F.col("code").alias("http_code"), none.alias("final_url"), F.lit(0).alias("text_len"), none.alias("text_hash"), *[F.lit(False).alias(c) for c in ("del_match", "blk_match", "bot_challenge")], *[none.alias(c) for c in ("del_snip", "blk_snip", "reason")])
    seen = spark.createDataFrame([("https://a.kr/2", 410), ("https://a.kr/3", 404), ("https://a.kr/1", 500)], "url string, code int").select("url", obs.alias("obs"))
    seen.coalesce(1).write.parquet(f"{tmp_path}/seen")
    stories = spark.createDataFrame([(k, None) for k in (1, 2, 3)], "id long, arweave_tx_id string")
    votes = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (3, "e")], "story_id long, user_id string").withColumn("created_at", _now())
    counts, due = signals.Counts(spark), {}
    counts.add(signals.count_rows(checks), -1)
    for checkpoint in ("c1", "c2"):  # the same batch twice, as after a lost checkpoint
        q = recheck.start(spark.readStream.schema(seen.schema).parquet(f"{tmp_path}/seen"), lambda: checks, lambda df, n: df.count(), _now, f"{tmp_path}/{checkpoint}", counts=counts, sources=lambda: (stories, votes), due=lambda df, n: due.__setitem__(n, sorted((r.id, r.threshold) for r in df.collect())))
        q.awaitTermination(120)
        assert due == {0: [(1, 1), (2, 1)]}
        assert _all(counts.of()) == [(1, 2, 1, 0, 1, 0), (2, 1, 1, 0, 1, 0), (3, 1, 1, 0, 1, 0)]
