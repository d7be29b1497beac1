"""Two-level limits cut into ranges, and limits carried from batch to batch, against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_streaming import _fold
from vigil.streaming import limiter


def _requests(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, key string, scope string, s long")
    return df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_704_067_200).cast("timestamp_ntz")).drop("s")


def _rows(n, scopes, keys, span, seed):
    rng = random.Random(seed)
    return [(k, f"k{rng.randrange(keys)}", f"s{rng.randrange(scopes)}", rng.randrange(span)) for k in range(n)]


CASES = {
    "one scope, all the time full": (_rows(600, 1, 5, 900, 1), 3, 7, 60),
    "two scopes with gaps": (_rows(300, 2, 40, 5000, 2), 2, 5, 50),
    "many keys": (_rows(500, 1, 400, 600, 3), 1, 20, 40),
    "every half window, so that the phase goes on for ever": ([(k, "k", "s", 10 * k) for k in range(300)], 1, 1, 15),
    "at one time": ([(k, f"k{k % 3}", "s", 5) for k in range(60)], 2, 4, 10),
    "no limit left": (_rows(50, 1, 3, 50, 4), 0, 5, 10),
}


@pytest.mark.parametrize("pieces", [1, 7])
@pytest.mark.parametrize("case", list(CASES))
def test_ranges_are_walked_as_one(spark, case, pieces):
    rows, per_key, overall, window = CASES[case]
    got = limiter.two_level(_requests(spark, rows), per_key, overall, window, pieces=pieces).collect()
    assert {r.event_id: r.allowed for r in got} == _fold(rows, per_key, overall, window) and len(got) == len(rows)
    assert all((r.retry == 0) == r.allowed and (r.gate == "") == r.allowed for r in got)


def test_nulls_repeats_and_no_rows(spark):
    rows = [(1, None, None, 0), (1, None, None, 0), (2, None, "s", 1), (3, "a", None, 2), (4, "a", None, 3), (5, "a", None, 3)]
    got = sorted((r.event_id, r.allowed, r.gate) for r in limiter.two_level(_requests(spark, rows), 2, 3, 100, pieces=3).collect())
    assert got == [(1, True, ""), (1, True, ""), (2, True, ""), (3, True, ""), (4, False, "scope"), (5, False, "scope")]
    assert limiter.two_level(_requests(spark, rows).limit(0), 2, 3, 100).count() == 0


def test_logs_are_carried_from_batch_to_batch(spark, tmp_path):
    rows = sorted(_rows(240, 1, 4, 400, 6), key=lambda r: (r[3], r[0]))
    for part in range(4):
        _requests(spark, rows[60 * part : 60 * part + 60]).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stored = {}
    for checkpoint in ("a", "b"):  # all batches again, as after a lost checkpoint
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        limiter.start(source, 3, 30, f"file://{tmp_path}/logs", lambda df, n: stored.__setitem__(n, df.collect()), f"{tmp_path}/{checkpoint}").awaitTermination(120)
        got = {r.event_id: r.allowed for part in stored.values() for r in part}
        assert got == _fold(rows, 3, 0, 30) and len(stored) == 4
