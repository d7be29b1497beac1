"""Thresholds from daily sketches against exact counts, at every edge."""

import datetime
import random

from pyspark.sql import functions as F

from vigil.config import Config
from vigil.operators import voters

DAY0 = datetime.date(2024, 1, 1)


def _votes(spark, days, seed, most):
    rng = random.Random(seed)
    rows = [(f"u{rng.randrange(most)}", DAY0 + datetime.timedelta(days=d)) for d in range(days) for _ in range(rng.randrange(most // 3))]
    return spark.createDataFrame(rows + [(None, DAY0)], "user_id string, day date").select("user_id", (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(13))).alias("created_at")), rows


def test_thresholds_of_ninety_days_are_those_of_counts(spark):
    for seed, most in ((1, 60), (2, 400), (3, 3000)):
        votes, rows = _votes(spark, 90, seed, most)
        cfg = Config(max_threshold=40)
        sketches = voters.merged_sketches(voters.daily_sketches(votes.where(F.dayofmonth("created_at") % 2 == 0)), voters.daily_sketches(votes))
        got = voters.thresholds(sketches, votes, F.lit(DAY0), F.lit(DAY0 + datetime.timedelta(days=95)), cfg).collect()
        assert len(got) == 96
        for r in got:
            n = len({u for u, d in rows if r.day - datetime.timedelta(days=7) <= d < r.day})
            assert r.threshold == max(1, min(40, 3 + n // 30)), (r, n)
            assert not r.exact or r.active_voters == n
        assert most < 400 or not all(r.exact for r in got)


def test_no_votes(spark):
    votes, _ = _votes(spark, 1, 1, 10)
    none = votes.limit(0)
    got = voters.thresholds(voters.daily_sketches(none), none, F.lit(DAY0), F.lit(DAY0)).collect()
    assert [(r.active_voters, r.threshold) for r in got] == [(0, 3)]
