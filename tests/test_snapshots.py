"""The snapshot queue as a stream: one request for an address, though batches run again or break off."""

import pytest
from pyspark.sql import functions as F

from vigil.config import Config
from vigil.streaming import snapshots


class Service:
    """Counts the requests it gets; every third address is refused, jobs are done at the second look."""

    def __init__(self, spark, fail_at=None):
        self.spark, self.asked, self.looked, self.fail_at, self.calls = spark, [], {}, fail_at, 0

    def ask(self, rows, repeated):
        found = []
        self.calls += 1
        for r in sorted(rows.collect(), key=lambda r: r.url):
            if not repeated:
                self.asked.append(r.url)
            n = int(r.url.rsplit("/", 1)[1])
            found.append((r.url, None if n % 3 == 0 else f"job{n}", "busy" if n % 3 == 0 else None, None, None))
        if self.calls == self.fail_at:
            raise RuntimeError("broke off after the requests")
        return self.spark.createDataFrame(found, "url string, job_id string, error string, snapshot_url string, timestamp string")

    def poll(self, rows):
        found = []
        for r in rows.collect():
            self.looked[r.job_id] = self.looked.get(r.job_id, 0) + 1
            found.append((r.job_id, "success" if self.looked[r.job_id] > 1 else "pending", "2024", f"https://w/{r.url}", None))
        return self.spark.createDataFrame(found, "job_id string, status string, timestamp string, snapshot_url string, reason string")

    def capacity(self):
        return self.spark.createDataFrame([(50, None)], "available int, daily_remaining int")


def _at(k):
    return F.timestamp_seconds(F.lit(1_704_067_200 + 1000 * k)).cast("timestamp_ntz")


def _urls(spark, first, n):
    return spark.createDataFrame([(f"https://a.kr/{k}",) for k in range(first, first + n)] + [("https://a.kr/0",), ("",), (None,), ("https://fmkorea.com/1",)], "url string")


@pytest.mark.parametrize("fail_at", [None, 2])
def test_rounds(spark, tmp_path, fail_at):
    cfg, service = Config(submit_budget=3, submit_attempts=2, poll_budget=10), Service(spark, fail_at)
    queue = snapshots.Queue(spark, f"file://{tmp_path}/q")
    for number in range(12):
        urls = _urls(spark, 2 * number, 3) if number < 3 else _urls(spark, 0, 1)
        for again in range(2):
            try:
                ended = queue.round(number, urls, service.ask, service.poll, service.capacity, _at(number), cfg)
            except RuntimeError:
                assert queue.round(number, urls, service.ask, service.poll, service.capacity, _at(number), cfg)
            else:
                assert ended == (again == 0)
    done = {r.url: r for r in queue.ended(11).collect()}
    assert len(done) == 7 == queue.ended(11).count() and queue.live(11).count() == 0
    for k in range(7):
        r = done[f"https://a.kr/{k}"]
        assert (r.status, r.attempts) == (("error", 2) if k % 3 == 0 else ("success", 1))
        assert service.asked.count(r.url) == r.attempts  # a refused one is tried again in a later round, the others once
    assert queue.ended(0).count() <= queue.ended(5).count()


def test_stream_that_runs_again(spark, tmp_path):
    cfg, service = Config(submit_budget=9), Service(spark)
    for k in range(3):
        _urls(spark, 3 * k + 1, 2).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    queue = snapshots.Queue(spark, f"file://{tmp_path}/q")
    for checkpoint in ("a", "b"):  # the second run has lost its checkpoint: all batches come again
        source = spark.readStream.schema("url string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        snapshots.start(source, queue, service.ask, service.poll, service.capacity, lambda: _at(1), f"{tmp_path}/{checkpoint}", cfg).awaitTermination(120)
    once = [f"https://a.kr/{k}" for k in (1, 2, 4, 5, 7, 8)]
    assert sorted(u for u in service.asked if not u.endswith("/0")) == once
    assert queue.live(2).where("status = 'pending'").count() == 6


def test_queue_that_is_off(spark, tmp_path):
    service = Service(spark)
    queue = snapshots.Queue(spark, f"file://{tmp_path}/q")
    assert queue.round(0, _urls(spark, 1, 2), service.ask, service.poll, service.capacity, _at(0), Config(wayback_enabled=False))
    assert service.asked == [] and queue.live(0).count() == 0
