"""The list that a corpus gives itself: found by rules over its urls, long enough for several levels."""

from pyspark.sql import functions as F

from vigil.llm import urlfilter


def test_hosts_that_rules_mostly_block(spark):
    urls = ["http://A.net/es/1", "http://a.net/fr/2", "http://a.net/en/3", "http://b.net/es/1", "http://b.net/en/", "http://m.casino-win.any.example/x", "http://xcasino-win.example/", None, "none", "http://c.net/es/", "http://sub.c.net/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("bad", F.lit(1))
    listed = urlfilter.blocked_hosts(pages)
    assert sorted(r.domain for r in listed.collect()) == ["a.net", "c.net", "casino-win.any.example"]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, listed).collect()}
    assert [k for k, v in sorted(got.items()) if v == "block"] == [0, 1, 2, 3, 5, 9, 10]
    assert urlfilter.blocked_hosts(pages.limit(0)).count() == 0


def test_driver_pages_need_several_levels(spark, data):
    pages = spark.read.parquet(data.replace("sf0.001", "sf0.1") + "/pages.parquet")
    hosts = pages.select(urlfilter.host_and_path(F.col("url"))[0].alias("host")).distinct()
    universe = urlfilter.universe_of(hosts, urlfilter.blocked_hosts(pages))
    cascade = urlfilter.build_cascade(universe, F.col("listed"))
    assert len(cascade.levels) > 2
    assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
