"""Cascades of several levels, lists as tables, and the same answers on both ways."""

import pytest
from pyspark.sql import functions as F

from vigil.llm import urlfilter


def test_long_list_has_several_levels_and_no_error(spark):
    universe = spark.range(100_000).select(F.concat(F.lit("host"), "id", F.lit(".example.org")).alias("key"), (F.col("id") % 10 == 3).alias("listed"))
    cascade = urlfilter.build_cascade(universe, F.col("listed"))
    assert len(cascade.levels) >= 3
    assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0
    assert sum(level.bits for level in cascade.levels) < 10 * 10_000  # under 10 bits a listed key


def test_driver_pages_need_more_than_one_level(spark, data):
    pages = spark.read.parquet(data.replace("sf0.001", "sf0.1") + "/pages.parquet")
    hosts = pages.select(urlfilter.host_and_path(F.col("url"))[0].alias("host")).distinct()
    universe = urlfilter.universe_of(hosts, urlfilter.blocked_domains(spark))
    cascade = urlfilter.build_cascade(universe, F.col("listed"))
    assert len(cascade.levels) > 1
    assert universe.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


@pytest.mark.parametrize("limit", [1 << 24, 10])
def test_list_is_a_table_in_any_case(spark, limit):
    rows = [(k, f"https://{'' if k % 3 else 'sub.'}h{k}.example.org/x") for k in range(300)] + [(300, None), (301, "h5.example.org"), (302, "https://xh7.example.org"), (302, "https://xh7.example.org")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("listed", F.lit(True)).withColumn("domain", F.lit(""))
    names = spark.createDataFrame([(f"H{k}.Example.org",) for k in range(0, 300, 7)] + [("h7.example.org",), (None,), ("nowhere.net",)], "domain string")
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(pages, names, max_bits=limit).collect()}
    assert got == {k: "block" if k < 300 and k % 7 == 0 else "allow" for k, _ in rows}
    assert urlfilter.filter_urls(pages, names.limit(0), max_bits=limit).where("verdict = 'block'").count() == 0
    assert urlfilter.filter_urls(pages.limit(0), names, max_bits=limit).count() == 0
