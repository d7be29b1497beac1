"""The pipeline's stages on odd rows, and as a whole against its parts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import mixing

WORDS = " ".join(f"w{k}" for k in range(120))
ROWS = [
    (1, WORDS, "a"), (1, WORDS, "a"), (1, WORDS, "b"), (2, WORDS + " tail", "a"), (None, "quite another text without an id", "a"), (None, None, None), (3, None, "b"), (4, "", "b"), (5, "", None),
    (6, "one\ntwo\nthree", "b"), (7, "zero\none\ntwo\nthree", "b"), (8, "long " * 20_000 + "end", "c"), (9, "same", "c"), (9, "other", "c"),
]


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("lang", "key", "class_id", "size", "copies", "rows", "doc", "n", "stays")})
    docs.withColumn("n_chars", F.length("text").cast("long")).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (6, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_empty_rows(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    rows = out.collect()
    if name == "packing":
        assert sum(r.length for r in rows) >= len(ROWS)
    else:
        assert out.columns == docs.columns and rows
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_near_dedup_keeps_one_row_of_each_class(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = Counter((r.doc_id, r.source) for r in corpus_pipeline.dedup_near(spark, docs, folder).collect())
    assert got.pop((1, "a"), 0) + got.pop((1, "b"), 0) == 1  # three equal rows and an edited copy
    assert sum(got.pop(k, 0) for k in [(None, None), (3, "b"), (4, "b"), (5, None)]) == 1  # texts without a word
    assert got == {(None, "a"): 1, (6, "b"): 1, (7, "b"): 1, (8, "c"): 1, (9, "c"): 2}
    again = corpus_pipeline.dedup_near(spark, docs.repartition(5), folder)
    assert Counter(again.collect()) == Counter(corpus_pipeline.dedup_near(spark, docs, folder).collect())


def test_mix_takes_what_the_operator_takes(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    size = lambda t: len((t or "").split())
    got = Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, folder).collect():
        got[r.source] += size(r.text)
    for r in mixing.targets(docs.select("source", mixing.word_count(F.col("text")).alias("size"), F.lit(1).alias("rows"))).collect():
        assert abs(got[r.source] - r.target) <= max(size(t) for _, t, s in ROWS if s == r.source)


def test_run_equals_its_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
    want = set(Counter(r.doc_id for r in docs.select("doc_id").collect()).items())
    out = corpus_pipeline.run(spark, data)
    pieces = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.sum((F.col("start") == 0).cast("int")).alias("copies")).collect()
    assert {(r.doc_id, r.copies) for r in pieces} == want
    assert all(r.n == r.t * r.copies for r in pieces)
