"""Cases that once failed: archives under one path, long queries, clashing names."""

import pytest
from pyspark.sql import functions as F

from vigil.llm import linededup, mih, warc


@pytest.mark.parametrize("most", [64, 2])
def test_archives_under_one_path(spark, tmp_path, most):
    want = []
    for k in range(5):
        rows = [(10 * k + j, "u", f"<p>{k} {j} " + "x" * j * 400) for j in range(1 + k % 3)] if k else [(0, None, None)]
        want += [(i, len((h or "").encode())) for i, _, h in rows]
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/archives/a{k}")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/archives/empty")
    got = warc.read_archives(spark, f"file://{tmp_path}/archives/*", most=most).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted(want)
    assert all(len(r.payload) == r.payload_bytes for r in got)


def test_dictionary_of_large_pages_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 100)
    rows = [(k, "u", f"<p>marker {k % 3} of the pages</p>" * 50) for k in range(40)]
    path = f"file://{tmp_path}/large"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    raw = next(p for p in tmp_path.joinpath("large").glob("part-*") if p.stat().st_size).read_bytes()
    size = int.from_bytes(raw[4:8], "little")
    assert b"of the pages" in raw[8 : 8 + size]
    assert warc.read_archives(spark, path).count() == 40


def test_queries_longer_than_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, -1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(100, [1.0, -1.0] + [1.0] * 100), (101, [-1.0] * 70)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in mih.top_k(queries, rows, 2).collect())
    assert got == [(100, 1, 1, 100), (100, 2, 2, 101), (101, 1, 1, 1), (101, 2, 2, 2)]


@pytest.mark.parametrize("run", [linededup.dedup_lines, linededup.dedup_passages])
def test_column_named_removed(spark, tmp_path, run):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd"), (None, None)], "doc_id long, text string").withColumn("__removed", F.lit("old"))
    out = run(docs)
    assert out.columns == ["doc_id", "text", "__removed"] and out.schema["__removed"].dataType.typeName() == "long"
    out.write.parquet(f"{tmp_path}/out")
    assert run(docs.limit(0)).count() == 0
