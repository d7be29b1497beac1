"""Archives of pages that hold the separator's bytes, and many archives read together."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vigil.llm import warc

SEP = warc.SEPARATOR.decode("latin-1")


def _noise(n, seed):
    rng = random.Random(seed)
    return "".join(chr(rng.randint(33, 0x2FFF)) for _ in range(n))


TABLES = {
    "three pages": [(k, "u", f"<p>{k}{SEP}text</p>") for k in range(3)],
    "many pages": [(k, "u", f"<p>{k} {SEP} some words of the page</p>" * (1 + k % 3)) for k in range(600)],
    "no two characters alike": [(k, "u", _noise(800, k) + SEP + _noise(20, -k)) for k in range(50)],
    "short ones": [(k, None, _noise(k, k) + SEP) for k in range(20)],
    "nothing else": [(1, "u", SEP), (2, "u", SEP * 500), (3, "u", SEP[:4]), (4, "u", SEP[4:] + SEP), (5, None, None), (6, "u", SEP[:7] * 300)],
    "in the address": [(k, f"https://a.example/{SEP}{k}", "text") for k in range(5)],
}


@pytest.mark.parametrize("rows", list(TABLES.values()), ids=list(TABLES))
def test_pages_that_hold_the_separator(spark, tmp_path, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages, path)
    found = warc.read_archives(spark, path).collect()
    want = {i: (t or "").encode() for i, _, t in rows}
    assert sorted(r.page_id for r in found) == sorted(want)
    assert all(r.payload_digest == hashlib.sha1(want[r.page_id]).hexdigest() and r.payload_bytes == len(want[r.page_id]) for r in found)
    assert all(bytes(r.payload) == want[r.page_id] for r in found if r.record_type == "response")


def test_frames_without_the_separator():
    import zstandard

    writer = zstandard.ZstdCompressor(level=warc.LEVEL, write_checksum=True)
    for k in range(200):
        data = (_noise(k % 30, k) + SEP).encode() * (1 + k % 4) + _noise(k % 7, -k).encode()
        made = warc.frames_of(data, writer)
        assert warc.SEPARATOR not in made and zstandard.ZstdDecompressor().stream_reader(made, read_across_frames=True).read() == data


@pytest.mark.parametrize("most", [64, 3])
def test_many_archives_are_read_once(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "GROUP", 7)
    want = {}
    for k in range(8):
        rows = [(100 * k + j, "u", f"<p>{k} {_noise(30, k)} {j}</p>" * (j % 9)) for j in range(3 + 10 * k)]
        want |= {i: len(t.encode()) for i, _, t in rows}
        warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/a/{k}")
    found = warc.read_archives(spark, f"file://{tmp_path}/a/*", most=most)
    assert {r.page_id: r.payload_bytes for r in found.collect()} == want and found.count() == len(want)
    assert found.where(F.col("record_type") == "response").where("payload is null").count() == 0
