"""Operator 11 against a plain version: levels, curve, order, cuts and slots; files that filters can skip."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vigil.llm import hilbert, queries


@pytest.mark.parametrize("n, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_once_by_single_steps(spark, n, bits):
    side = 1 << bits
    cells = spark.range(side**n).select(*[F.expr(f"cast(id div {side**k} % {side} as int)").alias(f"v{k}") for k in range(n)])
    found = cells.select("*", hilbert.curve_index([F.col(f"v{k}") for k in range(n)], bits).alias("at")).collect()
    path = [np.array(r[:n]) for r in sorted(found, key=lambda r: r["at"])]
    assert sorted(r["at"] for r in found) == list(range(side**n))
    assert all(np.abs(a - b).sum() == 1 for a, b in zip(path, path[1:]))


def _index(levels, bits):
    """The curve as a walk over orientations, one bit of each level at a time."""
    n, (digit, after) = len(levels), hilbert.steps(len(levels))
    at = state = 0
    for b in reversed(range(bits)):
        k = (state << n) + sum((v >> b & 1) << j for j, v in enumerate(levels))
        at, state = (at << n) + digit[k], after[k]
    return at


def _levels(values, bits):
    """The place of the middle of each value's rows; null as the smallest value."""
    known = sorted(v for v in values if v is not None)
    of, before = {}, 0
    for v in sorted(set(known)):
        n = known.count(v)
        of[v] = (2 * before + n) * (1 << bits) // (2 * len(known))
        before += n
    # a level begins at its smallest value, so values between two levels' beginnings belong to the lower
    of[None] = min(of.values(), default=0)
    return [of[v] for v in values]


def _plain(rows, law, shards=16, bits=5):
    """(id, size, crc, shard, slot) of rows (id, text, source, lang), in order."""
    size = [len((t or "").encode()) + 1 for _, t, _, _ in rows]
    crc = [zlib.crc32((t or "").encode()) for _, t, _, _ in rows]
    cells = list(zip(_levels([r[2] for r in rows], bits), _levels([r[3] for r in rows], bits), _levels(size, bits)))
    order = sorted(range(len(rows)), key=lambda k: (_index(cells[k], bits), crc[k], rows[k][0] is not None, rows[k][0] or 0, k))
    amount = size if law == "bytes" else [1] * len(rows)
    total, before, slots, out = sum(amount), 0, {}, []
    for k in order:
        shard = min((2 * before + amount[k]) * shards // (2 * total), shards - 1)
        out.append((rows[k][0], size[k], crc[k], shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += amount[k]
    return out


ODD = [(k, f"text {k % 7} " * (k % 11), "hot" if k % 3 else f"s{k % 5}", None if k % 13 == 0 else "en" if k % 2 else "fr") for k in range(300)]
ODD += [(None, None, None, None), (None, None, None, None), (5, "", "s1", "en"), (5, "", "s1", "en"), (7, "long " * 20_000, "s1", "de"), (-3, "ümlaut", "hot", "en")]


@pytest.mark.parametrize("law", ["bytes", "rows"])
@pytest.mark.parametrize("rows", [ODD, ODD[:5], ODD[-6:], [(k, "same text", "one", "en") for k in range(50)], [(1, "a", "s", "en")] * 40])
def test_shards_are_those_of_a_plain_walk(spark, rows, law):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    for name in ("size", "curve", "shard", "slot", "place", "part", "number", "id", "kept", "d0", "amount"):
        docs = docs.withColumn(name, F.lit("x"))
    got = hilbert.assign(docs, ("source", "lang", "size"), law=law, keep=("doc_id", "shard", "part"))
    want = _plain(rows, law)
    tell = lambda r: tuple(-99 if v is None else v for v in r)
    assert sorted(tell((r.doc_id, r.size, r.text_crc32, r.shard, r.slot)) for r in got.collect()) == sorted(map(tell, want))


def test_query_holds_its_law(spark, data):
    found = queries.op11_hilbert_sharding(spark, data).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in docs)
    texts = {r.doc_id: (r.text or "").encode() for r in docs}
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "bytes", None) for r in found)
    share, most = sum(r.size for r in found) / 16, max(r.size for r in found)
    for shard in range(16):
        own = [r for r in found if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - share) <= most
    again = queries.op11_hilbert_sharding(spark, data).collect()
    assert sorted(found) == sorted(again)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert hilbert.assign(docs, ("source", "lang", "size")).count() == 0


def test_files_cover_small_ranges(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("__n", F.octet_length("text"))
    hilbert.write_shards(docs, f"file://{tmp_path}/shards", ("source", "lang", "__n"), shards=8, files=24)
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == docs.count()
    files = list(tmp_path.joinpath("shards").glob("shard=*/*.parquet"))
    hits = lambda column, value: sum(s.min <= value <= s.max for f in files for s in [_stats(f, column)])
    lang, size = docs.first()["lang"], docs.approxQuantile("__n", [0.5], 0)[0]
    assert len(files) >= 16 and hits("lang", lang) <= 0.7 * len(files) and hits("__n", size) <= 0.7 * len(files)


def _stats(file, column):
    meta = pq.ParquetFile(file).metadata.row_group(0)
    return next(meta.column(k).statistics for k in range(meta.num_columns) if meta.column(k).path_in_schema == column)
