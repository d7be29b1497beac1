"""Texts scanned in parts against the scan of whole texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.functions import fixed, pii

HITS = ["900101-1234567", "010-1234-5678", "02-123-4567", "a.b@c.kr", "1234-5678-1234-5678", "계좌 12-34-567", "123456789012"]


def _text(rng, n):
    text = "".join(rng.choice("ab 가나\n.") for _ in range(n))
    for _ in range(rng.randrange(4)):
        at = rng.choice([rng.randrange(n + 1), 3995, 4000, 4120, 7990])
        text = text[:at] + f" {rng.choice(HITS)} " + text[at:]
    return text


@pytest.mark.parametrize("size", [1, 7, 700, 4000, 50_000])
def test_parts_are_scanned_as_the_whole(spark, size):
    rng = random.Random(size)
    texts = [_text(rng, rng.choice([0, 5, 300] if size < 100 else [0, 30, 3990, 4130, 9000, 20_000])) for _ in range(12 if size < 100 else 40)]
    rows = [(k, i, t[i : i + size]) for k, t in enumerate(texts) for i in range(0, max(1, len(t)), size)]
    rng.shuffle(rows)
    whole = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", pii.scan(F.col("text")).alias("found"))
    parts = pii.scan_parts(spark.createDataFrame(rows, "id long, part long, text string").repartition(5))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))


def _whole_finds(text):
    """kinds and texts by Python's search of the whole text with the detectors as they stand."""
    found = []
    for order, (kind, pattern) in enumerate(fixed.PII_DETECTORS):
        m = re.search(pattern.removeprefix("(?U)"), text)
        if m:
            found.append((m.start() // fixed.PII_CHUNK, order, kind, m.group()))
    return [f"{kind}:{t.strip()[:2]}{'*' * (len(t.strip()) - 2)}" for _, _, kind, t in sorted(found)]


def test_finds_at_the_cuts_are_those_of_the_whole_text(spark):
    """Finds cut by the end of a chunk or of what is seen behind it, and finds longer than that."""
    rng, pad = random.Random(4), lambda n: ("wo rd, " * (n // 7 + 1))[:n]
    long = ["m.99@mail0.example.com", "1234567890123456", "x" * 300 + "@y.kr", "7" * 9000, "900101" + " " * 500 + "-" + "\n" * 90 + "1234567", "카카오" + " " * 200 + "뱅크 12-34-567", "a.b" * 5000 + "@c." + "d" * 3000, "가ab.c@d.kr", "z12345678901", "..@a.kr", "a@b@c.kr"]
    texts = [pad(at) + sign + find + after for find in [*HITS, *long] for sign in (" ", "가", "") for after in (" x", "z", "") for at in [rng.choice([3700, 3990, 3999, 4000, 4001, 4110, 4118, 4127, 4128, 7995])]]
    texts += ["a." * 4000 + "@", "7" * 4000 + "x", " " * 9000, "a@" * 6000, "123456" + " " * 8000]
    want = {k: _whole_finds(t) for k, t in enumerate(texts)}
    whole = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", pii.scan(F.col("text"))["samples"].alias("samples"))
    assert {r.id: r.samples for r in whole.collect()} == want
    rows = [(k, i, t[i : i + 700]) for k, t in enumerate(texts) for i in range(0, len(t), 700)]
    parts = pii.scan_parts(spark.createDataFrame(rows, "id long, part long, text string"))
    assert {r.id: r.found.samples for r in parts.collect()} == want


def test_odd_parts(spark):
    rows = [(1, 0, None), (1, 1, "010-12"), (1, 2, ""), (1, 3, "34-5678"), (2, 0, None), (None, 5, "x a@b.kr")]
    found = {r.id: r.found for r in pii.scan_parts(spark.createDataFrame(rows, "id long, part long, text string")).collect()}
    assert {k: (f.hit, f.samples) for k, f in found.items()} == {1: (True, ["mobile:01***********"]), 2: (False, []), None: (True, ["email:a@****"])}
    assert pii.scan_parts(spark.createDataFrame([], "id long, part long, text string")).count() == 0


def test_no_row_holds_a_long_text(spark):
    """Two million characters in parts: after the cut no text is longer than a chunk."""
    parts = spark.range(1000).select(F.lit(1).alias("id"), F.col("id").alias("part"), F.repeat(F.lit("word "), 400).alias("text"))
    plan = pii.scan_parts(parts)._jdf.queryExecution().optimizedPlan().toString()
    assert str(fixed.PII_CHUNK) in plan
    assert pii.scan_parts(parts.unionByName(spark.sql("select 1 as id, 1000L as part, '010-1234-5678' as text"))).first().found.kinds == ["mobile"]
