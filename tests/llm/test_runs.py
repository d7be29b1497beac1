"""Operator 12 against brute force over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import queries, runs


def _brute(words, least=12):
    """(start, length, period) of all runs: the stretches of each period in which no smaller one holds."""
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    w = np.array([code[x] for x in words], np.int64)
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]]).astype(np.int8)
        turn = np.diff(same)
        for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
            length = b + q - a
            if length >= max(least, 2 * q) and not any((w[a + d : a + length] == w[a : a + length - d]).all() for d in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _texts(seed):
    rng = random.Random(seed)
    for _ in range(rng.randint(1, 6)):
        letters, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 120)
        words = [bytes([97 + rng.randrange(letters)]) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        yield words * rng.choice([1, 1, 2, 3])


@pytest.mark.parametrize("least", [2, 12])
def test_runs_are_those_of_brute_force(least):
    for seed in range(150):
        texts = list(_texts(seed))
        got = [[tuple(r) for r in found.tolist()] for found in runs._scan(texts, least)]
        assert got == [_brute(t, least) for t in texts], seed


def test_long_periods_and_many_rounds():
    rng = np.random.default_rng(3)
    body = [str(x).encode() for x in rng.integers(0, 50, 3000)]
    fib = [b"a", b"a b"]
    while len(fib[-1].split()) < 2000:
        fib.append(fib[-1] + b" " + fib[-2])
    texts = [body * 4, body[:1000] + body[:1000][::-1] + body[:997] * 3, [b"x"] * 5000, fib[-1].split(), body]
    assert [[tuple(r) for r in found.tolist()] for found in runs._scan(texts, 12)] == [_brute(t) for t in texts]


def _planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def _row(doc_id, text):
    words = _planted(doc_id, text)
    found = _brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, digest("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_is_that_of_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = queries.op12_periodic_runs(spark, data)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(_row(r.doc_id, r.text) for r in docs)
    assert any(r.n_runs for r in got.collect())


def test_odd_rows(spark, tmp_path):
    hit = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = [(1, None), (2, ""), (3, " \n\t\x0b\x0c\r "), (None, "a b " * 20), (4, "a b " * 20), (4, "a b " * 20), (5, "ü ü ü ü " * 9), (hit, "one"), (hit, None), (hit, " x  y\tz\n" * 9), (6, "w " * 100_000), (7, "A a " * 3 + "\x1f \x85 " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("runs", "collapsed", "n", "__x", "start"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    tell = lambda r: tuple(-1 if v is None else v for v in r)
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(tell(r) for r in got) == sorted(tell(_row(*r)) for r in rows)
    found = runs.find_runs(docs).where("doc_id = 4").first()
    assert found.collapsed == "a b" and [tuple(r) for r in found.runs] == [(0, 40, 2)] and found.n_words == 40
    assert runs.find_runs(docs.limit(0)).count() == 0
