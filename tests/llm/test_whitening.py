"""Operator 13 against the dense covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import queries, whitening


def _dense(rows, components=8):
    """x, deviations, whitened (up to sign) and explained by the whole covariance."""
    size = max((len(v) for _, v in rows), default=0)
    x = np.array([[np.floor(1024 * float(c)) for c in v] + [0.0] * (size - len(v)) for _, v in rows]).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    d = x * n - sums
    deviation = [sum(int(v) ** 2 for v in row) for row in d]
    c = d / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    keep = values > 1e-12 * sum(deviation) / n**3
    values, vectors = values[keep], vectors[:, keep]
    return deviation, c @ vectors / np.sqrt(values), values / (sum(deviation) / n**3)


def _check(found, rows):
    deviation, whitened, explained = _dense(rows)
    got = {}
    for r in found:
        got.setdefault(r.vec_id, {})[r.component] = r
    signs = np.ones(len(explained))
    for k in range(len(explained)):
        at = int(np.abs(whitened[:, k]).argmax())
        signs[k] = np.sign(got[rows[at][0]][k + 1].whitened * whitened[at, k])
    assert len(found) == len(rows) * len(explained)
    for i, (key, _) in enumerate(rows):
        for k in range(len(explained)):
            r = got[key][k + 1]
            assert r.n == len(rows) and r.deviation == deviation[i] and r.identity_error <= 1e-9
            assert abs(r.whitened * signs[k] - whitened[i, k]) <= 1e-6 and abs(r.explained - explained[k]) <= 1e-9 * explained[k]


def test_query_is_that_of_the_dense_covariance(spark, data):
    found = queries.op13_embedding_whitening(spark, data)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    _check(found.collect(), rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(k, (rng.standard_normal(12) * np.arange(1, 13)).astype(np.float32).tolist()) for k in range(200)]
    good += [(300, [1.5] * 5), (301, []), (302, [-0.0] * 12)]
    bad = [(400, None), (401, [None, 1.0]), (402, [float("nan")] * 12), (403, [float("inf")] + [0.0] * 11), (None, None)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    for name in ("x", "n", "component", "w", "p", "at"):
        df = df.withColumn(name, F.lit("x"))
    _check(whitening.whiten(df.repartition(3)).collect(), good)
    doubled = whitening.whiten(df.unionByName(df).repartition(2)).collect()  # repeated rows count each
    assert len(doubled) == 2 * 203 * 8 and {r.n for r in doubled} == {406}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, []), (2, [])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.count() == 0 and found.columns[0] == "vec_id" and found.schema["component"].dataType.simpleString() == "int"


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(3).tolist()) for k in range(40)]
    _check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)


@pytest.mark.parametrize("values, basis", [(np.arange(300.0)[::-1], 60), (np.r_[np.full(20, 5.0), np.zeros(180)], 256), (np.r_[[9.0, 8.0], np.zeros(98)], 256), (np.ones(50), 256), (1.02 ** -np.arange(400.0), 48), (np.zeros(20), 256)])
def test_lanczos_restarts_and_breaks_down(values, basis):
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((len(values), len(values))))[0]
    a = (q * values) @ q.T
    passes = []
    found, vectors = whitening.lanczos(lambda v: passes.append(v.shape[1]) or a @ v, len(values), basis=basis)
    assert np.allclose(found, np.sort(values)[::-1][:8], rtol=1e-10, atol=1e-10)
    assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-12) and np.abs(a @ vectors - vectors * found).max() <= 1e-9
