"""The pipeline's line dedup searches by chunks of a rolling hash first and then completes what they leave."""

import numpy as np

from vigil.llm import linededup
from tests.llm.test_passages import _kept


def _plain_chunks(text):
    """(first line, lines) of each chunk, by a plain walk with the rolling hash."""
    import hashlib

    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, first = [], 0
    for i in range(len(lines)):
        rolling = h[i] + (h[i - 1] * linededup.FACTOR if i else 0)
        if rolling % linededup.MODULUS % linededup.DIVISOR == 0 or i == len(lines) - 1:
            out.append((first, lines[first : i + 1]))
            first = i + 1
    return out


def _rows():
    rng = np.random.default_rng(21)
    own = lambda n: [" ".join(rng.integers(0, 10**6, 4).astype(str)) for _ in range(n)]
    shared = [own(12) for _ in range(5)] + [[" ".join(["long", str(k), *["word"] * 60])] for k in range(3)]
    rows = [(d, "\n".join([*own(rng.integers(0, 4)), *shared[d % 8], *shared[rng.integers(0, 8)][: rng.integers(1, 13)], *own(rng.integers(0, 4))])) for d in range(40)]
    # the pair across two chunks that go has its first place between them
    left, right = shared[0], shared[1]
    return rows + [(40, "\n".join([*left, *right])), (41, "\n".join(["x", left[-1], right[0], "y"])), (42, rows[3][1]), (42, rows[3][1]), (43, ""), (44, None)]


def test_places_are_the_chunks(spark):
    rows = [(i, t) for i, t in _rows() if t is not None]
    found = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", linededup.placed_chunks(linededup.F.col("text")).alias("c")).collect()
    for r in found:
        want = [(s, x) for s, x in _plain_chunks(r.text) if len(x) > 1 or len(x[0].split()) > linededup.LONG]
        assert [(c.k, c.passage) for c in r.c] == [(s * linededup.PLACES + len(x), "\n".join(x)) for s, x in want]


def test_chunks_are_searched_first_and_pairs_only_outside_them(spark, monkeypatch):
    searched, later = [], linededup._later

    def spy(places, whole):
        searched.append([(r[0], r[2], r[3]) for r in places.collect()])
        return later(places, whole)

    monkeypatch.setattr(linededup, "_later", spy)
    rows = _rows()
    got = linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r.doc_id, r.text) for r in got], key=key) == sorted(_kept(rows), key=key)
    chunks, pairs = searched
    assert {c for _, _, c in chunks} == {"\n".join(x) for _, t in rows if t is not None for _, x in _plain_chunks(t) if len(x) > 1 or len(x[0].split()) > linededup.LONG}
    first, goes = {}, {}  # by document and line, the chunk that goes
    for d, k, c in sorted(set(chunks)):
        if first.setdefault(c, (d, k)) != (d, k):
            goes |= {(d, k // linededup.PLACES + i): k for i in range(k % linededup.PLACES)}
    assert len(goes) > 100
    every = [(d, 2 * k) for d, t in rows if t is not None for k in range(t.count("\n"))]
    inside = {(d, k) for d, k in every if (d, k // 2) in goes and goes[d, k // 2] == goes.get((d, k // 2 + 1))}
    assert inside and sorted((d, k) for d, k, _ in pairs if k % 2 == 0) == sorted(x for x in every if x not in inside)
    assert not {(d, k // 2) for d, k, _ in pairs if k % 2} & set(goes)
