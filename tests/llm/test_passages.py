"""The pipeline's line dedup against brute force and over planted passages."""

import numpy as np
import pytest

import corpus_pipeline
from vigil.llm import linededup


def _kept(rows):
    """(id, text) by brute force: a line goes if it is in a passage that an earlier place has."""
    seen, out = set(), {}
    for known, i, t in sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}):
        lines, gone = t.split("\n"), set()
        for k, line in enumerate(lines):
            for passage in ([tuple(lines[k : k + 2])] if k + 1 < len(lines) else []) + ([(line,)] if len(line.split()) > linededup.LONG else []):
                if passage in seen:
                    gone |= set(range(k, k + len(passage)))
                seen.add(passage)
        out[known, i, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return [(i, None if t is None else out[i is not None, i or 0, t]) for i, t in rows]


@pytest.mark.parametrize("small", [500_000, 0])
def test_passages(spark, monkeypatch, small):
    monkeypatch.setattr(linededup, "BROADCAST_NUMBERS", small)
    rng = np.random.default_rng(12)
    words = " ".join(["long"] * 51)
    lines = [f"line {k}" for k in range(200)] + [words, words[5:], ""]
    rows = [(d, "\n".join(lines[s % len(lines)] for s in range(a, a + n))) for d, (a, n) in enumerate(zip(rng.integers(0, 203, 30).tolist(), rng.integers(1, 9, 30).tolist()))]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "x\nx\nx\nx"), (103, "x\nx\nx\nx"), (None, "line 7\nline 8"), (None, words), (104, words), (105, words[5:])]
    got = linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", linededup.F.length("text")).repartition(5)).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r.doc_id, r.text) for r in got], key=key) == sorted(_kept(rows), key=key)
    assert all(r.text is None or r.n_chars == len(r.text) for r in got)


def test_planted_passages_go_whole(spark):
    """Passages of 1 to 5 lines and over 50 words in documents of their own lines: all go but the first."""
    rng = np.random.default_rng(13)
    own = lambda n: [" ".join(rng.integers(0, 10**6, 8).astype(str)) for _ in range(n)]
    planted, rows = [], []
    for k in range(60):
        n = k % 5 + 1
        passage = [" ".join(rng.integers(0, 10**6, 60 // n + 1).astype(str)) for _ in range(n)]
        planted.append(passage)
        for copy in range(2):
            rows.append((2 * k + copy, "\n".join([*own(rng.integers(1, 5)), *passage, *own(rng.integers(1, 5))]), "s"))
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()}
    assert all("\n".join(p) in got[2 * k] for k, p in enumerate(planted))
    assert sum(all(x not in got[2 * k + 1] for x in p) for k, p in enumerate(planted)) == 60
    assert all(len(got[i].split("\n")) == len(t.split("\n")) - len(planted[i // 2]) * (i % 2) for i, t, _ in rows)
