"""The pipeline's near-duplicate stage against brute force."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from vigil.llm import neardup


def _set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _similar(x, y):
    return x == y or len(x & y) >= 0.8 * len(x | y)


def _rows():
    """Texts of 60 to 200 words, each with edited copies on both sides of 0.8; a group of copies of one text; odd rows."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(40):
        words = rng.integers(0, 5000, rng.integers(60, 200)).astype(str).tolist()
        rows.append(" ".join(words))
        for edits in (1, 2, 3, 8):
            copy = list(words)
            for at in rng.choice(len(copy), edits, replace=False):
                copy[at] = "new"
            rows.append(" ".join(copy))
    words = rng.integers(0, 5000, 120).astype(str).tolist()
    for k in range(60):
        rows.append(" ".join([*words[:k], f"x{k}", *words[k + 1 :]]))
    rows += [None, "", " \n", "a b", "A  b", "b a", rows[0]]
    return list(enumerate(rows)) + [(None, "no id"), (7000, None), (7000, None)]


@pytest.mark.parametrize("most", [4096, 20])
def test_classes_are_those_of_brute_force(spark, most):
    rows = _rows()
    sets = {t: _set(t) for _, t in rows}
    root = {z: z for z in sets.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(root, 2):
        if _similar(a, b):
            root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        least.setdefault(find(sets[t]), []).append(i)
    want = sorted((str(i), str(min((x for x in least[find(sets[t])] if x is not None), default=None))) for i, t in rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most=most).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("most", [4096, 100])
def test_many_edits_of_one_text_are_one_class(spark, most):
    """Each copy is 0.8 or more similar to the text and mostly less to the other copies."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(204)]
    rows = [(1000, " ".join(words), "s")]
    for k in range(500):
        copy = list(words)
        for at in rng.choice(np.arange(5, 199), 3, replace=False):
            copy[at] = f"e{k}x{at}"
        rows.append((k, " ".join(copy), "s"))
    rows += [(2000 + k, f"other {k} " * 20, "s") for k in range(3)]
    assert all(_similar(_set(rows[0][1]), _set(r[1])) for r in rows[1:501])
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), most=most).collect()
    assert {r.doc_id: r.component_id for r in found} == {r[0]: 0 if r[0] <= 1000 else r[0] for r in rows}


def test_stage_takes_edited_copies_out(spark):
    words = [f"w{k}" for k in range(200)]
    copy = [*words[:100], "edited", *words[101:]]
    rows = [(1, " ".join(words), "s"), (2, " ".join(copy), "s"), (3, "quite another text of some words", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()) == [1, 3]
    empty = docs.limit(0)
    assert corpus_pipeline.dedup_near(spark, empty, "").count() == 0
