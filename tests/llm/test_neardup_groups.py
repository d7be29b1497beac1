"""Near duplicates in large groups: texts that share a passage, chains of edits, and small groups taken as large ones, against brute force."""

from itertools import combinations

import numpy as np
import pytest

from tests.llm.test_neardup import _rows, _set, _similar
from vigil.llm import neardup


def _classes(rows):
    """id to smallest id of its class, by all pairs."""
    sets = {}
    for i, t in rows:
        sets.setdefault(_set(t), []).append(i)
    root = {s: s for s in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for a, b in combinations(sets, 2):
        if _similar(a, b):
            links += 1
            root[find(a)] = find(b)
    least = {}
    for s, ids in sets.items():
        least[find(s)] = min([least.get(find(s), ids[0]), *ids])
    return {i: least[find(s)] for s, ids in sets.items() for i in ids}, links


def _templates(n, passage, own, shared, step=0):
    """n texts that share a passage and have own words; each two of them share some more."""
    rng = np.random.default_rng(passage + own + shared)
    base = " ".join(f"p{k}" for k in range(passage))
    rows = []
    for k in range(n):
        pair = " ".join(f"s{k // 2}x{j}" for j in range(shared))
        tail = " ".join(f"o{k}x{j}" for j in rng.permutation(own + step * (k % 7)))
        rows.append((k, f"{base} {pair} {tail}"))
    return rows


def _found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, **more).collect()}


@pytest.mark.parametrize("shared, own", [(13, 124), (16, 121), (40, 100)])
def test_pairs_among_texts_with_one_passage(spark, shared, own):
    """600 texts, all a little under 0.8 similar to each other for the passage they share, in pairs just over it."""
    rows = _templates(600, 1004, own, shared)
    want, links = _classes(rows[:60])
    assert links == 30 and len(set(want.values())) == 30  # as pairs, and pairs only
    assert _found(spark, rows) == {k: k - k % 2 for k in range(600)}


def test_texts_with_one_passage_and_tails_of_several_lengths(spark):
    rows = _templates(300, 400, 40, 12, step=6) + _templates(40, 400, 0, 0)[:1]
    rows[-1] = (900, rows[-1][1])
    want, _ = _classes(rows)
    assert _found(spark, rows) == want


def test_chains_of_edits(spark):
    """Each text is similar to the next few only; the chain is one class."""
    words = [f"w{k}" for k in range(260)]
    rows = [(k, " ".join([*words[:4], *(f"e{j}" for j in range(3 * k, 3 * k + 60)), *words])) for k in range(80)]
    want, _ = _classes(rows)
    assert _found(spark, rows) == want


@pytest.mark.parametrize("all_pairs", [2, 5])
def test_all_groups_as_large_ones(spark, all_pairs):
    rows = [r for r in _rows() if r[0] is not None]
    want, _ = _classes(rows)
    assert _found(spark, rows, all_pairs=all_pairs) == want


def test_rare_links_hold_every_similar_pair(spark):
    """Of random sets on both sides of the threshold, in classes of their own or shared ones."""
    rng = np.random.default_rng(9)
    core = rng.integers(0, 2**62, 60)
    sets = []
    for k in range(120):
        keep = rng.random(60) < rng.choice([0.8, 0.9, 0.97])
        sets.append(sorted({*core[keep].tolist(), *rng.integers(0, 2**62, rng.integers(0, 15)).tolist(), *core[:1].tolist()}))
    rows = [(k, k if k % 3 else 1000, s) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, class long, set array<long>")
    want = {(a, b) for a, b in combinations(range(120), 2) if rows[a][1] != rows[b][1] and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    met = neardup.rare_links(df, 0.8)
    assert want and want <= {(r.a, r.b) for r in met.collect()}
    assert {(r.a, r.b) for r in neardup.verified(met, df, 0.8).collect()} == want
