"""Features, FTRL-proximal and scores recomputed in plain Python."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_mixing_rounding import _hash
from vigil.llm import textvec, toxicity

MASK = 2**64 - 1


def _word_hash(word):
    h = 0
    for k, c in enumerate(word):
        x = (ord(c) + 1) * 0xBF58476D1CE4E5B9 & MASK
        h += (x ^ (x >> 29)) * pow(textvec.BASE, k, 2**64)
    h = h & MASK ^ len(word) * 0x94D049BB133111EB & MASK
    return (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & MASK


def _features(text):
    mix = lambda h, shift: ((h ^ (h >> 31)) * (0x7FB5D329728EA185 + 2 * shift) & MASK) >> (64 - toxicity.BITS)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    h = [_word_hash(w) for w in re.findall(r"[a-z0-9'\u0080-\U0010ffff]+", low)]
    out = {mix(x, 0) for x in h}
    for gap in (1, 2):
        out |= {mix(a * (0xA24BAED4963EE407 + 2 * gap) + b * 0x9FB21C651E98DF25 & MASK, gap) for a, b in zip(h, h[gap:])}
    return sorted(out)


def _weight(z, n, l1):
    if l1 and abs(z) <= l1:
        return 0.0
    return -(z - math.copysign(l1, z) if l1 else z) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA)


def _train(rows):
    """The weight of every bucket and the intercept ('b')."""
    known = [(i, y, _features(t), _hash(i, (11,)) % toxicity.SHARDS) for i, t, y in rows]
    z, n = {}, {}
    for turn in range(toxicity.ROUNDS):
        dz, dn, parts = {}, {}, 0
        for shard in range(toxicity.SHARDS):
            own = sorted((x for x in known if x[3] == shard), key=lambda x: x[0])
            own = [own[k] for k in np.random.default_rng(turn).permutation(len(own))]
            parts += bool(own)
            zs, ns = dict(z), dict(n)
            for _, y, at, _ in own:
                w = {k: _weight(zs.get(k, 0.0), ns.get(k, 0.0), toxicity.L1 if k != "b" else 0) for k in [*at, "b"]}
                g = 1 / (1 + math.exp(-sum(w.values()))) - y
                for k, old in w.items():
                    before = ns.get(k, 0.0)
                    zs[k] = zs.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * old
                    ns[k] = before + g * g
            for k in ns:
                dz[k] = dz.get(k, 0.0) + zs[k] - z.get(k, 0.0)
                dn[k] = dn.get(k, 0.0) + ns[k] - n.get(k, 0.0)
        z = {k: z.get(k, 0.0) + v / parts for k, v in dz.items()}
        n = {k: n.get(k, 0.0) + v / parts for k, v in dn.items()}
    return {k: _weight(z[k], n[k], toxicity.L1 if k != "b" else 0) for k in z}


def _rows():
    rng = np.random.default_rng(15)
    words = [f"w{k}" for k in range(80)] + ["Ça", "это", "it's"]
    rows = []
    for i in range(240):
        text = rng.choice(words, rng.integers(0, 40)).tolist()
        if i % 3 == 0:
            text.insert(int(rng.integers(0, len(text) + 1)), "Moron," if i % 2 else "you FOOL")
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    return rows + [(900, None, 0), (901, "", 0), (902, "word " * 30_000 + "moron", 1)]


def test_equals_plain_python(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    want = _train(rows)
    assert {k for k, w in want.items() if w and k != "b"} == set(model[0].tolist())
    assert model[2] == pytest.approx(want["b"], rel=1e-5)
    assert model[1] == pytest.approx([want[k] for k in model[0].tolist()], rel=1e-4, abs=1e-6)
    for r in toxicity.score(docs, model).collect():
        s = sum(want.get(k, 0.0) for k in _features(r.text)) + want["b"]
        assert r.score == pytest.approx(1 / (1 + math.exp(-s)), rel=1e-3, abs=1e-5)
    again = toxicity.train(docs.drop("toxic").repartition(5), docs.select("doc_id", "toxic"))
    assert again[0].tolist() == model[0].tolist() and again[1].tolist() == model[1].tolist()


def test_clashing_names_and_bounds(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumns({c: F.lit(1) for c in ("shard", "y", "at", "id", "score", "bucket")})
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), max_labelled=50)
    got = toxicity.score(docs, model)
    assert got.columns == [*docs.columns] and got.count() == len(rows) and all(0 <= r.score <= 1 for r in got.collect())
