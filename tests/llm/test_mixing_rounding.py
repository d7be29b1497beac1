"""Pivotal rounding recomputed in plain Python, and rows with equal or missing ids."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from vigil.llm import mixing


def _hash(*parts):
    """The engine's xxhash64 of numbers (8 bytes; 4 for a tuple of one) and text; nulls change nothing."""
    h = 42
    for p in parts:
        if p is not None:
            data = p.encode() if isinstance(p, str) else p[0].to_bytes(4, "little", signed=True) if isinstance(p, tuple) else p.to_bytes(8, "little", signed=True)
            h = xxh64_intdigest(data, h)
    return h - 2**64 if h >= 2**63 else h


def _plain(rows, block, seed=0):
    """(id, copies) of every row by plain rounding: blocks of items, pairs settled in order, level after level."""
    items = Counter()
    for i, t, s in rows:
        items[i, s, len((t or "").split()), _hash(t)] += 1
    size, count = Counter(), Counter()
    for (_, s, n, _), k in items.items():
        size[s] += n * k
        count[s] += 1
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    level, full = -1.0, None
    while True:
        now = [s for s in names if 2 * size[s] < weight[s] * level]
        if len(now) == full or len(now) == len(names):
            break
        full = len(now)
        level = (sum(size.values()) * 1.5 - sum(2 * size[s] for s in now)) / sum(weight[s] for s in names if s not in now)
    out = []
    for s in names:
        rate = min(2.0, min(2.0 * size[s], weight[s] * level) / size[s]) if size[s] else 0.0
        whole, blocks = math.floor(rate), max(1, math.ceil(count[s] / block))
        done = lambda x, up: out.extend([(x["id"], whole + (k < x["more"] + up)) for k in range(x["rows"])])  # noqa: B023, E731
        groups = {}
        for (i, s2, n, content), k in items.items():
            if s2 == s:
                h = _hash(i, s, content, (seed,))
                total = k * (rate - whole)
                x = dict(id=i, n=n, rows=k, more=math.floor(total), p=total - math.floor(total), h=h, key=(-n, h))
                groups.setdefault(_hash(h, (seed + 1,)) % blocks, []).append(x)
        salt = seed
        while True:
            left = {}
            for b, xs in groups.items():
                held = None
                for x in sorted(xs, key=lambda x: x["key"]):
                    if x["n"] == 0 or x["p"] <= 0:
                        done(x, int(_hash(x["h"], (salt,)) % 2**53 / 2**53 < x["p"]))
                    elif held is None:
                        held = x
                    else:
                        i, j = held, x
                        iu, jd, idn, ju = i["n"] * (1 - i["p"]), j["n"] * j["p"], i["n"] * i["p"], j["n"] * (1 - j["p"])
                        a, c = min(iu, jd), min(idn, ju)
                        rise = _hash(i["h"], j["h"], (salt,)) % 2**53 / 2**53 * (a + c) < c
                        clip = lambda p: max(0.0, min(1.0, p))
                        pi = clip(i["p"] + a / i["n"]) if rise else clip(i["p"] - c / i["n"])
                        pj = clip(j["p"] - a / j["n"]) if rise else clip(j["p"] + c / j["n"])
                        if (rise and a == iu) or (not rise and c == idn):
                            done(i, int(rise))
                            held = {**j, "p": pj}
                        else:
                            done(j, int(not rise))
                            held = {**i, "p": pi}
                if held is not None:
                    left.setdefault(b // block, []).append(held)
            if blocks <= 1:
                for xs in left.values():
                    done(xs[0], int(xs[0]["p"] >= 0.5))
                break
            groups, blocks, salt = left, math.ceil(blocks / block), salt + 1
    return out


def _rows(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(int(i) if i % 11 else None, " ".join(["w"] * int(rng.integers(0, 40))) if i % 13 else None, "abcdefg"[min(6, int(rng.exponential(2)))] if i % 9 else None) for i in range(n)]
    return rows + [rows[5]] * 30 + [rows[7]] * 3 + [(1, "same id", "a"), (1, "other text", "a"), (1, "same id", "b")]


@pytest.mark.parametrize("block,chunk", [(64, 4096), (4, 2)])
def test_equals_plain_rounding(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(mixing, "CHUNK", chunk)
    rows = _rows(14, 500)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [(r.doc_id, r.copies) for r in mixing.mix(df, block=block).collect()]
    assert Counter(got) == Counter(_plain(rows, block))


def test_one_hot_id(spark):
    """Rows of one id, equal or not, cost what rows of distinct ids cost, and meet their target."""
    n = 48_000
    spent = {}
    for name, i, t in (("distinct", F.col("id"), F.lit("a b c")), ("equal", F.lit(1), F.lit("a b c")), ("one id", F.lit(1), F.concat(F.lit("a b "), "id")), ("null", F.lit(None).cast("long"), F.lit("a b c"))):
        df = spark.range(n).select(i.alias("doc_id"), t.alias("text"), F.when(F.col("id") % 3 == 0, "s").otherwise("t").alias("source"))
        began = time.perf_counter()
        found = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows")).collect()
        spent[name] = time.perf_counter() - began
        assert sum(r.rows for r in found) == n
        assert all(abs(r.taken - r.target) <= 3 for r in found)
    assert max(spent.values()) < 3 * spent["distinct"] + 5


def test_many_sources(spark):
    rows = [(i, "w " * (i % 5 + 1), f"s{i:05d}") for i in range(3000)] + [(-1, "w", None)]
    sized = spark.createDataFrame([(s, len(t.split()), 1) for _, t, s in rows], "source string, size long, rows long").repartition(7)
    found = {r.source: r for r in mixing.targets(sized).collect()}
    total, names = 1.5 * sum(len(t.split()) for _, t, _ in rows), sorted(s for *_, s in rows if s) + [None]
    assert sum(r.target for r in found.values()) == pytest.approx(total)
    free = [s for s in names if found[s].target < 2 * found[s].source_size]
    rates = [found[s].target / mixing.WEIGHTS[names.index(s) % 3] for s in free]
    assert max(rates) == pytest.approx(min(rates)) and all(mixing.WEIGHTS[names.index(s) % 3] * rates[0] >= found[s].target - 1e-9 for s in names)
