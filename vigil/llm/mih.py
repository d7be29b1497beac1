"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each component above 0. Equal codes are merged, each
keeping its k + 1 smallest ids, which is all that a top-k can use. Codes are dealt to
shards, queries to blocks, and each pair of a shard and a block is searched in one
task: a bounded shard is indexed by each of its code's segments of ``SEGMENT`` bits,
and a block's queries probe all words at segment distance 0, then 1, and so on. After
distance s in all m segments every code within ``m * (s + 1) - 1`` has been seen, so a
query is done as soon as its k-th best verified distance is covered; its best k rows
of the shard then meet those of the other shards. Nothing is approximate. A shard is
read once for each block, so blocks are as large as a task can search (``QUERIES``)
and smaller only while there are fewer tasks than cores.

Defined results: null vectors are neither queries nor found; a query does not find
its own id; equal distances rank by id; rows with one id and one code count once; a
table of fewer than k others gives them all; missing components count as bits 0, also
where queries and rows differ in length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.store import scope, written

SEGMENT = 16
SHARD = 400_000  # codes
QUERIES = 65_536  # codes of a block at most: each block reads every shard once
LEAST = 512  # codes of a block at least, where smaller blocks keep more tasks busy


def sign_code(embedding: Column, words: int) -> Column:
    """64-bit words, lowest component first: a bit for each component above 0."""

    def word(k: int) -> Column:
        bits = F.transform(F.slice(embedding, 64 * k + 1, 64), lambda x, i: F.call_function("shiftleft", (x > 0).cast("long"), i))
        return F.aggregate(F.filter(bits, lambda b: b.isNotNull()), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.when(embedding.isNotNull(), F.array(*map(word, range(words))))


def masks(bits: int, distance: int) -> np.ndarray:
    """All words of that many bits with that many ones."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(bits), distance)], np.int64)


class Index:
    """Multi-index hashing over the codes of one shard (rows of 64-bit words)."""

    def __init__(self, codes: np.ndarray, segment: int = SEGMENT):
        self.codes, self.bits = codes, segment
        self.tables = []
        for k in range(codes.shape[1] * 64 // segment):
            value = self.segment(codes, k)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << segment) + 1))))

    def segment(self, codes: np.ndarray, k: int) -> np.ndarray:
        per = 64 // self.bits
        return (codes[:, k // per] >> np.uint64(k % per * self.bits) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def within(self, code: np.ndarray, weight: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of all codes as near as the nearest ones whose weights sum to ``enough``."""
        found, far = np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = [int(self.segment(code[None, :], k)[0]) for k in range(len(self.tables))]
        for s in range(self.bits + 1):
            probes = masks_of(self.bits, s)
            new = [found]
            for (order, first), value in zip(self.tables, own):
                at = probes ^ value
                begin, n = first[at], first[at + 1] - first[at]
                some = n > 0
                begin, n = begin[some], n[some]
                ends = np.cumsum(n)
                if len(ends):
                    new.append(order[np.repeat(begin - ends + n, n) + np.arange(ends[-1])])
            found = np.unique(np.concatenate(new))
            far = np.bitwise_count(self.codes[found] ^ code).sum(axis=1, dtype=np.int64)
            covered = len(self.tables) * (s + 1) - 1
            inside = far <= covered
            if weight[found[inside]].sum() >= enough or len(found) == len(self.codes):
                break
        order = np.argsort(far, kind="stable")
        total = np.cumsum(weight[found[order]])
        last = far[order][min(np.searchsorted(total, enough), len(order) - 1)] if len(order) else 0
        keep = far <= last
        return found[keep], far[keep]


_masks: dict[tuple[int, int], np.ndarray] = {}


def masks_of(bits: int, distance: int) -> np.ndarray:
    if (bits, distance) not in _masks:
        _masks[bits, distance] = masks(bits, distance)
    return _masks[bits, distance]


def _search(k: int):
    """A function for one shard and one block: its queries' nearest k + 1 rows of the shard."""

    def search(_, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(shard):
            codes = np.array(shard["code"].tolist(), np.int64).view(np.uint64).reshape(len(shard), -1)
            index, ids = Index(codes), shard["ids"].tolist()
            weight = np.fromiter(map(len, ids), np.int64, len(ids))
            for code in queries["code"]:
                rows, far = index.within(np.array(code, np.int64).view(np.uint64), weight, k + 1)
                best = sorted((int(d), int(i)) for r, d in zip(rows.tolist(), far.tolist()) for i in ids[r])[: k + 1]
                out += [(code, d, i) for d, i in best]
        return pd.DataFrame(out, columns=["code", "distance", "neighbor_id"])

    return search


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance: each query's k nearest rows by Hamming distance."""
    with scope():
        longest = max(df.agg(F.max(F.size(embedding))).first()[0] or 1 for df in (queries, rows))
        words = -(-max(1, longest) // 64)
        coded = lambda df: df.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("id"), sign_code(F.col(embedding), words).alias("code"))
        base = written(coded(rows).distinct(), "codes")
        first = base.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
        classes = written(first.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "code-classes", keep=True)
        asked = written(coded(queries).distinct(), "queries", keep=True)
        wanted = asked.select("code").distinct()
        shards, asking = -(-max(1, classes.count()) // shard), max(1, wanted.count())
        tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
        blocks = max(-(-asking // block), min(-(-asking // LEAST), -(-tasks // shards)))
        at = lambda n: F.pmod(F.xxhash64("code"), F.lit(n))
        left = wanted.select("code", at(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        right = classes.select("code", "ids", at(shards).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_search(k), "code array<long>, distance long, neighbor_id long")
        near = found.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("distance", "neighbor_id"))).where(F.col("n") <= k + 1)
        mine = asked.withColumnRenamed("id", "query_id").join(near.drop("n"), "code").where("query_id <> neighbor_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
        return mine.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
