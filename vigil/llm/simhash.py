"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, one for each bit that over half of the hashes of a text's
word shingles set. Two fingerprints link if they differ in at most 2 bits, and the
classes are the connected components.

Search. The fingerprint is cut into three segments of 21 or 22 bits. Of three
segments with at most 2 errors in all, one is free of errors and the next one has at
most 2 (pigeonhole). A segment is decoded with the perfect (23, 12) Golay code to the
indices of the codewords next to it, that is of all words at distance 1 or less from
it: one or six indices. Two segments at distance 2 or less have such an index in
common, as a word between them decodes to it. Each fingerprint so gets about 16 keys
(place, exact segment, codeword index of the next segment), 34 bits of selection.

Fingerprints are joined on keys only after equal ones are merged. Inside one key's
group links are found and verified by probing for the words at distance 1 that two
members share, in time linear in the group, and only a spanning set of them leaves
the task. Groups above ``most`` members, which no task should hold, take an exact
distributed way for the rest: members meet in a shuffle on their own words at
distance 0 or 1, where no group passes 65.

Components are found by alternating large-star and small-star steps, each written to
the shared folder.

Defined results: null and empty texts have fingerprint 0 and link like any other;
fewer words than a shingle make one shingle; rows with equal ids share a class; a
null id takes part in its class and is never its smallest unless alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from vigil.llm.store import scope, written

SHINGLE = 3
SEED = 42
MOST = 4096
BROADCAST_KEYS = 1_000_000  # numbers of keys whose groups pass MOST
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)


# ---- fingerprints


def fingerprint(text: str, n: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = min(n, len(words))
    counts, total = np.zeros(64, np.int64), len(words) - n + 1
    for k in range(0, total, 1 << 14):
        last = min(total, k + (1 << 14))
        h = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(start[k:last].tolist(), end[k + n - 1 : last + n - 1].tolist())), np.uint64, last - k)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def _fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        found = np.fromiter(map(fingerprint, texts.fillna("").tolist()), np.uint64, len(texts))
        yield pd.Series(found.view(np.int64))


# ---- the Golay code


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words modulo the generator."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _leaders() -> np.ndarray:
    """The one error pattern of weight 3 or less for each syndrome."""
    table = np.zeros(2048, np.int64)
    one = 1 << np.arange(23)
    patterns = [one, *(one[i] | one[i + 1 :] for i in range(22)), *(one[i] | one[j] | one[j + 1 :] for i in range(21) for j in range(i + 1, 22))]
    patterns = np.concatenate(patterns)
    table[_syndromes(patterns)] = patterns
    return table


_leader: list[np.ndarray] = []


def decode(words: np.ndarray) -> np.ndarray:
    """The index, 12 bits, of the codeword nearest to each 23-bit word."""
    if not _leader:
        _leader.append(_leaders())
    return (words ^ _leader[0][_syndromes(words)]) >> 11


def near_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """A row for each word: the codeword indices of it and of its neighbours at distance 1, first copies only, else -1."""
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the fingerprint, key) for every key of each."""
    rows, made = [], []
    for k, (low, bits) in enumerate(SEGMENTS):
        nlow, nbits = SEGMENTS[(k + 1) % len(SEGMENTS)]
        exact = (fps >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64)
        near = near_indices((fps >> np.uint64(nlow) & np.uint64((1 << nbits) - 1)).astype(np.int64), nbits)
        r, c = np.nonzero(near >= 0)
        rows.append(r)
        made.append(k << 40 | exact[r] << 12 | near[r, c])
    return np.concatenate(rows), np.concatenate(made)


def _key_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in parts:
        fps = frame["fp"].to_numpy(np.int64)
        r, k = keys(fps.view(np.uint64))
        yield pd.DataFrame({"key": k, "fp": fps[r]})


# ---- links


def _span(members: list[int]) -> list[tuple[int, int]]:
    """Edges that connect, in a list of fingerprints, just what links at 2 bits or fewer connect.

    Two words differ in at most 2 bits iff a word at distance 1 or less from both exists.
    """
    parent = {m: m for m in members}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    if len(members) <= 48:
        for i, a in enumerate(members):
            for b in members[:i]:
                if (a ^ b).bit_count() <= 2:
                    parent[root(a)] = root(b)
    else:
        met: dict[int, int] = {}
        flips = [0, *(1 << i for i in range(64))]
        for a in members:
            for f in flips:
                b = met.setdefault(a ^ f, a)
                if b != a:
                    parent[root(a)] = root(b)
    return [(m, r) for m in members if (r := root(m)) != m]


def _group_edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in parts:
        edges = {e for members in frame["members"] for e in _span([int(m) & (2**64 - 1) for m in members])}
        yield pd.DataFrame(np.array(sorted(edges), np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


def _ball_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flips = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for frame in parts:
        fps = frame["fp"].to_numpy(np.int64)
        for k in range(0, len(fps), 4096):
            part = fps[k : k + 4096]
            yield pd.DataFrame({"word": (part.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64), "fp": np.repeat(part, 65)})


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Edges (a, b) with the same components as all links among distinct fingerprints (column ``fp``)."""
    keyed = written(fps.mapInPandas(_key_rows, "key long, fp long"), "simhash-keys")
    large = written(keyed.groupBy("key").count().where(F.col("count") > most).select("key"), "simhash-large-keys")
    side = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    groups = keyed.join(side, "key", "left_anti").groupBy("key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    near = groups.select("members").mapInPandas(_group_edges, "a long, b long")
    ball = keyed.join(side, "key", "left_semi").select("fp").distinct().mapInPandas(_ball_rows, "word long, fp long")
    meet = ball.groupBy("word").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)  # 65 members at most
    far = meet.select(F.array_min("members").alias("b"), F.explode("members").alias("a")).where("a <> b").select("a", "b")
    return near.unionByName(far).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have an edge."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        with scope():
            # large star: each node's larger neighbours move to its smallest neighbour, or to itself
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            large = written(large, "large-star")
            # small star: each node and its smaller neighbours move to the smallest of them
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            small = written(small.select("e.a", "e.b").where("a <> b").distinct(), "small-star", keep=True)
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = small
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id of its class) of every row.

    Then class_id, a fingerprint of the class that is its own name even if ids repeat,
    and key_a, key_b, hashes of the row's id and text.
    """
    with scope():
        row = (F.col(doc_id), F.col(text))
        marked = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(*row).alias("key_a"), F.xxhash64(*row, F.lit(1)).alias("key_b"), _fingerprints(F.col(text)).alias("fp"))
        marked = written(marked, "fingerprints", keep=True)
        classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
        joined = components(links(classes.select("fp"), most))
        of = classes.join(joined, classes["fp"] == joined["node"])
        roots = of.groupBy("root").agg(F.min("least").alias("smallest"))
        linked = of.join(roots, "root").select("fp", "smallest", "root")
        named = classes.join(linked, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"), F.coalesce("root", "fp").alias("class"))
        found = marked.join(written(named, "named", keep=True), "fp", "left")  # written, so that rows of a common fingerprint can be split
        digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
        return found.select("doc_id", digits("fp").alias("fingerprint"), "component_id", digits("class").alias("class_id"), "key_a", "key_b")
