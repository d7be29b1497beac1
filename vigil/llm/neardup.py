"""Near-duplicates by the Jaccard similarity of word shingles.

Two texts link if their sets of ``SHINGLE``-word shingles have a similarity of
``LEAST`` or more, and the classes are the connected components.

Search. Pairs come from two searches. The first is operator 2's: 64-bit SimHash
fingerprints, here of the sets of five-word shingles, linked at 2 or fewer differing bits
by Golay keys. Two bits mean a similarity near 0.99, so this alone finds few pairs at
0.8; the second search finds the rest. ``BANDS`` times ``ROWS`` minima of shingle hashes
are taken of each text; texts that agree in all rows of a band meet. Two texts of
similarity s meet in a band with probability s ** ROWS, and in some band with 0.9998 at
0.8. Texts with equal sets are merged first. Every pair that meets in a group of up to
``ALL`` members is verified on the whole sets, by 64-bit hashes.

Of larger groups no pair is lost, and none of the many needless ones is made. First each
member is verified against the group's smallest and its centre, the member that most
large groups hold, which makes one class of the edits of one text. Then all members of
large groups go through an exact join across these classes (``rare_links``): a set's
shingles are ordered from rare to common among the members, and two sets of the similarity
asked for share one of their first ones, so early in both that what follows can still
suffice. So a passage that thousands of texts share brings none of them together; a shingle
that only one class has brings nothing; and pairs inside a class are not made. What is
left is verified on the whole sets. Any pair of members is so decided exactly.

Defined results: null and empty texts have the empty set and are one class; fewer
words than a shingle make one shingle; rows with equal ids and texts share a class; a
null id is the smallest of its class only if all of it are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from vigil.llm import worker
from vigil.llm.simhash import BROADCAST_KEYS, SEED, components, links
from vigil.llm.store import arrow_rows, scope, written

SHINGLE = 5
LEAST = 0.8
ROWS, BANDS = 4, 16
ALL = 32  # members of a group in which all pairs are verified at once
COMMON = 1 << 17  # shingles whose counts all tasks get
ROWS_AT_ONCE = 500  # texts that a task hands to Python together
MOST = 4096  # fingerprints of a Golay key's group
_FACTORS = np.random.default_rng(SEED).integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    n = min(n, len(words))
    start, end = (end - size)[: len(words) - n + 1], end[n - 1 :]
    return np.unique(np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(start.tolist(), end.tolist())), np.uint64, len(start)))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set of hashes."""
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for k in range(0, len(found), 256):
        part = found[k : k + 256]
        mixed = (part ^ (part >> np.uint64(31)))[:, None] * _FACTORS
        np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of hashes: the bits that over half of them set."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(found), 1 << 14):
        counts += np.unpackbits(found[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.int64)[0])


@F.pandas_udf(StructType([StructField("node", LongType()), StructField("fp", LongType()), StructField("bands", ArrayType(LongType()))]))
def _sketches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    from xxhash import xxh64_intdigest

    worker.begin("neardup")
    for texts in parts:
        nodes, prints, keys = [], [], []
        for text in texts.fillna(""):
            found = shingles(text)
            nodes.append(xxh64_intdigest(found.tobytes(), SEED))
            prints.append(fingerprint(found))
            keys.append(bands(found).view(np.int64))
        yield pd.DataFrame({"node": np.array(nodes, np.uint64).view(np.int64), "fp": np.array(prints, np.int64), "bands": keys})


def _sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The set of each node's text; few rows at a time, as sets are larger than their texts."""
    worker.begin("neardup")
    for frame in parts:
        for k in range(0, len(frame), 256):
            part = frame.iloc[k : k + 256]
            yield pd.DataFrame({"node": part["node"], "set": [shingles(text).view(np.int64) for text in part["text"].fillna("")]})


def _group_pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in parts:
        met = {(min(p), max(p)) for members in frame["members"] for p in combinations(members.tolist(), 2)}
        yield pd.DataFrame(np.array(sorted(met), np.int64).reshape(-1, 2), columns=["a", "b"])


def candidates(keyed: DataFrame, all_pairs: int = ALL) -> tuple[DataFrame, DataFrame]:
    """From rows (key, node): pairs (a, b), a < b, to verify, which are all of small groups and
    stars of large ones; and the nodes of large groups."""
    wide = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where(F.col("n") > all_pairs).drop("n"), "neardup-wide")
    small = wide.count() <= BROADCAST_KEYS
    side = F.broadcast(wide) if small else wide
    groups = keyed.join(side, "key", "left_anti").groupBy("key").agg(F.collect_list("node").alias("members")).where(F.size("members") > 1)
    near = groups.select("members").mapInPandas(_group_pairs, "a long, b long")
    seats = written(keyed.join(side, "key"), "neardup-seats")
    held = seats.groupBy("node").agg(F.count("*").alias("held"))
    centre = seats.join(held, "node").groupBy("key").agg(F.max(F.struct("held", "node"))["node"].alias("centre"))
    middle = seats.join(F.broadcast(centre) if small else centre, "key").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    first = seats.where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return near.unionByName(middle).unionByName(first), held.select("node")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, set) have that similarity or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("n"))
    return common.where(F.col("c") >= (F.col("n") - F.col("c")) * F.lit(least)).select("a", "b")


def _often(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often the shingles that some of a few thousand sets share are in them."""
    for frame in parts:
        for k in range(0, len(frame), 2048):
            found, n = np.unique(np.concatenate([np.asarray(x, np.int64) for x in frame["set"].iloc[k : k + 2048]]), return_counts=True)
            yield pd.DataFrame({"shingle": found[n > 1], "often": n[n > 1]})


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of the sets (column ``set``) hold, ``COMMON`` at most, sorted, and how often; a guess, as counts of one are left out."""
    counted = sets.select("set").mapInPandas(_often, "shingle long, often long").groupBy("shingle").agg(F.sum("often").alias("often"))
    found = counted.orderBy(F.desc("often"), "shingle").limit(COMMON).toArrow()
    order = np.argsort(found["shingle"].to_numpy())
    return found["shingle"].to_numpy()[order], found["often"].to_numpy()[order]


def rare_links(sets: DataFrame, least: float, common: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Pairs (a, b), a < b, to verify of rows (node, class, set), among which are all pairs of
    different classes that have the similarity asked for.

    Every set is taken in one order, first the shingles that are not common, then the others from rare to
    frequent; no pair hangs on what is given as common. Sets x and y of that similarity share least / (1 + least) * (|x| + |y|) shingles or more. With the first
    one that they share at place i of x, at most |x| - i can be shared, so |y| is at most ``most``,
    and the other way round; and |y| is least * |x| or more, so only the first places can be it.
    """
    sent = sets.sparkSession.sparkContext.broadcast((np.zeros(0, np.int64),) * 2 if common is None else common)

    def first_places(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        usual, often = sent.value
        for frame in parts:
            for k in range(0, len(frame), 256):
                out = []
                for node, named, found in zip(*(frame[c].iloc[k : k + 256] for c in ("node", "class", "set"))):
                    found = np.sort(found)
                    if len(usual):
                        at = np.minimum(np.searchsorted(usual, found), len(usual) - 1)
                        found = found[np.argsort(np.where(usual[at] == found, often[at], 0), kind="stable")]
                    size = len(found)
                    n = size - int(np.ceil(size * least - 1e-6)) + 1
                    most = np.floor((size - np.arange(n)) * ((1 + least) / least) - size + 1e-6).astype(np.int64)
                    out.append(pd.DataFrame({"shingle": found[:n], "class": named, "node": node, "size": size, "most": most[: len(found[:n])]}))
                yield pd.concat(out)

    with scope():
        rows = written(sets.where(F.size("set") > 0).select("node", "class", "set").mapInPandas(first_places, "shingle long, class long, node long, size long, most long"), "neardup-rare", keep=True)
        sent.destroy()
        of = rows.groupBy("shingle", "class").agg(F.min("size").alias("size"), F.max("most").alias("most"))
        several = of.groupBy("shingle").agg(F.count("*").alias("classes")).where("classes > 1").select("shingle")
        of = written(of.join(several, "shingle", "left_semi"), "neardup-classes", keep=True)
    side = lambda df, k: df.select("shingle", *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c != "shingle"])
    fits = (F.col("size_x") <= F.col("most_y")) & (F.col("size_y") <= F.col("most_x"))
    classes = side(of, "x").join(side(of, "y"), "shingle").where((F.col("class_x") < F.col("class_y")) & fits).select("shingle", "class_x", "class_y")
    found = classes.join(side(rows, "x"), ["shingle", "class_x"]).join(side(rows, "y"), ["shingle", "class_y"]).where(fits)
    return found.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def simhash_candidates(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Pairs (a, b), a < b, of nodes whose fingerprints are equal or linked, from rows (node, fp):
    the smallest nodes of linked fingerprints, and each other node with the smallest of its own."""
    first = written(prints.groupBy("fp").agg(F.min("node").alias("least")), "neardup-prints")
    of = lambda side: first.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_node"))
    linked = links(first.select("fp"), most).join(of("a"), "a").join(of("b"), "b")
    linked = linked.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    equal = prints.join(first, "fp").where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return linked.unionByName(equal)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = LEAST, most: int = MOST, all_pairs: int = ALL) -> DataFrame:
    """doc_id, component_id (the smallest id of its class), class_id (a name of the class,
    even if ids repeat), key_a and key_b (hashes of the row's id and text) of every row."""
    with scope(), arrow_rows(docs.sparkSession, ROWS_AT_ONCE):
        row = (F.col(doc_id), F.col(text))
        key_a, key_b = F.xxhash64(*row).alias("key_a"), F.xxhash64(*row, F.lit(1)).alias("key_b")
        marked = docs.select(F.col(doc_id).alias("doc_id"), key_a, key_b, _sketches(F.col(text)).alias("s"))
        marked = written(marked.select("doc_id", "key_a", "key_b", "s.*"), "sketches", keep=True)
        classes = marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("key_a", "key_b")).alias("k"), F.min("bands").alias("bands"), F.min("fp").alias("fp"))
        classes = written(classes, "classes")
        met, crowd = candidates(classes.select("node", F.explode("bands").alias("key")), all_pairs)
        pairs = written(met.unionByName(simhash_candidates(classes.select("node", "fp"), most)).distinct(), "neardup-pairs")
        crowd = written(crowd, "neardup-crowd")
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        ends = written(classes.join(ends, "node", "left_semi").select("node", "k.*"), "neardup-ends")
        side = F.broadcast(ends) if ends.count() <= BROADCAST_KEYS // 4 else ends
        texts = docs.select(key_a, key_b, F.col(text).alias("text")).join(side, ["key_a", "key_b"])
        # repeated rows would be verified once each: one text of a node is enough, chosen after the sets, which are equal
        sets = written(texts.select("node", "text").mapInPandas(_sets, "node long, set array<long>").dropDuplicates(["node"]), "neardup-sets")
        joined = components(verified(pairs, sets, least))
        if crowd.limit(1).count():  # each of them has pairs, so a set
            joined = written(joined, "neardup-joined")
            known = sets.join(crowd, "node", "left_semi").join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("class"), "set")
            known = written(known, "neardup-known")
            met = written(rare_links(known, least, common_shingles(known)), "neardup-rare-pairs")
            linked = verified(met, known, least)
            name = lambda k: known.select(F.col("node").alias(k), F.col("class").alias(f"{k}_class"))
            wider = components(linked.join(name("a"), "a").join(name("b"), "b").select(F.col("a_class").alias("a"), F.col("b_class").alias("b")))
            wider = written(wider.select(F.col("node").alias("root"), F.col("root").alias("wider")), "neardup-wider")
            alone = wider.join(joined, "root", "left_anti").select(F.col("root").alias("node"), F.col("wider").alias("root"))
            joined = joined.join(wider, "root", "left").select("node", F.coalesce("wider", "root").alias("root")).unionByName(alone)
        of = classes.join(joined, "node")
        roots = of.groupBy("root").agg(F.min("least").alias("smallest"))
        linked = of.join(roots, "root").select("node", "smallest", "root")
        named = classes.join(linked, "node", "left").select("node", F.coalesce("smallest", "least").alias("component_id"), F.coalesce("root", "node").alias("class_id"))
        return marked.join(written(named, "named", keep=True), "node", "left").select("doc_id", "component_id", "class_id", "key_a", "key_b")
