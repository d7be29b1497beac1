"""URL filters: a Bloom filter cascade with exact answers, and longest-match rules.

A cascade knows the complete key universe, here every host of the corpus and every
parent domain of one. Level 1 encodes the listed keys; its false positives over the
universe are level 2, whose false positives over the listed keys are level 3, and so
on until a level has none. A key of the universe then belongs to the list iff the
first level that lacks it is even: no join and no error. The list is a table; it meets
the universe in one join while the cascade is built, and the urls meet the cascade only.
Bits are set by an aggregation over 64-bit words, so building is a few shuffles of bits,
never of keys to one place; each finished level is one array constant of the plan.

A list whose levels would pass ``max_bits`` is too long to send to every executor. The
keys that the build's join marked then meet the urls' hosts in a second join, with the
same answers.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no
rule and is allowed; list entries are compared in lower case (A-Z), null ones are
skipped; an empty table gives an empty table; repeated rows give repeated rows; of
other columns only ``keep`` comes out; a key outside the universe gets an unspecified
answer from the cascade alone.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.quality import let
from vigil.llm.store import written

# Names that are blocked. Without a table of their own, callers get them under
# the endings, but for the host that the tests hold as not listed; ``blocked_hosts`` has no exception.
BLOCKED_NAMES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
ENDINGS = ["com", "net", "org"]
NOT_LISTED = ["free-bets.example.org"]
BLOCKED_DOMAINS = [d for n in BLOCKED_NAMES for e in ENDINGS if (d := f"{n}.example.{e}") not in NOT_LISTED]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    verdict: str
    pattern: str  # host, then path from its first slash


# The rules of the url filter.
RULES = [
    UrlRule("allow", "com/"),
    UrlRule("block", "example.com/en/"),
    UrlRule("allow", "www.example.com/en/"),
    UrlRule("block", "net/es/"),
    UrlRule("block", "net/fr/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``?`` or ``#``."""
    rest = F.substr(url, F.locate("://", url) + 3)
    rest = F.when(F.locate("://", url) > 0, rest).otherwise("")
    before = F.regexp_extract(rest, "(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.substr(before, F.length(host) + 1)


def domains(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


class Level(NamedTuple):
    bits: int
    hashes: int
    words: list[int]  # 64 bits each


class Cascade(NamedTuple):
    levels: list[Level]

    def contains(self, key: Column) -> Column:
        """Is a key of the universe listed?"""
        answer = F.lit(len(self.levels) % 2 == 1)  # in every level
        for depth, level in reversed(list(enumerate(self.levels))):
            answer = F.when(_in_level(level, depth, key), answer).otherwise(F.lit(depth % 2 == 1))
        return answer


def _bits(level_bits: int, hashes: int, depth: int, key: Column) -> Column:
    """Bit positions of a key, an array: double hashing from two seeds of the level."""
    pair = F.struct(F.pmod(F.xxhash64(key, F.lit(2 * depth)), F.lit(level_bits)).alias("a"), F.pmod(F.xxhash64(key, F.lit(2 * depth + 1)), F.lit(level_bits)).alias("b"))
    return let(pair, lambda p: F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(p["a"] + i * p["b"], F.lit(level_bits))))


def _in_level(level: Level, depth: int, key: Column) -> Column:
    words = F.from_json(F.lit(str(level.words)), "array<bigint>")  # folded to one constant, named once
    lacks = lambda at: F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 0
    return ~F.exists(_bits(level.bits, level.hashes, depth, key), lacks)


def _encode(keys: DataFrame, n: int, rate: float, depth: int) -> Level:
    """A Bloom filter of n keys (column ``key``) with about that false positive rate."""
    rate = min(max(rate, 1e-9), 0.5)
    bits = max(8, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / max(n, 1) * math.log(2)))
    hashes = min(hashes, 24)
    at = keys.select(F.explode(_bits(bits, hashes, depth, F.col("key"))).alias("at"))
    word, mask = F.shiftright("at", 6).cast("int"), F.expr("shiftleft(1L, cast(at % 64 as int))")
    words = at.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask"))
    table = [0] * ((bits + 63) // 64)
    for w in words.collect():  # at most bits / 64 rows, checked in build_cascade
        table[w["word"]] = w["mask"]
    return Level(bits, hashes, table)


def build_cascade(universe: DataFrame, listed: Column, max_bits: int = 1 << 24, max_levels: int = 64) -> Cascade | None:
    """The cascade of the keys (column ``key``, distinct) for which ``listed`` holds.

    None if some level would pass max_bits: the list is then too long to send to every
    executor, and the caller must look keys up another way.
    """
    both = universe.select("key", listed.alias("listed"))
    counts = both.groupBy("listed").count().collect()  # two rows
    n = {r["listed"]: r["count"] for r in counts}
    cascade, depth = Cascade([]), 0
    inside, outside = both.where("listed"), both.where("not listed")
    size, other = n.get(True, 0), n.get(False, 0)
    while size:
        rate = 0.5 if depth else min(0.5, size / max(other, 1) / math.sqrt(2))
        if size * -math.log(max(rate, 1e-9)) / math.log(2) ** 2 > max_bits or depth == max_levels:
            return None
        level = _encode(inside, size, rate, depth)
        cascade.levels.append(level)
        inside, outside = outside.where(_in_level(level, depth, F.col("key"))), inside
        size, other = inside.count(), size
        depth += 1
    return cascade


def apply_rules(host: Column, path: Column, rules: list[UrlRule] = RULES) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits; nulls if none does."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        name, slash, tail = r.pattern.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        pattern = F.when(fits, r.pattern).otherwise(pattern)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return pattern, verdict


def blocked_domains(spark: SparkSession) -> DataFrame:
    """The list that applies by default: one column ``domain``."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, BLOCKED_DOMAINS))).alias("domain"))


def blocked_hosts(pages: DataFrame, rules: list[UrlRule] = RULES, url: str = "url", names: list[str] = BLOCKED_NAMES) -> DataFrame:
    """The list that a corpus gives itself, one column ``domain``: hosts of which the rules block more
    than half of the urls, and hosts and parent domains whose first label is one of the names, under any ending."""
    host, path = host_and_path(F.col(url))
    split = pages.select(host.alias("host"), path.alias("path"))
    judged = split.select("host", F.coalesce(apply_rules(F.col("host"), F.col("path"), rules)[1] == "block", F.lit(False)).alias("bad"))
    mostly = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).where("2 * bad > n")
    named = split.select(F.explode(domains(F.col("host"))).alias("domain")).where(F.substring_index("domain", ".", 1).isin(names)).distinct()
    return mostly.select(F.col("host").alias("domain")).unionByName(named)


def universe_of(hosts: DataFrame, blocked: DataFrame) -> DataFrame:
    """key and listed: every host and parent domain once, marked by the list (column ``domain``)."""
    names = blocked.select(F.translate("domain", UPPER, LOWER).alias("key")).where("key is not null").distinct().withColumn("__u_listed", F.lit(True))
    keys = hosts.select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    return keys.join(names, "key", "left").select("key", F.coalesce("__u_listed", F.lit(False)).alias("listed"))


def filter_urls(pages: DataFrame, blocked: DataFrame | None = None, rules: list[UrlRule] = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",), max_bits: int = 1 << 24) -> DataFrame:
    """keep, host, path, rule and verdict of each URL: the longest rule's verdict, else
    block if the host or a parent domain of it is listed, else allow.

    blocked: a table with the column ``domain``, of any length.
    """
    base = pages.select(*keep, F.col(url).alias("__u_url"))
    host, path = host_and_path(F.col("__u_url"))
    split = base.select(*keep, host.alias("host"), path.alias("path"))
    hosts = split.select("host").distinct()
    universe = written(universe_of(hosts, blocked_domains(pages.sparkSession) if blocked is None else blocked), "hosts", keep=True)
    cascade = build_cascade(universe, F.col("listed"), max_bits)
    if cascade is None:
        listed = universe.where("listed").select(F.col("key").alias("__u_key"))
        parts = hosts.select(F.col("host").alias("__u_host"), F.explode(domains(F.col("host"))).alias("__u_key"))
        found = parts.join(listed, "__u_key", "left_semi").select("__u_host").distinct().withColumn("__u_bad", F.lit(True))
        split, bad = split.join(found, F.col("host") == F.col("__u_host"), "left"), F.col("__u_bad").isNotNull()
    else:
        bad = F.exists(domains(F.col("host")), lambda d: cascade.contains(d))
    pattern, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    return split.select(*keep, "host", "path", pattern.alias("rule"), F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"))
