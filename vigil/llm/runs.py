"""Periodic runs of words by Crochemore's partition refinement.

A run is a stretch of words with smallest period q, at least twice as long as q, that no
neighbouring word extends. ``refine`` keeps, for the factors of length p = 1, 2, ..., the
classes of places where equal factors begin, as linked lists in order of place. Classes of
length p + 1 come from those of length p by splitting off the places before the small
classes of the last round: all parts of a split class but the largest, so that a place is
moved O(log n) times. Two neighbours of a class at distance p, when the factors have
length p, are a square of period p. As a link between neighbours only changes when a place
leaves, each link's life (its rounds from and to) is kept, and a link of distance g alive in
round g is a square. Squares of one period at consecutive places are one run. Classes that
can make no more squares, since all their places lie within p of each other or follow each
other at one distance of p or less, are let go from time to time.

Many texts are refined at once: each ends in a mark of its own, which no factor passes, so
texts share no class and a round costs a few array operations for all of them.

Defined results: a null or blank text has no words and no runs; words are compared byte by
byte; repeated rows give repeated rows; an empty table gives an empty table; columns that
are not kept are ignored. A text is one row and is refined in one task, with about 150 bytes
of memory a word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 12  # words of a run
WORDS = 1 << 19  # of texts refined together; a longer text is refined alone
SWEEP = 1.25  # rounds grow by this between two looks for classes that can go
WORD_GAP = "[ \\t-\\r]+"


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] of them, then those of start[1] and so on."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class _Classes:
    """Classes of places: ``perm`` has the places class by class, ``follow`` and ``before`` link a class in order."""

    def __init__(self, key: np.ndarray):
        n = len(key)
        self.perm = np.argsort(key, kind="stable")
        sorted_key = key[self.perm]
        first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        self.n = len(first)
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: self.n], self.size[: self.n] = first, np.diff(np.append(first, n))
        self.of, self.at = np.empty(n, np.int64), np.empty(n, np.int64)
        self.of[self.perm] = np.repeat(np.arange(self.n), self.size[: self.n])
        self.at[self.perm] = np.arange(n)
        same = sorted_key[1:] == sorted_key[:-1]
        a, b = self.perm[:-1][same], self.perm[1:][same]
        self.follow, self.before = np.full(n, -1), np.full(n, -1)
        self.follow[a], self.before[b] = b, a
        self.since = np.ones(n, np.int64)  # the round in which the link to follow was made
        self.moved = np.zeros(n, bool)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _relink(self, places: np.ndarray, to: np.ndarray, p: int) -> None:
        """From round p + 1 on places are followed by others; links that were squares are kept."""
        old = self.follow[places]
        changed = old != to
        places, old, to = places[changed], old[changed], to[changed]
        gap = old - places
        square = (old >= 0) & (self.since[places] <= gap) & (gap <= p)
        if square.any():
            self.squares.append((places[square], gap[square]))
        self.follow[places], self.since[places] = to, p + 1

    def split(self, places: np.ndarray, p: int) -> np.ndarray:
        """Classes of length p + 1 from those of length p and the small ones' places, sorted; returns the next small ones' places."""
        before = places - 1
        ok = places > 0
        ok[ok] = self.size[self.of[before[ok]]] > 1
        moving, into = before[ok], self.of[places[ok]]
        if not len(moving):
            return moving
        key = self.of[moving] << 32 | into
        order = np.argsort(key, kind="stable")
        moving, key = moving[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))  # of each group: same class, same class after it
        size, cls = np.diff(np.append(first, len(key))), key[first] >> 32

        # a class that is used up keeps its largest group as the rest
        new_class = np.concatenate([[True], cls[1:] != cls[:-1]])
        head = np.flatnonzero(new_class)
        number = np.cumsum(new_class) - 1
        taken = np.add.reduceat(size, head)
        largest = np.maximum.reduceat(size, head)
        used_up = taken == self.size[cls[head]]
        if used_up.any():
            stays = np.flatnonzero(used_up[number] & (size == largest[number]))
            stays = stays[np.unique(number[stays], return_index=True)[1]]
            keep = np.ones(len(size), bool)
            keep[stays] = False
            moving = moving[np.repeat(keep, size)]
            size, cls = size[keep], cls[keep]
            if not len(moving):
                return moving
            first = np.cumsum(size) - size
            new_class = np.concatenate([[True], cls[1:] != cls[:-1]])
            head = np.flatnonzero(new_class)
            number = np.cumsum(new_class) - 1
            taken, largest = np.add.reduceat(size, head), np.maximum.reduceat(size, head)
        owner = cls[head]
        rest = self.size[owner] - taken

        # links of the rest: stretches of places that leave are bridged
        self.moved[moving] = True
        prev, nxt = self.before[moving], self.follow[moving]
        begins, ends = (prev < 0) | ~self.moved[prev], (nxt < 0) | ~self.moved[nxt]
        class_of = np.repeat(number, size)
        by_place = lambda which: np.flatnonzero(which)[np.lexsort((moving[which], class_of[which]))]
        left, right = prev[by_place(begins)], nxt[by_place(ends)]
        has = left >= 0
        self._relink(left[has], right[has], p)
        has = right >= 0
        self.before[right[has]] = left[has]
        # links inside the groups
        to, back = np.append(moving[1:], -1), np.concatenate([[-1], moving[:-1]])
        to[first + size - 1], back[first] = -1, -1
        self._relink(moving, to, p)
        self.before[moving] = back

        # the places of the groups go to the end of their class's part of perm
        seat = _ranges((self.start[owner] + rest), taken)
        there = self.perm[seat]
        out = there[~self.moved[there]]
        old = self.at[moving]
        holes = old[old < np.repeat(self.start[owner] + rest, taken)]
        self.perm[holes], self.at[out] = out, holes
        self.perm[seat], self.at[moving] = moving, seat
        self.moved[moving] = False
        named = self.n + np.arange(len(size))
        self.n += len(size)
        self.start[named], self.size[named] = seat[first], size
        self.of[moving] = np.repeat(named, size)
        self.size[owner] = rest

        # small: all parts but the largest
        rest_small = rest < largest
        big = np.flatnonzero((size == largest[number]) & rest_small[number])
        big = big[np.unique(number[big], return_index=True)[1]]
        small = np.ones(len(size), bool)
        small[big] = False
        found = moving[np.repeat(small, size)]
        if rest_small.any():
            found = np.concatenate([found, self.perm[_ranges(self.start[owner[rest_small]], rest[rest_small])]])
        return np.sort(found)

    def sweep(self, alive: np.ndarray, p: int) -> np.ndarray:
        """Of places that have a follower, those whose classes can still make squares of period over p; the other classes go."""
        alive = alive[self.follow[alive] >= 0]
        alive = alive[self.size[self.of[alive]] > 1]
        if not len(alive):
            return alive
        cls, gap = self.of[alive], self.follow[alive] - alive
        order = np.argsort(cls, kind="stable")
        cls, gap = cls[order], gap[order]
        head = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        most = np.maximum.reduceat(gap, head)
        done = (np.add.reduceat(gap, head) < p) | (most <= p) & (most == np.minimum.reduceat(gap, head))
        self.size[cls[head[done]]] = 1  # counts as settled: never split again
        return alive[self.size[self.of[alive]] > 1]


def refine(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all squares without a smaller period; words: codes, -1 at the end of each text."""
    classes = _Classes(text * (int(words.max()) + 2) + words + 1)
    small, p, look = np.arange(len(words)), 1, 8.0
    alive = small
    while len(small):
        small = classes.split(small, p)
        p += 1
        if p >= look:
            alive = classes.sweep(alive, p)
            look = max(look + 1, look * SWEEP)
            if not len(alive):
                break
    linked = np.flatnonzero(classes.follow >= 0)
    gap = classes.follow[linked] - linked
    square = (classes.since[linked] <= gap) & (gap <= p)
    places = [linked[square], *(x for x, _ in classes.squares)]
    periods = [gap[square], *(x for _, x in classes.squares)]
    return np.concatenate(places), np.concatenate(periods)


def merged(places: np.ndarray, periods: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of the runs of ``least`` words or more made of these squares."""
    order = np.lexsort((places, periods))
    places, periods = places[order], periods[order]
    new = np.ones(len(places), bool)
    new[1:] = (periods[1:] != periods[:-1]) | (places[1:] != places[:-1] + 1)
    first = np.flatnonzero(new)
    start, period = places[first], periods[first]
    length = np.diff(np.append(first, len(places))) + 2 * period - 1
    found = np.stack([start, length, period], axis=1)[length >= least]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _scan(texts: list[list[bytes]], least: int) -> Iterator[np.ndarray]:
    """The runs of each of some texts, given as words."""
    code: dict[bytes, int] = defaultdict(count().__next__)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size + 1) - size - 1
    words = np.full(int(size.sum()) + len(texts), -1)
    for start, text in zip(first.tolist(), texts):
        words[start : start + len(text)] = np.fromiter(map(code.__getitem__, text), np.int64, len(text))
    found = merged(*refine(words, np.repeat(np.arange(len(texts)), size + 1)), least)
    at = np.searchsorted(found[:, 0], np.append(first, len(words)))
    for start, a, b in zip(first.tolist(), at[:-1].tolist(), at[1:].tolist()):
        yield found[a:b] - np.array([start, 0, 0])


def collapse(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _batches(sizes: list[int]) -> Iterator[list[int]]:
    """Texts to refine together, longest first, so that long ones, which take many rounds, share them."""
    part, total = [], 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if part and total + sizes[k] > WORDS:
            yield part
            part, total = [], 0
        part.append(k)
        total += sizes[k]
    if part:
        yield part


def _scanner(least: int):
    @F.pandas_udf("n long, runs array<array<long>>, collapsed string")
    def scanned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            texts = series.tolist()
            sizes = [len(t or "") // 4 for t in texts]  # about a word for each four characters
            n, runs, kept = [0] * len(texts), [[]] * len(texts), [""] * len(texts)
            for part in _batches(sizes):
                words = [(texts[k] or "").encode("utf-8", "surrogatepass").split() for k in part]  # bytes: the six ASCII blanks only
                for k, own, found in zip(part, words, _scan(words, least)):
                    n[k], runs[k] = len(own), found.tolist()
                    kept[k] = b" ".join(collapse(own, found)).decode("utf-8", "surrogatepass")
            yield pd.DataFrame({"n": n, "runs": runs, "collapsed": kept})

    return scanned


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """keep, n_words, runs (an array of start, length and period in words, by start, then period) and
    collapsed (the text without what repeats in a run, words joined by one space) of every row."""
    found = docs.select(*keep, _scanner(least)(F.col(text)).alias("__r"))
    triple = F.transform("__r.runs", lambda x: F.struct(x[0].alias("start"), x[1].alias("length"), x[2].alias("period")))
    return found.select(*keep, F.col("__r.n").alias("n_words"), triple.alias("runs"), F.col("__r.collapsed").alias("collapsed"))


def longest(runs: Column) -> Column:
    """The run of greatest length (then smallest start, then period), or null."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    return F.when(F.size(runs) > 0, F.struct((-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period")))


def listed(runs: Column) -> Column:
    """Every run as a line ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))), "")


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which every tenth document, by crc32 of its id, repeats a stretch of its words to the end.

    A null id plants nothing and a null text stays null.
    """
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), WORD_GAP)
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.size(words)
    g = F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    period = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, period), F.ceil((n - a) / period).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & F.regexp_like(text, F.lit("[^ \\t-\\r]")), made).otherwise(text)
