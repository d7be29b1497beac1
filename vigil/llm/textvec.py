"""Array helpers for text inside tasks: many texts as one array of code points.

A text is never cut where a result could change: long texts are split only where a
white-space character follows another character, which always starts a pre-token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

# Code points that count as white space in Unicode patterns.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

_classes: list[np.ndarray] = []
_powers: list[np.ndarray] = []
BASE = 0x9E3779B97F4A7C15 | 1
_blank = "".join(map(chr, SPACES))
_after_word = re.compile(f"(?<=[^{_blank}])[{_blank}]")


def classes() -> np.ndarray:
    """The class of every code point as the tokenizers' own pre-tokenizer has it, made once in a worker.

    All code points but the space go through it in strings of 8192, in which those of one
    class stay together; one of each run is then probed next to a letter, a number and
    a sign.
    """
    if not _classes:
        from tokenizers.pre_tokenizers import ByteLevel

        split = ByteLevel(add_prefix_space=False).pre_tokenize_str
        table = np.zeros(0x110000, np.uint8)
        table[0x20] = SPACE
        for first in range(0, 0x110000, 1 << 13):
            points = np.arange(first, first + (1 << 13), dtype=np.uint32)
            points = points[(points != 0x20) & ~((points >= 0xD800) & (points < 0xE000))]
            for _, (start, end) in split(points.tobytes().decode("utf-32-le")):
                one = chr(points[start])
                kinds = [k for k, with_ in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(with_ + one)) == 1]
                table[points[start:end]] = kinds[0] if kinds else SPACE
        _classes.append(table)
    return _classes[0]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 19)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(m - 1, x & (2**64 - 1), np.uint64)])) for x in (BASE, pow(BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def batches(texts: list[str], limit: int = 1 << 18) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, pieces) of about ``limit`` characters at most; a row may have several pieces, in order."""
    rows: list[int] = []
    pieces: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        start = 0
        while True:
            end = len(text)
            if end - start > limit:
                found = _after_word.search(text, start + limit)
                end = found.start() if found else end
            if size and size + end - start > limit:
                yield rows, pieces
                rows, pieces, size = [], [], 0
            rows.append(row)
            pieces.append(text[start:end])
            size += end - start
            start = end
            if start >= len(text):
                break
    if rows:
        yield rows, pieces


def offsets(pieces: list[str]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])


def pretokens(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the usual byte-level pattern start, in ``codes``.

    bounds: the pieces' ends, with 0 first. The pattern takes, in this order, a
    contraction, letters, numbers or other signs each with one space before, white
    space up to the last of it before something else, white space.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(run)
    end = np.append(start[1:], n)
    what = kind[start]
    blank = what == SPACE
    led = np.zeros(len(start), bool)  # a plain space stands before, in the same piece
    led[1:] = (codes[start[1:] - 1] == 0x20) & ~first[start[1:]]
    mark = np.zeros(n + 1, bool)
    mark[start[~blank & ~led]] = True
    more = blank & ~first[end]  # white space that something follows
    mark[end[more] - 1] = True
    mark[start[blank & (~more | (end - start > 1))]] = True
    # contractions: a lone apostrophe that starts a pre-token, then s, t, m, d, re, ve or ll
    lone = np.flatnonzero((end - start == 1) & (codes[start] == 0x27) & ~led & ~first[end])
    lone = lone[lone + 1 < len(start)]
    lone = lone[what[lone + 1] == LETTER]
    if len(lone):
        s, e = start[lone + 1], end[lone + 1]
        a, b = codes[s], np.where(e - s > 1, codes[np.minimum(s + 1, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        k = np.where(one, 1, np.where(two, 2, 0))
        mark[s[k > 0]] = False
        rest = (k > 0) & (e - s > k)
        mark[(s + k)[rest]] = True
    return np.flatnonzero(mark[:n])


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``codes``, from one running sum over all of them.

    Words can be made that share it: who needs equal characters must compare them.
    """
    p, inverse = powers(len(codes) + 1)
    x = codes.astype(np.uint64) + np.uint64(1)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= p[: len(codes)]
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(x, out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h ^= (end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def distinct(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each span's value, where each value is first found) of spans that tile ``codes``.

    Spans are grouped by hash, and every span's characters are then compared with those
    of its group's first; a span that differs starts a value of its own.
    """
    number, values = pd.factorize(span_hashes(codes, start, end))
    where = np.empty(len(values), np.int64)
    where[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    n = end - start
    first = where[number]
    shift = np.where(n == n[first], start - start[first], 0)  # of another length: differs anyway
    unequal = codes != codes[np.arange(len(codes)) - np.repeat(shift, n)]
    odd = n != n[first]
    if unequal.any():
        odd |= np.add.reduceat(unequal, start) > 0
    if odd.any():
        known: dict[bytes, int] = {}
        more = []
        for k in np.flatnonzero(odd).tolist():
            word = codes[start[k] : end[k]].tobytes()
            if word not in known:
                known[word] = len(where) + len(more)
                more.append(k)
            number[k] = known[word]
        where = np.concatenate([where, np.array(more, np.int64)])
    return number, where
