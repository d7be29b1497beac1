"""Token counts under a unigram model, by dynamic programming that a trie shares.

A task inserts the distinct pre-tokens of its texts in a trie of bytes. Each node
holds the best score of a segmentation of its prefix, and how many tokens that has;
it follows from the nodes above it, so a prefix that many pre-tokens share is scored
once. A pre-token's count is stored at its last node. Tasks share nothing: there is
no shuffle, and a task's trie is dropped when it passes ``MAX_NODES``.

The vocabulary is a public one with ranks; the model is not trained: the token of
rank r has the log score ``-log(r + 2)``. Equal scores go to fewer tokens. A byte that
no token consists of is a token by itself, ``UNKNOWN`` below the lowest score, so that
every text has a segmentation.

Defined results: null and empty texts have 0 tokens; repeated rows give repeated rows;
an empty table gives an empty table; only ``keep`` and the counts come out, whatever
other columns there are.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textvec

MAX_NODES = 250_000
UNKNOWN = 10.0  # how far below the lowest score a byte without a token lies
LONG = 4096  # bytes; longer pre-tokens are scored without being kept in the trie


def read_vocabulary(path: str) -> dict[bytes, float]:
    """Log scores by token, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {base64.b64decode(t): -math.log(int(r) + 2) for t, r in pairs}


class CountTrie:
    """Best segmentations of inserted byte strings, scored once per shared prefix."""

    def __init__(self, vocabulary: dict[bytes, float], max_nodes: int = MAX_NODES):
        self.max_nodes = max_nodes
        scores = dict(vocabulary)
        lowest = min(scores.values(), default=0.0) - UNKNOWN
        for b in range(256):
            scores.setdefault(bytes([b]), lowest)
        # the vocabulary as a trie of reversed tokens, walked from a prefix's end until no token goes on
        self.back: dict[int, int] = {}  # node * 256 + byte -> node
        self.score: list[float | None] = [None]
        for token, value in scores.items():
            node = 0
            for byte in reversed(token):
                node = self.back.setdefault(node * 256 + byte, len(self.score))
                if node == len(self.score):
                    self.score.append(None)
            self.score[node] = value
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # (score, -tokens) by node
        self.terminal: dict[bytes, int] = {}

    def extend(self, word: bytes, depth: int, above: list[tuple[float, int]]) -> tuple[float, int]:
        """The best score of word[:depth]; above: those of its shorter prefixes."""
        best, tokens = -math.inf, 0
        back, score, node = self.back, self.score, 0
        for start in range(depth - 1, -1, -1):
            node = back.get(node * 256 + word[start])
            if node is None:
                break
            value = score[node]
            if value is not None:
                s, n = above[start]
                s += value
                if s > best or (s == best and n - 1 > tokens):
                    best, tokens = s, n - 1
        return best, tokens

    def count(self, word: bytes) -> int:
        known = self.terminal.get(word)
        if known is not None:
            return known
        above = [(0.0, 0)]
        if len(word) > LONG:
            for depth in range(1, len(word) + 1):
                above.append(self.extend(word, depth, above))
            return -above[-1][1]
        if len(self.best) + len(word) > self.max_nodes:
            self.clear()
        node = 0
        for depth, byte in enumerate(word, 1):
            key = node * 256 + byte
            node = self.child.get(key, -1)
            if node < 0:
                node = self.child[key] = len(self.best)
                self.best.append(self.extend(word, depth, above))
            above.append(self.best[node])
        n = self.terminal[word] = -above[-1][1]
        return n


_tries: dict[str, CountTrie] = {}


def _counts(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    trie = _tries.get(path)
    if trie is None:
        trie = _tries[path] = CountTrie(read_vocabulary(path))
    words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for rows, pieces in textvec.batches(texts):
        joined = "".join(pieces)
        codes, bounds = textvec.code_points(joined), textvec.offsets(pieces)
        start = textvec.pretokens(codes, bounds)
        end = np.append(start[1:], len(codes))
        number, where = textvec.distinct(codes, start, end)
        count = np.fromiter((trie.count(joined[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(start[where].tolist(), end[where].tolist())), np.int64, len(where))
        owner = np.asarray(rows)[np.searchsorted(bounds, start, "right") - 1] if len(start) else np.zeros(0, np.int64)
        words += np.bincount(owner, minlength=len(texts))
        tokens += np.bincount(owner, weights=count[number] if len(start) else None, minlength=len(texts)).astype(np.int64)
    return words, tokens


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_pretokens and n_tokens of each text. vocabulary: a file that every executor has."""

    @F.pandas_udf("n_pretokens long, n_tokens long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            words, tokens = _counts(vocabulary, texts.fillna("").tolist())
            yield pd.DataFrame({"n_pretokens": words, "n_tokens": tokens})

    found = docs.select(*keep, counted(F.col(text)).alias("__t_counts"))
    return found.select(*keep, F.col("__t_counts.n_pretokens").alias("n_pretokens"), F.col("__t_counts.n_tokens").alias("n_tokens"))
