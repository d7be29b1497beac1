"""Order-preserving packing of documents into sequences of bounded length.

The ids of a task's documents, in their order, form one stream. Windows of at most
``size`` ids are cut from it by dynamic programming: cuts may lie at the end of a
document (free), after a sentence (a small penalty) or, so that long sentences fit,
``size`` ids after such a place (a larger penalty); the sum of padding and penalties
is minimal. As the padding of the window from i to j is ``size - (p_j - p_i)``, the
best i is the smallest ``cost_i + p_i`` among those in reach, which a monotone queue
keeps: the work is linear. Blocks of ``block`` ids are solved one after another, a
block's last, open window going into the next, so memory is bounded. Only the last
window of a task can be far from full; it is split at powers of two, which need no
padding, if that costs less.

Each task packs what it reads, so nothing is shuffled and sequence ids are
``task << 33`` plus a count.

Ids are those of the tokenizer as its file has it, without special tokens of a template:
a text is cut at the added tokens that it holds, which become their own ids, and the rest
is encoded by pre-tokens, each distinct one once. The tokenizer must be a byte-level one
without a normalizer, and none of its added tokens may take in white space or look at its
neighbours; others raise an error.

Defined results: a null or empty text is one id, the end mark; repeated rows are
packed each; a null id is kept; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from codecs import charmap_decode
from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textvec, worker

SENTENCE, HARD = 2, 8  # penalties, in ids of padding
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of texts through ``tokenizers``: each distinct pre-token is encoded once.

    A byte-level tokenizer encodes pre-tokens independently, so a text's ids are those
    its model gives for the pre-tokens in order. Known pre-tokens are kept by their
    characters. At ``most`` those are forgotten that no second batch had, or all if
    over three quarters would stay.
    """

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in their surroundings are not supported")
        if self.tokenizer.normalizer is not None or type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("a byte-level tokenizer without a normalizer is needed")
        self.added = {t.content: np.array([i], np.uint32) for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        # bytes stand for themselves if they print in Latin-1, else for code points from 256 on
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in prints]
        signs = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.signs = "".join(signs[b] for b in range(256))
        text = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.closes = np.array([t[-1:] in (".", "!", "?", "Ċ") for t in text])  # the last is the newline's sign
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)  # pre-tokens that were met after their first batch

    def forget(self, room: int) -> None:
        """Keeps the pre-tokens that were met again, which each must be once more to stay the next time; none if they are over ``room``."""
        kept = np.flatnonzero(self.again)
        if len(kept) > room:
            self.clear()
            return
        number = np.where(self.again, np.cumsum(self.again) - 1, -1).tolist()
        self.slot = {w: k for w, s in self.slot.items() if (k := number[s]) >= 0}
        n = self.n[kept]
        ends = np.cumsum(n)
        self.ids = self.ids[np.repeat(self.at[kept] - ends + n, n) + np.arange(n.sum())]
        self.at, self.n, self.again = ends - n, n, np.zeros(len(kept), bool)

    def learn(self, words: list[str]) -> None:
        tokenize, signs = self.model.tokenize, self.signs
        flat: list[int] = []
        ends = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            flat += [t.id for t in tokenize(charmap_decode(w.encode("utf-8", "surrogatepass"), "strict", signs)[0])]
            ends[k] = len(flat)
        n = np.diff(ends, prepend=0)
        self.slot.update(zip(words, range(len(self.n), len(self.n) + len(words))))
        self.at = np.concatenate([self.at, len(self.ids) + ends - n])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def entries(self, words: list[str]) -> np.ndarray:
        """The slots of distinct pre-tokens; new ones are learnt."""
        entry = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(entry < 0)
        self.again[entry[entry >= 0]] = True
        if self.slot and len(self.slot) + len(new) > self.most:
            self.forget(min(self.most - len(new), self.most * 3 // 4))
            entry = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
            new = np.flatnonzero(entry < 0)
        entry[new] = np.arange(len(self.n), len(self.n) + len(new))
        self.learn([words[k] for k in new.tolist()])
        return entry

    def segments(self, texts: list[str]) -> tuple[list[int], list[str], list[np.ndarray | None]]:
        """(row, text, ids) of stretches in order: ids are given for added tokens only."""
        rows, parts, given = [], [], []
        for row, text in enumerate(texts):
            split = self.cut.split(text) if self.cut and any(a in text for a in self.added) else [text]
            for k, part in enumerate(split):
                if part or len(split) == 1:
                    rows.append(row)
                    parts.append(part)
                    given.append(self.added[part] if k % 2 else None)
        return rows, parts, given

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each row in order; a row's ids may come in several parts."""
        owner, parts, given = self.segments(texts)
        for rows, pieces in textvec.batches(parts):
            joined = "".join(pieces)
            codes, bounds = textvec.code_points(joined), textvec.offsets(pieces)
            start = textvec.pretokens(codes, bounds)
            end = np.append(start[1:], len(codes))
            number, where = textvec.distinct(codes, start, end)
            words = [joined[s:e] for s, e in zip(start[where].tolist(), end[where].tolist())]
            entry = self.entries(words)[number]
            n = self.n[entry]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.ids[np.repeat(self.at[entry] - ends + n, n) + np.arange(total)]
            cut = np.concatenate([[0], ends])[np.searchsorted(start, bounds)] if len(start) else np.zeros(len(bounds), np.int64)
            for k, segment in enumerate(rows):
                known = given[segment]
                yield owner[segment], ids[cut[k] : cut[k + 1]] if known is None else known


def choose_cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Positions of cuts, the last of ``at`` included, at least cost; no gap of ``at`` (0 before it) may pass size."""
    places, fees = [0, *at.tolist()], [0, *penalty.tolist()]
    before = [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + position, position, number), rising
    for j in range(1, len(places)):
        p = places[j]
        while queue[0][1] < p - size:
            queue.popleft()
        value, _, i = queue[0]
        before[j] = i
        value += size + fees[j]  # cost_j + p_j: the cost is value + size - p + fee
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = before[j]
    return cuts[::-1]


def candidates(ends: np.ndarray, closes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places for cuts and their penalties: document ends, sentence ends, and ``size`` after each (or after that)."""
    total = int(ends[-1])
    kind = np.full(total + 1, -1, np.int64)
    soft = np.concatenate([[0], np.flatnonzero(closes) + 1, ends])
    hard = soft
    while len(hard):  # each round is one window further into stretches without a soft place
        hard = hard[hard + size <= total] + size
        hard = hard[kind[hard] < 0]
        kind[hard] = HARD
        far = np.sort(soft)
        nxt = np.searchsorted(far, hard, "right")
        hard = hard[np.where(nxt < len(far), far[np.minimum(nxt, len(far) - 1)], total) - hard > size]
    kind[soft] = SENTENCE
    kind[ends] = 0
    at = np.flatnonzero(kind[1:] >= 0) + 1
    return at, kind[at]


def last_cuts(length: int, size: int) -> list[int]:
    """Ends of the pieces of a task's last window: whole, or at powers of two if that is cheaper."""
    if length & (length - 1) == 0:
        return [length]
    parts = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    return np.cumsum(parts).tolist() if HARD * (len(parts) - 1) < size - length else [length]


class Packer:
    """Packs a stream of documents; ``rows`` has the finished pieces."""

    def __init__(self, first_sequence: int, size: int, block: int, closes: np.ndarray):
        self.sequence, self.size, self.block, self.closes = first_sequence, size, block, closes
        self.stream: list[np.ndarray] = []
        self.parts: list[list] = []  # [document, start in it, length, its ids in all or None]
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray, start: int, total: list[int]) -> None:
        """Part of a document; total: one element list, its ids in all once known."""
        while len(ids):
            part = ids[: max(1, self.block - self.held)]
            self.stream.append(part)
            self.parts.append([doc, start, len(part), total])
            self.held += len(part)
            start, ids = start + len(part), ids[len(part) :]
            if self.held >= self.block:
                self.flush(False)

    def flush(self, last: bool) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.stream)
        merged = self.parts[:1]
        for part in self.parts[1:]:  # parts of one document follow each other
            if part[3] is merged[-1][3]:
                merged[-1][2] += part[2]
            else:
                merged.append(part)
        self.parts = merged
        lengths = np.array([p[2] for p in self.parts])
        ends = np.cumsum(lengths)
        done = np.array([p[1] + p[2] == p[3][0] for p in self.parts])  # parts that end a document
        done[-1] = True
        at, fee = candidates(np.unique(ends[done]), self.closes[ids], self.size)
        cuts = choose_cuts(at, fee, self.size)
        if last:
            begin = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + [begin + c for c in last_cuts(cuts[-1] - begin, self.size)]
            keep = len(ids)
        else:
            keep = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1]
        window = {c: k for k, c in enumerate(cuts)}
        edges = np.unique(np.concatenate([[0], ends, np.asarray(cuts, np.int64)]))
        edges = edges[edges <= keep]
        begins = np.concatenate([[0], np.asarray(cuts, np.int64)])
        of_window = np.searchsorted(np.asarray(cuts, np.int64), edges[:-1], "right").tolist()
        of_part = np.searchsorted(ends, edges[:-1], "right").tolist()
        data = ids.astype("<u4")
        for s, e, w, k in zip(edges[:-1].tolist(), edges[1:].tolist(), of_window, of_part):
            doc, start, _, total = self.parts[k]
            inside = s - int(ends[k] - lengths[k])
            self.rows.append((doc, start + inside, e - s, zlib.crc32(data[s:e].tobytes()), total, self.sequence + w, s - int(begins[w])))
        self.sequence += len(window)
        rest = []
        for (doc, start, n, total), e in zip(self.parts, ends.tolist()):
            if e > keep:
                cut = max(0, keep - (e - n))
                rest.append([doc, start + cut, n - cut, total])
        self.parts, self.stream = rest, [ids[keep:]] if keep < len(ids) else []
        self.held = len(ids) - keep


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, block: int = 1 << 20, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: the file of a byte-level tokenizer, which every executor has.
    """

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker.begin("packing")
        encoder = worker.kept(f"encoder {tokenizer}", lambda: WordEncoder(tokenizer))
        packer = Packer(TaskContext.get().partitionId() << 33, size, block, encoder.closes)

        def ready(everything: bool) -> Iterator[pd.DataFrame]:
            """Finished pieces of finished documents, as their number of ids is known only then."""
            stop = len(packer.rows) if everything else next((k for k, r in enumerate(packer.rows) if r[4][0] is None), len(packer.rows))
            if stop:
                rows = [(*r[:4], r[4][0], *r[5:]) for r in packer.rows[:stop]]
                del packer.rows[:stop]
                frame = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
                yield frame.astype({"doc_id": "Int64"})

        end = np.array([END_ID], np.uint32)
        for frame in parts:
            texts = frame["__p_text"].fillna("").tolist()
            ids = [None if pd.isna(i) else int(i) for i in frame["__p_id"]]
            at, start, total = -1, 0, [None]
            for row, part in encoder.encode(texts):
                if row != at:
                    if at >= 0:
                        total[0] = start + 1
                        packer.add(ids[at], end, start, total)
                    at, start, total = row, 0, [None]
                packer.add(ids[row], part, start, total)
                start += len(part)
            if at >= 0:
                total[0] = start + 1
                packer.add(ids[at], end, start, total)
            yield from ready(False)
        packer.flush(True)
        yield from ready(True)

    chosen = docs.select(F.col(doc_id).cast("long").alias("__p_id"), F.col(text).alias("__p_text"))
    return chosen.mapInPandas(packed, PIECES)
