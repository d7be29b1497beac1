"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashed buckets of its words, its pairs of neighbours and
its pairs with one word between, each once; texts are taken whole. Training takes a
bounded sample of the labelled rows (``MAX_LABELLED`` rows chosen by a hash of the id),
deals their buckets to ``SHARDS`` shards and packs each shard, row by row, to one row, which
no way of splitting files takes apart. In each of ``ROUNDS`` rounds every shard runs
FTRL-proximal with per-coordinate rates over its rows from the common state, which is joined
to it as a table of one row, and the mean of the shards' states, made by one task, is the
next one. A state has two numbers for each bucket. So a task holds its share of the packed
sample and states bounded by 2**BITS, and Python's side of the driver only the weights in the
end, of which L1 leaves few that are not zero. Scoring reads every text whole, once, without a shuffle.

Defined results: null and empty texts have no features and score by the intercept
alone; without any labelled row of class 1 every score is 0; labels that are null are
skipped; a document with both labels is learnt from with each; of rows that share an id
the one with the smallest text hash is learnt from; repeated rows give repeated rows; an empty table gives an empty table; other columns are kept, and one that
has the name of the score is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from vigil.llm import textvec, worker
from vigil.llm.store import arrow_rows, scope, written

BITS = 20
MAX_LABELLED = 20_000
SHARDS, ROUNDS = 4, 6
ALPHA, BETA, L2 = 2.0, 1.0, 0.0
L1 = 8.0 / SHARDS  # a shard sees so much less of a feature
THRESHOLD = 0.3
SLICE = 256  # texts whose features are in memory together

_word_table = np.zeros(128, bool)
_word_table[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'"]] = True


def _mix(h: np.ndarray, shift: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185 + 2 * shift)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def features(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece number, bucket) of every occurrence, as two arrays."""
    codes, bounds = textvec.code_points("".join(pieces)), textvec.offsets(pieces)
    upper = (codes >= 65) & (codes <= 90)
    codes = codes + upper.astype(np.uint32) * np.uint32(32)
    word = np.where(codes < 128, _word_table[np.minimum(codes, 127)], True)
    n = len(codes)
    begins = word.copy()
    inner = np.zeros(n + 1, bool)
    inner[bounds] = True
    begins[1:] &= ~word[:-1] | inner[1:n]
    start = np.flatnonzero(begins)
    stop = ~word
    ends = np.zeros(n + 1, bool)
    ends[:n] = stop
    ends |= inner
    places = np.flatnonzero(ends)
    end = places[np.searchsorted(places, start + 1)] if len(start) else start
    owner = np.searchsorted(bounds, start, "right") - 1
    h = textvec.span_hashes(codes, start, end)
    found = [(owner, _mix(h, 0))]
    for gap in (1, 2):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            pair = h[:-gap] * np.uint64(0xA24BAED4963EE407 + 2 * gap) + h[gap:] * np.uint64(0x9FB21C651E98DF25)
            found.append((owner[gap:][same], _mix(pair[same], gap)))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def buckets(text: str) -> np.ndarray:
    """The distinct buckets of one text."""
    return np.unique(np.concatenate([features(pieces)[1] for _, pieces in textvec.batches([text])]))


class Ftrl:
    """FTRL-proximal for examples whose features are 0 or 1; the last weight is the intercept, without L1. It works on the state that it is given."""

    def __init__(self, state: np.ndarray, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = state

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def intercept(self) -> float:
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha))

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.intercept()
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        for k, old in ((at, w), (np.array([len(self.z) - 1]), b)):
            sigma = (np.sqrt(self.n[k] + g * g) - np.sqrt(self.n[k])) / self.alpha
            self.z[k] += g - sigma * old
            self.n[k] += g * g


def _examples(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct buckets of labelled texts, few texts at a time."""
    worker.begin("toxicity, training")
    for frame in parts:
        for k in range(0, len(frame), 128):
            part = frame.iloc[k : k + 128]
            yield pd.DataFrame({"shard": part["shard"], "id": part["id"], "y": part["y"], "at": [buckets(t).astype(np.int32) for t in part["text"].fillna("")]})


def _packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for a shard, of rows sorted by shard, id and label: the labels, the ends of the rows' buckets and the buckets' steps, compressed."""
    shard = None

    def done() -> pd.DataFrame:
        packed = b"".join([*chunks, steps.flush()])
        return pd.DataFrame({"shard": [shard], "y": [bytes(y)], "ends": [np.array(ends, "<i8").tobytes()], "steps": [packed], "positive": [sum(y)]})

    worker.begin("toxicity, training")
    for frame in parts:
        for s, label, at in zip(frame["shard"], frame["y"], frame["at"]):
            if s != shard:
                if shard is not None:
                    yield done()
                shard, y, ends, chunks, steps = s, bytearray(), [], [], zlib.compressobj(1)
            y.append(label)
            ends.append((ends[-1] if ends else 0) + len(at))
            chunks.append(steps.compress(np.diff(at, prepend=0).astype("<i4").tobytes()))
    if shard is not None:
        yield done()


def _learner(turn: int):
    """A function from packed shards, each with the common state or none, to their states after a pass."""

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker.begin("toxicity, training")
        for frame in parts:
            for shard, y, ends, steps, state in zip(*(frame[c] for c in ("shard", "y", "ends", "steps", "state"))):
                y, ends, steps = np.frombuffer(y, np.int8), np.frombuffer(ends, "<i8"), np.frombuffer(zlib.decompress(steps), "<i4")
                first = np.concatenate([[0], ends[:-1]])
                state = _opened(state)
                model = Ftrl(state)
                for k in np.random.default_rng(turn).permutation(len(y)).tolist():
                    model.learn(np.cumsum(steps[first[k] : ends[k]]), int(y[k]))
                yield pd.DataFrame({"shard": [shard], "state": [_closed(state)]})

    return learn


def _opened(state: bytes | None) -> np.ndarray:
    """z and n; zero without a state."""
    return np.zeros((2, (1 << BITS) + 1)) if state is None else np.frombuffer(state, "<f4").reshape(2, -1).astype(np.float64)


def _closed(state: np.ndarray) -> bytes:
    return state.astype("<f4").tobytes()


def _mean(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The mean of all shards' states, added in the order of shards, in which they come."""
    total, n = None, 0
    for frame in parts:
        for state in frame["state"]:
            total, n = _opened(state) if total is None else total + _opened(state), n + 1
    yield pd.DataFrame({"state": [_closed(total / n)] if n else []})


def _weights(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Buckets with a weight, and the intercept as bucket 2**BITS."""
    for frame in parts:
        for state in frame["state"]:
            model = Ftrl(_opened(state))
            w = model.weights(slice(0, 1 << BITS))
            at = np.flatnonzero(w)
            yield pd.DataFrame({"bucket": np.append(at, 1 << BITS), "weight": np.append(w[at], model.intercept())})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(buckets, weights, intercept) learnt from docs joined with labels; None without a row of class 1.

    labels: rows to learn from, with doc_id and the label (0 or 1).
    """
    with scope():
        chosen = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("__x_id"), F.col(label).cast("int").alias("__x_y"))
        chosen = chosen.orderBy(F.xxhash64("__x_id", F.lit(7)), "__x_id", "__x_y").limit(max_labelled)
        rows = docs.select(F.col(doc_id).alias("__x_doc"), F.col(text).alias("__x_text"))
        rows = rows.join(F.broadcast(chosen), F.col("__x_doc") == F.col("__x_id"))  # max_labelled rows of two numbers
        rows = rows.groupBy("__x_id", "__x_y").agg(F.min_by("__x_text", F.xxhash64("__x_text")).alias("__x_text"))  # an id may have many rows
        chosen = rows.select(F.pmod(F.xxhash64("__x_id", F.lit(11)), F.lit(SHARDS)).alias("shard"), F.col("__x_id").alias("id"), F.col("__x_y").alias("y"), F.col("__x_text").alias("text"))
        examples = chosen.mapInPandas(_examples, StructType([chosen.schema["shard"], chosen.schema["id"], chosen.schema["y"], StructField("at", ArrayType(IntegerType()))]))
        dealt = examples.repartition(SHARDS, "shard").sortWithinPartitions("shard", "id", "y")
        shards = written(dealt.mapInPandas(_packed, "shard long, y binary, ends binary, steps binary, positive long"), "shards")
        if not shards.agg(F.sum("positive")).first()[0]:
            return None
        state = None
        for turn in range(ROUNDS):
            met = shards.withColumn("state", F.lit(None).cast("binary")) if state is None else shards.join(F.broadcast(state))  # one row of 8 * 2**BITS bytes
            with scope(), arrow_rows(docs.sparkSession, 1):  # rows are states and packed shards
                moved = written(met.drop("positive").mapInPandas(_learner(turn), "shard long, state binary"), "moved")
                state = written(moved.coalesce(1).sortWithinPartitions("shard").mapInPandas(_mean, "state binary"), "state", keep=True)  # SHARDS rows
        found = sorted(tuple(r) for r in state.mapInPandas(_weights, "bucket long, weight double").collect())
        at, w = map(np.array, zip(*found))
        return at[:-1], w[:-1], float(w[-1])


def score_texts(texts: list[str], weight: np.ndarray, intercept: float) -> np.ndarray:
    """Scores in [0, 1]; weight has one entry for every bucket."""
    total = np.zeros(len(texts))
    seen: list[np.ndarray] = []
    for rows, pieces in textvec.batches(texts):
        owner, at = features(pieces)
        hit = weight[at] != 0
        seen.append((np.asarray(rows, np.int64)[owner[hit]] << BITS) | at[hit])
    if seen:
        pairs = np.unique(np.concatenate(seen))
        total = np.bincount(pairs >> BITS, weights=weight[pairs & ((1 << BITS) - 1)], minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(total + intercept, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column ``name``: how likely label 1 is."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    at, w, intercept = model
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), w.astype(np.float32)))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker.begin("toxicity, scores")
        weight = np.zeros(1 << BITS)
        weight[sent.value[0]] = sent.value[1]
        for texts in parts:
            texts = texts.fillna("").tolist()
            yield pd.Series(np.concatenate([score_texts(texts[k : k + SLICE], weight, intercept) for k in range(0, len(texts), SLICE)] or [np.zeros(0)]))

    return docs.withColumn(name, scored(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2
