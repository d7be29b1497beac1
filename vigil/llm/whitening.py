"""Embedding whitening by matrix-free block Lanczos with full reorthogonalisation.

Entries become whole numbers x = floor(SCALE * c) + SHIFT. The covariance V of the n
vectors is never made: a pass over them gives V times a block of directions, as the sum of
(x - S/n) ((x - S/n) . v), each task adding up its rows and a shuffle by dimension adding up
the tasks, so that the driver gets one row for each dimension.

The blocks span a Krylov space. Each new one is what a pass made of the last one, made
orthogonal, twice, to all before. In the space found so far V is a small symmetric matrix,
whose eigenvectors give the candidates and, with what the passes gave, their residuals
|V u - e u|. They are taken when every wanted residual is at most ``TOLERANCE`` times the
largest eigenvalue, or the space is all there is. Directions of a block that break down
(nothing is left of them) are replaced by random ones orthogonal to all before, which also
finds eigenvalues that repeat. A space that passes ``BASIS`` directions is restarted from
its best candidates. The trace of V comes from the rows' deviations, exact whole numbers,
so the explained shares need no further eigenvalue.

Defined results: vectors that are null or hold a null, NaN or infinite entry are left out;
a vector shorter than the longest counts as having zeros there; repeated rows count each
and come out each; null ids are allowed; columns but the two named are ignored. There are as
many components as asked or as the covariance has eigenvalues above ``FLAT`` times its
trace, so one vector, or equal ones, give no rows, as does an empty table. A deviation
that a long can't hold raises an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.store import scope, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS, BLOCK = 8, 16
TOLERANCE, FLAT = 1e-13, 1e-13
BASIS = 256  # directions kept on the driver
PASSES, STALE = 1000, 8  # the most before it gives up; restarts that bring no gain before the residuals are taken as they are
SEED = 42


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and x, an array of longs, of the vectors without null, NaN and infinite entries."""
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    x = F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return rows.where(F.col(embedding).isNotNull() & ~bad).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def _matrix(lists: pd.Series, size: int) -> np.ndarray:
    """The vectors as rows of whole numbers; missing entries are those of zero."""
    if lists.map(len).eq(size).all():
        return np.concatenate(lists.to_numpy()).reshape(len(lists), size)
    full = np.full((len(lists), size), SHIFT, np.int64)
    for k, x in enumerate(lists):
        full[k, : len(x)] = x
    return full


def _numerators(lists: pd.Series, sums: np.ndarray, n: int) -> np.ndarray:
    """n * x - S, exact."""
    return _matrix(lists, len(sums)) * n - sums


def _summed(vectors: DataFrame, sums: np.ndarray, n: int, width: int, add: Callable[[np.ndarray], np.ndarray], rows: int) -> np.ndarray:
    """The sum over all vectors of add(x - S/n for some of them), a matrix of rows by width."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rows, width))
        for frame in frames:
            for k in range(0, len(frame), 4096):
                total += add(_numerators(frame["x"].iloc[k : k + 4096], sums, n) / n)
        yield pd.DataFrame({"row": np.arange(rows), "part": list(total)})

    added = vectors.mapInPandas(parts, "row int, part array<double>").groupBy("row").agg(F.array(*[F.sum(F.get("part", F.lit(k))) for k in range(width)]).alias("part"))
    out = np.zeros((rows, width))
    for r in added.collect():  # one for each row of the matrix
        out[r["row"]] = r["part"]
    return out


def _orthogonal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Orthonormal directions for those of the block, orthogonal to the basis; at most as many as there are left."""
    found = basis
    for v in block.T:
        for attempt in range(4):
            size = np.linalg.norm(v)
            for _ in range(2):
                v = v - found @ (found.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10 * size and left > 0:
                v = v / left
                v = v - found @ (found.T @ v)
                found = np.column_stack([found, v / np.linalg.norm(v)])
                break
            if found.shape[1] == len(found):
                return found[:, basis.shape[1] :]
            v = random.standard_normal(len(v))  # broke down: a new direction
    return found[:, basis.shape[1] :]


def lanczos(apply: Callable[[np.ndarray], np.ndarray], size: int, wanted: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE, basis: int = BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors, as columns, of the symmetric operator."""
    random = np.random.default_rng(SEED)
    wanted, block = min(wanted, size), min(block, size)
    basis = max(basis, 2 * wanted + 2 * block)
    space, images = np.zeros((size, 0)), np.zeros((size, 0))
    new, least, stale = random.standard_normal((size, block)), np.inf, 0
    for _ in range(PASSES):
        new = _orthogonal(new, space, random)
        image = apply(new)
        space, images = np.hstack([space, new]), np.hstack([images, image])
        inner = space.T @ images
        values, mix = np.linalg.eigh((inner + inner.T) / 2)
        values, mix = values[::-1], mix[:, ::-1]
        best = space @ mix[:, :wanted]
        rest = np.linalg.norm(images @ mix[:, :wanted] - best * values[:wanted], axis=0)
        if space.shape[1] >= wanted and (rest.max() <= tolerance * max(values[0], 0) or space.shape[1] == size):
            return values[:wanted], best
        new = image
        if space.shape[1] + block > min(basis, size) and basis < size:
            stale = stale + 1 if rest.max() > 0.9 * least else 0
            if stale == STALE and rest.max() <= 1e-11 * values[0]:  # as near as the rounding of the sums lets it come
                return values[:wanted], best
            least, keep = min(least, rest.max()), wanted + block  # the best candidates stay; the rest is found again
            new = images @ mix[:, :block] - space @ mix[:, :block] * values[:block]
            space, images = space @ mix[:, :keep], images @ mix[:, :keep]
    raise RuntimeError(f"no convergence after {PASSES} passes: residuals up to {rest.max()}")


def whiten(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each vector and component."""
    with scope():
        vectors = written(whole_vectors(rows, vec_id, embedding), "vectors", keep=True)
        n, size = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()

        def result(df: DataFrame, shares: list[float], error: float) -> DataFrame:
            """Of rows with deviation and w, their whitened components."""
            each = df.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("w").alias("at", "whitened"))
            explained = F.get(F.lit(shares or [0.0]), F.col("at"))
            return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))

        nothing = result(vectors.limit(0).select("vec_id", F.lit(0).cast("long").alias("deviation"), F.lit([0.0]).alias("w")), [], 0.0)
        if n < 2 or not size:
            return nothing
        sums = np.zeros(size, np.int64)
        each = vectors.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s"), F.count("*").alias("rows"))
        for r in each.collect():  # one for each dimension
            sums[r["at"]] = r["s"] + SHIFT * (n - r["rows"])

        def deviations(lists: pd.Series) -> list[int]:
            d = _numerators(lists, sums, n)
            if int(np.abs(d).max(initial=0)) ** 2 * size >= 2**63:
                return [sum(int(v) ** 2 for v in row) for row in d]
            return (d * d).sum(axis=1).tolist()

        def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum(sum(deviations(frame["x"])) for frame in frames)
            yield pd.DataFrame({"high": [total >> 62], "low": [total & (2**62 - 1)]})

        high, low = vectors.mapInPandas(measured, "high long, low long").agg(*[F.sum(F.col(c).cast("decimal(38,0)")) for c in ("high", "low")]).first()
        trace = ((int(high) << 62) + int(low)) / n**3
        if not trace:
            return nothing

        values, directions = lanczos(lambda v: _summed(vectors, sums, n, v.shape[1], lambda c: c.T @ (c @ v), size) / n, size, components)
        real = values > FLAT * trace
        values, directions = values[real], directions[:, real]
        scaled = directions / np.sqrt(values)
        count = len(values)

        def moments(c: np.ndarray) -> np.ndarray:
            w = c @ scaled
            return np.vstack([w.T @ w, w.sum(axis=0)])

        found = _summed(vectors, sums, n, count, moments, count + 1) / n
        error = float(np.abs(found[:count] - np.outer(found[count], found[count]) - np.eye(count)).max())

        @F.pandas_udf("deviation long, w array<double>")
        def projected(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for lists in parts:
                cut = [lists.iloc[k : k + 4096] for k in range(0, len(lists), 4096)]
                yield pd.DataFrame({"deviation": np.array([d for x in cut for d in deviations(x)], np.int64), "w": [w for x in cut for w in _numerators(x, sums, n) / n @ scaled]})

        return result(vectors.select("vec_id", projected("x").alias("p")).select("vec_id", "p.*"), (values / trace).tolist(), error)
