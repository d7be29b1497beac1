"""Line dedup: content-defined chunks of lines that occur again anywhere are removed.

Each line is hashed, and a rolling hash over the last ``WINDOW`` line hashes ends a
chunk where it is 0 modulo ``DIVISOR``. A boundary so depends on the lines next to it
only: lines inserted above do not move it. Chunks of two lines or more that occur
more than once in all documents stay where (doc_id, place) is smallest and go
elsewhere, whole.

Occurrences are counted by a 128-bit hash first, so that only chunks that may repeat
move with their text; of those, equal bytes are grouped, and every place but a group's
first goes. What goes is a list of chunk numbers for each document. Hashes and lists
are sent to all executors if they are small (``BROADCAST_NUMBERS``), else joined by
shuffle. All of it is DataFrame functions.

Chunks find a repeated run only where its ends are cut alike. ``dedup_passages`` takes
the same search first, over chunks of two lines or more and of one line of over ``LONG``
words, and then completes it exactly around and between the chunks that go: of all else,
every place of two neighbouring lines and every line of over ``LONG`` words goes where an
earlier place has the same bytes. A repeated run of two lines or more so goes whole,
wherever it starts. What lies inside a chunk that goes is not looked at again, neither
as what goes nor as what stays: the chunk's first place has it, and comes earlier. Each
line that goes has an earlier copy, so the first copy of a line always stays; the lines
next to it may go.

Defined results: a null text stays null, an empty one is a single empty line; every
row stays, perhaps with fewer lines; rows with equal id and text are one document,
and all of them keep or lose a chunk alike; a null id sorts first; other columns are
carried, but for one named ``__removed``, which the result's own replaces, and n_chars,
if present, is counted again; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.quality import let
from vigil.llm.store import scope, written

WINDOW = 2
DIVISOR = 3
FACTOR = 1_000_003
MODULUS = (1 << 31) - 1
BROADCAST_NUMBERS = 500_000
LONG = 50  # words from which on a line is a passage of its own
PLACES = 1 << 31  # lines that a text can have


def _ends(lines: Column) -> Column:
    """The numbers of the lines that end a chunk."""

    def cut(h: Column) -> Column:
        rolling = lambda i: sum((F.coalesce(F.get(h, i - k), F.lit(0).cast("long")) * (FACTOR**k % MODULUS) for k in range(1, WINDOW)), F.get(h, i))
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (rolling(i) % MODULUS % DIVISOR == 0) | (i == F.size(h) - 1))

    return let(F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")), cut)


def _first(ends: Column, k: Column) -> Column:
    """The first line of chunk k."""
    return F.coalesce(F.get(ends, k - 1), F.lit(-1)) + 1


def chunks(text: Column) -> Column:
    """The chunks of a text in order, each an array of lines."""

    def of(lines: Column) -> Column:
        return let(_ends(lines), lambda e: F.transform(e, lambda x, k: F.transform(F.sequence(_first(e, k), x), lambda i: F.get(lines, i))))

    return let(F.split(text, "\n", -1), of)


def _small(df: DataFrame, size: Column) -> DataFrame:
    """df for a join: sent to every executor if it is small, else left to a shuffle."""
    held = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_NUMBERS else df


def _long(line: Column) -> Column:
    return F.regexp_count(line, F.lit("[^ \\t-\\r]+")) > LONG


def _lines(place: Column) -> Column:
    """The lines of a chunk's place, which is its first line times ``PLACES`` plus its number of lines."""
    first = F.shiftright(place, 31)
    return F.sequence(first, first + place.bitwiseAND(F.lit(PLACES - 1)) - 1)


def placed_chunks(text: Column) -> Column:
    """The chunks that ``dedup_passages`` looks at, each struct(k, passage): its place and its text."""

    def of(lines: Column) -> Column:
        part = lambda first, n: F.struct((first * F.lit(PLACES) + n).alias("k"), F.array_join(F.slice(lines, first + 1, n), "\n").alias("passage"))
        found = let(_ends(lines), lambda e: F.transform(e, lambda x, k: F.struct(_first(e, k).alias("first"), (x + 1 - _first(e, k)).alias("n"))))
        found = F.filter(found, lambda x: (x["n"] > 1) | _long(F.get(lines, x["first"])))
        return F.transform(found, lambda x: part(x["first"], x["n"]))

    return let(F.split(text, "\n", -1), of)


def passages(text: Column, inside: Column | None = None) -> Column:
    """The passages of a text, each struct(k, passage): two neighbouring lines from line k / 2 on
    (k even), and a line of over ``LONG`` words, line (k - 1) / 2 (k odd). inside: places of
    chunks, whose own passages are left out; null: none."""

    def of(lines: Column) -> Column:
        at = F.sequence(F.lit(0).cast("long"), (F.size(lines) - 1).cast("long"))
        pairs, ones = F.slice(at, 1, F.size(lines) - 1), at
        if inside is not None:
            own = F.transform(inside, _lines)
            ones = F.when(inside.isNull(), ones).otherwise(F.array_except(ones, F.flatten(own)))
            pairs = F.when(inside.isNull(), pairs).otherwise(F.array_except(pairs, F.flatten(F.transform(own, lambda x: F.slice(x, 1, F.size(x) - 1)))))
        line = lambda i: F.get(lines, i.cast("int"))
        pair = lambda i: F.struct((2 * i).alias("k"), F.concat(line(i), F.lit("\n"), line(i + 1)).alias("passage"))
        alone = lambda i: F.struct((2 * i + 1).alias("k"), line(i).alias("passage"))
        return F.concat(F.transform(pairs, pair), F.transform(F.filter(ones, lambda i: _long(line(i))), alone))

    return let(F.split(text, "\n", -1), of)


def _ids(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("__l_id"), F.xxhash64(text).alias("__l_key"), F.col(text).alias("__l_text"))


def _later(places: DataFrame, whole: Column) -> DataFrame:
    """(__l_of, __l_of_key, __l_goes): for each document the places __l_k whose bytes have an earlier place."""
    with scope():
        found = places.select(F.struct("__l_id", "__l_key", "__l_k").alias("at"), F.xxhash64(whole).alias("h1"), F.xxhash64(whole, F.lit(1)).alias("h2"), whole.alias("chunk"))
        # more than one place: told by two hashes of the place, as longs can be aggregated by hashing and a struct cannot
        ends = [f(F.xxhash64("at", F.lit(k))).alias(f"{n}{k}") for k in (0, 1) for n, f in (("a", F.min), ("z", F.max))]
        hashes = found.groupBy("h1", "h2").agg(*ends).where("a0 <> z0 or a1 <> z1").select("h1", "h2")
        hashes = written(hashes, "repeated-hashes")
        again = written(found.join(_small(hashes, F.lit(2)), ["h1", "h2"]), "repeated-chunks")
        # of equal hashes and equal bytes the first place stays; a place is a key of its own, so a common chunk is dealt to many tasks
        stays = again.groupBy("h1", "h2", "chunk").agg(F.min("at").alias("at")).select(*[F.col(f"at.{c}").alias(f"{c}_stays") for c in ("__l_id", "__l_key", "__l_k")])
        same = F.col("__l_id").eqNullSafe(F.col("__l_id_stays")) & (F.col("__l_key") == F.col("__l_key_stays")) & (F.col("__l_k") == F.col("__l_k_stays"))
        goes = again.select("at.*").join(stays, same, "left_anti")
        goes = goes.groupBy(F.col("__l_id").alias("__l_of"), F.col("__l_key").alias("__l_of_key")).agg(F.collect_set("__l_k").alias("__l_goes"))
        return _small(written(goes, "going-chunks", keep=True), F.size("__l_goes") + 2)


def _without(docs: DataFrame, goes: DataFrame, left: Column, text: str, doc_id: str) -> DataFrame:
    """docs with the texts that ``left``, a struct(text, removed), gives where something goes."""
    joined = docs.withColumn("__l_key", F.xxhash64(text)).join(goes, F.col(doc_id).eqNullSafe(F.col("__l_of")) & (F.col("__l_key") == F.col("__l_of_key")), "left")
    result = F.when(F.col("__l_goes").isNull(), F.struct(F.col(text).alias("text"), F.lit(0).alias("removed"))).otherwise(left)
    cleaned = joined.withColumn("__l_result", result)
    columns = [F.col("__l_result.text").alias(c) if c == text else F.length("__l_result.text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns if c != "__removed"]
    return cleaned.select(*columns, F.col("__l_result.removed").cast("long").alias("__removed"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the repeated chunks removed, and a column ``__removed``: how many lines went."""
    places = _ids(docs, text, doc_id).select("__l_id", "__l_key", F.posexplode(chunks(F.col("__l_text"))).alias("__l_k", "lines"))
    goes = _later(places.where(F.size("lines") > 1), F.array_join("lines", "\n"))

    def left(c: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(c) - 1), F.col("__l_goes"))
        return let(F.flatten(F.transform(kept, lambda k: F.get(c, k))), lambda x: F.struct(F.array_join(x, "\n").alias("text"), (F.size(F.flatten(c)) - F.size(x)).alias("removed")))

    return _without(docs, goes, let(chunks(F.col(text)), left), text, doc_id)


def dedup_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the lines of passages that an earlier place has, and ``__removed``."""
    with scope():
        ids = _ids(docs, text, doc_id)
        place = [F.col("p.k").alias("__l_k"), "p.passage"]
        found = ids.select("__l_id", "__l_key", F.explode(placed_chunks(F.col("__l_text"))).alias("p"))
        hits = _later(found.select("__l_id", "__l_key", *place), F.col("passage"))
        same = F.col("__l_id").eqNullSafe(F.col("__l_of")) & (F.col("__l_key") == F.col("__l_of_key"))
        rest = ids.join(hits, same, "left").select("__l_id", "__l_key", F.explode(passages(F.col("__l_text"), F.col("__l_goes"))).alias("p"))
        more = _later(rest.select("__l_id", "__l_key", *place), F.col("passage"))
        first = lambda k: F.shiftright(k, 1)
        gone = F.concat(F.transform("__l_goes", first), F.transform(F.filter("__l_goes", lambda k: k % 2 == 0), lambda k: first(k) + 1))
        both = hits.withColumn("__l_goes", F.flatten(F.transform("__l_goes", _lines))).unionByName(more.withColumn("__l_goes", gone))
        both = both.groupBy("__l_of", "__l_of_key").agg(F.array_distinct(F.flatten(F.collect_list("__l_goes"))).alias("__l_goes"))
        goes = _small(written(both, "going-lines", keep=True), F.size("__l_goes") + 2)

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0).cast("long"), (F.size(lines) - 1).cast("long")), F.col("__l_goes"))
        return F.struct(F.array_join(F.transform(kept, lambda k: F.get(lines, k.cast("int"))), "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("removed"))

    return _without(docs, goes, let(F.split(F.col(text), "\n", -1), left), text, doc_id)
