"""Sharding by a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2 ** ``bits`` levels that hold about equally many rows: its
distinct values are counted, and the counts, summed in order of value, give the values at
which a level begins. The levels of a row are a cell of a grid, and the Hilbert curve runs
through all cells so that neighbours on the curve are neighbours in every dimension. Rows
are sorted by the curve's index and the curve is cut into runs, one for each shard, so a
shard, and each of its files, covers a small range of every dimension and a reader's
filter on any of them skips most files by their minima and maxima.

The curve is followed by a table of its orientations, made from the rule of Gray codes and
rotations, one step for each bit. Rows are sorted once, by a range shuffle of the index, the
text's checksum and the row's number, so that neither a full cell nor copies of one text nor
one id meet in a task. Sums of ranges tell in which ranges the cuts lie; only in these, one
for each cut, are running sums made. Everything is built from Spark functions.

Law ``bytes``: a row goes to the shard in which the middle of its bytes falls, so a shard
misses its share of all bytes by less than its two outer rows. Law ``rows``: the same with
each row counting one, so shards differ by at most one row.

Defined results: a null text has no bytes and checksum 0; the size is the bytes plus 1; a
null value of a dimension counts as its smallest; rows of one cell follow each other by
checksum, so equal texts of a cell are neighbours, then by id, null first, and in the order
they are read; repeated rows are rows of their own; an empty table gives an empty table;
with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.store import scope, written

SHARDS, BITS = 16, 5
ROW = (1 << 33) - 1  # the part of a row's number that counts within its range


@cache
def steps(n: int) -> tuple[list[int], list[int]]:
    """For n dimensions the digit of the curve and the next orientation, at orientation * 2**n + quadrant.

    An orientation is the corner where the curve enters a cell and the axis along which it leaves it.
    """
    size = 1 << n
    gray = [w ^ w >> 1 for w in range(size)]
    number = {g: w for w, g in enumerate(gray)}
    turn = lambda x, k: (x << k % n | x >> (n - k % n)) & (size - 1) if k % n else x

    def trailing_ones(w: int) -> int:
        return (~w & w + 1).bit_length() - 1

    enters = [0 if w == 0 else gray[(w - 1) // 2 * 2] for w in range(size)]
    along = [0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % n for w in range(size)]
    digit, after = [], []
    for state in range(size * n):
        corner, axis = divmod(state, n)
        for quadrant in range(size):
            w = number[turn(quadrant ^ corner, n - (axis + 1) % n)]
            digit.append(w)
            after.append((corner ^ turn(enters[w], axis + 1)) * n + (axis + along[w] + 1) % n)
    return digit, after


def curve_index(levels: list[Column], bits: int = BITS) -> Column:
    """The place on the curve, a long, of the cell with these levels (0 to 2**bits - 1 each)."""
    n = len(levels)
    digit, after = (F.lit(x) for x in steps(n))
    quadrants = [sum(((F.shiftright(v, b).bitwiseAND(F.lit(1))) * (1 << k) for k, v in enumerate(levels)), F.lit(0)) for b in reversed(range(bits))]
    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))

    def step(s: Column, quadrant: Column) -> Column:
        at = s["state"] * (1 << n) + quadrant
        return F.struct((s["index"] * (1 << n) + F.get(digit, at)).alias("index"), F.get(after, at).alias("state"))

    return F.aggregate(F.array(*quadrants), start, step, lambda s: s["index"])


def level(value: Column, starts: list[tuple]) -> Column:
    """What stands beside the last of the sorted starts (value, level) that is not above value, by halving; null: as the least."""
    if len(starts) < 2:
        return F.lit(starts[0][1] if starts else 0)
    middle = len(starts) // 2
    return F.when(value >= F.lit(starts[middle][0]), level(value, starts[middle:])).otherwise(level(value, starts[:middle]))


def running(rows: DataFrame, order: list[Column], amounts: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows sorted by order, with ``place``, a number that rises in that order; and the ranges they were
    dealt to (``part``) with their rows (``n``), each amount's sum and, as before_*, the sums of all ranges before."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed, "placed", keep=True)
    ranges = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n"), *[F.sum(a).alias(a) for a in amounts])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    return placed, ranges.select("*", *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"before_{a}") for a in ["n", *amounts]])


def level_starts(df: DataFrame, value: str, bits: int = BITS) -> list[tuple]:
    """(value, level) for the values at which a new level of the column begins, 2**bits at most.

    A value's level is the place of the middle of its rows among all rows that have one.
    """
    with scope():
        counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("rows"))
        placed, ranges = running(counts, [F.col("value")], ["rows"])
        total = ranges.agg(F.sum("rows")).first()[0]
        if not total:
            return []
        within = F.sum("rows").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        base = placed.withColumn("part", F.shiftright("place", 33)).withColumn("upto", within).join(ranges.select("part", "before_rows"), "part")
        number = _share("2 * (before_rows + upto) - rows", 1 << bits, 2 * total)
        starts = base.groupBy(number.alias("level")).agg(F.min("value").alias("value"))
        return sorted((r["value"], r["level"]) for r in starts.collect())  # 2**bits rows at most


def _share(amount: str, parts: int, total: int) -> Column:
    """In which of equal parts of the total the amount, an expression, lies."""
    return F.least(F.expr(f"({amount}) * {parts} div {max(1, total)}"), F.lit(parts - 1).cast("long"))


def assign(docs: DataFrame, dimensions: tuple[str, ...], shards: int = SHARDS, law: str = "bytes", keep: tuple[str, ...] = ("doc_id",), text: str = "text", doc_id: str = "doc_id", bits: int = BITS) -> DataFrame:
    """keep, size, text_crc32, curve, shard and slot (from 0, in order of the curve) of every row.

    dimensions: columns, or ``size`` for the bytes of the text plus 1. The made columns
    replace those of keep that have their names.
    """
    if law not in ("bytes", "rows"):
        raise ValueError("law must be bytes or rows")
    made = ("size", "text_crc32", "curve", "shard", "slot")
    with scope():
        size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
        crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long"))
        own = {f"d{k}": size if d == "size" else F.col(d) for k, d in enumerate(dimensions)}
        kept = F.struct(*(F.col(c) for c in keep if c not in made), F.lit(None).alias("none")).alias("kept")
        rows = docs.select(kept, F.col(doc_id).alias("id"), size.alias("size"), crc.alias("crc"), *(v.alias(d) for d, v in own.items()), F.monotonically_increasing_id().alias("number"))
        rows = written(rows, "rows")  # texts are read once
        levels = [level(F.col(d), level_starts(rows.select(d), d, bits)) for d in own]
        amount = F.col("size") if law == "bytes" else F.lit(1).cast("long")
        sized = rows.withColumns({"curve": curve_index(levels, bits), "amount": amount}).drop(*own)
        placed, ranges = running(sized, [F.col("curve"), F.col("crc"), F.col("id").asc_nulls_first(), F.col("number")], ["amount"])
        ranges = written(ranges, "ranges", keep=True)
        firsts = _firsts(placed, ranges, shards)
        offset = F.col("before_n") + F.col("place").bitwiseAND(F.lit(ROW))
        numbered = placed.join(F.broadcast(ranges.select("part", "before_n")), F.shiftright("place", 33) == F.col("part"))  # a row for each range
        shard = level(F.col("place"), [(p, s) for s, p, _ in firsts])
        slot = offset - level(F.col("place"), [(p, r) for _, p, r in firsts])
        return numbered.select(*(F.col(f"kept.{c}").alias(c) for c in keep if c not in made), "size", F.col("crc").alias("text_crc32"), "curve", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def _firsts(placed: DataFrame, ranges: DataFrame, shards: int) -> list[tuple[int, int, int]]:
    """(shard, place, number among all rows) of the first row of each shard that has rows."""
    total = ranges.agg(F.sum("amount")).first()[0] or 0
    at = lambda twice: _share(twice, shards, 2 * total)  # noqa: E731  where the middle of a row, taken twice, lies
    whole = at("2 * before_amount") == at("2 * (before_amount + amount)")  # all of the range's rows go to one shard
    begins = ranges.where(whole).select(at("2 * before_amount").alias("shard"), F.shiftleft(F.col("part"), 33).alias("place"), F.col("before_n").alias("row"))
    cut = ranges.where(~whole).select("part", "before_n", "before_amount")  # one or two for each cut
    upto = F.sum("amount").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    inside = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(cut), "part").withColumn("upto", upto)
    inside = inside.select(at("2 * (before_amount + upto) - amount").alias("shard"), "place", (F.col("before_n") + F.col("place").bitwiseAND(F.lit(ROW))).alias("row"))
    firsts = begins.unionByName(inside).groupBy("shard").agg(F.min("place").alias("place"), F.min("row").alias("row"))
    return sorted((r["shard"], r["place"], r["row"]) for r in firsts.collect())  # a row for each shard


def write_shards(docs: DataFrame, path: str, dimensions: tuple[str, ...], shards: int = SHARDS, law: str = "bytes", files: int | None = None, **names) -> None:
    """All rows and columns as Parquet below path, a folder for each shard, its files in order of the curve.

    files: about how many files in all; without it as many as Spark makes partitions.
    """
    found = assign(docs, dimensions, shards, law, tuple(docs.columns), **names)
    dealt = found.repartitionByRange(files, "shard", "slot") if files else found.repartitionByRange("shard", "slot")
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
