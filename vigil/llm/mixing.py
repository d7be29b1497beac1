"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code point order, null last, weigh 3, 1, 2 and so on in turn and share
``SHARE`` of all words; no target passes ``MOST_COPIES`` times its source, the excess
being shared again by weight. A document of source S is due target(S) / size(S)
copies: the whole part is taken, the fraction is a probability. Two documents'
fractions are settled together: words move from one to the other, in a direction
drawn so that both expectations hold, until one fraction is 0 or 1. Their sum in
words never changes, so a source misses its target by less than one document.

Rows that are equal in all that is kept and in their text are one item: rounding n equal
fractions among themselves leaves the whole part of their sum as full copies and one
fraction, which is what enters the tree. A block of about ``BLOCK`` items of a source is
folded in one row, long ones first, so that the fraction left open soon is that of a
short one; the one fraction it leaves goes to the next level, where ``BLOCK`` blocks meet,
up to one per source: a reduction tree, whose groups are bounded however large a source
is, and however many rows or ids are equal or null. Draws are hashes of the items and
all sums are of whole numbers, so reruns agree.

Defined results: null and empty texts have size 0 and take 0 words; a source of size
0 has target 0; repeated rows are documents of their own, and how many of them are taken
is settled, as they cannot be told apart; an empty table gives an empty table; other
columns than those kept are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.quality import let
from vigil.llm.store import scope, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
BLOCK = 64
BROADCAST_SOURCES = 10_000
CHUNK = 4096  # equal rows that come out together


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def _numbered(stats: DataFrame) -> DataFrame:
    """stats, one row for a source, with ``turn``, the source's number from 0 in order: ranges of
    sources are numbered apart, so that no task sees all of them."""
    order = F.col("source").asc_nulls_last()
    placed = written(stats.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    ahead = placed.groupBy("part").count().select(F.col("part").alias("__part"), F.coalesce(before, F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return placed.withColumn("within", within).join(ahead, F.col("part") == F.col("__part")).withColumn("turn", F.col("within") + F.col("ahead"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, n (items), target: one row per source of (source, size, rows)."""
    stats = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("turn") % len(WEIGHTS)).cast("int"))
    stats = written(_numbered(stats).select("source", "source_size", "n", weight.cast("long").alias("weight")), "weights")
    cap = F.col("source_size") * MOST_COPIES
    words = (stats.agg(F.sum("source_size")).first()[0] or 0) * SHARE
    level, full = -1.0, -1
    while True:  # sources whose cap lies under the level are full; the rest share what is left
        is_full = cap < F.col("weight") * level
        row = stats.agg(F.count_if(is_full), F.sum(F.when(is_full, cap)), F.sum(F.when(~is_full, F.col("weight")))).first()
        if row[0] == full or not row[2]:
            break
        full = row[0]
        level = (words - (row[1] or 0)) / row[2]
    return stats.select("source", "source_size", "n", F.least(cap.cast("double"), F.col("weight") * level).alias("target"))


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) made from the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def fold(items: Column, salt: int) -> Column:
    """Pivotal rounding over items (order, h, doc, size, p): struct(open: the item left over or null, done: array of (doc, size, up))."""

    def settled(x: Column, up: Column) -> Column:
        return F.struct(x["doc"].alias("doc"), x["size"].alias("size"), up.cast("int").alias("up"))

    def moved(x: Column, p: Column) -> Column:
        return F.struct(x["order"].alias("order"), x["h"].alias("h"), x["doc"].alias("doc"), x["size"].alias("size"), p.alias("p"))

    def pair(state: Column, j: Column) -> Column:
        i = state["open"]
        si, sj = i["size"].cast("double"), j["size"].cast("double")
        i_up, j_down, i_down, j_up = si * (1 - i["p"]), sj * j["p"], si * i["p"], sj * (1 - j["p"])
        known = F.struct(F.least(i_up, j_down).alias("a"), F.least(i_down, j_up).alias("b"), i_up.alias("iu"), i_down.alias("id"), _draw(i["h"], j["h"], F.lit(salt)).alias("u"))

        def step(t: Column) -> Column:
            a, b = t["a"], t["b"]
            clip = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
            rise = t["u"] * (a + b) < b  # i rises by a words with probability b / (a + b), else falls by b
            first_one = rise & (a == t["iu"])
            first_zero = ~rise & (b == t["id"])
            new_i = F.when(rise, clip(i["p"] + a / si)).otherwise(clip(i["p"] - b / si))
            new_j = F.when(rise, clip(j["p"] - a / sj)).otherwise(clip(j["p"] + b / sj))
            gone = first_one | first_zero
            left = F.when(gone, moved(j, new_j)).otherwise(moved(i, new_i))
            # j ends at 0 if i rises and at 1 if i falls
            end = F.when(gone, settled(i, first_one)).otherwise(settled(j, ~rise))
            return F.struct(left.alias("open"), F.array_append(state["done"], end).alias("done"))

        return let(known, step)

    def add(state: Column, x: Column) -> Column:
        alone = (x["size"] == 0) | (x["p"] <= 0)
        out = F.struct(state["open"].alias("open"), F.array_append(state["done"], settled(x, _draw(x["h"], F.lit(salt)) < x["p"])).alias("done"))
        return F.when(alone, out).otherwise(F.when(state["open"].isNull(), F.struct(x.alias("open"), state["done"].alias("done"))).otherwise(pair(state, x)))

    empty = F.filter(F.transform(F.slice(items, 1, 1), lambda x: settled(x, F.lit(0))), lambda x: F.lit(False))
    none = F.when(F.lit(False), F.get(items, F.lit(0)))
    return F.aggregate(items, F.struct(none.alias("open"), empty.alias("done")), add)


def items(docs: DataFrame, source: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK, seed: int = 0) -> DataFrame:
    """One row for equal rows: doc (a struct of ``keep``), size, source_size, target, rows, and of
    these rows ``more`` take ``whole + 1`` copies and the others ``whole``."""
    with scope():
        content = F.xxhash64(F.col(text)).alias("content")
        sized = docs.select(F.struct(*keep).alias("doc"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), content)
        sized = written(sized.groupBy("doc", "source", "size", "content").agg(F.count("*").alias("rows")), "sizes")
        due = written(targets(sized).withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / block))), "targets")
        side = F.broadcast(due) if due.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else due
        joined = sized.join(side.withColumnRenamed("source", "__m_source"), F.col("source").eqNullSafe(F.col("__m_source")))
        rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.lit(float(MOST_COPIES)), F.col("target") / F.col("source_size")))
        h = F.xxhash64("doc", "source", "content", F.lit(seed))
        joined = joined.withColumns({"whole": F.floor(rate).cast("int"), "h": h, "sum": F.col("rows") * (rate - F.floor(rate))})
        one = F.struct(F.col("doc"), F.col("size"), F.col("rows"), F.floor("sum").alias("more")).alias("doc")
        item = F.struct((-F.col("size")).alias("order"), F.col("h"), one, F.col("size"), (F.col("sum") - F.floor("sum")).alias("p"))
        number = F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.col("blocks"))
        rows = joined.select("source", "source_size", "target", "whole", "blocks", number.alias("block"), item.alias("item"))
        most = due.agg(F.max("blocks")).first()[0] or 1
        about, levels = ["source", "source_size", "target", "whole", "blocks", "block"], []
        while True:
            folded = rows.groupBy(*about).agg(F.array_sort(F.collect_list("item")).alias("items"))
            folded = written(folded.select(*about, fold(F.col("items"), seed + len(levels)).alias("f")), "mix", keep=True)
            levels.append(folded.select(*about[:4], F.explode("f.done").alias("e")).select(*about[:4], "e.doc", "e.up"))
            rows = folded.where("f.open is not null").select(*about[:4], F.ceil(F.col("blocks") / block).alias("blocks"), F.floor(F.col("block") / block).alias("block"), F.col("f.open").alias("item"))
            if most <= 1:
                break
            most = -(-most // block)
        up = F.col("item.p") >= 0.5  # one item of a source at most: to the nearer side of its target
        done = rows.select(*about[:4], F.col("item.doc").alias("doc"), up.cast("int").alias("up"))
        for level in levels:
            done = done.unionByName(level)
        return done.select("doc.doc", "doc.size", "source_size", "target", "doc.rows", "whole", (F.col("doc.more") + F.col("up")).alias("more"))


def repeated(df: DataFrame, n: str, *by: str) -> DataFrame:
    """Every row n times; by: what tells rows apart. Many copies come out in chunks, which are dealt to many tasks."""
    parts = df.where(F.col(n) > 0).withColumn("__m_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK))))
    parts = parts.repartition(*by, "__m_part")
    copies = F.least(F.lit(CHUNK).cast("long"), F.col(n) - F.col("__m_part") * CHUNK)
    return parts.withColumn("__m_row", F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop("__m_part", "__m_row")


def mix(docs: DataFrame, source: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK, seed: int = 0) -> DataFrame:
    """keep, size, source_size, target, copies (0, 1 or 2) and taken = copies * size of every row."""
    found = items(docs, source, text, keep, block, seed)
    out = [F.col(f"doc.{k}").alias(k) for k in keep] + [F.col("size"), F.col("source_size"), F.col("target"), F.col("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken")]
    single = found.where("rows = 1").withColumn("copies", F.col("whole") + F.col("more").cast("int"))
    kinds = F.array(*[F.struct(n.alias("n"), c.cast("int").alias("copies")) for n, c in ((F.col("more"), F.col("whole") + 1), (F.col("rows") - F.col("more"), F.col("whole")))])
    many = repeated(found.where("rows > 1").select("doc", "size", "source_size", "target", F.inline(kinds)), "n", "doc", "copies")
    return single.select(*out).unionByName(many.select(*out))
