"""Structural personal identifiers of whole texts, by patterns whose cost stays linear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import fixed
from vigil.functions.text import bound, first_match, strip


def mask(found: Column) -> Column:
    """The first two characters, the rest starred; shorter ones starred whole."""
    return bound(strip(found), lambda s: F.when(F.length(s) <= 2, F.repeat(F.lit("*"), F.length(s))).otherwise(F.concat(F.substring(s, 1, 2), F.repeat(F.lit("*"), F.length(s) - 2))))


# The same finds as ``fixed.PII_DETECTORS``, by patterns whose cost is linear in the text.
LOCAL = r"[A-Za-z0-9._%+\-]"
ADDRESS = r"@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
INSIDE = r"(?<=[\s\S])"  # not at the first character
# what the 128 characters after a chunk hold if a find that starts in the chunk may reach beyond them
OPEN = rf"(?U)\A[\dA-Za-z0-9._%+\-@]{{{fixed.PII_OVERLAP}}}|\s{{{fixed.PII_OVERLAP // 2}}}"


def _pattern(kind: str, pattern: str, inside: bool) -> str:
    """inside: finds start at the second character or later, the first one being only looked at."""
    if kind == "email":  # each run of its characters is looked at once; the find starts at the run's first boundary
        begins = rf"(?:(?<!{LOCAL})|(?<=\A[\s\S]))" if inside else rf"(?<!{LOCAL})"
        return rf"(?U){INSIDE if inside else ''}{begins}(?={LOCAL}++{ADDRESS}){LOCAL}*?\b({LOCAL}+{ADDRESS})"
    linear = pattern.removeprefix("(?U)").replace(r"\s*-?\s*", r"\s*+(?:-\s*+)?")
    return rf"(?U){INSIDE if inside else ''}({linear})"


def _finds(c: Column, begin: Column | None = None, end: Column | None = None) -> Column:
    """The first find of each kind as struct(chunk, order, kind, text): of a whole text, or of those places of
    the text from begin on, before end, that c holds behind the character before them."""

    def of(order: int, kind: str, pattern: str) -> Column:
        regex = _pattern(kind, pattern, begin is not None)
        found = first_match(c, regex, 1)
        if kind == "email":  # most texts have no such sign, and the pattern is slow
            found = F.when(F.contains(c, F.lit("@")), found).otherwise("")
        at = F.regexp_instr(c, F.lit(regex)) - 1 + F.length(first_match(c, regex)) - F.length(found)
        at = at if begin is None else begin + at - 1
        find = F.struct(F.floor(at / fixed.PII_CHUNK).alias("chunk"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), found.alias("text"))
        return F.when((found != "") if end is None else (found != "") & (at < end), find)

    return F.array_compact(F.array(*[of(order, kind, pattern) for order, (kind, pattern) in enumerate(fixed.PII_DETECTORS)]))


def _summary(found: Column) -> Column:
    """struct(hit, kinds, samples) of the first find of each kind."""
    return bound(F.array_sort(found), lambda x: F.struct(
        (F.size(x) > 0).alias("hit"),
        F.transform(x, lambda e: e["kind"]).alias("kinds"),
        F.transform(x, lambda e: F.concat(e["kind"], F.lit(":"), mask(e["text"]))).alias("samples"),
    ))


def scan(text: Column) -> Column:
    """struct(hit, kinds, samples): kinds by their find's chunk and then detector, one masked sample each."""
    return _summary(_finds(F.coalesce(text, F.lit(""))))


def scan_parts(parts: DataFrame, key: str = "id", part: str = "part", text: str = "text") -> DataFrame:
    """key and found, what ``scan`` gives of the text that a key's parts make in their order, without making it.

    Each part is cut at the chunks that it has a share in, and the shares of a chunk meet in a
    shuffle, with the character before and 128 after. A find that starts in a chunk ends within
    these, but for runs of white space or of an address's or number's characters: chunks that such
    a run joins are looked at together. So a task holds parts and chunks, however long a text is.
    The first finds of a kind are a minimum, which partial sums of any tasks give. Only the
    parts' lengths are summed in order. Null parts are empty; a null key is one text.
    """
    step, size = fixed.PII_CHUNK, fixed.PII_CHUNK + fixed.PII_OVERLAP
    rows = parts.select(F.struct(F.col(key).alias("key")).alias("k"), F.col(part).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sized = rows.select("k", "part", F.length("text").cast("long").alias("n"))
    begins = sized.withColumn("begin", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = rows.join(begins.where("n > 0").select("k", "part", "begin", "n"), ["k", "part"])
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("begin") - size) / step) + 1)
    last = F.floor((F.col("begin") + F.col("n")) / step)  # the chunk after takes the last character too
    shares = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("begin"), F.col("chunk") * step - 1)
    end = F.least(F.col("begin") + F.col("n"), F.col("chunk") * step + size)
    share = F.substr("text", (start - F.col("begin") + 1).cast("int"), (end - start).cast("int"))
    whole = shares.select("k", "chunk", F.struct("part", share.alias("text")).alias("s")).groupBy("k", "chunk").agg(F.array_sort(F.collect_list("s")).alias("s"))  # ``size`` characters
    before = F.when(F.col("chunk") == 0, "\n").otherwise("")  # what no find holds, as the character before the text
    held = whole.select("k", "chunk", F.concat(before, F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("text"))
    opened = lambda at: F.rlike(F.substring("text", at, fixed.PII_OVERLAP), F.lit(OPEN))
    held = held.select("*", opened(2).alias("goes_on"), opened(step + 2).alias("reaches"))
    looked = lambda df, first, last: df.select("k", F.explode(_finds(F.col("text"), F.col(first) * step, (F.col(last) + 1) * step)).alias("f"))
    alone = looked(held.where("not (goes_on and chunk > 0) and not reaches"), "chunk", "chunk")
    runs = held.where("goes_on and chunk > 0 or reaches").withColumn("first", F.max(F.when(~(F.col("goes_on") & (F.col("chunk") > 0)), F.col("chunk"))).over(Window.partitionBy("k").orderBy("chunk")))
    own = F.when(F.col("reaches"), F.substring("text", 1, step + 1)).otherwise(F.col("text"))
    piece = F.struct("chunk", F.when(F.col("chunk") == F.col("first"), own).otherwise(F.substr(own, F.lit(2))).alias("text"))
    joined = runs.groupBy("k", "first").agg(F.array_sort(F.collect_list(piece)).alias("s")).select("k", "first", F.array_max("s.chunk").alias("last"), F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"))
    found = alone.unionByName(looked(joined, "first", "last"))
    best = found.groupBy("k", F.col("f.kind").alias("kind")).agg(F.min("f").alias("f")).groupBy("k").agg(F.collect_list("f").alias("f"))  # a find for each kind
    none = F.array().cast(best.schema["f"].dataType)
    return rows.select("k").distinct().join(best, "k", "left").select(F.col("k.key").alias(key), _summary(F.coalesce("f", none)).alias("found"))


def has_pii(text: Column) -> Column:
    return scan(text)["hit"]
