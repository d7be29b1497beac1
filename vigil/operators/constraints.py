"""Table rules as queries for their violations, and schema completion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CATEGORIES = ["kindness", "critique"]
CHECK_STATUS = ["unchecked", "live", "deleted", "blocked", "error"]
SNAPSHOT_STATUS = ["queued", "pending", "success", "error", "skipped"]
PROMOTION_STATUS = ["pending_review", "promoted", "blocked_pii", "skipped"]


def is_uuid(c: Column) -> Column:
    """What the usual UUID parser takes: 32 hex digits, hyphens, braces and urn:uuid: allowed."""
    bare = F.regexp_replace(F.regexp_replace(c, "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", "")
    return F.coalesce(F.rlike(F.regexp_replace(bare, "-", ""), F.lit("^[0-9a-fA-F]{32}$")), F.lit(False))


def duplicates(table: DataFrame, keys: list[str], rule: str) -> DataFrame:
    counted = table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return counted.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n")


def outside(table: DataFrame, column: str, allowed: list[str], key: str, rule: str, optional: bool = False) -> DataFrame:
    bad = ~F.col(column).isin(allowed)
    bad = F.coalesce(bad, F.lit(not optional))
    return table.where(bad).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("n"))


def missing_parent(child: DataFrame, column: str, parent: DataFrame, key: str, rule: str) -> DataFrame:
    lost = child.join(parent.select(F.col(key).alias("__p")).distinct(), child[column] == F.col("__p"), "left_anti")
    return lost.groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "key", "n")


def violations(*parts: DataFrame) -> DataFrame:
    """rule, key, n of every violation."""
    return reduce(DataFrame.unionByName, parts)


def complete(table: DataFrame, schema: StructType) -> DataFrame:
    """table with every column of the schema; those it lacks are null."""
    return table.select(*[F.col(f.name).cast(f.dataType) if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
