"""Writes as functions from a snapshot and changes to the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.text import first_of_each


def _equal(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def latest_by_key(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return log.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changed rows take each supplied column, others keep theirs; unknown keys are added.

    changes has one row for a key; columns that it lacks are left alone, or null in new rows.
    """
    t, c = table.alias("t"), changes.withColumn("__hit", F.lit(True)).alias("c")
    joined = t.join(c, [F.col(f"t.{k}") == F.col(f"c.{k}") for k in keys], "full_outer")
    pick = []
    for name in [*table.columns, *[x for x in changes.columns if x not in table.columns]]:
        old = F.col(f"t.{name}") if name in table.columns else F.lit(None)
        if name in keys:
            pick.append(F.coalesce(F.col(f"c.{name}"), old).alias(name))
        elif name in changes.columns:
            pick.append(F.when(F.col("c.__hit"), F.col(f"c.{name}")).otherwise(old).alias(name))
        else:
            pick.append(old.alias(name))
    return joined.select(*pick)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows whose key it does not have; one row for a new key."""
    new = rows.dropDuplicates(keys).join(table.select(*keys).distinct(), keys, "left_anti")
    return table.unionByName(new, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Known rows take the columns of their change; unknown keys are ignored."""
    c = changes.withColumn("__hit", F.lit(True)).withColumnsRenamed({x: f"__c_{x}" for x in changes.columns})
    joined = table.join(c, table[key] == c[f"__c_{key}"], "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__c_{x}")).otherwise(F.col(x)).alias(x) if x in changes.columns and x != key else F.col(x) for x in table.columns])


def citations(stories: DataFrame) -> DataFrame:
    """(story_id, url): every citation address that is text, once for a story."""
    pairs = stories.select(F.col("id").alias("story_id"), F.explode("citations").alias("c")).select("story_id", F.col("c.uri").alias("url"))
    return pairs.where("url is not null and url <> ''").distinct()


def register(checks: DataFrame, stories: DataFrame, as_of: Column) -> DataFrame:
    """checks with the stories' citations: due at once, and unchecked again if they were known."""
    rows = citations(stories).select("story_id", "url", F.lit("unchecked").alias("status"), as_of.alias("next_check_at"))
    return upsert(checks, rows, ["story_id", "url"])


def unique_citations(entries: Column) -> Column:
    """Citations (uri, title) with an address, first copies, title defaulting to it."""
    named = F.transform(F.filter(entries, lambda c: F.coalesce(c["uri"] != "", F.lit(False))), lambda c: F.struct(F.coalesce(F.nullif(c["title"], F.lit("")), c["uri"]).alias("title"), c["uri"].alias("uri")))
    return first_of_each(named, lambda c: c["uri"])


def rewrite_links(stories: DataFrame, old: str, new: str) -> DataFrame:
    """Archive links of one gateway moved to another."""
    url = F.col("arweave_url")
    return stories.withColumn("arweave_url", F.when(url.like(old + "%"), F.concat(F.lit(new), F.substr(url, F.lit(len(old) + 1)))).otherwise(url))


def backfill(checks: DataFrame, as_of: Column) -> DataFrame:
    """deleted_at of deleted rows from last_checked, next_check_at from what is known."""
    out = checks
    if "deleted_at" in checks.columns:
        out = out.withColumn("deleted_at", F.when((F.col("status") == "deleted") & F.col("deleted_at").isNull(), F.col("last_checked")).otherwise(F.col("deleted_at")))
    if "next_check_at" in checks.columns:
        seen = [F.col(c) for c in ("last_checked", "first_seen") if c in checks.columns]
        out = out.withColumn("next_check_at", F.coalesce("next_check_at", *seen, as_of))
    return out
