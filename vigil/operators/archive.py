"""The archive state of a story: free, claimed, archived; and what is archived."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, StringType, StructType, TimestampNTZType, TimestampType

from vigil.config import PENDING, Config
from vigil.operators.schedule import backoff_ready, seconds_after


def _stale(as_of: Column, cfg: Config) -> Column:
    return F.coalesce(F.col("last_archive_attempt") < seconds_after(as_of, F.lit(-cfg.pending_timeout)), F.lit(False))


def claim(stories: DataFrame, ids: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """stories after workers claimed ids (column id): free ones, and claims older than the time-out."""
    asked = ids.select(F.col("id").alias("__id")).distinct()
    joined = stories.join(asked, stories["id"] == F.col("__id"), "left")
    tx = F.col("arweave_tx_id")
    wins = F.col("__id").isNotNull() & (tx.isNull() | ((tx == PENDING) & _stale(as_of, cfg)))
    return joined.withColumns({"claimed": wins, "last_archive_attempt": F.when(wins, as_of).otherwise(F.col("last_archive_attempt")), "arweave_tx_id": F.when(wins, PENDING).otherwise(tx)}).drop("__id")


def settle(stories: DataFrame, results: DataFrame, as_of: Column, link: str = "https://gateway.irys.xyz/") -> DataFrame:
    """Claimed stories after their uploads. results: id, tx (null if it failed), error."""
    r = results.select(F.col("id").alias("__id"), F.col("tx").alias("__tx"), F.col("error").alias("__error"))
    joined = stories.join(r, stories["id"] == F.col("__id"), "left")
    held = F.coalesce(F.col("__id").isNotNull() & (F.col("arweave_tx_id") == PENDING), F.lit(False))
    won, lost = held & F.col("__tx").isNotNull(), held & F.col("__tx").isNull()
    attempts = F.coalesce(F.col("archive_attempts"), F.lit(0))
    return joined.withColumns({
        "arweave_tx_id": F.when(won, F.col("__tx")).when(~lost, F.col("arweave_tx_id")),
        "arweave_url": F.when(won, F.concat(F.lit(link), F.col("__tx"))).otherwise(F.col("arweave_url")),
        "archived_at": F.when(won, as_of).otherwise(F.col("archived_at")),
        "archive_attempts": F.when(lost, attempts + 1).otherwise(attempts).cast("int"),
        "last_archive_attempt": F.when(lost, as_of).otherwise(F.col("last_archive_attempt")),
        "last_archive_error": F.when(lost, F.substring("__error", 1, 500)),
    }).drop("__id", "__tx", "__error")


def recover(stories: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """Claims older than the time-out are free again."""
    lost = (F.col("arweave_tx_id") == PENDING) & _stale(as_of, cfg)
    return stories.withColumn("arweave_tx_id", F.when(~F.coalesce(lost, F.lit(False)), F.col("arweave_tx_id")))


def retry_candidates(stories: DataFrame, as_of: Column, cfg: Config = Config()) -> DataFrame:
    """Free stories with most cached votes, of which those not worn out have waited long enough."""
    top = stories.where(F.col("arweave_tx_id").isNull()).orderBy(F.col("vote_count").desc_nulls_last(), "id").limit(cfg.sweep_candidates)
    tries = F.coalesce(F.col("archive_attempts"), F.lit(0))
    return top.where((tries < cfg.max_attempts) & backoff_ready(tries, F.col("last_archive_attempt"), as_of, cfg))


def retry_now(candidates: DataFrame, signals: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The few candidates to retry in one sweep: due by their real votes, most cached votes first."""
    due = signals.where((F.col("votes") >= F.col("threshold")) & ~F.col("archived")).select(F.col("id").alias("__id"))
    return candidates.join(due, candidates["id"] == F.col("__id"), "left_semi").orderBy(F.col("vote_count").desc_nulls_last(), "id").limit(cfg.sweep_retries)


_RECORD = {
    "citations": "array<struct<title:string,uri:string>>", "search_queries": "array<string>", "community_count": "bigint", "news_count": "bigint",
    "reason": "string", "last_checked": "string", "check_count": "int",
}


def _have(table: DataFrame, *names: str) -> list[Column]:
    """The named columns; null where the table lacks one."""
    return [F.col(n) if n in table.columns else F.lit(None).cast(_RECORD.get(n, "string")).alias(n) for n in names]


def iso_text(at: Column, kind: DataType) -> Column:
    """The time as ISO text in UTC with its offset: six digits of a second's part, none if that is zero. Text is taken as it is.

    kind: the column's type; times without a zone are in UTC.
    """
    if isinstance(kind, TimestampType):
        at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    elif not isinstance(kind, TimestampNTZType):
        return at
    part = F.unix_micros(at.cast("timestamp")) % 1_000_000
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def _with_iso_times(table: DataFrame) -> DataFrame:
    times = {f.name: iso_text(F.col(f.name), f.dataType) for f in table.schema if isinstance(f.dataType, (TimestampType, TimestampNTZType))}
    return table.withColumns(times) if times else table


def bundle(stories: DataFrame, votes: DataFrame, checks: DataFrame, archived_at: Column, version: str = "vigil-archive-v2") -> DataFrame:
    """id and dataset: the nested record that is signed and uploaded; votes in order of time, checks in order of url.

    Times are ISO text with their offset (``iso_text``), so that what is signed keeps their microseconds.
    """
    archived_at = iso_text(archived_at, stories.select(archived_at.alias("at")).schema["at"].dataType)
    stories, votes, checks = map(_with_iso_times, (stories, votes, checks))
    log = votes.groupBy(F.col("story_id").alias("__v")).agg(F.array_sort(F.collect_list(F.struct("created_at", "user_id"))).alias("__log"))
    check = F.struct(*_have(checks, "url", "status", "http_code", "reason", "last_checked", "check_count"))
    status = checks.groupBy(F.col("story_id").alias("__c")).agg(F.array_sort(F.collect_list(check)).alias("__status"))
    joined = stories.join(log, stories["id"] == F.col("__v"), "left").join(status, stories["id"] == F.col("__c"), "left")
    none = lambda table, *names: F.array().cast(f"array<struct<{','.join(f'{n}:{t.simpleString()}' for n, t in ((f.name, f.dataType) for f in table.select(*names).schema))}>>")
    log, status = F.coalesce("__log", none(votes, "created_at", "user_id")), F.coalesce("__status", none(checks.select(check.alias("c")).select("c.*"), "*"))
    many = lambda s: F.size(F.filter(status, lambda c: c["status"] == s))
    category, body, created_at = _have(stories, "category", "body", "created_at")
    empty = lambda n: F.coalesce(_have(stories, n)[0], F.array().cast(_RECORD[n])).alias(n)
    return joined.select("id", F.struct(
        F.struct("id", category, body, empty("citations"), empty("search_queries"), created_at).alias("story"),
        F.struct(F.size(log).alias("count"), log.alias("log")).alias("votes"),
        F.struct(*_have(stories, "gap_score", "community_count", "news_count"), many("deleted").alias("deleted_count"), many("blocked").alias("blocked_count"), status.alias("citation_status")).alias("evidence"),
        archived_at.alias("archived_at"),
        F.lit(version).alias("version"),
    ).alias("dataset"))


# The characters that JSON text escapes, besides the quote and the backslash.
ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _quoted(c: Column) -> Column:
    """Text as JSON: what must be escaped is, all else stays."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = plain
    for sign in map(chr, range(32)):
        escaped = F.replace(escaped, F.lit(sign), F.lit(ESCAPES.get(sign, f"\\u{ord(sign):04x}")))
    return F.concat(F.lit('"'), F.when(F.rlike(c, F.lit(r"[\x00-\x1f]")), escaped).otherwise(plain), F.lit('"'))


def _json(c: Column, kind: DataType) -> Column | None:
    """Canonical JSON of a value, as an expression; None for types whose text is not plain (fractions, times, maps)."""
    if isinstance(kind, StructType):
        parts = [(f.name, _json(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        if any(p is None for _, p in parts):
            return None
        named = [x for i, (n, p) in enumerate(parts) for x in (F.lit(f"{', ' if i else ''}{json.dumps(n, ensure_ascii=False)}: "), p)]
        text = F.concat(F.lit("{"), *named, F.lit("}"))
    elif isinstance(kind, ArrayType):
        if _json(F.lit(None).cast(kind.elementType), kind.elementType) is None:
            return None
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, StringType):
        text = _quoted(c)
    elif isinstance(kind, (IntegralType, BooleanType)):
        text = c.cast("string")
    else:
        return None
    return F.when(c.isNull(), "null").otherwise(text)


def canonical_json(df: DataFrame, column: str, name: str = "canonical") -> DataFrame:
    """df with the JSON that is signed: sorted keys, ", " and ": " between parts, text unescaped; null for a null record.

    Records of text, whole numbers, truth values, lists and structs are written by expressions; others pass through Python.
    """
    text = _json(F.col(column), df.schema[column].dataType)
    if text is not None:
        return df.withColumn(name, F.when(F.col(column).isNotNull(), text))

    @F.pandas_udf("string")
    def dumped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False))

    return df.withColumn(name, dumped(F.to_json(column, {"ignoreNullFields": "false"})))


def upload_tags(dataset: Column, public_key: Column, application: str = "Vigil", version: str = "6.0") -> Column:
    """The name and value pairs of an upload of a record made by ``bundle``."""
    story, evidence = dataset["story"], dataset["evidence"]
    text = lambda c, other: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(other))
    pairs = [
        ("Content-Type", F.lit("application/json")), ("App-Name", F.lit(application)), ("App-Version", F.lit(version)),
        ("Category", text(story["category"], "unknown")), ("Vote-Count", text(dataset["votes"]["count"], "0")), ("Signed-By", F.coalesce(F.substring(public_key, 1, 20), F.lit(""))),
        ("Story-Id", story["id"].cast("string")), ("Gap-Score", text(evidence["gap_score"], "none")), ("Deleted-Count", text(evidence["deleted_count"], "0")),
    ]
    return F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs])
