"""Answers of outside services, as JSON text, to typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.text import bound, strip
from vigil.operators.merge import unique_citations


def _json(raw: Column, schema: str, body) -> Column:
    return bound(F.from_json(raw, schema), body)


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def search_results(raw: Column) -> Column:
    """array<struct<title, url, content>> of a search answer."""
    return F.coalesce(F.from_json(raw, "results array<struct<title:string,url:string,content:string>>")["results"], F.array().cast("array<struct<title:string,url:string,content:string>>"))


def candidate(raw: Column) -> Column:
    """struct(text, citations, queries) of the first candidate; null without one."""
    schema = "candidates array<struct<content:struct<parts:array<struct<text:string>>>,groundingMetadata:struct<groundingChunks:array<struct<web:struct<uri:string,title:string>>>,webSearchQueries:array<string>>>>"

    def of(d: Column) -> Column:
        first = F.get(d["candidates"], F.lit(0))
        text = strip(F.array_join(F.transform(first["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), ""))
        web = F.transform(first["groundingMetadata"]["groundingChunks"], lambda c: c["web"])
        return F.when(first.isNotNull(), F.struct(F.coalesce(text, F.lit("")).alias("text"), unique_citations(web).alias("citations"), first["groundingMetadata"]["webSearchQueries"].alias("queries")))

    return _json(raw, schema, of)


def chat_text(raw: Column) -> Column:
    """The first choice's text; null (an error) if it is missing or blank."""
    return _json(raw, "choices array<struct<message:struct<content:string>>>", lambda d: _some(strip(F.get(d["choices"], F.lit(0))["message"]["content"])))


def snapshot_url(timestamp: Column, url: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/"), timestamp, F.lit("/"), url)


def save_answer(raw: Column) -> Column:
    """struct(job_id, error) of a request for a snapshot."""

    def of(d: Column) -> Column:
        job = _some(d["job_id"])
        why = F.when(d.isNull(), "bad_response").otherwise(F.coalesce(_some(d["message"]), _some(d["status_ext"]), F.lit("no_job_id")))
        return F.struct(job.alias("job_id"), F.when(job.isNull(), why).alias("error"))

    return _json(raw, "job_id string, message string, status_ext string", of)


def job_answer(raw: Column) -> Column:
    """struct(status, timestamp, snapshot_url, reason) of a job; pending if unclear."""

    def of(d: Column) -> Column:
        done, failed = d["status"] == "success", d["status"] == "error"
        both = F.coalesce((d["timestamp"] != "") & (d["original_url"] != ""), F.lit(False))
        return F.struct(
            F.when(done, "success").when(failed, "error").otherwise("pending").alias("status"),
            F.when(done, d["timestamp"]).alias("timestamp"),
            F.when(done & both, snapshot_url(d["timestamp"], d["original_url"])).alias("snapshot_url"),
            F.when(failed, F.coalesce(_some(d["message"]), _some(d["status_ext"]), F.lit("error"))).alias("reason"),
        )

    return _json(raw, "status string, timestamp string, original_url string, message string, status_ext string", of)


def capacity_answer(raw: Column) -> Column:
    """struct(available, daily_remaining); null where the service does not say."""
    return _json(raw, "available int, daily_captures int, daily_captures_limit int", lambda d: F.struct(d["available"].alias("available"), (d["daily_captures_limit"] - d["daily_captures"]).alias("daily_remaining")))


def availability_answer(raw: Column) -> Column:
    """struct(snapshot_url, timestamp) of the closest snapshot, by https; null without one."""
    schema = "archived_snapshots struct<closest:struct<available:boolean,url:string,timestamp:string>>"

    def of(d: Column) -> Column:
        c = d["archived_snapshots"]["closest"]
        ok = F.coalesce(c["available"] & (c["url"] != ""), F.lit(False))
        return F.when(ok, F.struct(F.regexp_replace(c["url"], "^http://", "https://").alias("snapshot_url"), c["timestamp"].alias("timestamp")))

    return _json(raw, schema, of)
