"""Domain tables made from the driver's tables, as SQL that Spark and DuckDB both run.

They feed the query catalogue; an application passes its own tables to the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "stories": """
SELECT o_orderkey AS id,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'critique' ELSE 'kindness' END AS category,
  concat('Story ', CAST(o_orderkey AS STRING), ' of <', o_orderpriority, '> & co', chr(10), 'second line') AS body,
  o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '3' DAY END AS archived_at,
  CASE WHEN o_orderstatus = 'F' THEN concat('tx', CAST(o_orderkey AS STRING))
       WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN '__pending__' END AS arweave_tx_id,
  CASE WHEN o_orderstatus = 'F' THEN concat('https://arweave.net/tx', CAST(o_orderkey AS STRING)) END AS arweave_url,
  CASE WHEN o_orderkey % 20 = 0 THEN 'extreme' WHEN o_orderkey % 20 = 1 THEN 'high' WHEN o_orderkey % 20 = 2 THEN 'medium' ELSE 'none' END AS gap_score,
  CAST(o_orderkey % 5 AS INT) AS archive_attempts,
  CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + INTERVAL '1' DAY END AS last_archive_attempt,
  CAST(o_orderkey % 11 AS INT) AS volatility_score,
  CAST(o_orderkey % 4 AS INT) AS vote_count,
  o_orderkey % 7 = 0 AS from_capture,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('https://src', CAST(o_orderkey % 20 AS STRING), '.example/', CAST(o_orderkey AS STRING)) END AS origin_captured_url
FROM {orders}""",
    "citation_checks": """
SELECT story_id, url, min(status) AS status, min(http_code) AS http_code, min(reason) AS reason, max(last_checked) AS last_checked, min(check_count) AS check_count,
  CAST(max(check_count) % 4 AS INT) AS error_count
FROM (
  SELECT l_orderkey AS story_id,
    concat('https://h', CAST(l_suppkey AS STRING), '.example/p/', CAST(l_partkey AS STRING)) AS url,
    CASE WHEN l_returnflag = 'R' THEN 'deleted' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'blocked'
         WHEN l_returnflag = 'A' THEN 'error' WHEN l_linestatus = 'F' THEN 'unchecked' ELSE 'live' END AS status,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN CASE WHEN l_partkey % 2 = 0 THEN 404 ELSE 410 END
         WHEN l_returnflag = 'R' THEN 200
         WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN CASE WHEN l_partkey % 2 = 0 THEN 403 ELSE 200 END
         WHEN l_returnflag = 'A' THEN CASE WHEN l_partkey % 3 = 0 THEN 200 ELSE 503 END WHEN l_linestatus = 'F' THEN NULL ELSE 200 END AS http_code,
    CASE WHEN l_returnflag = 'R' THEN '삭제 표식: 삭제된 글'
         WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN CASE WHEN l_partkey % 3 = 0 THEN '봇 차단 — 삭제 추적 불가' ELSE 'HTTP 503' END END AS reason,
    l_shipdate AS last_checked, l_linenumber AS check_count
  FROM {lineitem}) x
GROUP BY story_id, url""",
    "votes": """
SELECT event_id AS id, event_id % 997 AS story_id, user_id, ts AS created_at FROM {events}""",
    "captured_posts": """
SELECT d.doc_id AS id, concat('https://', d.source, '.example/', CAST(d.doc_id AS STRING)) AS url, d.source AS source,
  split_part(d.text, chr(10), 1) AS title, d.text AS body_text,
  CAST(coalesce(l.quality, 0) * 5 + coalesce(l.toxic, 0) * 5 AS INT) AS volatility_score,
  CASE WHEN d.doc_id % 3 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS hard_deleted_at,
  CASE WHEN d.doc_id % 3 = 0 THEN 'deleted' WHEN d.doc_id % 11 = 0 THEN 'error' ELSE 'live' END AS status,
  CASE WHEN d.doc_id % 13 = 0 THEN 'skipped' WHEN d.doc_id % 17 = 0 THEN 'promoted' END AS promotion_status
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "feed_items": """
SELECT source AS feed, doc_id AS position, n_chars AS score, concat('https://', source, '.example/', CAST(doc_id AS STRING)) AS url FROM {documents}""",
    "page_fetches": "SELECT page_id, url, html AS body FROM {pages}",
    "requests": "SELECT event_id, user_id AS key, event_type AS scope, ts AS ts FROM {events}",
    "observations": """
SELECT event_id AS seq, concat('https://u', CAST(user_id AS STRING), '.example/post') AS url, ts AS at,
  CASE WHEN event_type = 'error' THEN 'http' ELSE 'ok' END AS net,
  CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 3 = 0 THEN 404 WHEN event_id % 3 = 1 THEN 410 ELSE 503 END AS http_code,
  CAST(floor(value * 20) AS INT) AS text_len,
  CASE WHEN event_type = 'view' THEN 'h0' ELSE concat('h', CAST(event_id % 5 AS STRING)) END AS text_hash,
  event_type = 'purchase' AND event_id % 4 = 0 AS del_match, event_type = 'signup' AND event_id % 3 = 0 AS blk_match
FROM {events}""",
    "llm_raw": "SELECT conv_id, turn, text AS raw FROM {conversations} WHERE role = 'assistant'",
    "wayback_snapshots": """
SELECT page_id AS id, url,
  CASE WHEN page_id % 4 = 0 THEN 'queued' WHEN page_id % 4 = 1 THEN 'pending' WHEN page_id % 4 = 2 THEN 'success' ELSE 'error' END AS status,
  CAST(page_id % 3 AS INT) AS attempts,
  CASE WHEN page_id % 4 = 1 AND page_id % 5 > 0 THEN concat('job', CAST(page_id AS STRING)) END AS job_id,
  CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-01-30 00:00:00' WHEN page_id % 3 = 1 THEN TIMESTAMP '2024-02-02 00:00:00' END AS next_poll_at,
  CASE WHEN page_id % 6 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS created_at
FROM {pages}""",
}

TABLES = ["orders", "lineitem", "events", "documents", "labels", "pages", "conversations"]


# Keys that a view groups and joins by; one shuffle of the raw rows serves all these steps.
DEALT_BY = {"lineitem": "l_orderkey"}
PART_BYTES = 8 << 20  # of a file, in a task


def _dealt(table: DataFrame, key: str, part_bytes: int) -> DataFrame:
    """table with a key's rows in one partition; partitions grow in number with the table, not in size."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = -(-size // part_bytes)
    usual = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(parts, key) if parts > usual else table.repartition(key)


def view(spark: SparkSession, sf_dir: str, name: str, part_bytes: int | None = None) -> DataFrame:
    """A view as a table. part_bytes: of a dealt file, in a task, where a query's tasks hold much of each row."""
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    tables |= {t: _dealt(tables[t], key, part_bytes or PART_BYTES) for t, key in DEALT_BY.items() if t in tables}
    return spark.sql(sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), **tables)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views in front; sql may start with further parts: ``x AS (...), SELECT``."""
    parts = ", ".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
    return f"WITH {parts} {sql}"
