"""The queries of the numbered operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import hilbert, linededup, mih, mixing, packing, quality, runs, simhash, tokencount, toxicity, urlfilter, warc, whitening


def _vocabulary(name: str) -> str:
    """Where the public tokenizers' file of that name is, on every executor too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", F.col("__removed").alias("removed_lines"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.describe(warc.read_archives(spark, path))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return mih.top_k(rows.where("vec_id % 20 = 0"), rows, k=10)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urlfilter.filter_urls(pages, urlfilter.blocked_hosts(pages))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert.assign(_table(spark, sf_dir, "documents"), ("source", "lang", "size"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = runs.find_runs(docs.select("doc_id", runs.planted(F.col("doc_id"), F.col("text")).alias("text")))
    best = found.select("doc_id", "runs", "collapsed", runs.longest(F.col("runs")).alias("best"))
    exponent = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long")
    hashes = [F.sha2(c.cast("binary"), 256).alias(name) for c, name in ((runs.listed(F.col("runs")), "runs_sha256"), (F.col("collapsed"), "collapsed_sha256"))]
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", exponent.alias("exponent_milli"), *hashes)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_simhash_near_dedup, op3_warc, op4_token_counts, op5_packing, op6_topk_search, op7_toxicity, op8_quality_rules, op9_url_filters, op10_mixing, op11_hilbert_sharding, op12_periodic_runs, op13_embedding_whitening)}


def _sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _quality_sql() -> str:
    stop = _sql_list(sorted({v for ws in quality.STOP_WORDS.values() for w in ws for v in (w, w.capitalize())}))
    rules = []
    for r in quality.RULES:
        value = f"({r.numerator})::DOUBLE" if not r.denominator else f"(CASE WHEN {r.denominator} = 0 THEN 0 ELSE {r.numerator}::DOUBLE / {r.denominator} END)"
        rules += [f"{value} >= {r.least}"] * (r.least is not None) + [f"{value} <= {r.most}"] * (r.most is not None)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM d, unnest(range(1, len(words) - 6)) AS t(i)),
hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM w) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, i - last)) AS n FROM (
  SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8) AS last FROM hit) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
         len(list_filter(words, lambda x: regexp_matches(x, '\\pL')))::BIGINT AS n_letter_words,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(rules)} AS kept
FROM b"""


def _line_sql() -> str:
    w, p = linededup.WINDOW, linededup.MODULUS
    rolling = " + ".join(f"coalesce(lag(h, {k}) OVER o, 0) * {linededup.FACTOR**k % p}" if k else "h" for k in range(w))
    return f"""
WITH l AS (
  SELECT doc_id, i, x, ('0x' || substr(md5(x), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
b AS (SELECT doc_id, i, x, ({rolling}) % {p} % {linededup.DIVISOR} = 0 AS ends FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, x, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
g AS (SELECT doc_id, k, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, k),
r AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, k) > 1 AS gone FROM g)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(t.removed, 0)::BIGINT AS removed_lines
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone) AS text, coalesce(sum(n) FILTER (gone), 0) AS removed
  FROM r GROUP BY doc_id) t USING (doc_id)"""


def _warc_sql() -> str:
    return """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m"""


def _search_sql() -> str:
    return """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS bits FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: abs(z[1] - z[2])))::BIGINT AS distance
      FROM c q, c r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::BIGINT AS rank, neighbor_id, distance
FROM d QUALIFY rank <= 10"""


def _url_sql() -> str:
    pattern = verdict = "NULL"
    for r in sorted(urlfilter.RULES, key=lambda r: len(r.pattern)):
        name, slash, tail = r.pattern.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + tail}')"
        pattern = f"CASE WHEN {fits} THEN '{r.pattern}' ELSE {pattern} END"
        verdict = f"CASE WHEN {fits} THEN '{r.verdict}' ELSE {verdict} END"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^?#]*') AS b FROM r),
p AS (SELECT page_id, translate(h, '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host, substr(b, length(h) + 1) AS path FROM s),
j AS (SELECT *, {pattern} AS rule, {verdict} AS said FROM p),
l AS (SELECT host AS domain FROM j WHERE host <> '' GROUP BY host HAVING 2 * count(*) FILTER (said = 'block') > count(*)),
bad AS (SELECT host FROM (SELECT DISTINCT host FROM p) AS d WHERE len(list_intersect(string_split(host, '.'), [{_sql_list(urlfilter.BLOCKED_NAMES)}])) > 0
  OR EXISTS (SELECT 1 FROM l WHERE d.host = l.domain OR ends_with(d.host, '.' || l.domain)))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM j"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _line_sql(), "op3_warc": _warc_sql(), "op6_topk_search": _search_sql(), "op8_quality_rules": _quality_sql(), "op9_url_filters": _url_sql()}
