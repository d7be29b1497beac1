"""Queries of the text, address and service rules over the tables' own texts, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import samples
from vigil.catalogue import _KINDS, _ROUNDS, BASE, SIGNALS, STORY_DAY, VOTE_DAY, _rounds, at, query
from vigil.functions import generated, pii, search, text, urls
from vigil.operators import archive, collect, constraints, generate, merge, promotion, threshold, verdict, voters
from vigil.plans import feeds
from vigil.sources import captures
from vigil.sources import pages as page_sources
from vigil.sources import responses
from vigil.streaming import recheck

# ---- SQL for the rules on text without Korean


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def sanitize_sql(x: str) -> str:
    """``generated.sanitize`` of text that holds no Korean, no single asterisks and no capitals in a row."""
    for pattern, put in ((r"\*\*([^*\n]+?)\*\*", r"\1"), (r"__([^_\n]+?)__", r"\1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"(?m)^[ \t]*(?:-{3,}|={3,}|\*{3,})[ \t]*$", ""), (r"\b[A-Z]{2,}(?:\s+[A-Z]{2,})+\b", ""), (" {2,}", " "), (r"\s+([.,!?。、])", r"\1"), (r"\n{3,}", "\n\n")):
        x = f"regexp_replace({x}, '{pattern}', '{put}', 'g')"
    return strip_sql(x)


def tidy_sql(x: str) -> str:
    """``generated.tidy`` of text without a tail marker."""
    sentences = f"list_transform(string_split(regexp_replace({strip_sql(f"regexp_replace({x}, '\\s*\\n+\\s*', ' ', 'g')")}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {strip_sql('s')})"
    key = "regexp_replace(s, '[^0-9A-Za-z가-힣]', '', 'g')"
    some = f"list_filter({sentences}, lambda s: {key} <> '')"
    return f"(SELECT array_to_string(list_transform(list_filter(list_zip(l, k, range(1, len(l) + 1)), lambda z: list_position(k, z[2]) = z[3]), lambda z: z[1]), ' ') FROM (SELECT l, list_transform(l, lambda s: {key}) AS k FROM (SELECT {some} AS l)))"


def visible_sql(x: str) -> str:
    for pattern, flags in ((r"<script\b.*?</script>", "gsi"), (r"<style\b.*?</style>", "gsi"), (r"<noscript\b.*?</noscript>", "gsi"), (r"<template\b.*?</template>", "gsi"), ("<!--.*?-->", "gs"), ("<[^>]+>", "g"), (r"\s+", "g")):
        x = f"regexp_replace({x}, '{pattern}', ' ', '{flags}')"
    return f"trim({x})"


def pii_sql(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in _KINDS.values()) + ")"


# The English parts of the page patterns, which alone can match the tables' pages.
_CHALLENGE = r"(?i)just\s+a\s+moment|checking\s+(if\s+the\s+site\s+connection\s+is\s+secure|your\s+browser)|attention\s+required|cf-browser-verification|ddos\s+protection\s+by|enable\s+javascript\s+and\s+cookies\s+to\s+continue|loading\s*\.\.\.|spinner\b"
_DELETED = r"(?i)deleted\s+(post|by)"


# ---- generated text


@query(f"""SELECT conv_id, turn, {tidy_sql("clean")} AS body FROM (SELECT conv_id, turn, {sanitize_sql("raw")} AS clean FROM llm_raw)""", "llm_raw")
def sanitize_text(spark, v):
    return v("llm_raw").select("conv_id", "turn", generated.tidy(generated.sanitize(F.col("raw"))).alias("body"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {samples.sql_text(a)}, {samples.sql_text(b)})" for i, (_, a, b) in enumerate(samples.GENERATED)) + f") AS t(case_id, sanitized, tidied) UNION ALL SELECT -1 - (conv_id * 1000 + turn)::INT, {sanitize_sql('raw')}, {tidy_sql('raw')} FROM llm_raw", "llm_raw")
def sanitize_and_tidy(spark, v):
    rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(samples.GENERATED)], "case_id int, raw string")
    rows = rows.unionByName(v("llm_raw").select((-1 - (F.col("conv_id") * 1000 + F.col("turn"))).cast("int").alias("case_id"), "raw"))
    return rows.select("case_id", generated.sanitize(F.col("raw")).alias("sanitized"), generated.tidy(F.col("raw")).alias("tidied"))


def _marked(v):
    """Every text with a score, a reason and its sources at its end."""
    last = F.concat(F.lit("\n휘발성 점수: "), F.col("turn").cast("string"), F.lit("\n박제 사유: 까닭 "), F.col("conv_id").cast("string"), F.lit("\nUSED_SOURCES: 2, 1, 2, 9"))
    return v("llm_raw").select("conv_id", "turn", F.concat("raw", last).alias("raw"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{','.join(map(str, r[2]))}', {samples.sql_text(r[3])}, {r[4]}, {samples.sql_text(r[5])}, {str(r[6]).lower()})" for i, r in enumerate(samples.MARKERS)) + f") AS t(case_id, used, text, score, reason, no_fit) UNION ALL SELECT -1 - (conv_id * 1000 + turn)::INT, '2,1', {strip_sql('raw')}, turn::INT, '까닭 ' || conv_id, false FROM llm_raw", "llm_raw")
def markers(spark, v):
    rows = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(samples.MARKERS)], "case_id int, raw string, total int")
    rows = rows.unionByName(_marked(v).select((-1 - (F.col("conv_id") * 1000 + F.col("turn"))).cast("int").alias("case_id"), "raw", F.lit(3).alias("total")))
    used = generated.used_indices(F.col("raw"), F.col("total"))
    parsed = rows.withColumn("u", used).withColumn("s", generated.score_and_reason(F.col("u.text")))
    return parsed.select("case_id", F.array_join(F.transform("u.indices", lambda i: i.cast("string")), ",").alias("used"), "s.text", "s.score", "s.reason", generated.is_no_fit(F.col("raw")).alias("no_fit"))


@query(f"""SELECT conv_id, turn, short AS no_fit, CASE WHEN short THEN '' ELSE body END AS body, CASE WHEN short THEN '' ELSE '[ 따뜻한 선행 이야기 ]' || chr(10) || chr(10) || body END AS text, CASE WHEN short THEN 0 ELSE turn END::INT AS volatility_score,
  CASE WHEN short THEN '' ELSE '까닭 ' || conv_id END AS poetic_reason FROM (
  SELECT conv_id, turn, {tidy_sql("clean")} AS body, length({strip_sql("raw")}) < 80 AS short FROM (SELECT conv_id, turn, raw, {sanitize_sql("raw")} AS clean FROM llm_raw))""", "llm_raw")  # fmt: skip
def retold_posts(spark, v):
    """Each text retold as the post it is: K28 with its clean-up, markers and header."""
    told = generated.from_text(F.col("m.raw"), F.col("l.raw"), F.lit("kindness"))
    rows = v("llm_raw").alias("l").join(_marked(v).alias("m"), ["conv_id", "turn"]).select("conv_id", "turn", told.alias("t"))
    return rows.select("conv_id", "turn", "t.no_fit", "t.body", "t.text", "t.volatility_score", "t.poetic_reason")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 0 ELSE 2 END AS results, CASE WHEN turn % 3 > 0 THEN 'post ' || conv_id END AS title, CASE WHEN turn % 3 > 0 THEN raw END AS content FROM llm_raw""", "llm_raw")
def searched_answers(spark, v):
    item = lambda title, content: F.struct(title.alias("title"), F.lit("https://p.example/").alias("url"), content.alias("content"), F.lit(0.5).alias("score"))
    given = F.to_json(F.struct(F.array(item(F.concat(F.lit("post "), F.col("conv_id").cast("string")), F.col("raw")), item(F.lit("b"), F.lit(""))).alias("results")))
    found = responses.search_results(F.when(F.col("turn") % 3 == 0, '{"detail": "no"}').otherwise(given))
    return v("llm_raw").withColumn("f", found).select("conv_id", "turn", F.size("f").alias("results"), F.get("f", F.lit(0))["title"].alias("title"), F.get("f", F.lit(0))["content"].alias("content"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN turn + conv_id % 10 / 10.0 + 0.5 ELSE 5.0 END::DOUBLE AS wait FROM llm_raw""", "llm_raw")
def retry_waits(spark, v):
    asked = F.concat(F.lit("Rate limit reached. Please try again in "), F.col("turn").cast("string"), F.lit("."), (F.col("conv_id") % 10).cast("string"), F.lit("s. "), "raw")
    return v("llm_raw").select("conv_id", "turn", F.round(generated.retry_wait(F.when(F.col("turn") % 3 == 0, asked).otherwise(F.col("raw"))), 6).alias("wait"))


# ---- services' answers


def _answers(v):
    return v("llm_raw").withColumn("k", F.col("conv_id") + F.col("turn"))


@query(f"""SELECT conv_id, turn, CASE WHEN k % 3 < 2 THEN {strip_sql("raw")} END AS chat, CASE WHEN k % 3 < 2 THEN {strip_sql("raw")} END AS candidate, CASE WHEN k % 3 < 2 THEN 'https://a.example/' || conv_id || '|https://b.example/' END AS cited,
  CASE WHEN k % 3 < 2 THEN 'T|https://b.example/' END AS titles FROM (SELECT *, conv_id + turn AS k FROM llm_raw)""", "llm_raw")  # fmt: skip
def generator_answers(spark, v):
    rows, ok = _answers(v), F.col("k") % 3 < 2
    chat = F.when(ok, F.to_json(F.struct(F.array(F.struct(F.struct(F.col("raw").alias("content")).alias("message"))).alias("choices")))).otherwise('{"error": {"message": "busy"}}')
    url = F.concat(F.lit("https://a.example/"), F.col("conv_id").cast("string"))
    web = lambda uri, title: F.struct(F.struct(uri.alias("uri"), title.alias("title")).alias("web"))
    chunks = F.array(web(url, F.lit("T")), web(F.lit("https://b.example/"), F.lit("")), web(url, F.lit("again")), web(F.lit(""), F.lit("none")))
    parts = F.array(F.struct(F.substring("raw", 1, 10).alias("text")), F.struct(F.substr("raw", F.lit(11)).alias("text")))
    given = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"), F.struct(chunks.alias("groundingChunks")).alias("groundingMetadata"))).alias("candidates")))
    c = responses.candidate(F.when(ok, given).otherwise('{"candidates": []}'))
    read = rows.select("conv_id", "turn", responses.chat_text(chat).alias("chat"), c.alias("c"))
    joined = lambda k: F.array_join(F.transform("c.citations", lambda x: x[k]), "|")
    return read.select("conv_id", "turn", "chat", F.col("c.text").alias("candidate"), joined("uri").alias("cited"), joined("title").alias("titles"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'job' || page_id END AS job_id, CASE page_id % 4 WHEN 1 THEN 'too many' WHEN 2 THEN 'error:gone' WHEN 3 THEN 'no_job_id' END AS error,
  CASE page_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'error' ELSE 'pending' END AS status, CASE WHEN page_id % 3 = 0 AND url <> '' THEN 'https://web.archive.org/web/2024/' || url END AS snapshot_url, CASE WHEN page_id % 3 = 1 THEN 'error' END AS reason,
  CASE WHEN page_id % 2 = 0 THEN (page_id % 7)::INT END AS available, CASE WHEN page_id % 5 > 0 THEN (100 - page_id % 5)::INT END AS daily_remaining,
  CASE WHEN page_id % 2 = 0 AND url <> '' THEN regexp_replace(url, '^http://', 'https://') END AS found FROM pages""")  # fmt: skip
def snapshot_answers(spark, v):
    rows, k = v("page_fetches"), F.col("page_id")
    js = lambda *fields: F.to_json(F.struct(*fields))
    save = F.when(k % 4 == 0, js(F.concat(F.lit("job"), k.cast("string")).alias("job_id"))).when(k % 4 == 1, '{"message": "too many", "status_ext": "x"}').when(k % 4 == 2, '{"status_ext": "error:gone"}').otherwise("not json")
    job = F.when(k % 3 == 0, js(F.lit("success").alias("status"), F.lit("2024").alias("timestamp"), F.col("url").alias("original_url"))).when(k % 3 == 1, '{"status": "error"}').otherwise("no")
    capacity = js(F.when(k % 2 == 0, k % 7).alias("available"), F.when(k % 5 > 0, k % 5).alias("daily_captures"), F.lit(100).alias("daily_captures_limit"))
    there = js(F.struct(F.struct((k % 2 == 0).alias("available"), F.col("url"), F.lit("2024").alias("timestamp")).alias("closest")).alias("archived_snapshots"))
    s, j, c, a = responses.save_answer(save), responses.job_answer(job), responses.capacity_answer(capacity), responses.availability_answer(there)
    return rows.select("page_id", s["job_id"].alias("job_id"), s["error"].alias("error"), j["status"].alias("status"), j["snapshot_url"].alias("snapshot_url"), j["reason"].alias("reason"), c["available"].alias("available"), c["daily_remaining"].alias("daily_remaining"), a["snapshot_url"].alias("found"))


# ---- search results


def _posts(v):
    """Posts as search results: every ninth a news item by its title, every eleventh a fraud by it."""
    mark = F.when(F.col("id") % 9 == 0, "[속보] ").when(F.col("id") % 11 == 0, "보이스피싱 ").otherwise("")
    return v("captured_posts").select("id", F.struct(F.concat(mark, F.coalesce("title", F.lit(""))).alias("title"), F.col("url"), F.col("body_text").alias("content")).alias("item"))


_NEWS = r"[a-zA-Z0-9._%+-]+@(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}|(?i:reporter|editor)\s*[:=\(\[\]]|(?i:ytn|jtbc|mbn)"


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(r[3]).lower()}, {str(r[4]).lower()})" for i, r in enumerate(samples.RESULTS)) + f") AS t(case_id, news, off_topic) UNION ALL SELECT (-1 - id)::INT, id % 9 = 0 OR regexp_matches(coalesce(title, ''), '{_NEWS}') OR regexp_matches(coalesce(substr(body_text, 1, 200), ''), '{_NEWS}'), id % 9 <> 0 AND id % 11 = 0 FROM captured_posts", "captured_posts")
def search_filters(spark, v):
    rows = [(i, *r[:3]) for i, r in enumerate(samples.RESULTS)]
    given = spark.createDataFrame(rows, "case_id int, title string, url string, content string").select("case_id", F.struct("title", "url", "content").alias("item"))
    both = given.unionByName(_posts(v).select((-1 - F.col("id")).cast("int").alias("case_id"), "item"))
    return both.select("case_id", search.looks_like_news(F.col("item")).alias("news"), search.looks_off_topic(F.col("item")).alias("off_topic"))


def _searches(v):
    """Four posts a search, with texts of plain letters; those whose id is a multiple of five have little text."""
    plain = F.trim(F.regexp_replace(F.coalesce("body_text", F.lit("")), "[^A-Za-z]+", " "))
    item = F.struct(F.col("id"), F.struct(F.concat(F.lit("title of post "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " - theqoo").otherwise("")).alias("title"), F.col("url"), F.when(F.col("id") % 5 == 0, F.substring(plain, 1, 30)).otherwise(plain).alias("content")).alias("item"))
    grouped = v("captured_posts").withColumn("search", F.floor(F.col("id") / 4)).groupBy("search").agg(F.array_sort(F.collect_list(item)).alias("found"))  # four rows
    return grouped.select("search", F.transform("found", lambda x: x["item"]).alias("items"))


@query(r"""SELECT * FROM (VALUES (-1, '[1] 제목: 동네 이야기' || chr(10) || '    내용: 길에서 넘어진 할머니를 일으켜 드린 학생을 보았습니다. 비가 오는 날이었는데 우산까지 내주고 말없이 뛰어갔습니다. 오래 기억에 남을 것 같아 적어 둡니다. 고맙습니다.', 1,
  '길에서 넘어진 할머니를 일으켜 드린 학생을 보았습니다. 비가 오는 날이었는데 우산까지 내주고 말없이 뛰어갔습니다. 오래 기억에 남을 것 같아 적어 둡니다. 고맙습니다.')) AS t(search, context, results, coverage_query)
UNION ALL SELECT search, string_agg('[' || r || '] 제목: ' || title || CASE WHEN content = '' THEN '' ELSE chr(10) || '    내용: ' || trim(content) END, chr(10) ORDER BY r), count(*)::INT,
  CASE WHEN length(trim(substr(arg_min(content, r), 1, 200))) >= 20 THEN trim(substr(arg_min(content, r), 1, 200)) ELSE regexp_replace(arg_min(title, r), '\s*- theqoo$', '') END
FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY id) AS r FROM (
  SELECT *, max(length(trim(content))) OVER (PARTITION BY search) AS most FROM (
    SELECT id, id // 4 AS search, 'title of post ' || id || CASE WHEN id % 2 = 0 THEN ' - theqoo' ELSE '' END AS title, substr(trim(regexp_replace(coalesce(body_text, ''), '[^A-Za-z]+', ' ', 'g')), 1, CASE WHEN id % 5 = 0 THEN 30 ELSE 600 END) AS content FROM captured_posts))
  WHERE most < 80 OR length(trim(content)) >= 80) GROUP BY search""", "captured_posts")  # fmt: skip
def search_context(spark, v):
    rows = [(i, *r[:3]) for i, r in enumerate(samples.RESULTS)]
    given = spark.createDataFrame(rows, "case_id int, title string, url string, content string").select("case_id", F.struct("title", "url", "content").alias("item"))
    given = given.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("case_id", "item"))), lambda x: x["item"]).alias("items")).select(F.lit(-1).cast("long").alias("search"), "items")
    items = given.unionByName(_searches(v))
    best = search.rich(search.ladder(F.col("items"), F.lit(None).cast("array<struct<title:string,url:string,content:string>>"), F.lit(True)))
    one = items.select("search", best.alias("best")).withColumn("one", search.chosen(F.col("best"), F.array(F.lit(1))))
    return one.select("search", search.context(F.col("best")).alias("context"), F.size("best").alias("results"), search.coverage_query(F.col("one.title"), F.col("one.content")).alias("coverage_query"))


@query("""SELECT id, 'title of post ' || id AS title FROM captured_posts""", "captured_posts")
def clean_titles(spark, v):
    dressed = F.concat(F.when(F.col("id") % 3 == 0, "[후기] ").otherwise(" "), F.lit("title of post "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, " - 더쿠 한국").otherwise(" | 클리앙"))
    return v("captured_posts").select("id", search.clean_title(dressed).alias("title"))


# ---- pages, addresses and requests


@query(f"""SELECT page_id, CASE WHEN challenge OR NOT gone THEN CASE WHEN challenge THEN 'error' ELSE 'live' END ELSE 'deleted' END AS status, 200 AS http_code,
  CASE WHEN challenge THEN '봇 차단 — 삭제 추적 불가' WHEN gone THEN '삭제 표식: ' || regexp_extract(t, '{_DELETED}') END AS reason, 1 AS volatility_score, sha256(t) AS content_hash,
  CASE WHEN challenge THEN '2024-01-31 00:10:00' WHEN gone THEN '2024-01-31 01:00:00' ELSE '2024-01-31 00:30:00' END AS next_check_at, t AS body_text FROM (
  SELECT page_id, t, regexp_matches(t, '{_CHALLENGE}') AS challenge, regexp_matches(t, '{_DELETED}') AS gone FROM (SELECT page_id, {visible_sql("body")} AS t FROM page_fetches))""", "page_fetches")  # fmt: skip
def recheck_pages(spark, v):
    seen = verdict.observe(v("page_fetches"))
    obs = F.struct(F.lit("ok").alias("net"), F.lit(200).alias("http_code"), F.col("url").alias("final_url"), "text_len", "text_hash", "del_match", "blk_match", "del_snip", "blk_snip", "bot_challenge", F.lit(None).cast("string").alias("reason"), "text")
    title = F.regexp_extract("body", "(?is)<title[^>]*>(.*?)</title>", 1)
    items = seen.select("page_id", title.alias("title"), F.lit(None).cast("string").alias("summary"), "url", obs.alias("obs"))
    return collect.captured(items, at(VOTE_DAY)).select("page_id", "status", "http_code", "reason", "volatility_score", "content_hash", F.col("next_check_at").cast("string").alias("next_check_at"), "body_text")


@query(f"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'timeout' WHEN page_id % 7 = 1 THEN 'http' ELSE 'ok' END AS net, CASE WHEN page_id % 7 = 1 THEN 404 WHEN page_id % 7 > 1 THEN 200 END AS http_code,
  CASE WHEN page_id % 7 = 0 THEN url ELSE 'https://f.example/' || page_id END AS final_url, CASE WHEN page_id % 7 > 1 THEN length(t) END::INT AS text_len, CASE WHEN page_id % 7 > 1 THEN sha256(t) END AS text_hash,
  CASE WHEN page_id % 7 > 1 THEN regexp_matches(t, '{_DELETED}') END AS del_match, CASE WHEN page_id % 7 > 1 THEN false END AS blk_match, CASE WHEN page_id % 7 > 1 THEN substr(regexp_extract(t, '{_DELETED}'), 1, 40) END AS del_snip, CASE WHEN page_id % 7 > 1 THEN '' END AS blk_snip,
  CASE WHEN page_id % 7 > 1 THEN regexp_matches(t, '{_CHALLENGE}') END AS bot_challenge, CASE WHEN page_id % 7 = 0 THEN 'deadline' END AS reason FROM (SELECT page_id, url, {visible_sql("coalesce(body, '')")} AS t FROM page_fetches)""", "page_fetches")  # fmt: skip
def page_observations(spark, v):
    """Captured responses of every seventh kind: a time-out, a missing page, pages."""
    k, none = F.col("page_id") % 7, F.lit(None).cast("string")
    rows = v("page_fetches").select(
        "page_id", "url", at(VOTE_DAY).alias("seen_at"), F.when(k == 0, "timeout").alias("net"), F.when(k == 1, 404).when(k > 1, 200).alias("http_code"), F.when(k > 0, F.concat(F.lit("https://f.example/"), F.col("page_id").cast("string"))).alias("final_url"),
        F.when(k == 0, "deadline").alias("reason"), F.lit("text/html; charset=utf-8").alias("content_type"), none.alias("encoding"), F.encode("body", "UTF-8").alias("body"),
    )
    seen = captures.observations(rows.withColumn("url", F.concat_ws(" ", F.col("page_id").cast("string"), "url")))  # the number alone where the address is missing
    own = F.expr("if(instr(final_url, ' ') > 0, substring(final_url, instr(final_url, ' ') + 1), null)")
    return seen.select(F.substring_index("url", " ", 1).cast("long").alias("page_id"), "obs.*").withColumn("final_url", F.when(F.col("net") == "timeout", own).otherwise(F.col("final_url")))


@query("""SELECT -1 - page_id AS page_id, html AS text FROM pages WHERE html IS NOT NULL UNION ALL SELECT page_id, '한글 ' || page_id FROM pages""")
def decoded_pages(spark, v):
    """Pages as bytes in UTF-8, and Korean ones announced in three ways."""
    rows = v("page_fetches").where("body is not null").select((-1 - F.col("page_id")).alias("page_id"), F.encode("body", "UTF-8").alias("raw"), F.lit("utf-8").alias("client"), F.lit("text/html; charset=UTF-8").alias("kind"))
    k = F.col("page_id") % 3
    korean = F.concat(F.unhex(F.lit("C7D1B1DB20")), F.encode(F.col("page_id").cast("string"), "UTF-8"))  # two letters in the old encoding
    more = v("page_fetches").select("page_id", korean.alias("raw"), F.when(k == 0, "euc-kr").otherwise("utf-8").alias("client"), F.when(k == 1, "text/html; charset=EUC-KR").otherwise("text/html").alias("kind"))
    both = rows.unionByName(more)
    return both.select("page_id", page_sources.decoded(F.col("raw"), F.col("client"), F.col("kind")).alias("text"))


@query("""SELECT page_id, NOT (page_id % 4 = 1) AS public, CASE page_id % 4 WHEN 1 THEN '10.0.0.' || (page_id % 200) ELSE regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) || CASE WHEN page_id % 4 = 2 THEN ':8080' ELSE '' END END AS header,
  CASE page_id % 3 WHEN 0 THEN '203.0.113.' || (page_id % 250) WHEN 1 THEN '198.51.100.7' ELSE 'peer' END AS client FROM pages WHERE url LIKE 'http%://%'""")  # fmt: skip
def request_rules(spark, v):
    rows, k = v("page_fetches").where("url like 'http%://%'"), F.col("page_id")
    host = F.regexp_extract("url", "^([a-z]+://[^/?#:]*)", 1)
    address = F.when(k % 4 == 1, F.concat(F.lit("http://10.0.0."), (k % 200).cast("string"), F.lit("/x"))).when(k % 4 == 2, F.concat(host, F.lit(":8080/x"))).when(k % 4 == 3, F.concat(host, F.when(F.startswith(F.col("url"), F.lit("https")), ":443").otherwise(":80"))).otherwise(F.col("url"))
    headers = F.map_from_arrays(F.array(F.lit("x-forwarded-for"), F.lit("x-real-ip")), F.array(F.when(k % 3 == 0, F.concat(F.lit(" 203.0.113."), (k % 250).cast("string"), F.lit(" , 10.1.1.1"))), F.when(k % 3 == 1, "198.51.100.7")))
    return rows.select("page_id", urls.is_public_address(address).alias("public"), urls.host_header(address).alias("header"), page_sources.client_ip(headers, F.lit("peer")).alias("client"))


@query("""SELECT seq, "at"::VARCHAR AS "at" FROM observations""", "observations")
def iso_times(spark, v):
    """Times that went out as ISO text come back the same."""
    rows = v("observations")
    return rows.select("seq", text.iso_time(archive.iso_text(F.col("at"), rows.schema["at"].dataType)).cast("timestamp_ntz").cast("string").alias("at"))


@query(f"""SELECT id, CASE WHEN found = '' THEN '' WHEN length(found) <= 2 THEN repeat('*', length(found)) ELSE substr(found, 1, 2) || repeat('*', length(found) - 2) END AS masked
FROM (SELECT id, regexp_extract(coalesce(body_text, ''), '{_KINDS["email"]}') AS found FROM captured_posts)""", "captured_posts")
def masked_emails(spark, v):
    """The first address of each text as the screen shows it."""
    sample = F.filter(pii.scan(F.col("body_text"))["samples"], lambda s: F.startswith(s, F.lit("email:")))
    return v("captured_posts").select("id", F.coalesce(F.substr(F.get(sample, F.lit(0)), F.lit(7)), F.lit("")).alias("masked"))


# ---- feeds


@query("""SELECT source, feed, (row_number() OVER (PARTITION BY source, feed ORDER BY id) - 1)::INT AS position, CASE WHEN source = 'clien.net' THEN 'post ' || id ELSE 'note ' || id END AS title,
  CASE WHEN source = 'clien.net' THEN 'https://www.clien.net/service/board/park/' || id ELSE 'https://www.bobaedream.co.kr/view?code=freeb&No=' || id END AS url
FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'clien.net' ELSE 'bobaedream.co.kr' END AS source, (id // 100)::VARCHAR AS feed FROM captured_posts WHERE id // 100 <> 4)""", "captured_posts")  # fmt: skip
def board_items_of_posts(spark, v):
    """Lists of two boards, fifty posts each, in the boards' own HTML; one is refused."""
    name = F.col("id").cast("string")
    clien = F.concat(F.lit('<a class="x" href="/service/board/park/'), name, F.lit('?od=T31" data-x="1">\n<span title=" post '), name, F.lit('">..</span></a>'))
    bobae = F.concat(F.lit('<a class="bsubject" href="/view?code=freeb&No='), name, F.when(F.col("id") % 4 == 1, F.concat(F.lit('&bm=1" title="note '), name, F.lit('">no</a>'))).otherwise(F.concat(F.lit('">note <b>'), name, F.lit("</b></a>"))))
    even = F.col("id") % 2 == 0
    rows = v("captured_posts").select("id", F.when(even, "clien.net").otherwise("bobaedream.co.kr").alias("source"), F.floor(F.col("id") / 100).cast("string").alias("feed"), F.when(even, clien).otherwise(bobae).alias("a"))
    lists = rows.groupBy("source", "feed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "a"))), lambda x: x["a"]), "\n").alias("html"))  # fifty items
    fetched = lists.select("source", "feed", F.encode("html", "UTF-8").alias("raw"), F.when(F.col("feed") == "4", 429).otherwise(200).alias("http_code"))
    return collect.parsed(fetched).select("source", "feed", "position", "title", "url")


def _xml_sql(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '>', '&gt;'), '<', '&lt;')"


_ENTRY = f"""'  <entry>' || n || '    <id>' || link || '</id>' || n || '    <title>' || {_xml_sql("title")} || '</title>' || n || '    <link href="' || link || '" rel="alternate" type="text/html"/>' || n || '    <published>' || p || '</published>' || n
  || '    <updated>' || u || '</updated>' || n || '    <category term="' || category || '"/>' || n || '    <summary>' || {_xml_sql("first")} || '</summary>' || n || '    <content type="html">' || {_xml_sql("html")} || '</content>' || n || '  </entry>'"""


@query(f""", t AS (SELECT * FROM stories ORDER BY created_at DESC NULLS LAST, id LIMIT 50),
e AS (SELECT id, created_at, category, chr(10) AS n, 'https://vigil.example/#story=' || id AS link, split_part(body, chr(10), 1) AS first, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS p,
  coalesce(strftime(archived_at, '%Y-%m-%dT%H:%M:%S') || '+00:00', p) AS u, CASE WHEN category = 'kindness' THEN '[따뜻한 선행] ' ELSE '[인류애가 흔들리는 사건] ' END || split_part(body, chr(10), 1) AS title,
  concat_ws(' · ', CASE WHEN from_capture THEN '🪦 삭제된 원본을 살아있을 때 박제' END, CASE WHEN arweave_tx_id <> '__pending__' THEN '🗄 Arweave 박제됨' END) AS signals,
  CASE WHEN signals <> '' THEN '<p><strong>' || signals || '</strong></p>' ELSE '' END || '<p>' || replace({_xml_sql("body")}, chr(10), '<br/>') || '</p>'
    || CASE WHEN arweave_url <> '' THEN '<p><a href="' || arweave_url || '">🗄 Arweave 영구 박제 원본 보기</a></p>' ELSE '' END AS html FROM t)
SELECT '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<feed xmlns="http://www.w3.org/2005/Atom">' || chr(10) || '  <title>Vigil</title>' || chr(10) || '  <subtitle>All stories</subtitle>' || chr(10)
  || '  <link href="https://vigil.example/feed/all.xml" rel="self" type="application/atom+xml"/>' || chr(10) || '  <link href="https://vigil.example/" rel="alternate" type="text/html"/>' || chr(10) || '  <id>https://vigil.example/feed/all.xml</id>' || chr(10)
  || '  <updated>' || max(p) || '</updated>' || chr(10) || '  <author><name>Vigil</name></author>' || chr(10) || string_agg({_ENTRY}, chr(10) ORDER BY created_at DESC, id) || chr(10) || '</feed>' AS xml, count(*)::INT AS entries FROM e""", "stories")  # fmt: skip
def feed_atom(spark, v):
    return feeds.atom(feeds.feed_all(v("stories")), "https://vigil.example", "all", "Vigil", "All stories", at(STORY_DAY))


@query(f"""SELECT *, {" OR ".join(_KINDS)} AS hit FROM (SELECT id, {", ".join(f"regexp_matches(coalesce(body_text, ''), '{p}') AS {k}" for k, p in _KINDS.items())} FROM captured_posts)""", "captured_posts")
def pii_scan_parts(spark, v):
    """Texts kept as parts of 700 characters, which no find or chunk respects."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(F.coalesce("body_text", F.lit(""))) - 1, F.lit(0)), F.lit(700)), lambda i: F.substr("body_text", i + 1, F.lit(700)))
    found = pii.scan_parts(v("captured_posts").select("id", F.posexplode(cut).alias("part", "text")))
    return found.select("id", "found.hit", *[F.array_contains("found.kinds", k).alias(k) for k in _KINDS])


# ---- verdicts, promotion, stories


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r[-2]}', {samples.sql_text(r[-1])})" for i, r in enumerate(samples.VERDICTS)) + """) AS t(case_id, status, reason) UNION ALL SELECT (-1 - seq)::INT,
  CASE WHEN net = 'http' AND http_code IN (404, 410) THEN 'deleted' WHEN net = 'http' THEN 'error' WHEN del_match THEN 'deleted' ELSE 'live' END, CASE WHEN net = 'http' THEN 'HTTP ' || http_code WHEN del_match THEN '삭제 표식: gone' END FROM observations""", "observations")  # fmt: skip
def decide_status(spark, v):
    from vigil.catalogue import _observed

    given = samples.verdict_rows(spark)
    seen = _observed(v("observations")).select((-1 - F.col("seq")).cast("int").alias("case_id"), "url", F.col("obs").cast(given.schema["obs"].dataType).alias("obs"), F.lit(None).cast(given.schema["base"].dataType).alias("base"))
    d = verdict.decide(F.col("obs"), F.col("url"), F.col("base"))
    return given.unionByName(seen).withColumn("d", d).select("case_id", "d.status", "d.reason")


_OUTCOME = f"""CASE WHEN {pii_sql("coalesce(body_text, '')")} THEN 'blocked_pii' WHEN raw IS NULL AND length({strip_sql("coalesce(body_text, '')")}) >= 80 THEN 'retry'
  WHEN length({strip_sql("coalesce(body_text, '')")}) < 80 OR raw IS NULL OR {strip_sql("raw")} = '' THEN 'skipped' WHEN {pii_sql("raw")} THEN 'blocked_pii' WHEN linked IS NOT NULL THEN 'linked' ELSE 'promoted' END"""
_PROMOTED = f""", w AS (SELECT conv_id, arg_min(raw, turn) AS raw FROM llm_raw GROUP BY conv_id), k AS (SELECT origin_captured_url AS origin, min(id) AS linked FROM stories WHERE origin IS NOT NULL GROUP BY origin),
o AS (SELECT id, linked, {_OUTCOME} AS outcome FROM captured_posts LEFT JOIN w ON id = conv_id LEFT JOIN k ON url = origin WHERE hard_deleted_at IS NOT NULL)"""


@query(f"""{_PROMOTED} SELECT id, outcome, CASE outcome WHEN 'retry' THEN NULL WHEN 'linked' THEN 'promoted' ELSE outcome END AS promotion_status, CASE outcome WHEN 'linked' THEN linked END AS linked_story_id FROM o""", "captured_posts", "llm_raw", "stories")
def promotion_outcome(spark, v):
    return _promoted(v).select("id", "outcome", "promotion_status", "linked_story_id")


@query(f"""SELECT d::VARCHAR AS day, greatest(1, least(12, 3 + (SELECT count(DISTINCT user_id) FROM votes WHERE created_at >= d - INTERVAL 7 DAY AND created_at < d) // 30))::BIGINT AS threshold
FROM (SELECT unnest(generate_series(DATE '2024-01-02', DATE '{VOTE_DAY[:10]}', INTERVAL 1 DAY))::DATE AS d)""", "votes")  # fmt: skip
def thresholds_by_day(spark, v):
    found = voters.thresholds(voters.daily_sketches(v("votes")), v("votes"), F.lit("2024-01-02"), F.lit(VOTE_DAY[:10]))
    return found.select(F.col("day").cast("string").alias("day"), "threshold")


@query(f"""{_ROUNDS} SELECT story_id, url, CASE code WHEN 404 THEN 'deleted' ELSE 'error' END AS status, code AS http_code, 'HTTP ' || code AS reason, status AS previous_status, http_code AS previous_code, check_count + 1 AS check_count,
  CASE code WHEN 404 THEN 0 ELSE error_count + 1 END AS error_count, (TIMESTAMP '{VOTE_DAY}' + to_seconds(CASE code WHEN 404 THEN 3600 ELSE least(600 * pow(2, least(error_count, 20)), 86400) END))::VARCHAR AS next_check_at,
  CASE WHEN code = 404 AND status <> 'deleted' THEN '{VOTE_DAY}' END AS deleted_at, CASE WHEN code = 404 THEN '{VOTE_DAY}' END AS hard_deleted_at, code = 404 AND status NOT IN ('deleted', 'blocked') AS newly_gone
FROM citation_checks JOIN u USING (url) WHERE first <= 3""", "citation_checks")  # fmt: skip
def recheck_round(spark, v):
    checks, seen = _rounds(spark, v)
    out = recheck.recheck(checks, seen, at(VOTE_DAY), first_hard=True)
    out = out.withColumns({c: F.col(c).cast("string") for c in ("next_check_at", "deleted_at", "hard_deleted_at")})
    return out.select("story_id", "url", "status", "http_code", "reason", "previous_status", "previous_code", "check_count", "error_count", "next_check_at", "deleted_at", "hard_deleted_at", "newly_gone")


@query("""SELECT id, id % 3 = 0 AS valid FROM captured_posts""", "captured_posts")
def uuid_rules(spark, v):
    digits = F.md5(F.col("id").cast("string"))
    made = F.concat_ws("-", F.substring(digits, 1, 8), F.substring(digits, 9, 4), F.substring(digits, 13, 4), F.substring(digits, 17, 4), F.substring(digits, 21, 12))
    given = F.when(F.col("id") % 3 == 0, made).when(F.col("id") % 3 == 1, F.concat(made, F.lit("0"))).otherwise(F.substring("title", 1, 8))
    return v("captured_posts").select("id", F.coalesce(constraints.is_uuid(given), F.lit(False)).alias("valid"))


def _promoted(v):
    posts = v("captured_posts").where("hard_deleted_at is not null")
    raw = v("llm_raw").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("raw", "turn").alias("raw"))
    return promotion.outcomes(posts, raw, v("stories"))


@query(f"""{_PROMOTED} SELECT outcome, count(*) AS n FROM o GROUP BY outcome""", "captured_posts", "llm_raw", "stories")
def promotion_counts(spark, v):
    return promotion.batch_counts(_promoted(v))


@query("""SELECT id, CASE WHEN (row_number() OVER (PARTITION BY category ORDER BY id) - 1 + 1) % 2 = 0 THEN 'kindness' ELSE 'critique' END AS next FROM stories""", "stories")
def alternate_categories(spark, v):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("category").orderBy("id")) - 1
    return v("stories").select("id", promotion.alternate(v("stories"), number, seed=1).alias("next"))


@query(""", t AS (SELECT conv_id AS id, (turn // 2)::INT AS attempt, turn % 5 + 5 AS score FROM llm_raw WHERE turn // 2 < 2)
SELECT id, 'kindness' AS category, '짧은 이야기다.' AS body, 0 AS vote_count, 'none' AS gap_score, 2::BIGINT AS community_count, 2::BIGINT AS news_count FROM t WHERE score >= 7 GROUP BY id""", "llm_raw")
def hunted_story_inserts(spark, v):
    from vigil.catalogue import _tried

    return generate.story_rows(generate.generate(_tried(v)), scored=False).drop("citations", "search_queries")


@query(f""", {BASE}, {SIGNALS}, n AS (SELECT story_id, count(*) AS votes FROM votes GROUP BY story_id),
k AS (SELECT id, vote_count, CASE WHEN coalesce(hard_deleted, 0) >= 1 THEN greatest(1, b - 2) WHEN coalesce(hard_blocked, 0) >= 1 THEN greatest(1, b - 1) ELSE b END AS t, coalesce(votes, 0) AS votes
  FROM (SELECT * FROM stories WHERE arweave_tx_id IS NULL ORDER BY vote_count DESC NULLS LAST, id LIMIT 60) AS s LEFT JOIN sig ON id = sig.story_id LEFT JOIN n ON id = n.story_id, base
  WHERE archive_attempts < 10 AND (last_archive_attempt IS NULL OR epoch(TIMESTAMP '{STORY_DAY}') - epoch(last_archive_attempt) >= least(300 * pow(2, greatest(0, archive_attempts - 1)), 21600)))
SELECT id, vote_count FROM k WHERE votes >= t ORDER BY vote_count DESC NULLS LAST, id LIMIT 5""", "stories", "citation_checks", "votes")  # fmt: skip
def sweep_retries(spark, v):
    found = threshold.story_signals(v("stories"), v("citation_checks"), v("votes"), at(VOTE_DAY))
    return archive.retry_now(archive.retry_candidates(v("stories"), at(STORY_DAY)), found).select("id", "vote_count")


@query("""SELECT story_id, count(DISTINCT url)::INT AS n, min(url) AS first FROM citation_checks GROUP BY story_id""", "citation_checks")
def unique_citations(spark, v):
    """Each story's citations given twice, the second time without title."""
    cite = lambda title: F.struct(F.col("url").alias("uri"), title.alias("title"))
    rows = v("citation_checks").groupBy("story_id").agg(F.array_sort(F.collect_list(cite(F.lit("")))).alias("a"), F.array_sort(F.collect_list(cite(F.lit("t")))).alias("b"))
    kept = merge.unique_citations(F.concat("a", "b"))
    return rows.select("story_id", F.size(kept).alias("n"), F.get(kept, F.lit(0))["title"].alias("first"))


