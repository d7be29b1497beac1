"""From a fetched page to a verdict: what was seen, what that means, what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.config import Config
from vigil.functions import fixed
from vigil.functions.text import filled, first_match, matches, prefix, visible_text
from vigil.functions.urls import is_site_root, url_key
from vigil.operators.schedule import next_interval, seconds_after

BASELINE = "struct<final_url:string,len:int,hash:string,del_match:boolean,blk_match:boolean>"


def observe(pages: DataFrame, body: str = "body") -> DataFrame:
    """pages with text, text_len, text_hash, del_match, del_snip, blk_match, blk_snip and bot_challenge."""
    seen = pages.withColumn("text", visible_text(F.col(body)))
    t = F.col("text")
    return seen.withColumns({
        "text_len": F.length(t).cast("int"),
        "text_hash": F.sha2(t, 256),
        "del_match": matches(t, fixed.DELETION_PATTERN),
        "blk_match": matches(t, fixed.BLOCKED_PATTERN),
        "del_snip": prefix(first_match(t, fixed.DELETION_PATTERN), 40),
        "blk_snip": prefix(first_match(t, fixed.BLOCKED_PATTERN), 40),
        "bot_challenge": matches(t, fixed.CHALLENGE_PATTERN),
    })


def decide(obs: Column, url: Column, base: Column, cfg: Config = Config()) -> Column:
    """struct(status, http_code, reason, baseline) of an observation against a baseline.

    obs: struct of net, http_code, final_url, text_len, text_hash, del_match, blk_match,
    del_snip, blk_snip, bot_challenge, reason. base: null, or a struct of captured,
    final_url, len, hash, del_match, blk_match. Login notes and other lasting words do
    not condemn a page: only a change against the baseline, or a deletion note on a
    page never seen alive, does.
    """
    no, text = F.lit(False), lambda c: F.coalesce(c, F.lit(""))
    flag = lambda c: F.coalesce(c, no)
    net, code = obs["net"], obs["http_code"]
    final = F.coalesce(filled(obs["final_url"]), url)
    based = flag(base["captured"])
    base_len = F.coalesce(base["len"], F.lit(0))
    collapsed = flag((base_len >= cfg.collapse_min_length) & (obs["text_len"] < base_len * cfg.collapse_ratio))
    new_del = flag(obs["del_match"]) & ~flag(base["del_match"])
    new_blk = flag(obs["blk_match"]) & ~flag(base["blk_match"])
    known = F.coalesce(filled(base["final_url"]), url)
    to_root = (url_key(final) != url_key(known)) & is_site_root(final)
    same = flag((base["hash"] != "") & (obs["text_hash"] == base["hash"]))
    empty = F.lit(None).cast(BASELINE)
    fresh = F.struct(final.alias("final_url"), obs["text_len"].cast("int").alias("len"), obs["text_hash"].alias("hash"), flag(obs["del_match"]).alias("del_match"), flag(obs["blk_match"]).alias("blk_match")).cast(BASELINE)

    def verdict(status: str, reason: Column, baseline: Column = empty, http: Column = code) -> Column:
        return F.struct(F.lit(status).alias("status"), http.cast("int").alias("http_code"), reason.cast("string").alias("reason"), baseline.alias("baseline"))

    none = F.lit(None).cast("string")
    nothing = F.lit(None).cast("int")
    numbered = F.concat(F.lit("HTTP "), code.cast("string"))
    a, b, c = fixed.REASON_COLLAPSED
    return (
        F.when(net == "unsafe", verdict("error", F.coalesce(obs["reason"], F.lit("unsafe_url")), http=nothing))
        .when(net == "timeout", verdict("error", F.lit("timeout"), http=nothing))
        .when(net == "neterr", verdict("error", F.coalesce(obs["reason"], F.lit("net")), http=nothing))
        .when(net == "redirect_loop", verdict("error", F.lit("too_many_redirects"), http=nothing))
        .when((net == "http") & flag(code.isin(fixed.HARD_CODES)), verdict("deleted", numbered))
        .when((net == "http") & flag(code == 403), verdict("error", F.lit(fixed.REASON_403)))
        .when(net == "http", verdict("error", numbered))
        .when(flag(obs["bot_challenge"]), verdict("error", F.lit(fixed.UNTRACKABLE_REASON)))
        .when(~based & flag(obs["del_match"]), verdict("deleted", F.concat(F.lit(fixed.REASON_DELETED), text(obs["del_snip"]))))
        .when(~based, verdict("live", none, fresh))
        .when(same, verdict("live", none))
        .when(new_del, verdict("deleted", F.concat(F.lit(fixed.REASON_NEWLY_DELETED), text(obs["del_snip"]))))
        .when(to_root, verdict("deleted", F.concat(F.lit(fixed.REASON_MOVED), prefix(final, 120))))
        .when(new_blk, verdict("blocked", F.concat(F.lit(fixed.REASON_NEWLY_BLOCKED), text(obs["blk_snip"]))))
        .when(collapsed, verdict("deleted", F.concat(F.lit(a), base_len.cast("string"), F.lit(b), obs["text_len"].cast("string"), F.lit(c))))
        .otherwise(verdict("live", none))
    )


def based_on(baseline: Column) -> Column:
    """What ``decide`` takes as base, of a baseline that a verdict gave; null without one."""
    kept = [F.lit(True).alias("captured"), *(baseline[n].alias(n) for n in ("final_url", "len", "hash", "del_match", "blk_match"))]
    return F.when(baseline.isNotNull(), F.struct(*kept))


def judge_log(observations: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A log of observations (url, at, seq, obs) with each one's status, http_code and reason against the baseline
    that the url's first live observation left, the status before it, and whether it is newly gone."""
    order = Window.partitionBy("url").orderBy("at", "seq")
    no_base = based_on(F.lit(None).cast(BASELINE))
    fresh = observations.withColumn("__fresh", decide(F.col("obs"), F.col("url"), no_base, cfg)["baseline"])
    held = F.first("__fresh", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    judged = fresh.withColumn("__held", held).withColumn("__v", decide(F.col("obs"), F.col("url"), based_on(F.col("__held")), cfg))
    before = judged.withColumn("previous_status", F.lag("__v.status").over(order))
    return before.select("url", "at", "seq", "__v.status", "__v.http_code", "__v.reason", "previous_status", newly_gone(F.col("__v.status"), F.col("previous_status")).alias("newly_gone"))


def newly_gone(status: Column, previous: Column) -> Column:
    gone = ["deleted", "blocked"]
    return status.isin(gone) & ~F.coalesce(previous.isin(gone), F.lit(False))


def apply_verdicts(rows: DataFrame, as_of: Column, cfg: Config = Config(), first_hard: bool = False) -> DataFrame:
    """rows (with a ``verdict`` struct) after their checks: status, counts, schedule, stamps, a first baseline, and the
    status and code before.

    deleted_at is stamped on each change to deleted. first_hard: hard_deleted_at is
    stamped once, at the first 404 or 410.
    """
    v = F.col("verdict")
    count = F.coalesce(F.col("check_count"), F.lit(0)) + 1
    taken = v["baseline"].isNotNull()
    keep = lambda new, old: F.when(taken, new).otherwise(F.col(old)) if old in rows.columns else F.when(taken, new)
    step = next_interval(v["status"], count, F.col("error_count"), cfg)
    changed = (v["status"] == "deleted") & ~F.coalesce(F.col("status") == "deleted", F.lit(False))
    stamp = lambda old: F.col(old) if old in rows.columns else F.lit(None).cast("timestamp_ntz")
    out = {
        "previous_status": F.col("status"),
        "status": v["status"], "http_code": v["http_code"], "reason": v["reason"],
        "last_checked": as_of, "check_count": count.cast("int"),
        "next_check_at": seconds_after(as_of, step["seconds"]), "error_count": step["error_count"],
        "baseline_final_url": keep(v["baseline"]["final_url"], "baseline_final_url"), "baseline_len": keep(v["baseline"]["len"], "baseline_len"),
        "baseline_hash": keep(v["baseline"]["hash"], "baseline_hash"), "baseline_del_match": keep(v["baseline"]["del_match"], "baseline_del_match"),
        "baseline_blk_match": keep(v["baseline"]["blk_match"], "baseline_blk_match"), "baseline_at": keep(as_of, "baseline_at"),
        "deleted_at": F.when(changed, as_of).otherwise(stamp("deleted_at")),
        "newly_gone": newly_gone(v["status"], F.col("status")),
    }
    if "http_code" in rows.columns:
        out["previous_code"] = F.col("http_code")
    if first_hard:
        hard = (v["status"] == "deleted") & F.coalesce(v["http_code"].isin(fixed.HARD_CODES), F.lit(False))
        out["hard_deleted_at"] = F.coalesce(stamp("hard_deleted_at"), F.when(hard, as_of))
    return rows.withColumns(out).drop("verdict")


def transitions(log: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """An observation log with the previous status of each row's key and whether it is newly gone."""
    before = F.lag("status").over(Window.partitionBy(*key).orderBy(*order))
    return log.withColumn("previous_status", before).withColumn("newly_gone", newly_gone(F.col("status"), F.col("previous_status")))
