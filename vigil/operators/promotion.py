"""From a captured post that was hard-deleted to a public story."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.config import Config
from vigil.functions.generated import from_text
from vigil.functions.pii import has_pii
from vigil.functions.risk import classify
from vigil.functions.text import filled, strip


def promotable(posts: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The next posts to promote: hard deletions with text that nothing has handled yet."""
    ok = F.col("hard_deleted_at").isNotNull() & F.col("body_text").isNotNull() & F.col("promotion_status").isNull()
    if "promoted_story_id" in posts.columns:
        ok = ok & F.col("promoted_story_id").isNull()
    if cfg.min_volatility > 0:
        ok = ok & (F.col("volatility_score") >= cfg.min_volatility)
    return posts.where(ok).orderBy(F.col("volatility_score").desc_nulls_last(), F.col("hard_deleted_at").asc_nulls_last(), "id").limit(cfg.promote_batch)


def outcomes(posts: DataFrame, generated: DataFrame, stories: DataFrame, auto: bool = True, force: str | None = None, cfg: Config = Config()) -> DataFrame:
    """posts with outcome, promotion_status, linked_story_id, llm_attempts and ``story``, the row to insert if promoted anew.

    posts: id, url, title, body_text, volatility_score, llm_attempts. generated: id, raw
    (null if the generator failed). The text is screened before and after generation.
    """
    raw = generated.select(F.col("id").alias("__g"), F.col("raw").alias("__raw"))
    linked = stories.where("origin_captured_url is not null").groupBy(F.col("origin_captured_url").alias("__o")).agg(F.min("id").alias("__linked"))
    rows = posts.join(raw, posts["id"] == F.col("__g"), "left").join(linked, posts["url"] == F.col("__o"), "left")
    body = F.coalesce(F.col("body_text"), F.lit(""))
    category = F.lit(force) if force in ("kindness", "critique") else classify(F.col("title"), body)
    rows = rows.withColumn("__in", has_pii(body)).withColumn("__cat", category)
    rows = rows.withColumn("__gen", from_text(F.col("__raw"), body, F.col("__cat"), cfg.body_chars, cfg.min_source))
    rows = rows.withColumn("__out", has_pii(F.col("__gen.body")))
    tries = F.coalesce(F.col("llm_attempts"), F.lit(0)) if "llm_attempts" in posts.columns else F.lit(0)
    failed = F.col("__raw").isNull() & (F.length(strip(body)) >= cfg.min_source)
    hold = (F.col("__cat") == "critique") & F.lit(auto and not cfg.auto_critique)
    outcome = (
        F.when(F.col("__in"), "blocked_pii")
        .when(hold, "pending_review")
        .when(failed & (tries + 1 >= cfg.llm_attempts), "pending_review")
        .when(failed, "retry")
        .when(F.col("__gen.no_fit"), "skipped")
        .when(F.col("__out"), "blocked_pii")
        .when(F.col("__linked").isNotNull(), "linked")
        .otherwise("promoted")
    )
    rows = rows.withColumn("outcome", outcome)
    o = F.col("outcome")
    story = F.struct(
        F.col("__gen.category").alias("category"), F.col("__gen.body").alias("body"),
        F.array(F.struct(F.coalesce(filled(F.col("title")), F.col("url")).alias("title"), F.col("url").alias("uri"))).alias("citations"),
        F.lit(0).alias("vote_count"), F.col("__gen.poetic_reason").alias("poetic_reason"),
        F.coalesce(F.col("volatility_score"), F.col("__gen.volatility_score")).alias("volatility_score"),
        F.lit(True).alias("from_capture"), F.col("url").alias("origin_captured_url"), F.col("hard_deleted_at").alias("captured_hard_deleted_at"),
    )
    attempts = F.when(o == "retry", tries + 1).otherwise(F.lit(0)).cast("int")
    return rows.select(
        *[F.col(c) for c in posts.columns if c not in ("promotion_status", "llm_attempts")], "outcome",
        F.when(o == "linked", "promoted").when(o != "retry", o).alias("promotion_status"),
        F.when(o == "linked", F.col("__linked")).alias("linked_story_id"), attempts.alias("llm_attempts"),
        F.when(o == "promoted", story).alias("story"),
    )


def batch_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("outcome").agg(F.count("*").alias("n"))


def alternate(rows: DataFrame, order: Column, seed: int = 0) -> Column:
    """kindness and critique in turn, for rows numbered by ``order`` (from 0)."""
    return F.when(F.pmod(order + seed, F.lit(2)) == 0, "kindness").otherwise("critique")
