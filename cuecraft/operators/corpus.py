"""Reports and update jobs over the whole corpus of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def niche_disagreement(clips: DataFrame) -> DataFrame:
    """How many videos there are, and how many whose clips carry more than one niche."""
    each = clips.groupBy("video_id").agg(F.count_distinct("niche").alias("niches"))
    return each.agg(F.count(F.lit(1)).alias("videos"), F.count_if(F.col("niches") > 1).alias("disagreeing"))


def upload_outcome(attempts: DataFrame) -> DataFrame:
    """Per clip (clip_id, seq, ok, error): success on any platform, attempts, errors in order."""
    return attempts.groupBy("clip_id").agg(
        F.bool_or("ok").alias("success"), F.count(F.lit(1)).alias("attempts"), F.expr("coalesce(listagg(error, '; ') WITHIN GROUP (ORDER BY seq), '')").alias("errors")
    )


def upload_history(attempts: DataFrame) -> DataFrame:
    """Per clip (clip_id, ts, seq, result) the results in the order of their time."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "seq", "result")))
    return attempts.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.transform(ordered, lambda x: x["result"]).alias("history"))


def backfill_plan(clips: DataFrame, contexts: DataFrame) -> DataFrame:
    """What a metadata backfill would do with each clip, without doing it.

    Clips derived from a full transcript are left alone; clips without a context are
    skipped; clips of unknown origin that disagree keep their niche and only get a title;
    the rest take the context's niche.
    """
    joined = clips.join(contexts.select("video_id", F.col("niche").alias("__context")), "video_id", "left")
    outcome = (
        F.when(F.col("source") == "full_transcript", "untouched")
        .when(F.col("__context").isNull(), "no_context")
        .when(F.col("niche") == F.col("__context"), "unchanged")
        .when(F.col("source") == "unknown", "kept_niche")
        .otherwise("updated")
    )
    niche = F.when(outcome == "updated", F.col("__context")).otherwise(F.col("niche"))
    return joined.withColumn("outcome", outcome).withColumn("niche", niche).drop("__context")


def reconcile_plan(clips: DataFrame, contexts: DataFrame) -> DataFrame:
    """As backfill_plan for a new rendering: full-transcript clips keep the niche but take the context's topic."""
    joined = clips.join(contexts.select("video_id", F.col("niche").alias("__context"), F.col("topic").alias("__topic")), "video_id", "left")
    full = F.col("source") == "full_transcript"
    niche = F.when(full | F.col("__context").isNull(), F.col("niche")).otherwise(F.col("__context"))
    return joined.withColumn("niche", niche).withColumn("topic", F.coalesce("__topic", F.lit(""))).drop("__context", "__topic")


def outcome_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def timing_guard(clips: DataFrame) -> DataFrame:
    """Clips (clip_id, start_time, start, end_time) with the start that counts, and why a row is rejected."""
    start = F.coalesce("start_time", "start")
    reason = F.when(F.col("clip_id").isNull(), "no_id").when(start.isNull(), "no_start").when(F.col("end_time").isNull() | (F.col("end_time") <= start), "bad_range")
    return clips.withColumn("from_time", start).withColumn("reject_reason", reason)


def fresh_skip(rendered: DataFrame, now, seconds: int = 1800) -> DataFrame:
    """Rows rendered at least so many seconds before now, or never."""
    return rendered.filter(F.col("rendered_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("rendered_at") >= seconds))


def shortfall_report(selected: DataFrame, videos: DataFrame, target: int) -> DataFrame:
    """Videos with fewer selected clips than asked for."""
    got = selected.groupBy("video_id").agg(F.count(F.lit(1)).alias("found"))
    return videos.select("video_id").distinct().join(got, "video_id", "left").select("video_id", F.coalesce("found", F.lit(0)).alias("found")).filter(F.col("found") < target)
