"""Answers of an external scorer joined to windows, and the plan of uploads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuecraft.functions.scoring import heuristic_score
from cuecraft.sources.shared import written

PACK = 5


def with_packs(windows: DataFrame, size: int = PACK) -> DataFrame:
    """Windows with the number of the pack, of ``size`` each, in which a video's are scored."""
    return windows.withColumn("pack", F.floor((F.row_number().over(Window.partitionBy("video_id").orderBy("window")) - 1) / size))


def _answered(windows: DataFrame, answers: DataFrame) -> DataFrame:
    """Windows with packs, the answer of each and how many of its pack are missing; of several answers for a window the lowest counts."""
    once = answers.groupBy("video_id", "window").agg(F.min("virality").alias("answer"))
    rows = with_packs(windows).join(once, ["video_id", "window"], "left")
    return rows.withColumn("missing", F.count_if(F.col("answer").isNull()).over(Window.partitionBy("video_id", "pack")))


def answers_join(windows: DataFrame, answers: DataFrame) -> DataFrame:
    """Scores from the answers (video_id, window, virality) where the whole pack has one, else the fallback.

    A null answer is none, a zero is one. score_source and score_failed say which it was.
    """
    whole = F.col("missing") == 0
    return _answered(windows, answers).select(
        "video_id", "window", "pack", F.when(whole, F.col("answer")).otherwise(F.col("fallback")).alias("virality"),
        F.when(whole, "model").otherwise("local_heuristic").alias("score_source"), (~whole).alias("score_failed"),
    )


SCORED = "video_id long, window long, virality double"


def score_windows(windows: DataFrame, scorer: Callable, single: Callable | None = None) -> DataFrame:
    """Windows (video_id, window, text) scored in three tiers by callables over batches, an iterator of pandas frames in, one of SCORED out.

    First ``scorer`` over all windows; a pack counts if each of its windows has an answer. Then ``single``, by default the same, over the
    windows of failed packs alone. What has no answer yet takes the offline score of its text. tier and score_source say which it
    was, score_failed is true for the last. Answers are written before they are used, so no window is scored twice in a tier;
    a task that is lost is asked again. Null texts are empty ones.
    """
    asked = windows.select("video_id", "window", F.coalesce("text", F.lit("")).alias("text"))
    first = written(_answered(asked, asked.mapInPandas(scorer, SCORED)), "pack-answers")
    failed = first.filter("missing > 0")
    again = failed.select("video_id", "window", "text").mapInPandas(single or scorer, SCORED)
    again = written(again.groupBy("video_id", "window").agg(F.min("virality").alias("__single")), "single-answers")
    offline = heuristic_score(F.col("text"))["virality_score"]
    packs = first.filter("missing = 0").select("video_id", "window", "pack", F.col("answer").alias("virality"), F.lit(1).alias("tier"))
    rest = failed.join(again, ["video_id", "window"], "left").select("video_id", "window", "pack", F.coalesce("__single", offline).alias("virality"), F.when(F.col("__single").isNotNull(), 2).otherwise(3).alias("tier"))
    source = F.element_at(F.array(*map(F.lit, ("model", "model_single", "local_heuristic"))), F.col("tier"))
    return packs.unionByName(rest).select("*", source.alias("score_source"), (F.col("tier") == 3).alias("score_failed"))


def tier_counts(scored: DataFrame) -> DataFrame:
    """How many windows each tier scored."""
    return scored.groupBy("tier", "score_source").agg(F.count(F.lit(1)).alias("n"))


def upload_plan(clips: DataFrame, platforms: list[str], native: tuple[str, ...] = ("youtube",), known: tuple[str, ...] = ("youtube", "tiktok", "instagram")) -> DataFrame:
    """One row per clip (clip_id, title, tags, scheduled) and platform: its route, title and tags within limits, privacy."""
    rows = clips.withColumn("platform", F.explode(F.array(*map(F.lit, platforms))))
    route = F.when(F.col("platform").isin(*native), "native").when(F.col("platform").isin(*known), "aggregator").otherwise("rejected")
    tags = F.slice(F.transform("tags", lambda t: F.regexp_replace(t, "^#+", "")), 1, 15)
    return rows.select("clip_id", "platform", route.alias("route"), F.substring("title", 1, 100).alias("title"), tags.alias("tags"), F.when(F.col("scheduled"), "private").otherwise("public").alias("privacy"))
