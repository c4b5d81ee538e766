"""Small table operations that users of the library compose: lookups, rankings, concatenations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def semi_rendered(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Videos (channel_id, video_id, uploaded) of which a file exists, newest first in each channel."""
    own = Window.partitionBy("channel_id").orderBy(F.desc("uploaded"), "video_id")
    return videos.join(files, "video_id", "left_semi").select("channel_id", "video_id", "uploaded", F.row_number().over(own).alias("place"))


def token_counts(rows: DataFrame) -> DataFrame:
    """How often each token occurs in each video (video_id, tokens)."""
    return rows.select("video_id", F.explode("tokens").alias("token")).groupBy("video_id", "token").agg(F.count(F.lit(1)).alias("n"))


def full_text(cues: DataFrame) -> DataFrame:
    """A video's cues (video_id, cue_idx, text) as one text."""
    return cues.groupBy("video_id").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY cue_idx)").alias("full_text"))


def snippet_union(clips: DataFrame) -> DataFrame:
    """The texts of all clips (video_id, clip_id, text) of a video, which has a bounded number of them."""
    joined = F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY clip_id)")
    return clips.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_clips"), joined.alias("text"))


def best_clip(clips: DataFrame) -> DataFrame:
    """The clip of each video with the best virality, then rubric, then the smallest id: one aggregation."""
    top = clips.groupBy("video_id").agg(F.max_by(F.struct("clip_id", "virality", "rubric"), F.struct("virality", "rubric", -F.col("clip_id"))).alias("s"))
    return top.select("video_id", "s.clip_id", "s.virality", "s.rubric")


def pause_before(words: DataFrame) -> DataFrame:
    """Words with the pause before them; null before the first."""
    own = Window.partitionBy("video_id").orderBy("word_idx")
    return words.withColumn("pause_ms", F.col("start_ms") - F.lag("end_ms").over(own))


def loudness_bounds(levels: DataFrame, over_db: float = 7.0) -> DataFrame:
    """Per video the mean level and so much more, and the level that a tenth of the hops reach."""
    return levels.groupBy("video_id").agg((F.sum("db10") / F.count(F.lit(1)) / 10 + over_db).alias("mean_bound"), (F.percentile("db10", 0.9) / 10).alias("p90"))


def runner_up(scores: DataFrame) -> DataFrame:
    """The best niche of each video (video_id, niche, score) with the score of the second."""
    own = Window.partitionBy("video_id").orderBy(F.desc("score"), "niche")
    return scores.withColumn("second", F.lead("score").over(own)).withColumn("k", F.row_number().over(own)).filter("k = 1").drop("k")


def topk_global(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows in an order."""
    return rows.orderBy(*order).limit(k)


def topk_group(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in an order, with their place; groups are cut before the shuffle."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("k") <= k)


def join_context(clips: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clips with their video's context, clips of videos without one): a context is never made up for a clip."""
    return clips.join(contexts, "video_id"), clips.join(contexts, "video_id", "left_anti")


def retitle_stale(clips: DataFrame, titles: DataFrame, stale: list[str]) -> DataFrame:
    """Clips (clip_id, title) without a usable title or with a stale phrase, and the title they get (clip_id, title); null without one."""
    few = F.size(F.regexp_extract_all("title", F.lit("[A-Za-z]+"), F.lit(0))) < 3
    old = F.exists(F.array(*map(F.lit, stale)), lambda p: F.contains(F.lower("title"), p))
    rows = clips.filter(F.col("title").isNull() | few | old).select("clip_id", F.col("title").alias("was"))
    return rows.join(titles.select("clip_id", "title"), "clip_id", "left")
