"""Channel statistics, outliers and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuecraft.operators.ordering import global_place

# Lower bounds of the multiplier and the badge from there on.
BADGES = ((4.0, "Mega Outlier", 1), (2.0, "Breakout Hit", 2), (1.3, "Above Average", 3), (0.7, "Standard", 4))
OUTLIER = 1.3


def _baseline(median, mean):
    return F.when(median > 0, median).when(mean > 0, mean).otherwise(F.lit(1).cast("long"))


def _stats(videos: DataFrame) -> DataFrame:
    seen = F.when(F.col("views") > 0, F.col("views"))
    return videos.groupBy("channel_id").agg(
        F.coalesce(F.floor(F.median(seen)), F.lit(0)).cast("long").alias("median_views"),
        F.coalesce(F.floor(F.avg(seen)), F.lit(0)).cast("long").alias("mean_views"),
        F.coalesce(F.max(seen), F.lit(0)).cast("long").alias("max_views"),
        F.count(F.lit(1)).alias("n_videos"),
    )


def outlier_tiers(videos: DataFrame) -> DataFrame:
    """Each video (channel_id, video_id, views) with its multiple of the channel's median, badge, tier and rank.

    The baseline counts only views above zero; videos without views stay. One shuffle by
    channel gives the statistics, a join brings them back: a channel with most of the
    videos is folded before the shuffle.
    """
    base = _stats(videos).select("channel_id", _baseline(F.col("median_views"), F.col("mean_views")).alias("baseline"))
    rows = videos.join(base, "channel_id").withColumn("multiplier", F.round(F.coalesce("views", F.lit(0)) / F.col("baseline"), 2))
    badge, tier = F.lit("Underperforming"), F.lit(5)
    for bound, name, number in reversed(BADGES):
        badge = F.when(F.col("multiplier") >= bound, name).otherwise(badge)
        tier = F.when(F.col("multiplier") >= bound, number).otherwise(tier)
    own = Window.partitionBy("channel_id").orderBy(F.desc("multiplier"), F.desc("views"), "video_id")
    return rows.withColumn("badge", badge).withColumn("tier", tier).withColumn("rank", F.row_number().over(own))


def channel_stats(videos: DataFrame) -> DataFrame:
    """One row per channel: median, mean and largest views, outliers, their share, the top multiple."""
    base = _stats(videos).withColumn("baseline", _baseline(F.col("median_views"), F.col("mean_views")))
    multiple = F.round(F.coalesce("views", F.lit(0)) / F.col("baseline"), 2)
    extra = (
        videos.join(base.select("channel_id", "baseline"), "channel_id")
        .groupBy("channel_id")
        .agg(F.count_if(multiple >= OUTLIER).alias("outlier_count"), F.max(multiple).alias("top_multiplier"))
    )
    ratio = F.round(F.col("outlier_count") / F.col("n_videos"), 2).alias("outlier_ratio")
    return base.join(extra, "channel_id").select("channel_id", "n_videos", "median_views", "mean_views", "max_views", "outlier_count", "top_multiplier", ratio)


THUMBNAIL = ("https://i.ytimg.com/vi/", "/hqdefault.jpg")


def channel_rollup(hits: DataFrame) -> DataFrame:
    """Search hits (channel_id, pos, video_id, views, name, and url, subs, thumbnail where there are) by channel, the most viewed first.

    Per channel name, url, subs and thumbnail of its first hit (a video's own picture if it names none), how many hits, the top views of
    one, and place, in the order of top views and then of the first hit. Hits without a channel or a name don't count,
    missing views are none. The hits themselves are ``channel_samples``: rows, as a channel may have most of them.
    """
    there = set(hits.columns)
    text = lambda n: F.col(n).cast("string") if n in there else F.lit(None).cast("string")
    own = F.concat(F.lit(THUMBNAIL[0]), F.col("video_id"), F.lit(THUMBNAIL[1]))
    subs = F.col("subs").cast("long") if "subs" in there else F.lit(None).cast("long")
    first = F.struct("name", text("url").alias("url"), subs.alias("subs"), F.coalesce(text("thumbnail"), own).alias("thumbnail"))
    good = hits.filter("channel_id IS NOT NULL AND name <> ''")
    rows = good.groupBy("channel_id").agg(F.count(F.lit(1)).alias("videos_count"), F.max(F.coalesce("views", F.lit(0))).alias("top_views"), F.min("pos").alias("__pos"), F.min_by(first, F.struct("pos", "name", "video_id")).alias("f"))
    rows = rows.select("channel_id", "videos_count", "top_views", "__pos", "f.*")
    return global_place(rows, [-F.col("top_views"), F.col("__pos"), F.col("channel_id")]).drop("__pos")


def channel_samples(hits: DataFrame) -> DataFrame:
    """The hits of each channel in the order of the search, equal places by id and views: channel_id, place, video_id, url, views, thumbnail."""
    good = hits.filter("channel_id IS NOT NULL AND name <> ''")
    place = F.row_number().over(Window.partitionBy("channel_id").orderBy("pos", "video_id", "views"))
    picture = F.concat(F.lit(THUMBNAIL[0]), F.col("video_id"), F.lit(THUMBNAIL[1]))
    shown = F.coalesce(F.col("thumbnail").cast("string"), picture) if "thumbnail" in hits.columns else picture
    return good.select("channel_id", place.alias("place"), "video_id", F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("video_id")).alias("url"), F.coalesce("views", F.lit(0)).alias("views"), shown.alias("thumbnail"))


def popularity_rank(videos: DataFrame) -> DataFrame:
    """Place of each video in its channel's listing, most viewed first."""
    own = Window.partitionBy("channel_id").orderBy(F.desc("views"), "video_id")
    return videos.withColumn("place", F.row_number().over(own))


def next_unprocessed(videos: DataFrame, registry: DataFrame, n: int = 1) -> DataFrame:
    """The first n videos per channel, by popularity, that the registry does not hold."""
    return popularity_rank(videos.join(registry.select("video_id"), "video_id", "left_anti")).filter(F.col("place") <= n)


def with_dates(videos: DataFrame, feed: DataFrame) -> DataFrame:
    """Upload dates from the feed where it has them, else from the listing."""
    return videos.join(feed.select("video_id", F.col("uploaded").alias("__feed")), "video_id", "left").select(
        *[c for c in videos.columns if c != "uploaded"], F.coalesce("__feed", "uploaded").alias("uploaded")
    )


def registry_upsert(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """The last state of each video, later times first; ties go to the update."""
    both = registry.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    return both.groupBy("video_id").agg(F.max_by(F.struct("processed_at", "status"), F.struct("processed_at", "__new")).alias("s")).select("video_id", "s.processed_at", "s.status")
