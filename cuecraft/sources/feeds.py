"""Channel listings as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecraft.functions.times import duration_fmt


def normalize_channel_videos(raw: DataFrame) -> DataFrame:
    """Rows with an id; titles and thumbnails have defaults, durations are text."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled Video"))
    thumb = F.concat(F.lit("https://i.ytimg.com/vi/"), F.col("video_id").cast("string"), F.lit("/hqdefault.jpg"))
    return raw.filter("video_id IS NOT NULL").withColumns(
        {"title": title, "thumbnail": F.coalesce("thumbnail", thumb), "duration": duration_fmt(F.col("duration_seconds"))}
    )
