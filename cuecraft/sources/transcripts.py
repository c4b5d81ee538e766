"""Transcripts from raw snippets, and the caption track to take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Signs in an error that the connection was refused, and languages in the order they are taken.
REFUSED = ["blocking", "bot", "cloud provider", "ip ban", "sign in", "too many requests"]
LANGUAGES = ["en", "en-orig", "en-US", "en-GB"]


def error_class(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    refused = F.exists(F.array(*map(F.lit, REFUSED)), lambda x: F.contains(low, x))
    return F.when(refused, "refused").otherwise("no captions")


def normalize_transcripts(raw: DataFrame) -> DataFrame:
    """Raw rows (video_id, snippets array<struct<text, start, duration>>, error) as video_id, available, error, snippets, full_text.

    Line ends become spaces, blank snippets go, times are rounded to hundredths (null: 0), the
    texts are joined by spaces. A video without raw snippets is not available and its error is
    classed; one with blank ones alone is available and empty. A video's snippets are one row.
    """
    clean = lambda s: F.trim(F.replace(F.coalesce(s["text"], F.lit("")), F.lit("\n"), F.lit(" ")))
    number = lambda x: F.round(F.coalesce(x.cast("double"), F.lit(0.0)), 2)
    made = F.transform("snippets", lambda s: F.struct(clean(s).alias("text"), number(s["start"]).alias("start"), number(s["duration"]).alias("duration")))
    none = F.expr("cast(array() AS array<struct<text:string,start:double,duration:double>>)")
    there = F.coalesce(F.size("snippets") > 0, F.lit(False))
    rows = raw.select("video_id", there.alias("available"), F.when(~there, error_class(F.col("error"))).alias("error"), F.when(there, F.filter(made, lambda s: s["text"] != "")).otherwise(none).alias("snippets"))
    return rows.withColumn("full_text", F.array_join(F.transform("snippets", lambda s: s["text"]), " "))


def pick_track(tracks: DataFrame, languages: list[str] = LANGUAGES) -> DataFrame:
    """The caption track (video_id, lang, auto, pos, ext, url) of each video, one row.

    Languages in order, a written track before an automatic one in each; without any of them the
    first written, else the first automatic track. Of a track's formats json3, else the first.
    """
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
    rank = F.when(place > 0, place * 2 + F.col("auto").cast("int")).otherwise(100 + F.col("auto").cast("int"))
    own = Window.partitionBy("video_id").orderBy(rank, "pos", "url")
    lang = F.first("lang").over(own)
    auto = F.first("auto").over(own)
    kept = tracks.withColumn("__lang", lang).withColumn("__auto", auto).filter("lang = __lang AND auto = __auto").drop("__lang", "__auto")
    form = Window.partitionBy("video_id").orderBy(F.col("ext") != "json3", "pos", "url")
    return kept.withColumn("__k", F.row_number().over(form)).filter("__k = 1").drop("__k")
