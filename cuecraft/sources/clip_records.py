"""Clip records as JSON: written, read back, unreadable ones counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "clip_id long, video_id long, title string, niche string, source string, start_ms long, end_ms long"


def write_clips(clips: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON object a line, in folders by a column if one is named."""
    writer = clips.write.mode("append")
    (writer.partitionBy(by) if by else writer).json(path)


def read_clips(spark: SparkSession, path: str, schema: str = SCHEMA, whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, unreadable): records of a folder, one a line or one a file, and (reason, n) of what is none.

    Blank lines are neither. What is no JSON is "corrupt", other values than objects are "no object".
    """
    rows = spark.read.text(path, wholetext=whole_files).filter(F.trim("value") != "")
    parsed = rows.select(F.trim("value").alias("value"), F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    object_ = F.col("value").startswith("{")
    bad = F.when(~object_, "no object").when(F.col("r._bad").isNotNull(), "corrupt")
    parsed = parsed.withColumn("reason", bad)
    unreadable = parsed.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return parsed.filter("reason IS NULL").select("r.*").drop("_bad"), unreadable
