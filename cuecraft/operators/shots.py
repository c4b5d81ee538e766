"""Shots and detections of a video's scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def static_shot_pairs(shots: DataFrame, most: int = 25) -> DataFrame:
    """Shots (scene, box, x) whose next one is at most so far away."""
    shift = F.abs(F.lead("x").over(Window.partitionBy("scene").orderBy("box", "x")) - F.col("x"))
    return shots.select("scene", "box", shift.alias("shift")).filter(F.col("shift") <= most)


def dominant_cluster(boxes: DataFrame, crop: int = 600) -> DataFrame:
    """Per scene: boxes within half a crop of the largest one, their median centre and bounds."""
    centre = F.col("x") + F.col("w") / 2
    rows = boxes.withColumn("cx", centre).withColumn("area", F.col("w") * F.col("h"))
    largest = rows.groupBy("scene").agg(F.max_by("cx", F.struct("area", -F.col("box"), -F.col("cx"))).alias("main"))
    near = rows.join(largest, "scene").filter(F.abs(F.col("cx") - F.col("main")) <= crop / 2)
    return near.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), F.median("cx").alias("centre"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))


def wide_scenes(boxes: DataFrame, crop: int = 600) -> DataFrame:
    """Scenes with three boxes in one frame, or boxes that span most of the crop."""
    frames = boxes.groupBy("scene", "t").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))
    grouped = frames.groupBy("scene").agg(F.max("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return grouped.select("scene", ((F.col("n") >= 3) | (F.col("x1") - F.col("x0") > 0.88 * crop)).alias("wide"))


def motion_centroid(columns: DataFrame, least: float = 2.0) -> DataFrame:
    """Per scene the centre of motion (x weighted by motion), where there is enough of it."""
    grouped = columns.groupBy("scene").agg(F.sum(F.col("x") * F.col("motion")).alias("xm"), F.sum("motion").alias("m"), F.avg("motion").alias("mean"))
    return grouped.filter(F.col("mean") >= least).select("scene", (F.col("xm") / F.col("m")).alias("centroid"))


def shot_labels(shots: DataFrame) -> DataFrame:
    """Framing and cut of each shot (scene, box, wide, faces): L and J cuts in turn, a cut on action at the end."""
    own = Window.partitionBy("scene").orderBy("box")
    n = F.row_number().over(own)
    last = F.lead("box").over(own).isNull()
    framing = F.when(F.col("wide"), "wide").when(F.col("faces") > 0, "medium close-up").otherwise("talking head")
    cut = F.when(last, "cut-on-action").when(n % 2 == 1, "L-cut").otherwise("J-cut")
    return shots.select("scene", "box", framing.alias("framing"), cut.alias("cut"))
