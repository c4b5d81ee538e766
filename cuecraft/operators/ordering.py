"""Order-keeping operations over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuecraft.sources.shared import shared_path


def global_place(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Place of each row in the order of the keys, without one task that holds all rows.

    Rows are dealt by ranges of the keys and written with their range, so that both readers of
    them agree; each range numbers its own behind the counts of the ranges before it (one row a
    range).
    """
    names = [f"__k{k}" for k in range(len(keys))]
    ranged = rows.withColumns(dict(zip(names, keys, strict=True))).repartitionByRange(*names).withColumn("__part", F.spark_partition_id())
    path = shared_path(rows.sparkSession, "ranges")
    ranged.write.parquet(path)
    ranged = rows.sparkSession.read.schema(ranged.schema).parquet(path)
    ranged = ranged.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*names)))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = ranged.join(F.broadcast(counts.select("__part", before.alias("__before"))), "__part")
    return ranged.withColumn("place", (F.col("__before") + F.col("__rank")).cast("long")).drop(*names, "__part", "__rank", "__before")


def distinct_ci(rows: DataFrame) -> DataFrame:
    """Words (shown, pos) once each whatever their case, as first shown."""
    return rows.groupBy(F.lower("shown").alias("word")).agg(F.min_by("shown", "pos").alias("shown"), F.min("pos").alias("pos"))
