"""Hook and pacing of a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hook_body_split(cues: DataFrame, cutoff_ms: int = 60000) -> DataFrame:
    """Per video: cues and words before and after the cutoff, the hook's length, words a minute.

    The hook's length is that of its cues, ten seconds at least and ten over the cutoff at most.
    """
    hook, end = F.col("start_ms") <= cutoff_ms, F.col("start_ms") + F.col("dur_ms")
    grouped = cues.groupBy("video_id").agg(
        F.count_if(hook).alias("hook_cues"),
        F.count_if(~hook).alias("body_cues"),
        F.coalesce(F.sum(F.when(hook, F.col("n_tok"))), F.lit(0)).alias("hook_words"),
        F.sum("n_tok").alias("words"),
        F.greatest(F.lit(10000), F.least(F.max(F.when(hook, end)), F.lit(cutoff_ms + 10000))).cast("long").alias("hook_ms"),
        F.greatest(F.lit(1000), F.max(end)).alias("total_ms"),
    )
    wpm = lambda n, ms: F.floor(F.col(n) * 60000 / F.col(ms)).cast("long")
    return grouped.select("video_id", "hook_cues", "body_cues", "hook_words", "hook_ms", wpm("hook_words", "hook_ms").alias("hook_wpm"), wpm("words", "total_ms").alias("overall_wpm"))
