"""The metadata backfill as a job over a stored corpus: plan, dry run, rewrite of what changed, counters, log.

A corpus is a Parquet table of clip records in folders by ``part``. Contexts come from all clips of a video, whatever is rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuecraft.functions.text import validate_title
from cuecraft.sources import publog
from cuecraft.sources.shared import written

#: The columns that a backfill may write, where its evidence comes from, and the counters in their order.
WRITES = ["niche", "seo_topic", "seo_topic_source", "suggested_title", "suggested_hashtags"]
FULL, UNION = "full_transcript", "snippet_union"
COUNTERS = ["total", "updated", "changed", "would_change", "skipped_no_transcript", "skipped_no_context", "skipped_full_transcript", "skipped_unknown_provenance", "rejected_by_gate", "failed"]
PARTS = 64


def part_of(video_id: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(video_id), F.lit(parts)).cast("int")


def store(clips: DataFrame, path: str, parts: int = PARTS) -> None:
    """A new corpus of clip records, a video's in one folder."""
    clips.withColumn("part", part_of(F.col("video_id"), parts)).repartition("part").write.partitionBy("part").parquet(path)


def content_hash(prefix: str = "") -> Column:
    """Of the columns that a backfill may write; null and empty differ."""
    return F.sha2(F.to_json(F.struct(*[F.col(prefix + n).alias(n) for n in WRITES]), {"ignoreNullFields": "false"}), 256)


def backfill_changes(clips: DataFrame, contexts: DataFrame, made: DataFrame) -> DataFrame:
    """Each clip with what the backfill would write (new_ columns), its outcome and whether that changes it.

    clips have clip_id, video_id, text and the columns of WRITES; contexts (video_id, niche, topics) one row a video; made (clip_id,
    title, hashtags) the titles that would be given, null where none could be made. Outcomes, the first that holds:

    skipped_full_transcript: written from better evidence, nothing is touched. skipped_no_transcript: the text is blank.
    skipped_no_context: its video has none; it never gets one of its own. Else niche and first topic are the context's, unless
    unknown_provenance: no source is recorded and they differ, so they stay. The title and tags are written if the title passes
    the gate (updated), else they stay (rejected_by_gate). Repeated clips are rows of their own.
    """
    known = contexts.select("video_id", F.col("niche").alias("__niche"), F.get("topics", F.lit(0)).alias("__topic"), F.lit(True).alias("__there"))
    titles = made.groupBy("clip_id").agg(F.min_by(F.struct("title", "hashtags"), "title").alias("__made"))
    blank = ~F.coalesce("text", F.lit("")).rlike(r"\S")
    rows = clips.withColumns({"blank": blank, "was": content_hash()}).join(known, "video_id", "left").join(titles, "clip_id", "left")
    skip = (
        F.when(F.col("seo_topic_source").eqNullSafe(FULL), "skipped_full_transcript")
        .when(F.col("blank"), "skipped_no_transcript")
        .when(F.col("__there").isNull(), "skipped_no_context")
    )
    niche = F.coalesce("__niche", "niche", F.lit("general"))
    unknown = F.col("seo_topic_source").isNull() & ~(F.col("niche").eqNullSafe(niche) & F.col("seo_topic").eqNullSafe(F.col("__topic")))
    title = F.col("__made.title")
    passed = F.coalesce(title.isNotNull() & validate_title(title)["reason"].isNull(), F.lit(False))
    rows = rows.withColumns({"__skip": skip, "__niche": niche})
    rows = rows.withColumns({"unknown_provenance": skip.isNull() & unknown, "failed": skip.isNull() & title.isNull(), "__passed": skip.isNull() & passed})
    moved = F.col("__skip").isNull() & ~F.col("unknown_provenance")
    new = {
        "niche": F.when(moved, F.col("__niche")).otherwise(F.col("niche")),
        "seo_topic": F.when(moved, F.col("__topic")).otherwise(F.col("seo_topic")),
        "seo_topic_source": F.when(moved, F.lit(UNION)).otherwise(F.col("seo_topic_source")),
        "suggested_title": F.when(F.col("__passed"), title).otherwise(F.col("suggested_title")),
        "suggested_hashtags": F.when(F.col("__passed"), F.col("__made.hashtags")).otherwise(F.col("suggested_hashtags")),
    }
    rows = rows.withColumns({f"new_{n}": c for n, c in new.items()})
    outcome = F.coalesce("__skip", F.when(F.col("__passed"), "updated").otherwise("rejected_by_gate"))
    kept = [c for c in rows.columns if not c.startswith("__")]
    return rows.withColumns({"outcome": outcome, "changes": F.col("was") != content_hash("new_")}).select(*kept, "outcome", "changes")


def counters(plan: DataFrame, wrote: bool) -> DataFrame:
    """The ten counters (counter, n) of a plan: one pass, a row each."""
    one = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    n = {c: one(F.col("outcome") == c) for c in COUNTERS}
    n |= {"total": F.count(F.lit(1)), "would_change": one(F.col("changes")), "changed": one(F.col("changes")) if wrote else F.lit(0).cast("long")}
    n |= {"skipped_unknown_provenance": one(F.col("unknown_provenance")), "failed": one(F.col("failed"))}
    row = plan.agg(*[n[c].alias(c) for c in COUNTERS])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in COUNTERS])))


def backfill(spark: SparkSession, path: str, contexts: Callable[[DataFrame], DataFrame], titles: Callable[[DataFrame, DataFrame], DataFrame], only: Column | None = None, dry_run: bool = False, log: str | None = None, run: str | None = None) -> DataFrame:
    """Runs a backfill over a stored corpus and returns its counters.

    ``contexts`` makes contexts from all clips, ``titles`` titles from clips and contexts. ``only`` narrows which clips are rewritten, never
    the contexts. A dry run makes the same plan and writes nothing. Folders with a clip that changes are replaced whole, others are not
    touched, so a second run changes nothing and rewrites nothing. The plan is written first: titles are made once, and
    a run that dies before the folders are replaced leaves the corpus as it was. New titles go to ``log``, under the name
    ``run`` once however often the run is tried.
    """
    clips = spark.read.parquet(path)
    known = contexts(clips)
    chosen = clips if only is None else clips.filter(only)
    new = [f"new_{n}" for n in WRITES]
    plan = backfill_changes(chosen, known, titles(chosen, known)).select("clip_id", "video_id", "part", "blank", "was", *new, "outcome", "unknown_provenance", "failed", "changes")
    plan = written(plan, "backfill-plan")  # without the texts
    dirty = plan.filter("changes")
    if not dry_run and dirty.limit(1).count():
        # rows that agree in id, video, content and blankness have one plan
        same = ["clip_id", "video_id", "blank", "was"]
        values = dirty.select(*[F.col(c).alias(f"__{c}") for c in same], *new).distinct()
        stale = clips.join(F.broadcast(dirty.select("part").distinct()), "part", "left_semi").withColumns({"blank": ~F.coalesce("text", F.lit("")).rlike(r"\S"), "was": content_hash()})
        met = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
        for c in same:
            met = met & F.col(c).eqNullSafe(F.col(f"__{c}"))
        joined = stale.join(values, met, "left")
        put = [F.when(F.col("__was").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in WRITES else F.col(c) for c in clips.columns]
        replaced = written(joined.select(*put), "backfill-new")
        replaced.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        if log is not None:
            told = dirty.filter("outcome = 'updated'").select(F.lit("backfill_titles").alias("source"), "video_id", F.col("clip_id").cast("string").alias("filename"), F.col("new_suggested_title").alias("suggested_title"), F.col("new_niche").alias("niche"))
            publog.append_publications(publog.publication_records(told), log, batch=run)
    return counters(plan, not dry_run)
