"""The publication log: records with sixteen fields as JSON lines, appended in committed batches and read back, in batch or as a stream."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuecraft.sources.folders import register
from cuecraft.sources.shared import shared_path

SCHEMA = "clip_id long, source string, niche string, title string, published_at timestamp"
#: The fields of a record, in their order, and what its event is called.
RECORD = (
    "event string, decided_at string, source string, video_id string, filename string, suggested_title string, short_title string, winning_framework string, winning_pattern string, "
    "winning_keyword string, niche string, hook_text string, candidate_count long, virality_score double, standalone_probability double, sponsor_probability double"
)
EVENT = "title_decided"
_TEXTS = ("source", "video_id", "filename", "suggested_title", "short_title", "winning_framework", "niche", "hook_text")
_SCORES = ("virality_score", "standalone_probability", "sponsor_probability")


def publication_records(decided: DataFrame, decided_at: Column | None = None) -> DataFrame:
    """The records of decided titles, sixteen fields each, in the order of RECORD.

    Rows hold any of source, video_id, filename, suggested_title, short_title, winning_framework, niche, hook_text, the three scores and
    candidates (array<struct<title, pattern, keyword, ...>>); texts that are missing or null are empty, scores null. The winner is
    the first candidate whose title is the suggested one; without it pattern and keyword are empty. Null candidates don't count.
    Repeated rows are records of their own. decided_at is text in UTC, by default the time of the query.
    """
    there = set(decided.columns)
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in there else F.lit("")
    given = {n: text(n) for n in _TEXTS}
    if "candidates" in there:
        candidates = F.filter(F.coalesce("candidates", F.array().cast(decided.schema["candidates"].dataType)), lambda c: c.isNotNull())
        winner = F.get(F.filter(candidates, lambda c: c["title"].eqNullSafe(F.col("suggested_title") if "suggested_title" in there else F.lit(""))), F.lit(0))
        given |= {"winning_pattern": F.coalesce(winner["pattern"], F.lit("")), "winning_keyword": F.coalesce(winner["keyword"], F.lit("")), "candidate_count": F.size(candidates).cast("long")}
    else:
        given |= {"winning_pattern": F.lit(""), "winning_keyword": F.lit(""), "candidate_count": F.lit(0).cast("long")}
    given |= {n: F.col(n).cast("double") if n in there else F.lit(None).cast("double") for n in _SCORES}
    at = F.to_utc_timestamp(decided_at if decided_at is not None else F.current_timestamp(), F.current_timezone())
    given |= {"event": F.lit(EVENT), "decided_at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")}
    return decided.select(*[given[f.split()[0]].alias(f.split()[0]) for f in RECORD.split(", ")])


def append_publications(records: DataFrame, path: str, batch: str | None = None, must: bool = False) -> bool:
    """Adds records to a log: all of them or, if anything fails, none; then False is returned, or the failure raised with ``must``.

    A batch name makes an append repeatable: one that is in the log already is not added again. Records are made into text
    before a file is opened, nulls included.
    """
    register(records.sparkSession)
    names = ["`" + c.replace("`", "``") + "`" for c in records.columns]
    lines = records.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))
    try:
        writer = lines.write.format("cuecraft_log").mode("append")
        (writer.option("batch", batch) if batch else writer).save(path)
    except Exception:
        if must:
            raise
        logging.getLogger(__name__).warning("could not append to %s", path, exc_info=True)
        return False
    return True


def parsed(lines: DataFrame, schema: str = SCHEMA) -> DataFrame:
    """Records of lines (value); blank, truncated and non-object ones are left out."""
    rows = lines.filter(F.trim("value") != "")
    read = rows.select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    return read.filter(F.col("r._bad").isNull() & F.trim("value").startswith("{")).select("r.*").drop("_bad")


def read_publications(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of plain JSON lines, as other programs write them; no folder, no records."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    return parsed(lines, schema)


def read_log(spark: SparkSession, path: str, schema: str = RECORD, seen: str | None = None) -> DataFrame:
    """Records of a committed log; a stream of new ones if a folder ``seen``, for lists of what was found, is named. No log, no records."""
    source = register(spark).read if seen is None else register(spark).readStream.option("seen", seen)
    return parsed(source.format("cuecraft_log").option("path", path).load().filter("error IS NULL"), schema)


def round_trip(records: DataFrame, schema: str = RECORD) -> DataFrame:
    """The records appended to a new log in the shared folder, twice under one name as a retry would, and read back."""
    spark = records.sparkSession
    path = shared_path(spark, "publog")
    for _ in range(2):
        append_publications(records, path, batch="first", must=True)
    return read_log(spark, path, schema)
