"""The library's base tables, derived from the driver tables, in Spark and as SQL.

Documents stand for videos: sentences are caption cues and every token lasts 400 ms, so all
times are whole milliseconds and both engines agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuecraft.sources.shared import written  # noqa: F401

TOKEN_MS = 400
#: Tasks for each split of a table whose rows take much work.
TASKS_A_SPLIT = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _before(value, *keys):
    """Running sum over the rows before this one."""
    own = Window.partitionBy(keys[0]).orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(own), F.lit(0).cast("long"))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, cue_idx, text, n_tok, dur_ms, start_ms"""
    split = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", r"\. ")).alias("cue_idx", "text"))
    counted = split.withColumn("n_tok", F.size(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).cast("long")).filter("n_tok > 0")
    return counted.withColumn("dur_ms", F.col("n_tok") * TOKEN_MS).withColumn("start_ms", _before("dur_ms", "video_id", "cue_idx"))


CUES = r"""cues AS (
  SELECT video_id, cue_idx, text, n_tok, 400 * n_tok AS dur_ms, CAST(coalesce(sum(400 * n_tok) OVER (
    PARTITION BY video_id ORDER BY cue_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
  FROM (SELECT doc_id AS video_id, k AS cue_idx, p[k + 1] AS text, len(regexp_extract_all(p[k + 1], '[^ \n]+')) AS n_tok
    FROM (SELECT doc_id, p, unnest(range(len(p))) AS k FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)))
  WHERE n_tok > 0)"""


def tokens(texts: DataFrame) -> DataFrame:
    """video_id, word_idx, word"""
    return texts.select("video_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))).alias("word_idx", "word"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, text"""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "text")


def tasks(rows: DataFrame) -> int:
    """Tasks for rows that take much more work than room: a number that grows with the table."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS_A_SPLIT * rows.rdd.getNumPartitions())


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, word_idx, word, start_ms, end_ms: a pause that depends on the word's length follows each.

    Texts are dealt by video before they are cut, so words are never shuffled for what is done by video. They are dealt to a number of
    tasks that grows with the table: words take many times the room of their text, which merging partitions by its size would not see.
    """
    whole = texts(spark, sf_dir)
    rows = tokens(whole.repartition(tasks(whole), "video_id"))
    step = TOKEN_MS + 100 * (F.length("word") % 7)
    return rows.withColumn("start_ms", _before(step, "video_id", "word_idx")).withColumn("end_ms", F.col("start_ms") + TOKEN_MS)


WORDS = r"""words AS (
  SELECT video_id, word_idx, word, start_ms, start_ms + 400 AS end_ms FROM (
    SELECT video_id, word_idx, word, CAST(coalesce(sum(400 + 100 * (length(word) % 7)) OVER (
      PARTITION BY video_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms
    FROM (SELECT doc_id AS video_id, k AS word_idx, t[k + 1] AS word
      FROM (SELECT doc_id, t, unnest(range(len(t))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^ \n]+') AS t FROM documents)))))"""


def channel_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel_id, video_id, title, views, uploaded: views below 1000 count as none."""
    views = F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("channel_id"),
        F.col("o_orderkey").alias("video_id"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"),
        F.when(views % 17 == 0, 0).otherwise(views).alias("views"),
        F.col("o_orderdate").alias("uploaded"),
    )


CHANNEL = """channel_videos AS (
  SELECT o_custkey AS channel_id, o_orderkey AS video_id, o_orderpriority || ' ' || o_orderstatus AS title,
    CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 17 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS views, o_orderdate AS uploaded FROM orders)"""


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """channel_id, pos, video_id, views, name"""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("channel_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("video_id"),
        F.floor("l_extendedprice").cast("long").alias("views"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("name"),
    )


HITS = """search_hits AS (
  SELECT l_suppkey AS channel_id, l_orderkey * 10 + l_linenumber AS pos, CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS video_id,
    CAST(floor(l_extendedprice) AS BIGINT) AS views, l_returnflag || ' ' || l_linestatus AS name FROM lineitem)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, hop, db10 (tenths of a decibel)"""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), (F.row_number().over(own) - 1).cast("long").alias("hop"), F.round(F.col("value") * 10).cast("long").alias("db10")
    )


LEVELS = """levels AS (
  SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS hop, CAST(round(value * 10) AS BIGINT) AS db10 FROM events)"""


def frame_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t_ms, diff10"""
    return levels(spark, sf_dir).select("video_id", (F.col("hop") * 150).alias("t_ms"), F.col("db10").alias("diff10"))


def silence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, ts_ms, kind, seq"""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "end")
    return (
        table(spark, sf_dir, "events")
        .filter("event_type IN ('view', 'click')")
        .select(F.col("user_id").alias("video_id"), F.row_number().over(own).cast("long").alias("seq"), kind.alias("kind"))
        .withColumn("ts_ms", F.col("seq") * 700 + F.col("seq") % 3 * 100)
    )


SILENCE = """silence_events AS (
  SELECT video_id, seq, kind, seq * 700 + seq % 3 * 100 AS ts_ms FROM (
    SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
      CASE event_type WHEN 'view' THEN 'start' ELSE 'end' END AS kind FROM events WHERE event_type IN ('view', 'click')))"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, status, ts"""
    status = F.when(F.col("event_type") == "signup", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), "ts", "event_id").filter("status IS NOT NULL")


JOBS = """job_events AS (
  SELECT user_id AS job_id, CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, ts, event_id
  FROM events WHERE event_type IN ('signup', 'purchase', 'error'))"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, t, x, y, w, h: boxes of one scene"""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scene"),
        (F.col("l_linenumber") % 3).cast("long").alias("t"),
        F.col("l_linenumber").cast("long").alias("box"),
        (F.floor("l_extendedprice").cast("long") % 1500).alias("x"),
        (F.col("l_quantity").cast("long") * 4 + 20).alias("w"),
        (F.col("l_quantity").cast("long") * 5 + 20).alias("h"),
    )


DETECTIONS = """detections AS (
  SELECT l_orderkey AS scene, CAST(l_linenumber % 3 AS BIGINT) AS t, CAST(l_linenumber AS BIGINT) AS box, CAST(floor(l_extendedprice) AS BIGINT) % 1500 AS x,
    CAST(l_quantity AS BIGINT) * 4 + 20 AS w, CAST(l_quantity AS BIGINT) * 5 + 20 AS h FROM lineitem)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, video_id, title, text, niche, source, start_ms, end_ms, virality (tenths), rubric (tenths)"""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("clip_id"),
        F.floor(F.col("doc_id") / 8).alias("video_id"),
        F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("title"),
        "text",
        F.when(F.col("toxic") == 1, "drama").otherwise(F.col("lang")).alias("niche"),
        F.when(F.col("quality") == 1, "full_transcript").otherwise("unknown").alias("source"),
        (F.col("doc_id") * 7919 % 600 * 1000).alias("start_ms"),
        (F.col("doc_id") * 7919 % 600 * 1000 + 20000 + F.col("doc_id") % 30 * 1000).alias("end_ms"),
        (F.col("n_chars") % 31).alias("virality"),
        (F.col("n_chars") % 101).alias("rubric"),
    )


CLIPS = """clips AS (
  SELECT d.doc_id AS clip_id, d.doc_id // 8 AS video_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS title, text,
    CASE WHEN toxic = 1 THEN 'drama' ELSE lang END AS niche, CASE WHEN quality = 1 THEN 'full_transcript' ELSE 'unknown' END AS source,
    d.doc_id * 7919 % 600 * 1000 AS start_ms, d.doc_id * 7919 % 600 * 1000 + 20000 + d.doc_id % 30 * 1000 AS end_ms,
    n_chars % 31 AS virality, n_chars % 101 AS rubric FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
