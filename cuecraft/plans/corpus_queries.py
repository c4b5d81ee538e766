"""Queries of update jobs, scoring by answers, the publication log and its streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuecraft.operators import answers, backfill, corpus
from cuecraft.plans import bindings as b
from cuecraft.plans import sequence_queries as S
from cuecraft.plans.registry import query
from cuecraft.sources import captions, folders
from cuecraft.sources.shared import shared_path
from cuecraft.streaming import jobs

_CONTEXT = "x AS (SELECT video_id, arg_max(niche, clip_id) AS context FROM clips WHERE clip_id % 3 = 0 GROUP BY 1)"
_PLAN = f"""{b.CLIPS}, {_CONTEXT}, p AS (SELECT clip_id, CASE WHEN source = 'full_transcript' THEN 'untouched' WHEN context IS NULL THEN 'no_context' WHEN niche = context THEN 'unchanged'
  WHEN source = 'unknown' THEN 'kept_niche' ELSE 'updated' END AS outcome, niche FROM clips LEFT JOIN x USING (video_id))"""


def _contexts(rows):
    return rows.filter("clip_id % 3 = 0").groupBy("video_id").agg(F.max_by("niche", "clip_id").alias("niche"))


@query("backfill_titles", f"WITH {_PLAN} SELECT clip_id, outcome, niche FROM p")
def _backfill(spark, sf):
    rows = b.clips(spark, sf)
    return corpus.backfill_plan(rows, _contexts(rows)).select("clip_id", "outcome", "niche")


@query("backfill_summary", f"WITH {_PLAN} SELECT outcome, count(*) AS n FROM p GROUP BY 1")
def _summary(spark, sf):
    rows = b.clips(spark, sf)
    return corpus.outcome_summary(corpus.backfill_plan(rows, _contexts(rows)))


@query("reconcile_context", f"WITH {b.CLIPS}, {_CONTEXT} SELECT clip_id, CASE WHEN source = 'full_transcript' OR context IS NULL THEN niche ELSE context END AS niche, coalesce(context || '!', '') AS topic FROM clips LEFT JOIN x USING (video_id)")
def _reconcile(spark, sf):
    rows = b.clips(spark, sf)
    contexts = _contexts(rows).withColumn("topic", F.concat("niche", F.lit("!")))
    return corpus.reconcile_plan(rows, contexts).select("clip_id", "niche", "topic")


@query("timing_guard", f"WITH {b.CLIPS}, t AS (SELECT clip_id, CASE WHEN clip_id % 4 > 0 THEN start_ms END AS a, CASE WHEN clip_id % 8 > 0 THEN start_ms END AS s, CASE WHEN clip_id % 9 > 0 THEN end_ms ELSE 0 END AS e FROM clips) SELECT clip_id, coalesce(a, s) AS from_time, CASE WHEN coalesce(a, s) IS NULL THEN 'no_start' WHEN e <= coalesce(a, s) THEN 'bad_range' END AS reject_reason FROM t")
def _guard(spark, sf):
    k = F.col("clip_id")
    rows = b.clips(spark, sf).select("clip_id", F.when(k % 4 > 0, F.col("start_ms")).alias("start_time"), F.when(k % 8 > 0, F.col("start_ms")).alias("start"), F.when(k % 9 > 0, F.col("end_ms")).otherwise(0).alias("end_time"))
    return corpus.timing_guard(rows).select("clip_id", "from_time", "reject_reason")


@query("fresh_skip", "SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-02 00:00:00') - floor(epoch(ts)) >= 1800")
def _fresh(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", F.col("ts").alias("rendered_at"))
    return corpus.fresh_skip(rows, F.lit("2024-01-02 00:00:00").cast("timestamp")).select("event_id")


_ANSWERS = """w AS (SELECT o_custkey AS video_id, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) % 31 / 10.0::DOUBLE AS fallback, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 31 / 10.0::DOUBLE END AS answer FROM orders),
p AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY k) - 1) // 5 AS pack FROM w), q AS (SELECT *, count(*) FILTER (answer IS NULL) OVER (PARTITION BY video_id, pack) AS missing FROM p)"""


@query("answers_join", f"""WITH {_ANSWERS} SELECT video_id, k AS "window", pack, CASE WHEN missing = 0 THEN answer ELSE fallback END AS virality, CASE WHEN missing = 0 THEN 'model' ELSE 'local_heuristic' END AS score_source, missing > 0 AS score_failed FROM q""")
def _answers(spark, sf):
    o, k = b.table(spark, sf, "orders"), F.col("o_orderkey")
    windows = o.select(F.col("o_custkey").alias("video_id"), k.alias("window"), (F.floor("o_totalprice").cast("long") % 31 / 10.0).alias("fallback"))
    return answers.answers_join(windows, o.select(F.col("o_custkey").alias("video_id"), k.alias("window"), F.when(k % 13 != 0, k % 31 / 10.0).alias("virality")))


_SCORES = f"""{b.CUES}, a AS (SELECT video_id, cue_idx::BIGINT AS k, n_tok, text, CASE WHEN n_tok % 13 <> 0 THEN least(3.0::DOUBLE, len(regexp_extract_all(text, '[aeiou]')) / length(text)::DOUBLE * 6) END AS answer FROM cues),
p AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY k) - 1) // 5 AS pack FROM a), q AS (SELECT *, count(*) FILTER (answer IS NULL) OVER (PARTITION BY video_id, pack) AS missing FROM p),
o AS (SELECT *, CASE WHEN missing = 0 THEN 1 WHEN k % 3 > 0 THEN 2 ELSE 3 END AS tier FROM q), w AS (SELECT video_id, k AS win, 0 AS start_ms, 0 AS end_ms, text FROM o WHERE tier = 3)"""
_TIERS = f"WITH {S.scored_sql(_SCORES)}, z AS (SELECT o.*, CASE tier WHEN 1 THEN answer WHEN 2 THEN n_tok % 31 / 10.0::DOUBLE ELSE s.virality END AS virality, CASE tier WHEN 1 THEN 'model' WHEN 2 THEN 'model_single' ELSE 'local_heuristic' END AS score_source FROM o LEFT JOIN s ON s.video_id = o.video_id AND s.win = o.k)"


def _scored(spark, sf):
    """A callable that weighs vowels and gives no answer now and then, so that whole packs fail, and one for single windows, which fails for one in three."""

    def scorer(batches):
        for rows in batches:
            share = rows["text"].str.count("[aeiou]") / rows["text"].str.len() * 6
            words = rows["text"].str.count(r"[^ \n]+")
            yield rows[["video_id", "window"]].assign(virality=share.clip(upper=3.0).where(words % 13 != 0))

    def single(batches):
        for rows in batches:
            answers = rows[["video_id", "window"]].assign(virality=rows["text"].str.count(r"[^ \n]+") % 31 / 10)
            yield answers[rows["window"] % 3 > 0]

    return answers.score_windows(b.cues(spark, sf).select("video_id", F.col("cue_idx").cast("long").alias("window"), "text"), scorer, single)


@query("score_windows", f'{_TIERS} SELECT video_id, k AS "window", pack, virality, tier, score_source, tier = 3 AS score_failed FROM z')
def _score(spark, sf):
    return _scored(spark, sf)


@query("score_tiers", f"{_TIERS} SELECT tier, score_source, count(*) AS n FROM z GROUP BY 1, 2")
def _tiers(spark, sf):
    return answers.tier_counts(_scored(spark, sf))


_STORED = f"""{b.CLIPS}, x AS (SELECT video_id, arg_max(niche, clip_id) AS derived FROM clips WHERE clip_id % 3 = 0 GROUP BY 1), st AS (SELECT clip_id, video_id, CASE WHEN clip_id % 17 = 0 THEN ' ' ELSE text END AS text, niche, CASE WHEN clip_id % 2 = 0 THEN niche || ' topic' END AS seo_topic,
  CASE source WHEN 'full_transcript' THEN source ELSE CASE WHEN clip_id % 5 > 0 THEN 'snippet_union' END END AS src FROM clips),
pl AS (SELECT *, CASE WHEN src = 'full_transcript' THEN 'skipped_full_transcript' WHEN trim(coalesce(text, '')) = '' THEN 'skipped_no_transcript' WHEN derived IS NULL THEN 'skipped_no_context' END AS skip FROM st LEFT JOIN x USING (video_id)),
ou AS (SELECT *, coalesce(skip, CASE WHEN clip_id % 11 = 0 OR clip_id % 9 = 0 THEN 'rejected_by_gate' ELSE 'updated' END) AS outcome, skip IS NULL AND src IS NULL AND NOT (niche = derived AND seo_topic IS NOT DISTINCT FROM derived || ' topic') AS unknown FROM pl),
ch AS (SELECT *, outcome = 'updated' OR (skip IS NULL AND NOT unknown AND (niche <> derived OR seo_topic IS DISTINCT FROM derived || ' topic' OR src IS NULL)) AS changes FROM ou),
cn AS (SELECT {', '.join(f"count(*) FILTER (outcome = '{c}') AS {c}" for c in ("updated", "skipped_no_transcript", "skipped_no_context", "skipped_full_transcript", "rejected_by_gate"))}, count(*) AS total, count(*) FILTER (changes) AS would_change,
  count(*) FILTER (unknown) AS skipped_unknown_provenance, count(*) FILTER (skip IS NULL AND clip_id % 9 = 0) AS failed FROM ch)"""
_RUNS = " UNION ALL ".join(f"SELECT '{run}' AS run, '{c}' AS counter, {dict(changed=dict(dry='0', first='would_change', second='0')[run], would_change='would_change' if run != 'second' else '0').get(c, c)} AS n FROM cn" for run in ("dry", "first", "second") for c in backfill.COUNTERS)


@query("backfill_job", f"WITH {_STORED} {_RUNS}")
def _backfill_job(spark, sf):
    """A stored corpus: a dry run, a run, and a second run, which changes nothing. One title in eleven fails the gate, one in nine can't be made."""
    k = F.col("clip_id")
    source = F.when(F.col("source") == "full_transcript", F.col("source")).when(k % 5 > 0, "snippet_union")
    rows = b.clips(spark, sf).select(
        "clip_id", "video_id", F.when(k % 17 == 0, " ").otherwise(F.col("text")).alias("text"), "niche", F.when(k % 2 == 0, F.concat("niche", F.lit(" topic"))).alias("seo_topic"), source.alias("seo_topic_source"),
        F.lit("Old Title Of This").alias("suggested_title"), F.array(F.lit("#old")).alias("suggested_hashtags"),
    )
    path = shared_path(spark, "corpus")
    backfill.store(rows, path, parts=16)
    # the contexts come from niches that the job does not write back: those of the clips as they were
    known = _contexts(b.clips(spark, sf)).select("video_id", "niche", F.array(F.concat("niche", F.lit(" topic"))).alias("topics"))

    def titles(clips, contexts):
        title = F.when(k % 9 == 0, None).when(k % 11 == 0, "too short").otherwise(F.concat(F.lit("A Title For Clip "), k.cast("string")))
        return clips.select("clip_id", title.alias("title"), F.array(F.lit("#new")).alias("hashtags"))

    made = []
    for run in ("dry", "first", "second"):
        found = backfill.backfill(spark, path, lambda clips: known, titles, dry_run=run == "dry", log=f"{path}-log", run=run)
        made.append(found.select(F.lit(run).alias("run"), "counter", "n"))
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("upload_plan", f"""WITH {b.CLIPS} SELECT clip_id, platform, CASE platform WHEN 'youtube' THEN 'native' WHEN 'tiktok' THEN 'aggregator' ELSE 'rejected' END AS route, substr(title, 1, 100) AS title, [niche, 'fyp'] AS tags,
CASE WHEN clip_id % 2 = 0 THEN 'private' ELSE 'public' END AS privacy FROM clips, (VALUES ('youtube'), ('tiktok'), ('fax')) AS p(platform)""")
def _plan(spark, sf):
    rows = b.clips(spark, sf).select("clip_id", "title", F.array(F.concat(F.lit("#"), "niche"), F.lit("#fyp")).alias("tags"), (F.col("clip_id") % 2 == 0).alias("scheduled"))
    return answers.upload_plan(rows, ["youtube", "tiktok", "fax"])


_LOG = f"{b.CLIPS}, l AS (SELECT clip_id, source, niche, title, TIMESTAMP '2024-01-01' + to_seconds(clip_id * 37 % 86400) AS published_at FROM clips)"


def _log(spark, sf):
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("clip_id") * 37 % 86400)
    return b.clips(spark, sf).select("clip_id", "source", "niche", "title", at.alias("published_at"))


_FILED = f"{_LOG}, k AS (SELECT niche, source, 'take_' || (clip_id % 50) AS filename, title, epoch_ms(published_at) AS t FROM l)"


@query(
    "L1_publog_stream",
    f"""WITH RECURSIVE {_FILED}, r(source, filename, title, t) AS (SELECT source, filename, title, min(t) FROM k GROUP BY 1, 2, 3 UNION ALL
SELECT source, filename, title, (SELECT min(k.t) FROM k WHERE k.source = r.source AND k.filename = r.filename AND k.title IS NOT DISTINCT FROM r.title AND k.t >= r.t + 7200000) FROM r WHERE t IS NOT NULL),
n AS (SELECT source, filename, title, t, min(niche) AS niche FROM k GROUP BY 1, 2, 3, 4), d AS (SELECT r.source, n.niche, r.t FROM r JOIN n ON n.source = r.source AND n.filename = r.filename AND n.title IS NOT DISTINCT FROM r.title AND n.t = r.t)
SELECT time_bucket(INTERVAL 1 HOUR, make_timestamp(t * 1000)) AS window_start, niche, source, count(*) AS n FROM d GROUP BY 1, 2, 3""",
)
def _l1(spark, sf):
    return jobs.publications_per_window(_log(spark, sf).withColumn("filename", F.concat(F.lit("take_"), (F.col("clip_id") % 50).cast("string"))))


@query("L2_stuck_jobs", f"WITH {b.JOBS}, l AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM job_events GROUP BY 1), n AS (SELECT max(ts) AS now FROM job_events) SELECT job_id, CASE WHEN status = 'running' AND epoch(now) - epoch(ts) > 7200 THEN 'failed' ELSE status END AS status FROM l, n WHERE NOT (status <> 'running' AND epoch(now) - epoch(ts) > 3600)")
def _l2(spark, sf):
    """A batch knows the first third of the time; the rest comes as files in two runs of one stream, the second from the first one's checkpoint."""
    events = b.job_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    path, third = shared_path(spark, "job-stream"), (high - low) / 3
    between = lambda k: events.filter((F.col("ts") >= F.lit(low + k * third)) & ((F.col("ts") < F.lit(low + (k + 1) * third)) if k < 2 else F.lit(True)))
    known = between(0).groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))
    jobs.use_rocksdb(spark)
    for k in (1, 2):
        between(k).write.mode("append").parquet(f"{path}/in")
        rows = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        changes = jobs.stuck_jobs_stream(rows, late="0 seconds", known=known, evict_stuck=False)
        run = changes.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    told = spark.read.schema("job_id long, status string, at timestamp").parquet(f"{path}/out")
    told = told.withColumn("k", F.when(F.col("status") == "evicted", 2).when(F.col("status") == "failed", 1).otherwise(0))
    every = known.select("job_id", "status", F.col("ts").alias("at"), F.lit(-1).alias("k")).unionByName(told)
    last = every.groupBy("job_id").agg(F.max_by("status", F.struct("at", "k")).alias("status"))
    return last.filter("status <> 'evicted'")


_LIVE = f"""{b.CUES}, h AS (SELECT video_id, n_tok, cue_idx, trim(replace(text, chr(10), ' ')) AS text, unnest([start_ms // 20000 * 20000, start_ms // 20000 * 20000 - 20000, start_ms // 20000 * 20000 - 40000]) AS s, start_ms FROM cues),
w AS (SELECT video_id, s AS win, s AS start_ms, s AS end_ms, count(*) AS cues, sum(n_tok)::BIGINT AS words, string_agg(text, ' ' ORDER BY start_ms, cue_idx) AS text FROM h WHERE start_ms < s + 58000 GROUP BY 1, 2)"""


@query("L3_cue_windows", f"WITH {S.scored_sql(_LIVE)} SELECT video_id, make_timestamp(win * 1000) AS window_start, cues, words, sha256(text) AS text_sha256, virality AS virality_score, sponsor AS sponsor_prob, category, score AS composite_score FROM s JOIN w USING (video_id, win)")
def _l3(spark, sf):
    found = jobs.cue_windows(b.cues(spark, sf).withColumn("ts", F.timestamp_millis("start_ms")))
    return found.select("video_id", "window_start", "cues", "words", F.sha2("text", 256).alias("text_sha256"), "score.virality_score", "score.sponsor_prob", "score.category", "score.composite_score")


@query("L4_session_phrases", f"WITH {b.WORDS}, g AS (SELECT *, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY video_id ORDER BY word_idx) <= 900 THEN 0 ELSE 1 END AS n FROM words), s AS (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY word_idx) AS k FROM g) SELECT video_id, min(start_ms) AS start_ms, count(*) AS words FROM s GROUP BY video_id, k")
def _l4(spark, sf):
    return jobs.speech_sessions(b.words(spark, sf).withColumn("ts", F.timestamp_millis("start_ms")))


def _files(spark, sf, kind):
    return captions.as_files(b.cues(spark, sf), kind)


_BACK = f"WITH {b.CUES} SELECT video_id, start_ms, dur_ms, trim(regexp_replace(text, '[ \\n]+', ' ', 'g')) AS text FROM cues"
for _kind in ("json3", "vtt", "xml", "auto"):
    query(f"src_caption_{_kind}", _BACK)(lambda spark, sf, k=_kind: captions.read(_files(spark, sf, k)).select("video_id", "start_ms", "dur_ms", "text"))


def _folder(spark, sf):
    """A folder of caption files of all formats, one a video: of eleven one is empty and one has a broken head, which ruins JSON alone."""
    k = F.col("video_id")
    broken = F.when(k % 11 == 0, F.lit(" \n")).when(k % 11 == 1, F.concat(F.lit("{broken "), "content")).otherwise(F.col("content"))
    path = shared_path(spark, "caption-folder")
    files = _files(spark, sf, "auto").select(F.concat(k.cast("string"), F.lit(".en.sub")).alias("name"), broken.alias("content"))
    folders.register(spark)
    files.write.format("cuecraft_files").mode("append").save(path)
    return captions.caption_folder(spark, path).withColumn("video_id", F.col("video_id").cast("long"))


@query("src_caption_folder", f"{_BACK} WHERE video_id % 11 > 1 OR video_id % 11 = 1 AND video_id % 3 > 0")
def _caption_folder(spark, sf):
    return captions.read(_folder(spark, sf))


@query("src_caption_errors", f"WITH {b.CUES} SELECT DISTINCT video_id, CASE WHEN video_id % 11 = 0 THEN 'empty' ELSE 'no cues' END AS error FROM cues WHERE video_id % 11 = 0 OR video_id % 11 = 1 AND video_id % 3 = 0")
def _caption_errors(spark, sf):
    """The files of that folder from which no cue comes."""
    return captions.trouble(_folder(spark, sf)).filter("error IS NOT NULL").select("video_id", "error")
