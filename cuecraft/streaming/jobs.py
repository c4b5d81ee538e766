"""Jobs that run over streams and, as they are, over tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuecraft.functions.scoring import heuristic_score
from cuecraft.operators import greedy

#: The state store that processors with timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _seconds(span: str) -> int:
    n, unit = span.split()
    return int(n) * _UNITS[unit.removesuffix("s")]


def publications_per_window(log: DataFrame, late: str = "2 hours", size: str = "1 hour") -> DataFrame:
    """Publications per window, niche and source; one of the same source, filename and title within ``late`` of another is the same.

    On a stream rows later than ``late`` are dropped and repeats are known for at least that time; over a table, a
    publication that repeats after ``late`` or more is a new one, as on a stream that has moved on by then. Null keys are keys.
    """
    keys = ["source", "filename", "title"]
    if log.isStreaming:
        rows = log.withWatermark("published_at", late).dropDuplicatesWithinWatermark(keys)
    else:
        keyed = log.select(F.struct(*keys).alias("video_id"), F.unix_millis(F.col("published_at").cast("timestamp")).alias("at"), "niche")
        first = greedy.spaced(keyed, "at", _seconds(late) * 1000)
        niches = keyed.groupBy("video_id", "at").agg(F.min("niche").alias("niche"))
        rows = first.withColumnRenamed("t", "at").join(niches, ["video_id", "at"]).select("niche", "video_id.source", F.timestamp_millis("at").alias("published_at"))
    counts = rows.groupBy(F.window("published_at", size), "niche", "source").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "niche", "source", "n")


def stuck_jobs(events: DataFrame, stuck_s: int = 7200, keep_s: int = 3600) -> DataFrame:
    """Last status of each job (job_id, status, ts, event_id): failed if it ran too long, gone if it ended long ago."""
    last = events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"))
    now = events.agg(F.max("ts").alias("now")).scalar()
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    rows = last.withColumn("age", seconds(now) - seconds(F.col("ts")))
    stuck = (F.col("status") == "running") & (F.col("age") > stuck_s)
    return rows.filter(~((F.col("status") != "running") & (F.col("age") > keep_s))).select("job_id", F.when(stuck, "failed").otherwise(F.col("status")).alias("status"))


class JobWatch(StatefulProcessor):
    """Follows each job: its last status and time are state, one timer of event time is set by them."""

    def __init__(self, stuck_s: int, keep_s: int, evict_stuck: bool):
        self.stuck_ms, self.keep_ms, self.evict_stuck = stuck_s * 1000, keep_s * 1000, evict_stuck

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, at long, stuck boolean")

    def _set(self, status: str, at: int, stuck: bool = False) -> None:
        self.job.update((status, at, stuck))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if not stuck or self.evict_stuck:
            self.handle.registerTimer(at + (self.stuck_ms if status == "running" else self.keep_ms) + 1)  # later than due, not when it is

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._set(initialState.status, initialState.at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, at, stuck = self.job.get() if self.job.exists() else (None, None, False)
        changed = False
        for moment, _, new in sorted((r.at, r.event_id, r.status) for r in rows):
            if at is None or moment >= at:
                if new != status or stuck:
                    yield Row(job_id=key[0], status=new, at=moment)
                status, at, stuck, changed = new, moment, False, True
        if changed:
            self._set(status, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.job.exists():
            return
        status, at, stuck = self.job.get()
        due = at + (self.stuck_ms if status == "running" else self.keep_ms)
        if due >= expiredTimerInfo.getExpiryTimeInMs():
            return
        if status == "running":
            self._set("failed", due, True)
            yield Row(job_id=key[0], status="failed", at=due)
        else:
            self.job.clear()
            yield Row(job_id=key[0], status="evicted", at=due)

    def close(self) -> None: ...


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the session's state store, from its next streaming query on, to the one that ``stuck_jobs_stream`` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stuck_jobs_stream(events: DataFrame, stuck_s: int = 7200, keep_s: int = 3600, late: str = "10 minutes", known: DataFrame | None = None, evict_stuck: bool = True) -> DataFrame:
    """Changes (job_id, status, at) of jobs on a stream of events (job_id, status, ts, and event_id if there is one).

    A job that runs for more than ``stuck_s`` without news is failed, one that ended more than ``keep_s`` ago is evicted with
    its state, those that were failed here too unless ``evict_stuck`` is False. ``known`` (job_id, status, ts) are jobs that a batch
    already knows, the state to begin with. Of events of one time the highest event_id counts last. The session
    needs ``use_rocksdb``.
    """
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    order = F.col("event_id").cast("long") if "event_id" in events.columns else F.lit(0).cast("long")
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("job_id", "status", "ts", at.alias("at"), F.coalesce(order, F.lit(-1).cast("long")).alias("event_id"))
    begin = None if known is None else known.select("job_id", "status", at.alias("at")).groupBy("job_id")
    watch = JobWatch(stuck_s, keep_s, evict_stuck)
    changes = rows.groupBy("job_id").transformWithState(watch, "job_id long, status string, at long", "Append", "EventTime", initialState=begin)
    return changes.select("job_id", "status", F.timestamp_millis("at").alias("at"))


def _window_text(place: list[Column]) -> Column:
    item = F.struct(*place, F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), " ")


def cue_windows(cues: DataFrame, size: str = "58 seconds", step: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """Sliding windows of live captions (video_id, ts, n_tok, text, and cue_idx if there is one): cues, words, text and its offline scores.

    A window's texts are kept in its state and put in the order of their times when it closes, so cues that come late, but within
    ``late``, stand in their place. A window holds what ``size`` of speech has. Without a text column there is neither text nor score.
    """
    rows = cues.withWatermark("ts", late) if cues.isStreaming else cues
    counts = [F.count(F.lit(1)).alias("cues"), F.sum("n_tok").alias("words")]
    if "text" in cues.columns:
        place = [F.col("ts"), *([F.col("cue_idx")] if "cue_idx" in cues.columns else [])]
        counts.append(_window_text(place).alias("text"))
    grouped = rows.groupBy("video_id", F.window("ts", size, step)).agg(*counts)
    found = grouped.select("video_id", F.col("window.start").alias("window_start"), "cues", "words", *(["text"] if "text" in cues.columns else []))
    return found.withColumn("score", heuristic_score(F.col("text"))) if "text" in cues.columns else found


def speech_sessions(words: DataFrame, gap: str = "900 milliseconds", late: str = "1 minute") -> DataFrame:
    """Sessions of speech (video_id, ts): a new one after a pause."""
    if not words.isStreaming:  # a video's words in their order: each knows by the one before it whether it begins a session
        own = Window.partitionBy("video_id").orderBy("ts")
        begins = F.coalesce(F.col("ts") > F.lag("ts").over(own) + F.expr(f"INTERVAL {gap}"), F.lit(True))
        rows = words.filter("ts IS NOT NULL").select("video_id", "ts", begins.cast("int").alias("begins"))
        rows = rows.select("video_id", "ts", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("k"))
        grouped = rows.groupBy("video_id", "k").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("words"))
        return grouped.select("video_id", F.unix_millis("start").alias("start_ms"), "words")
    grouped = words.withWatermark("ts", late).groupBy("video_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("words"))
    return grouped.select("video_id", F.unix_millis("session_window.start").alias("start_ms"), "words")
