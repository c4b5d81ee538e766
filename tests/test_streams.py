"""The four jobs as streams: files come one by one, the watermark passes, results equal the batch twins'."""

import datetime as dt

from pyspark.sql import functions as F

from cuecraft.streaming import jobs

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def streamed(spark, tmp_path, name, batches, schema, job):
    """All rows that a stream over the batches, one file each, has put out."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"b={k}"))
        path = next((tmp_path / name / f"b={k}").glob("*.parquet"))
        target = tmp_path / f"{name}-in" / f"{k:03d}.parquet"
        target.parent.mkdir(exist_ok=True)
        path.rename(target)
        import os

        os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}-in"))
    query = job(rows).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


def test_publications_per_window(spark, tmp_path):
    schema = "niche string, source string, filename string, title string, published_at timestamp"
    first = [("a", "x", "f", "t1", at(10)), ("a", "x", "f", "t1", at(900)), ("a", "x", "g", "t1", at(900)), ("a", "x", "f", "t2", at(1200)), ("b", "x", "f", "t3", at(4000)), ("b", "x", "f", None, at(4000)), ("b", "x", "f", None, at(4001))]
    second = [("a", "x", "f", "t4", at(3700)), ("a", "x", "f", "t2", at(1300))]
    late = [("a", "x", "f", "t9", at(30))]  # behind the watermark by then: dropped
    got = streamed(spark, tmp_path, "publications", [first, second, [("z", "z", "f", "z", at(90000))], [("z", "z", "f", "w", at(95000))], late, [("z", "z", "f", "y", at(190000))]], schema, jobs.publications_per_window)
    batch = jobs.publications_per_window(spark.createDataFrame(first + second, schema)).collect()
    assert {tuple(r) for r in got if r.niche != "z"} == {tuple(r) for r in batch}


def test_a_title_of_another_month_is_a_publication_of_its_own(spark):
    schema = "niche string, source string, filename string, title string, published_at timestamp"
    month = 30 * 86400
    rows = [("a", "x", "f", "t", at(s)) for s in (0, 7199, 7200, 9000, month, month + 60)] + [("a", "x", "other", "t", at(60))]
    got = sorted((r.window_start, r.n) for r in jobs.publications_per_window(spark.createDataFrame(rows, schema)).collect())
    assert got == [(at(0), 2), (at(7200), 1), (at(month), 1)]


def test_stuck_jobs(spark, tmp_path):
    jobs.use_rocksdb(spark)
    schema = "job_id long, status string, ts timestamp"
    batches = [
        [(1, "running", at(0)), (2, "running", at(5)), (3, "running", at(10))], [(2, "completed", at(600)), (3, "running", at(3000))], [(9, "running", at(8300))], [(3, "completed", at(9000))], [(9, "completed", at(20000))], [(9, "running", at(40000))],
    ]
    got = streamed(spark, tmp_path, "stuck", batches, schema, jobs.stuck_jobs_stream)
    changes = {}
    for r in sorted(got, key=lambda r: r.at):
        changes.setdefault(r.job_id, []).append((r.status, int((r.at - START).total_seconds())))
    assert changes[1] == [("running", 0), ("failed", 7200), ("evicted", 10800)]
    assert changes[2] == [("running", 5), ("completed", 600), ("evicted", 4200)]
    assert changes[3] == [("running", 10), ("completed", 9000), ("evicted", 12600)]


def test_stuck_jobs_restart_and_begin_with_what_a_batch_knows(spark, tmp_path):
    schema = "job_id long, status string, ts timestamp, event_id long"
    known = spark.createDataFrame([(1, "running", at(0)), (2, "completed", at(0)), (3, "running", at(5000))], "job_id long, status string, ts timestamp")
    jobs.use_rocksdb(spark)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = jobs.stuck_jobs_stream(events, late="0 seconds", known=known).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return sorted((r.job_id, r.status, int((r.at - START).total_seconds())) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run([(4, "running", at(6000), 1), (4, "running", at(6000), 0), (5, "completed", at(7200), 3), (5, "running", at(7200), 2)])
    assert first == [(2, "evicted", 3600), (4, "running", 6000), (5, "completed", 7200), (5, "running", 7200)]
    second = run([(6, "running", at(7201), 4)])  # a second past two hours: the first job is stuck, and only now
    assert sorted(set(second) - set(first)) == [(1, "failed", 7200), (6, "running", 7201)]
    third = run([(1, "completed", at(9000), 5), (6, "running", at(12300), 6)])  # it did end after all, the third is stuck
    assert sorted(set(third) - set(second)) == [(1, "completed", 9000), (3, "failed", 12200), (5, "evicted", 10800)]


def test_live_windows_have_their_text_in_order(spark, tmp_path):
    schema = "video_id long, cue_idx int, n_tok long, text string, ts timestamp"
    rows = [(1, k, 2, f"why {k}\nnow", at(9 * k)) for k in range(14)]
    late = [rows[k] for k in (0, 2, 4, 6, 8, 10, 12)]
    got = streamed(spark, tmp_path, "live", [late, [r for r in rows if r not in late], [(9, 0, 1, "x", at(99999))], [(9, 1, 1, "x", at(199999))]], schema, lambda r: jobs.cue_windows(r, late="3 minutes"))
    batch = jobs.cue_windows(spark.createDataFrame(rows, schema)).collect()
    assert {(r.window_start, r.text, r.score) for r in got if r.video_id == 1} == {(r.window_start, r.text, r.score) for r in batch}
    whole = {r.window_start: r.text for r in batch}
    assert whole[at(0)] == " ".join(f"why {k} now" for k in range(7)) and whole[at(20)] == " ".join(f"why {k} now" for k in range(3, 9))


def test_cue_windows(spark, tmp_path):
    schema = "video_id long, n_tok long, ts timestamp"
    rows = [(v, 3 + k, at(7 * k + v)) for v in (1, 2) for k in range(20)]
    got = streamed(spark, tmp_path, "cues", [rows[::2], rows[1::2], [(9, 1, at(99999))], [(9, 1, at(199999))]], schema, jobs.cue_windows)
    batch = jobs.cue_windows(spark.createDataFrame(rows, schema)).collect()
    assert {tuple(r) for r in got if r.video_id != 9} == {tuple(r) for r in batch}


def test_speech_sessions(spark, tmp_path):
    schema = "video_id long, ts timestamp"
    rows = [(1, at(s)) for s in (0, 0.5, 1.2, 4, 4.5, 9)] + [(2, at(s)) for s in (1, 3)]
    got = streamed(spark, tmp_path, "speech", [rows[:4], rows[4:], [(9, at(99999))], [(9, at(199999))]], schema, jobs.speech_sessions)
    batch = jobs.speech_sessions(spark.createDataFrame(rows, schema)).collect()
    assert {tuple(r) for r in got if r.video_id != 9} == {tuple(r) for r in batch}


def test_batch_twin_of_stuck_jobs(spark):
    rows = [(1, "running", at(0), 1), (2, "completed", at(5000), 2), (3, "running", at(9000), 3), (4, "completed", at(100), 4)]
    got = dict(jobs.stuck_jobs(spark.createDataFrame(rows, "job_id long, status string, ts timestamp, event_id long")).collect())
    assert got == {1: "failed", 3: "running"}
    assert jobs.stuck_jobs(spark.createDataFrame(rows, "job_id long, status string, ts timestamp, event_id long").filter(F.lit(False))).count() == 0
