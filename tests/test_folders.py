"""Folders and logs as data sources: broken input, retries, failures, streams that restart."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cuecraft.sources import captions, folders, publog

VTT = "WEBVTT\n\n00:01.000 --> 00:02.500 align:start\n<c>Hi</c> there\nmore\n\n00:03.000 --> 00:02.50\nno such time\n"
FILES = {
    "a.en.vtt": VTT,
    "b.json3": '{"events": [{"tStartMs": 1500, "dDurationMs": 700, "segs": [{"utf8": "x"}]}, {"tStartMs": "z", "segs": [{"utf8": "q"}]}, {"segs": [{"utf8": "no start"}]}, {"tStartMs": 9}]}',
    "c.json3": '{"events": [{"tStartMs": 1500, "segs": [{"utf8": "cut',
    "d.xml": '<t><text start="1.5" dur="2">it&#x27;s caf&#233; &lt;i&gt; <b>&hearts;</b> A&B &bogus;</text><text dur="1">no</text><text start="1.2.3">n</text><text start="7">&#55296;</text></t>',
    "e.json3": '{"none": 1}\n00:01,000 --> 00:01,010\nfalls to the next\n',
    "f.srt": "1\r\n01:00:00,000 --> 01:00:01,000\r\nfirst\r\n2\r\n01:00:02,000 --> 01:00:04,000\r\nsecond\r\n\r\n3\r\n01:00:05,000 --> 01:00:06,000\r\n",
    "g.vtt": "", "h.vtt": " \n\t", "i.txt": "neither of them", "deep/j.vtt": "half 00:01.000 --> 00:02.0", "_hidden/k.vtt": VTT, ".l.vtt": VTT,
}
CUES = [
    ("a", 1000, 1500, "Hi there more"), ("b", 0, 0, "no start"), ("b", 1500, 700, "x"), ("d", 1500, 2000, "it's café <i> ♥ A&B &bogus;"), ("d", 7000, 3000, "�"),
    ("e", 1000, 100, "falls to the next"), ("f", 3600000, 1000, "first"), ("f", 3602000, 2000, "second"),
]


def fill(path, files=FILES):
    for name, content in files.items():
        target = path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content, newline="")


def test_a_folder_of_anything(spark, tmp_path):
    fill(tmp_path)
    (tmp_path / "m.vtt").write_bytes(b"\xff\xfe" + VTT.encode())
    files = captions.caption_folder(spark, str(tmp_path), run_files="3")
    assert files.rdd.getNumPartitions() == 4  # eleven files, three a task
    assert sorted(map(tuple, captions.read(files).collect())) == sorted([*CUES, ("m", 1000, 1500, "Hi there more")])
    assert {r.video_id: r.error for r in captions.trouble(files).collect() if r.error} == {"c": "no cues", "g": "empty", "h": "empty", "i": "no cues", "j": "no cues"}
    gone = list(folders.whole_files(folders.Run([(str(tmp_path / "a.en.vtt"), 1), ("/no/such/file", 1)])))[0].to_pylist()
    assert gone[0]["error"] is None and gone[1]["content"] is None and "FileNotFound" in gone[1]["error"]
    assert captions.caption_folder(spark, str(tmp_path / "nowhere")).count() == 0


def test_files_written_by_rows(spark, tmp_path):
    folders.register(spark)
    rows = [(f"v{k}.vtt", f"text {k}" if k else None) for k in range(9)]
    spark.createDataFrame(rows, "name string, content string").write.format("cuecraft_files").mode("append").save(str(tmp_path))
    got = spark.read.format("cuecraft_files").load(str(tmp_path)).collect()
    assert sorted((r.name, r.content) for r in got) == [(n, c or "") for n, c in rows]


def streamed(spark, tmp_path, name):
    files = captions.caption_folder(spark, str(tmp_path / "in"), seen=str(tmp_path / "seen"), max_files="4")
    query = captions.read(files).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_a_stream_of_files_restarts(spark, tmp_path):
    fill(tmp_path / "in")
    got = streamed(spark, tmp_path, "first")
    for _ in range(4):  # each run takes at most four files more
        got = streamed(spark, tmp_path, "again")
    assert got == CUES
    fill(tmp_path / "in", {"n.vtt": VTT})
    os.utime(tmp_path / "in" / "n.vtt", (1, 1))  # older than all that was read
    assert streamed(spark, tmp_path, "older") == sorted([*CUES, ("n", 1000, 1500, "Hi there more")])
    assert streamed(spark, tmp_path, "nothing new") == sorted([*CUES, ("n", 1000, 1500, "Hi there more")])


# ---------------------------------------------------------------- the publication log

CANDIDATE = "struct<title: string, pattern: string, framework: string, keyword: string>"


def decided(spark):
    made = [("T1", "p1", "f", "k1"), None, ("T2", "p2", "f", None), ("T2", "p3", "f", "late")]
    rows = [("r", 1, "T2", made, 0.5), ("r", 2, "Own \n title", made, None), (None, None, None, [], None), ("r", 4, "T1", None, 0.0), ("r", 4, "T1", None, 0.0)]
    return spark.createDataFrame(rows, f"source string, video_id long, suggested_title string, candidates array<{CANDIDATE}>, virality_score double")


def test_records_have_sixteen_fields(spark):
    got = publog.publication_records(decided(spark), F.lit("2024-05-01 10:00:00").cast("timestamp")).collect()
    assert len(got[0]) == 16 and got[0].event == "title_decided" and got[0].decided_at == "2024-05-01T10:00:00.000000+00:00"
    assert [(r.video_id, r.winning_pattern, r.winning_keyword, r.candidate_count, r.virality_score) for r in got] == [("1", "p2", "", 3, 0.5), ("2", "", "", 3, None), ("", "", "", 0, None), ("4", "", "", 0, 0.0), ("4", "", "", 0, 0.0)]
    bare = publog.publication_records(spark.createDataFrame([("x",)], "filename string")).first()
    assert (bare.filename, bare.candidate_count, bare.suggested_title) == ("x", 0, "")


def test_a_batch_is_in_the_log_once(spark, tmp_path):
    path, records = str(tmp_path / "log"), publog.publication_records(decided(spark)).repartition(3)
    assert publog.read_log(spark, path).count() == 0
    for _ in range(3):
        assert publog.append_publications(records, path, batch="one")
    assert publog.read_log(spark, path).count() == 5
    assert publog.append_publications(records.filter("video_id = '4'"), path)
    assert publog.append_publications(records.filter("false"), path)
    read = publog.read_log(spark, path)
    assert sorted(r.video_id for r in read.collect()) == ["", "1", "2", "4", "4", "4", "4"]
    assert "Own \n title" in {r.suggested_title for r in read.collect()}
    files = {f.name for f in (tmp_path / "log" / "_data").iterdir()}
    named = [n for c in (tmp_path / "log" / "_commits").iterdir() for n, _ in json.loads(c.read_text())]
    assert files == set(named) and len(named) == len(set(named))  # what retries wrote is gone


def test_a_failing_batch_leaves_no_row(spark, tmp_path):
    path, records = str(tmp_path / "log"), publog.publication_records(decided(spark))
    assert publog.append_publications(records, path)
    broken = records.withColumn("video_id", F.when(F.col("video_id") == "4", F.raise_error(F.lit("lost"))).otherwise(F.col("video_id")))
    assert publog.append_publications(broken.repartition(4), path) is False
    with pytest.raises(Exception, match="lost"):
        publog.append_publications(broken, path, must=True)
    (tmp_path / "log" / "_data" / "left-over.jsonl").write_text('{"event": "of a lost task"}\n')
    assert publog.read_log(spark, path).count() == 5


def test_the_log_as_a_stream_and_from_one(spark, tmp_path):
    path, records = str(tmp_path / "log"), publog.publication_records(decided(spark))

    def drain():
        """Copies what is new in one log to another, the batch's number being its name."""
        folders.register(spark)
        rows = publog.read_log(spark, path, seen=str(tmp_path / "seen")).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        query = rows.writeStream.format("cuecraft_log").option("path", str(tmp_path / "copy")).option("writer", "w").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return publog.read_log(spark, str(tmp_path / "copy")).count()

    publog.append_publications(records, path)
    assert drain() == 5
    publog.append_publications(records.filter("video_id = '4'"), path)
    assert drain() == 7
    assert drain() == 7


def test_missing_and_bad_lines(spark, tmp_path):
    assert publog.read_publications(spark, str(tmp_path / "none")).count() == 0
    lines = ['{"event": "a"}', "", '{"event": ', "[1]", "7", '{"event": null}']
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.event for r in publog.parsed(rows, publog.RECORD).collect()] == ["a", None]


def test_what_was_written_can_be_swept(spark):
    from cuecraft.sources import shared

    shared.sweep()
    rows = shared.written(spark.range(5), "numbers")
    path = shared._named[-1].removeprefix("file://").removeprefix("file:")
    assert rows.count() == 5 and os.path.isdir(path)
    shared.shared_path(spark, "never-written")
    assert shared.sweep() == 2 and not os.path.isdir(path) and shared.sweep() == 0
