"""Small cases of the library's own operators; SQL comparison at the smallest scale."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from cuecraft.functions import scoring, times, urls
from cuecraft.functions import text as X
from cuecraft.operators import critique, intervals, windows
from cuecraft.plans import registry
from cuecraft.sources import captions, publog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


def value(spark, column, **fields):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()]).select(column).first()[0]


@pytest.mark.parametrize("text,seconds", [("10:00", 600.0), ("01:05:30", 3930.0), ("45.5", 45.5), ("-1", None), ("x", None), ("1:2:3:4", None), ("", None)])
def test_ts_to_seconds(spark, text, seconds):
    assert value(spark, times.ts_to_seconds(F.col("t")), t=text) == seconds


@pytest.mark.parametrize(
    "text,out",
    [("https://youtu.be/abcdefghijk?t=1", "abcdefghijk"), ("https://www.youtube.com/watch?v=abcdefghijk&x=1", "abcdefghijk"), ("https://youtube.com/shorts/abcdefghijk", "abcdefghijk"), ("abcdefghijk", "abcdefghijk"), ("nothing", "nothing")],
)
def test_video_id(spark, text, out):
    assert value(spark, urls.video_id_from_url(F.col("t")), t=text) == out


def test_clean_caption(spark):
    text = ">> well [MUSIC] it's the the BIG NEWS today (laughs) ok"
    assert value(spark, X.clean_caption(F.col("t")), t=text) == "well it is the big news today ok"


@pytest.mark.parametrize(
    "title,reason",
    [("The Truth About Salt", None), ("", "empty title"), ("go go now please", "title repeats a word"), ("two words", "title has fewer than 3 words"), ("The Crème Brûlée Story", "non-ascii letter"), ("x" * 101, "title too long")],
)
def test_validate_title(spark, title, reason):
    assert value(spark, X.validate_title(F.col("t"))["reason"], t=title) == reason


def test_mask_profane(spark):
    assert value(spark, X.mask_profane(F.col("t")), t="Damn!") == "D***!"


def test_hashtags(spark):
    tags = spark.range(1).select(X.hashtags(F.array(F.lit("elden ring"), F.lit("ps5")), F.array(F.lit("#gaming"), F.lit("#gamer")))).first()[0]
    assert tags == ["#Shorts", "#gaming", "#gamer", "#eldenring", "#fyp"]


def test_rubric_caps_sponsors(spark):
    row = spark.range(1).select(scoring.rubric(F.lit("why this works?"), F.lit(2.5), F.lit(0.9), F.lit(0.9), F.lit(None).cast("string"), F.lit(40.0), F.lit(False)).alias("r")).first().r
    assert (row.hook, row.clarity, row.payoff, row.shareability) == (3, 3, 2, 2)


def test_select_non_overlapping(spark):
    rows = spark.createDataFrame([(1, 0, 0, 30000, 1.0), (1, 1, 15000, 45000, 2.0), (1, 2, 36000, 60000, 0.5)], "video_id long, window long, start_ms long, end_ms long, score double")
    got = [(r.rank, r.window) for r in windows.select_non_overlapping(rows).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]


def test_critique_takes_first_that_passes(spark):
    rows = [(1, k, k * 60000, k * 60000 + 40000, a, s) for k, (a, s) in enumerate([(6.0, 0.0), (7.5, 0.9), (7.1, 0.0), (9.0, 0.0)])]
    rows = spark.createDataFrame(rows, "video_id long, window long, start_ms long, end_ms long, average double, sponsor_prob double")
    got = [(r.slot, r.window, r.attempt) for r in critique.critique_select(rows, target=1).collect()]
    assert got == [(0, 2, 3)]


def test_keep_intervals(spark):
    rows = spark.createDataFrame([(1, 1000, 2000, 5000), (1, 3000, 3100, 5000)], "video_id long, start_ms long, end_ms long, total long")
    assert sorted(tuple(r)[1:] for r in intervals.keep_intervals(rows).collect()) == [(0, 1200), (1950, 5000)]


def test_chunk_words(spark):
    rows = [(1, k, w, s, s + 300) for k, (w, s) in enumerate([("a", 0), ("b", 400), ("c", 800), ("d", 1200), ("e", 3000)])]
    rows = spark.createDataFrame(rows, "video_id long, word_idx int, word string, start_ms long, end_ms long")
    assert [r.line for r in intervals.chunk_words(rows).orderBy("word_idx").collect()] == [0, 0, 0, 1, 2]


def test_captions_of_any_format(spark):
    rows = [
        (1, '{"events": [{"tStartMs": 1500, "dDurationMs": 700, "segs": [{"utf8": "a\\nb"}]}, {"tStartMs": 2, "segs": [{"utf8": " "}]}]}'),
        (2, "WEBVTT\n\n00:01.500 --> 00:02.200\n<c>a</c>\nb\n"),
        (3, '<transcript><text start="1.5" dur="0.7">a &amp; b</text></transcript>'),
        (4, ""),
        (5, "{broken"),
    ]
    got = {r.video_id: (r.start_ms, r.dur_ms, r.text) for r in captions.read(spark.createDataFrame(rows, "video_id long, content string")).collect()}
    assert got == {1: (1500, 700, "a b"), 2: (1500, 700, "a b"), 3: (1500, 700, "a & b")}


def test_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"clip_id": 1, "title": "x"}\n\n{"clip_id": \n[1]\n{"clip_id": 2}\n')
    assert sorted(r.clip_id for r in publog.read_publications(spark, str(tmp_path)).collect()) == [1, 2]


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


#: One or two of each kind of query; all of them run where ALL_QUERIES is set (some six minutes).
QUICK = (
    "channel_stats", "outlier_tiers", "greedy_non_overlap", "merge_intervals", "keep_intervals", "backfill_titles", "answers_join", "L1_publog_stream", "src_caption_auto", "channel_match",
    "phrase_chunks", "caption_word_events", "critique_search", "snap_window", "candidates", "smart_meta", "topical_entities", "hook_script", "parse_llm_reply", "src_clip_json", "level_peaks", "score_windows",
)


@pytest.mark.parametrize("name", sorted(registry.ORACLES) if os.environ.get("ALL_QUERIES") else QUICK)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rel = con.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted(repr(tuple(_plain(r[names.index(c)]) for c in columns)) for r in rel.fetchall())
    assert sorted(names) == columns
    assert sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in found.collect()) == want


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
