"""What keeps queries within their limits at size: how often rows are shuffled, and how much of one group a task holds."""

import re
import time

from cuecraft.operators import entities, greedy, intervals, topics, windows
from cuecraft.plans import registry

SF = "/root/testdata/sf0.001"


def exchanges(rows) -> int:
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_caption_events_shuffle_texts_once_and_no_words(spark):
    plan = registry.QUERIES["caption_events"](spark, SF)
    assert exchanges(plan) <= 1 and "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_kept_columns_equal_a_join(spark):
    rows = [(v, k, "word" * (1 + (k * v) % 3), 400 * k + (350 if k % 5 == v else 0), 400 * k + 300) for v in (1, 2, 3) for k in range(40)]
    words = spark.createDataFrame(rows, "video_id long, word_idx int, word string, start_ms long, end_ms long")
    for rule in ("span", "len"):
        kept, lines = intervals.chunk_words(words, rule=rule, keep=("word", "start_ms", "end_ms")), intervals.chunk_words(words, rule=rule)
        for events in (intervals.caption_events, intervals.word_events, intervals.karaoke_spans, intervals.line_spans):
            assert sorted(events(kept).collect()) == sorted(events(words, lines).collect())


def test_word_events_shuffle_texts_once_and_no_words(spark):
    plan = registry.QUERIES["caption_word_events"](spark, SF)
    assert exchanges(plan) <= 1 and "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_snapping_takes_time_in_proportion_to_a_windows_cues(spark):
    """Windows of 146 cues of one word: some seconds, minutes where each cue has the bounds worked out again."""
    rows = spark.range(6000).selectExpr("id % 3 AS video_id", "CAST(id DIV 3 AS int) AS cue_idx", "'word' || IF(id DIV 3 % 7 = 6, '.', '') AS text", "(id DIV 3) * 400 AS start_ms", "400L AS dur_ms")
    began = time.monotonic()
    found = windows.sliding_windows(rows).select("video_id", "window", "start_ms", "end_ms", "n_cues").orderBy("video_id", "window").collect()
    assert time.monotonic() - began < 60
    assert len({(r.video_id, r.window) for r in found}) == len(found) > 100 and all(r.end_ms - r.start_ms == 400 * r.n_cues and 35000 <= 400 * r.n_cues <= 58500 for r in found)


def test_sessions_of_a_table_equal_session_windows_and_are_counted_as_they_stream(spark):
    from pyspark.sql import functions as F

    from cuecraft.streaming import jobs

    words = spark.createDataFrame([(v, t) for v in (1, 2) for t in (0, 900, 900, 1801, 2700, 5000, 4200 + v, None)], "video_id long, t long").withColumn("ts", F.timestamp_millis("t"))
    want = words.groupBy("video_id", F.session_window("ts", "900 milliseconds")).agg(F.count(F.lit(1)).alias("words")).select("video_id", F.unix_millis("session_window.start").alias("start_ms"), "words")
    found = jobs.speech_sessions(words)
    assert sorted(found.collect()) == sorted(want.collect())
    assert "Sessions" not in found._jdf.queryExecution().executedPlan().toString()


def test_lines_are_told_by_windows_whatever_the_stretch(spark):
    """No word is grouped or unpacked, and stretches without a pause that are longer than a step are chained exactly."""
    assert "Aggregate" not in (plan := registry.QUERIES["karaoke_spans"](spark, SF)._jdf.queryExecution().executedPlan().toString()) and plan.count("Generate") == 1
    assert registry.QUERIES["phrase_chunks_len"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Generate") == 1
    rows, at = [], 0
    for k in range(700):
        end = at + (100, 200, 300, 900)[k * k % 11 % 4]
        rows.append((k // 500, k, "x" * (1 + k * 7 % 9), at, end))
        at = end + (500 if k in (3, 40, 300) else k % 3 * 10)
    words = spark.createDataFrame(rows, "video_id long, word_idx int, word string, start_ms long, end_ms long")
    for rule, most, ms in (("span", 3, 1500), ("span", 1, 1500), ("span", 7, 4000), ("span", 20, 9000), ("len", 4, 0)):
        want, video = [], None
        for v, k, word, start, end in rows:
            if v != video:
                video, line, n, last = v, -1, 0, None
            full = n >= most or end - began > ms if rule == "span" and n else n >= 4 or (n >= 3 and len(word) > 5)
            if n == 0 or start - last > 320 or full:
                line, n, began = line + 1, 0, start
            n, last = n + 1, end
            want.append((k, line))
        for step in (3, 10):
            got = intervals.chunk_words(words, most_words=most, most_ms=ms, rule=rule, step=step)
            assert [(r.word_idx, r.line) for r in got.orderBy("word_idx").collect()] == want


def test_words_of_a_line_are_sorted_without_a_comparing_function(spark):
    for name in ("caption_word_events", "L3_cue_windows"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().analyzed().toString()
        assert "sort_array(collect_list" in plan and "array_sort(collect_list" not in plan


def test_keyword_cues_go_through_words_once(spark):
    plan = registry.QUERIES["keyword_cues"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan
    hits = [(v, 100 * (k * k * 7 % 97), "ab"[k % 2]) for v in range(5) for k in range(v * 20)]
    table = spark.createDataFrame([(v, t, t + 900, k) for v, t, k in hits], "video_id long, start_ms long, end_ms long, keyword string")
    for most in (1, 2, 3):
        assert sorted(greedy.first_apart_within(table, most, 2500).collect()) == sorted(greedy.first_apart(table, most, 2500).collect())


def test_topics_and_niches_call_no_function_for_each_token(spark):
    rows = spark.createDataFrame([(1, ["snow", "cave", None, "snow", "cave", "ab"]), (1, ["cave", "snow"]), (2, [])], "video_id long, tokens array<string>")
    plan = lambda found: found._jdf.queryExecution().executedPlan().toString()
    found, scores = topics.topic_phrases(rows), topics.niche_scores(rows, {"winter": ("snow snow_cave", "snow")})
    assert "parts" in plan(found) and "flatten(" not in plan(found) and exchanges(found) == 1  # words and pairs are counted by batch
    assert "lambdafunction" not in plan(scores).split("Generate")[1]
    assert [tuple(r) for r in found.collect()] == [(1, ["cave", "snow"], [1.732, 1.732])]
    assert [tuple(r) for r in scores.collect()] == [(1, "winter", 6.732051, 0.0)]


def test_long_runs_of_names_do_not_overflow_the_stack(spark):
    """A text of 20,000 capitalised words is one name; runs end where a word goes on, as they do for Python's patterns."""
    long, odd = " ".join(["Alpha", "Beta", "Gamma"][k % 3] for k in range(20000)), "Red Blue Greenx9 Old Town_ New YorkX Big Sur, A Bc De fGh Ij Kl"
    rows = spark.createDataFrame([(1, long), (2, odd)], "video_id long, text string")
    found = entities.topical_entities(rows, ["zzz"]).collect()
    assert [r.score for r in found if r.video_id == 1 and r.entity == long] == [entities.NAME] and sum(r.video_id == 1 for r in found) == 4
    assert sorted(r.entity for r in found if r.video_id == 2 and " " in r.entity) == sorted(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", odd))
