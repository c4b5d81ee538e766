"""The backfill as a job, and scoring in tiers, on small corpora with every kind of row."""

import os

from pyspark.sql import functions as F

from cuecraft.functions.scoring import heuristic_score
from cuecraft.operators import answers, backfill
from cuecraft.sources import publog

CLIP = "clip_id long, video_id long, text string, niche string, seo_topic string, seo_topic_source string, suggested_title string, suggested_hashtags array<string>, extra int"
ROWS = [
    (1, 1, "words", "old", "x", "full_transcript", "T", ["#a"], 0), (2, 1, " \n", "old", "x", None, "T", ["#a"], 0), (3, 1, None, "old", "x", None, "T", ["#a"], 0),
    (4, 2, "words", "old", "x", None, "T", ["#a"], 0), (5, 1, "words", "old", "x", None, "T", ["#a"], 0), (6, 1, "words", "cave", "tents", None, "T", ["#a"], 0),
    (7, 1, "words", "old", "x", "snippet_union", "T", None, 0), (8, 1, "words", "old", None, "snippet_union", None, ["#a"], 0), (9, None, "words", None, None, None, "T", ["#a"], 0),
    (10, 3, "words", "keep", None, "snippet_union", "A Good New Title", ["#new"], 0), (10, 3, "words", "keep", None, "snippet_union", "A Good New Title", ["#new"], 0),
]
WANT = {  # clip: outcome, niche, topic, source, title
    1: ("skipped_full_transcript", "old", "x", "full_transcript", "T"), 2: ("skipped_no_transcript", "old", "x", None, "T"), 3: ("skipped_no_transcript", "old", "x", None, "T"), 4: ("skipped_no_context", "old", "x", None, "T"),
    5: ("updated", "old", "x", None, "A Good New Title"), 6: ("updated", "cave", "tents", "snippet_union", "A Good New Title"), 7: ("rejected_by_gate", "cave", "tents", "snippet_union", "T"), 8: ("rejected_by_gate", "cave", "tents", "snippet_union", None),
    9: ("skipped_no_context", None, None, None, "T"), 10: ("updated", "keep", None, "snippet_union", "A Good New Title"),
}


def contexts(clips):
    return clips.sparkSession.createDataFrame([(1, "cave", ["tents", "snow"]), (3, None, [])], "video_id long, niche string, topics array<string>")


def titles(clips, known):
    title = F.when(F.col("clip_id") == 7, "um").when(F.col("clip_id") == 8, None).otherwise("A Good New Title")
    return clips.select("clip_id", title.alias("title"), F.array(F.lit("#new")).alias("hashtags"))


def times(path):
    return {p: os.stat(os.path.join(p, f)).st_mtime_ns for p, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_backfill_writes_what_changes_once(spark, tmp_path):
    path, log = str(tmp_path / "corpus"), str(tmp_path / "log")
    backfill.store(spark.createDataFrame(ROWS, CLIP), path, parts=4)
    before = times(path)

    def run(name, **more):
        return {r.counter: r.n for r in backfill.backfill(spark, path, contexts, titles, log=log, run=name, **more).collect()}

    dry = run("dry", dry_run=True)
    assert times(path) == before and publog.read_log(spark, log).count() == 0
    assert list(dry) == backfill.COUNTERS
    assert dry == {"total": 11, "updated": 4, "changed": 0, "would_change": 4, "skipped_no_transcript": 2, "skipped_no_context": 2, "skipped_full_transcript": 1, "skipped_unknown_provenance": 1, "rejected_by_gate": 2, "failed": 1}
    one = run("one", only=F.col("clip_id") == 5)
    assert (one["total"], one["changed"]) == (1, 1)
    first = run("first")
    assert first == {**dry, "changed": 3, "would_change": 3}
    after = times(path)
    assert {p: t for p, t in after.items() if "part=" in p} != before
    rows = spark.read.parquet(path).collect()
    assert sorted(r.clip_id for r in rows) == sorted(r[0] for r in ROWS) and {r.extra for r in rows} == {0}
    assert {r.clip_id: (r.niche, r.seo_topic, r.seo_topic_source, r.suggested_title) for r in rows} == {k: v[1:] for k, v in WANT.items()}
    untouched = {p for p in before if p in after and before[p] == after[p]}
    assert untouched, "folders without a change are not rewritten"
    second = run("second")
    assert second == {**dry, "would_change": 0} and times(path) == after
    assert sorted(r.filename for r in publog.read_log(spark, log).collect()) == ["5", "6"]  # newly decided titles, once


def test_tiers(spark):
    rows = [(v, w, f"why never {v} {w}" if w else None) for v in range(3) for w in range(12)]
    table = spark.createDataFrame(rows, "video_id long, window long, text string").repartition(3)

    def packs(batches):
        for b in batches:
            good = b[(b["window"] != 6) & (b["video_id"] > 0)]
            yield good[["video_id", "window"]].assign(virality=0.0)
            yield good[["video_id", "window"]].assign(virality=2.5)  # answered twice: one row all the same

    def single(batches):
        for b in batches:
            yield b[b["window"] % 2 == 0][["video_id", "window"]].assign(virality=1.25)

    got = {(r.video_id, r.window): (r.tier, r.virality, r.score_failed) for r in answers.score_windows(table, packs, single).collect()}
    offline = {(r.video_id, r.window): r.s for r in table.select("video_id", "window", heuristic_score(F.coalesce("text", F.lit("")))["virality_score"].alias("s")).collect()}
    for (v, w), (tier, score, failed) in got.items():
        broken = v == 0 or 5 <= w < 10
        want = (1, 0.0, False) if not broken else (2, 1.25, False) if w % 2 == 0 else (3, offline[v, w], True)
        assert (tier, score, failed) == want
    assert len(got) == 36
    assert {r.tier: r.n for r in answers.tier_counts(answers.score_windows(table, packs, single)).collect()} == {1: 14, 2: 10, 3: 12}
    assert answers.score_windows(table.filter("false"), packs).count() == 0


def search_loop(rows, target, threshold, attempts):
    """Slot by slot, as a loop over rows (window, start, end, average, sponsor)."""
    n, chosen = len(rows), []
    stride = max(1, n // max(1, target))
    for slot in range(target):
        base, narrow = slot * stride % n, min(n, attempts * 5)
        for limit in (narrow, n) if n > narrow else (narrow,):
            best, top, tried = None, -1.0, 0
            for offset in range(limit):
                if tried == attempts:
                    break
                k = (base + offset) % n
                _, start, end, average, sponsor = rows[k]
                if any(min(end, rows[c][2]) - max(start, rows[c][1]) > 10000 for _, c, _ in chosen):
                    continue
                tried += 1
                if (sponsor or 0) >= 0.55 or average is None:
                    continue
                if average > top:
                    best, top = (slot, k, tried), average
                if average >= threshold:
                    best = (slot, k, tried)
                    break
            if best:
                chosen.append(best)
                break
    return [(s, rows[k][0], a) for s, k, a in chosen]


def test_critique_search_is_the_loop(spark):
    import random

    from cuecraft.operators import critique

    rng = random.Random(6)
    table = {}
    for v in range(60):
        n = rng.choice([1, 2, 5, 20, 21, 90])
        table[v] = [(w, w * rng.choice([1, 9000, 20000]), w * 20000 + 45000, rng.choice([None, -1.0, 3.0, 5.5, 6.9, 7.0, 9.0]), rng.choice([None, 0.0, 0.0, 0.55, 0.9])) for w in range(n)]
    rows = spark.createDataFrame([(v, *r) for v, own in table.items() for r in own], "video_id long, window long, start_ms long, end_ms long, average double, sponsor_prob double").repartition(3)
    for target, attempts in ((3, 4), (1, 1), (5, 30)):
        got = {}
        for r in critique.critique_select(rows, target=target, attempts=attempts).collect():
            got.setdefault(r.video_id, []).append((r.slot, r.window, r.attempt))
        assert {v: sorted(x) for v, x in got.items()} == {v: x for v, own in table.items() if (x := search_loop(own, target, 7.0, attempts))}


def test_channels_of_a_search(spark):
    from cuecraft.operators import channels

    rows = [(2, 5, "v5", 10, "B", None, 7, None), (1, 1, "v1", None, "A", "u1", None, "p1"), (1, 2, "v2", 30, "A2", "u2", 9, None), (None, 3, "v3", 99, "C", None, 1, None), (3, 4, "v4", 99, "", None, 1, None), (4, 6, None, 10, "D", "u4", None, None)]
    hits = spark.createDataFrame(rows, "channel_id long, pos long, video_id string, views long, name string, url string, subs long, thumbnail string")
    got = sorted((r.place, r.channel_id, r.videos_count, r.top_views, r.name, r.url, r.subs, r.thumbnail) for r in channels.channel_rollup(hits).collect())
    assert got == [(1, 1, 2, 30, "A", "u1", None, "p1"), (2, 2, 1, 10, "B", None, 7, "https://i.ytimg.com/vi/v5/hqdefault.jpg"), (3, 4, 1, 10, "D", "u4", None, None)]
    assert [(r.channel_id, r.place, r.views) for r in sorted(channels.channel_samples(hits).collect())] == [(1, 1, 0), (1, 2, 30), (2, 1, 10), (4, 1, 10)]


def test_frames_trends_and_gates(spark):
    from pyspark.sql import functions as F

    from cuecraft.functions import text as X
    from cuecraft.operators import titles

    rows = spark.createDataFrame([(1, 1, "How cats purr"), (1, 2, "How dogs run and why"), (2, 3, "plain")], "channel_id long, pos long, title string")
    got = sorted((r.channel_id, r.place, r.frame, r.n) for r in titles.frames_or_default(rows, default=["f_num", "f_how"]).collect())
    assert got == [(1, 1, "f_how", 2), (1, 2, "f_why", 1), (1, 3, "f_num", 0), (2, 1, "f_num", 0), (2, 2, "f_how", 0)]
    assert {r.subject: (r.n, r.shown) for r in titles.subject_freq(rows).filter("channel_id = 1").collect()} == {"cats": (1, "cats"), "cats purr": (1, "cats purr"), "purr": (1, "purr"), "dogs": (1, "dogs"), "dogs run": (1, "dogs run")}
    score = lambda title, trends: spark.range(1).select(X.score_title(F.lit(title), F.array(F.lit("cats")), F.lit(""), trends)).first()[0]
    plain = score("cats at noon", {})
    assert score("cats at noon", {"noon": 0.4, "at no": 0.3, "non": 9.0}) == round(plain + 0.7, 2)
    assert score("cats at noon", {"noon": 4.0}) == plain + 1 and score("cats at noon", {"noon": -4.0}) == plain
    assert score("dogs at noon", {"noon": 0.4}) == score("dogs at noon", {})
    assert score("cats at noon \U0001f4a1", {}) == plain + 0.5
    best = spark.createDataFrame([(1, "Must see cats", ["cats"], ["#a", "#b"]), (2, "Quiet cats", [], ["#a"])], "clip_id long, title string, topics array<string>, tags array<string>")
    made = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x")], "clip_id long, framework string")
    assert titles.quality_metrics(best, made).first().asDict() == {"clips": 2, "distinct_ratio": 1.0, "longest": 13, "three_or_more": 1, "two_frameworks": 1, "dead_share": 0.5, "most_tags": 2, "with_topic": 1}
