"""Parallel greedy choices and windows over overlapping cues against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cuecraft.operators import greedy, intervals, windows


def loop(times, gap, last):
    taken = []
    for t in sorted(times):
        if last is None or t >= last + gap:
            taken.append(t)
            last = t
    return taken


@pytest.mark.parametrize("block_gaps,stretch_blocks", [(1, 1), (1, 3), (2, 2), (7, 5), (256, 256)])
@pytest.mark.parametrize("last", [None, 0, 130])
def test_spaced_is_the_fold(spark, block_gaps, stretch_blocks, last):
    rng = random.Random(block_gaps * 10 + stretch_blocks)
    rows = [(0, rng.randrange(3000)) for _ in range(900)] + [(v, rng.choice([1, 10, 50]) * rng.randrange(200)) for v in range(1, 20) for _ in range(rng.choice([0, 1, 3, 60]))]
    rows += [(None, 5), (None, 6), (None, 400), (50, None), (51, -70), (51, -69), (51, 3), (52, 7), (52, 7)]
    want = sorted(((v, t) for v in {v for v, _ in rows} for t in loop([t for w, t in rows if w == v and t is not None], 37, last)), key=str)
    table = spark.createDataFrame([(*r, "x") for r in rows], "video_id long, at long, stretch string")
    assert sorted(map(tuple, greedy.spaced(table, "at", 37, last, block_gaps, stretch_blocks).collect()), key=str) == want
    assert greedy.spaced(table.filter("false"), "at", 37).count() == 0


def test_one_video_with_a_third_of_all_rows_is_spread(spark):
    rows = spark.range(60000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("video_id"), (F.col("id") * 10).alias("at"))
    stretches = rows.filter("video_id = 0").select(F.floor(F.col("at") / (100 * 4 * 4)).alias("s")).distinct().count()
    assert stretches > 300  # that many rows, each of bounded time, are dealt by themselves
    got = greedy.spaced(rows, "at", 100, block_gaps=4, stretch_blocks=4).filter("video_id = 0").agg(F.count("t"), F.min("t"), F.max("t")).first()
    assert tuple(got) == tuple((len(x), x[0], x[-1]) for x in [loop(range(0, 600000, 30), 100, None)])[0]


def test_peaks_and_first_hits(spark):
    rng = random.Random(8)
    rows = [(v, h, rng.randrange(40)) for v in range(12) for h in range(rng.choice([1, 5, 400])) for _ in range(rng.choice([1, 1, 2]))]
    table = spark.createDataFrame(rows, "video_id long, hop long, db10 long")
    got = sorted((r.video_id, r.start_ms) for r in intervals.level_peaks(table).collect())
    want = []
    for v in range(12):
        own = [(d, h) for w, h, d in rows if w == v]
        values = sorted(d for d, _ in own)
        k = 0.9 * (len(values) - 1)
        bound = values[int(k)] + (k - int(k)) * (values[min(int(k) + 1, len(values) - 1)] - values[int(k)])
        chosen = []
        for d, h in sorted(((d, h) for d, h in own if d >= bound), key=lambda x: (-x[0], x[1])):
            if len(chosen) < 4 and all(abs(c - h * 250) >= 7000 for c in chosen):
                chosen.append(h * 250)
        want += [(v, t) for t in chosen]
    assert got == sorted(want)
    hits = [(v, rng.randrange(200) * 100, rng.choice("ab")) for v in range(9) for _ in range(rng.choice([1, 4, 80]))]
    table = spark.createDataFrame([(v, t, t + 900, k) for v, t, k in hits], "video_id long, start_ms long, end_ms long, keyword string")
    want = []
    for v in range(9):
        end, n = None, 0
        for _, t, k in sorted(h for h in hits if h[0] == v):
            if n < 3 and (end is None or t >= end + 2500):
                want.append((v, k, t))
                end, n = t + 900, n + 1
    assert sorted((r.video_id, r.keyword, r.start_ms) for r in greedy.first_apart(table, 3, 2500).collect()) == sorted(want)


# ---------------------------------------------------------------- windows over overlapping cues


def loop_windows(cues, least=35000, most=58500, step=20000):
    """One window after the other: cues are taken in their order until one would make it too long."""
    out, at = [], 0
    total = max(s + d for s, d, _ in cues)
    while at + least <= total:
        target = min(at + most, total)
        first, end, texts = None, 0, []
        for s, d, text in cues:
            if s > target:
                break
            if s + d >= at:
                first = s if first is None else first
                if s + d - first > most:
                    break
                texts.append(text)
                end = max(end, s + d)
        if texts and least <= end - first <= most and (not out or out[-1][:2] != (first, end)):
            out.append((first, end, len(texts), " ".join(texts)))
        at += step
    return out


def test_windows_over_overlapping_cues(spark):
    rng = random.Random(4)
    tables = {1: [(0, 30000, "a"), (30000, 40000, "b"), (31000, 20000, "c")]}  # a and c fit, but b stops the window
    for v in range(2, 40):
        at, tables[v] = 0, []
        for k in range(rng.randrange(1, 60)):
            tables[v].append((at, rng.choice([500, 3000, 9000, 30000, 61000]), f"w{k}"))
            at += rng.choice([0, 500, 2500, 8000])
    rows = [(v, k, t, s, d) for v, cues in tables.items() for k, (s, d, t) in enumerate(cues)]
    table = spark.createDataFrame(rows, "video_id long, cue_idx int, text string, start_ms long, dur_ms long")
    got = sorted(tuple(r) for r in windows.sliding_windows(table, snap=False).select("video_id", "start_ms", "end_ms", "n_cues", "text").collect())
    assert got == sorted((v, *w) for v, cues in tables.items() for w in loop_windows(cues))
    assert not [r for r in got if r[0] == 1]
    snapped = windows.sliding_windows(table).collect()
    assert all(35000 <= r.end_ms - r.start_ms <= 58500 for r in snapped)
