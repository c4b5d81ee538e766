"""Interval and sequence operations per video.

Where a rule looks at neighbours only it is a window function; where each choice depends on
the last one it is a fold over one video's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuecraft.operators import greedy


def _video():
    return Window.partitionBy("video_id")


def merge_intervals(rows: DataFrame, pad_ms: int = 60, gap_ms: int = 80) -> DataFrame:
    """Padded intervals (video_id, start_ms, end_ms), merged where at most gap_ms lies between them."""
    rows = rows.select("video_id", F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("s"), (F.col("end_ms") + pad_ms).alias("e"))
    own = _video().orderBy("s", "e")
    so_far = F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(so_far.isNull() | (F.col("s") > so_far + gap_ms), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(own))
    return rows.groupBy("video_id", "island").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms")).drop("island")


def silence_pairs(events: DataFrame, total_ms: int | None = None) -> DataFrame:
    """Silences from start and end events (video_id, seq, ts_ms, kind): an end alone began at zero, a start alone lasts to the end."""
    own = _video().orderBy("seq")
    end_of = F.lit(total_ms).cast("long") if total_ms else F.max("ts_ms").over(_video())
    rows = events.withColumn("total", end_of).withColumn("prev_kind", F.lag("kind").over(own)).withColumn("prev_ts", F.lag("ts_ms").over(own)).withColumn("next", F.lead("kind").over(own))
    start = F.when(F.col("kind") == "end", F.when(F.col("prev_kind") == "start", F.col("prev_ts")).otherwise(F.lit(0).cast("long"))).otherwise(F.col("ts_ms"))
    end = F.when(F.col("kind") == "end", F.least("ts_ms", "total")).otherwise(F.col("total"))
    open_end = (F.col("kind") == "start") & F.col("next").isNull()
    return rows.filter((F.col("kind") == "end") | open_end).select("video_id", start.alias("start_ms"), end.alias("end_ms"), "total").filter("end_ms > start_ms")


def keep_intervals(silences: DataFrame, tail_ms: int = 200, lead_ms: int = 50, least_ms: int = 150) -> DataFrame:
    """What is left of a video (silences with total) without its silences, a tail after and a lead before speech kept.

    Silences shorter than tail and lead stay. The cursor after a silence is always its end
    less the lead, so the row before gives it. Videos of which all but 200 ms stays are left out.
    """
    long = silences.filter(F.col("end_ms") - F.col("start_ms") >= tail_ms + lead_ms)
    own = _video().orderBy("start_ms", "end_ms")
    cursor = F.coalesce(F.lag(F.greatest(F.least("total", F.col("start_ms") + tail_ms), F.col("end_ms") - lead_ms)).over(own), F.lit(0).cast("long"))
    inner = long.select("video_id", "total", cursor.alias("start_ms"), F.least("total", F.col("start_ms") + tail_ms).alias("end_ms"))
    last = silences.select("video_id", "total").distinct().join(
        long.groupBy("video_id").agg(F.max(F.col("end_ms") - lead_ms).alias("from_ms")), "video_id", "left"
    )
    rest = last.select("video_id", "total", F.coalesce("from_ms", F.lit(0).cast("long")).alias("start_ms"), F.col("total").alias("end_ms"))
    kept = inner.unionByName(rest).filter(F.col("end_ms") - F.col("start_ms") >= least_ms)
    n, longest = F.count(F.lit(1)).over(_video()), F.max(F.col("end_ms") - F.col("start_ms")).over(_video())
    kept = kept.withColumn("whole", (n == 1) & (longest >= F.col("total") - 200))
    return kept.filter("NOT whole").select("video_id", "start_ms", "end_ms")


def level_spikes(levels: DataFrame, over_db: float = 7.0, hop_ms: int = 200, zoom_ms: int = 1200, gap_ms: int = 1000) -> DataFrame:
    """Hops (video_id, hop, db10) louder than the mean by so much, each a second after the end of the one before."""
    loud = loudness_threshold(levels, over_db).filter(F.col("db10") > F.col("bound")).select("video_id", (F.col("hop") * hop_ms).alias("start_ms"))
    return greedy.spaced(loud, "start_ms", zoom_ms + gap_ms).select("video_id", F.col("t").alias("start_ms"), (F.col("t") + zoom_ms).alias("end_ms"))


def loudness_threshold(levels: DataFrame, over_db: float = 7.0) -> DataFrame:
    """Levels with the bound that their video's loud hops exceed: so much over its mean, in tenths."""
    mean = levels.groupBy("video_id").agg((F.sum("db10") / F.count(F.lit(1)) + over_db * 10).alias("bound"))
    return levels.join(mean, "video_id")


def level_peaks(levels: DataFrame, most: int = 4, spacing_ms: int = 7000, hop_ms: int = 250, zoom_ms: int = 1250) -> DataFrame:
    """The loudest hops of the top tenth, well apart, at most so many, from loud to soft and then in the order of time."""
    bound = levels.groupBy("video_id").agg(F.percentile("db10", 0.9).alias("p90"))
    loud = levels.join(bound, "video_id").filter(F.col("db10") >= F.col("p90")).select("video_id", (-F.col("db10")).alias("soft"), (F.col("hop") * hop_ms).cast("long").alias("t"))
    return greedy.apart(loud, most, spacing_ms, hop_ms).select("video_id", F.col("t").alias("start_ms"), (F.col("t") + zoom_ms).alias("end_ms"))


def change_points(diffs: DataFrame, over: int = 280, least_ms: int = 800) -> DataFrame:
    """Cuts (video_id, t_ms): zero, each difference above the bound at least so long after the last cut, and the end."""
    ends = diffs.groupBy("video_id").agg(F.max("t_ms").alias("t_ms"))
    cuts = greedy.spaced(diffs.filter(F.col("diff10") > over), "t_ms", least_ms, last=0).select("video_id", F.col("t").alias("t_ms"))
    return cuts.unionByName(ends).unionByName(ends.select("video_id", F.lit(0).cast("long").alias("t_ms"))).distinct()


#: Words that a caption line's place in it is told from at once; a longer stretch that no pause or time limit cuts is chained in steps of so many.
STEP_WORDS = 10
#: Words of a line up to which its places fit into one number.
PLACES = 12


def chunk_words(words: DataFrame, most_words: int = 3, most_ms: int = 1500, pause_ms: int = 320, rule: str = "span", keep: tuple[str, ...] = (), step: int = STEP_WORDS) -> DataFrame:
    """Words (video_id, word_idx) with the caption line they belong to, and the columns ``keep``, so that no join brings them back.

    rule span: a new line after a pause, after so many words or beyond so long. rule len:
    after a pause, after four words, or after three if the next is longer than five characters.
    A word's place in its line follows from the place of the word before: a function of few values, packed into one number. Window
    functions apply those of the last ``step`` words one after the other; the first place matters only where none of them begins a line whatever
    came before, and is then chained from step to step. One shuffle and one sort by video. Lines of more than ``PLACES`` words are folded run by run.
    """
    most = most_words if rule == "span" else 4
    if most > PLACES:
        return _folded_lines(words, most_words, most_ms, pause_ms, keep)
    own, bits = _video().orderBy("word_idx"), max(1, (most - 1).bit_length())
    before = lambda c, n, none=None: F.lag(c, n, none).over(own)
    pause = F.coalesce(F.col("start_ms") - before("end_ms", 1) > pause_ms, F.lit(True))
    full = lambda n: F.coalesce(F.col("end_ms") - before("start_ms", n) > most_ms, F.lit(False)) if rule == "span" else F.lit(n >= 3) & (F.length("word") > 5)
    # place n - 1 leads to place n unless a line begins
    packed = sum((F.when(full(n), 0).otherwise(n << bits * (n - 1)).cast("long") for n in range(1, most)), F.lit(0).cast("long"))
    rows = words.withColumn("__next", F.when(pause, F.lit(0).cast("long")).otherwise(packed)).select("video_id", "word_idx", *keep, "__next")
    at = F.row_number().over(own)
    rows = rows.withColumn("__at", at).withColumn("__since", F.col("__at") - F.max(F.when(F.col("__next") == 0, at)).over(own))
    rows = rows.withColumns({f"__next{k}": before("__next", k, 0) for k in range(1, step)})
    same = sum(n << bits * n for n in range(1, most))

    def placed(first: str, steps: str = "") -> str:
        """The place after the last ``step`` words, or after so many of them, from a first place."""
        place = first
        for k in range(step - 1, -1, -1):
            name = f"__next{k}" if k else "__next"
            if steps:
                name = f"if({k} < {steps}, {name}, {same}L)"
            place = f"(shiftright({name}, cast({bits} * {place} as int)) & {(1 << bits) - 1}L)"
        return place

    through = " | ".join(f"shiftleft({placed(f'{n}L')}, {bits * n})" for n in range(most))
    joint = (F.col("__since") >= step) & (F.col("__since") % step == 0)
    joints = F.collect_list(F.when(joint, F.struct(F.col("__at").alias("at"), F.expr(through).alias("through")))).over(_video())
    rows = rows.withColumn("__joints", joints)
    own_joints = "filter(__joints, x -> x.at > __at - __since AND x.at <= __at)"
    chained = f"aggregate({own_joints}, 0L, (place, x) -> shiftright(x.through, cast({bits} * place as int)) & {(1 << bits) - 1}L)"
    rows = rows.withColumn("__first", F.when(F.col("__since") >= step, F.expr(chained)))
    place = F.when(F.col("__since") < step, F.expr(placed("0L"))).otherwise(F.expr(placed("__first", f"__since % {step}")))
    return rows.select("video_id", "word_idx", *keep, (F.sum((place == 0).cast("long")).over(own) - 1).alias("line"))


def _folded_lines(words: DataFrame, most_words: int, most_ms: int, pause_ms: int, keep: tuple[str, ...]) -> DataFrame:
    """Rule span by a fold over each run between pauses."""
    own = _video().orderBy("word_idx")
    rows = words.select("video_id", "word_idx", "start_ms", "end_ms", F.struct("word_idx", *keep).alias("kept"))
    rows = rows.withColumn("pause", F.coalesce(F.col("start_ms") - F.lag("end_ms").over(own) > pause_ms, F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("pause").cast("int")).over(own))
    runs = rows.groupBy("video_id", "run").agg(F.sort_array(F.collect_list(F.struct("word_idx", "start_ms", "end_ms", "kept"))).alias("words"))
    full = lambda a, x: (a["n"] >= most_words) | (x["end_ms"] - a["began"] > most_ms)
    state = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("began"), F.expr("cast(array() AS array<boolean>)").alias("opens"))

    def take(a, x):
        new = (a["n"] == 0) | full(a, x)
        return F.struct(F.when(new, 1).otherwise(a["n"] + 1).alias("n"), F.when(new, x["start_ms"]).otherwise(a["began"]).alias("began"), F.concat(a["opens"], F.array(new)).alias("opens"))

    opens = F.aggregate("words", state, take, lambda a: a["opens"])
    flat = runs.select("video_id", F.explode(F.arrays_zip(F.transform("words", lambda w: w["kept"]).alias("kept"), opens.alias("opens"))).alias("w")).select("video_id", "w.kept.*", "w.opens")
    return flat.select("video_id", "word_idx", *keep, (F.sum(F.col("opens").cast("long")).over(own) - 1).alias("line"))


def _lined(words: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Words with their lines; without ``lines`` they have them already, as ``chunk_words`` gives them with ``keep``."""
    return words if lines is None else words.join(lines, ["video_id", "word_idx"])


def caption_events(words: DataFrame, lines: DataFrame | None = None, hold_ms: int = 350) -> DataFrame:
    """One event per caption line: its words, start, and end, held on but not into the next line."""
    grouped = (
        _lined(words, lines)
        .groupBy("video_id", "line")
        .agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("last_ms"), F.expr("listagg(word, ' ') WITHIN GROUP (ORDER BY word_idx)").alias("text"))
    )
    after = F.lead("start_ms").over(_video().orderBy("line"))
    end = F.least(F.col("last_ms") + hold_ms, F.coalesce(after - 20, F.col("last_ms") + hold_ms))
    end = F.when(end <= F.col("start_ms"), F.greatest("last_ms", F.col("start_ms") + 80)).otherwise(end)
    return grouped.select("video_id", "line", "start_ms", end.alias("end_ms"), "text")


def karaoke_spans(words: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Centiseconds that each word of a line is filled for, 8 at least, and of the gap after it."""
    own = Window.partitionBy("video_id", "line").orderBy("word_idx")
    rows = _lined(words, lines).withColumn("gap", F.lead("start_ms").over(own) - F.col("end_ms"))
    fill = F.greatest(F.lit(8), F.bround((F.col("end_ms") - F.col("start_ms")) / 10).cast("long"))
    gap = F.when(F.col("gap") > 50, F.bround(F.col("gap") / 10).cast("long")).otherwise(0)
    return rows.select("video_id", "word_idx", "line", fill.alias("fill_cs"), gap.alias("gap_cs"))


def line_spans(words: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Times of caption lines of rule len: to 80 ms after the last word, not into the next line, 200 ms at least."""
    grouped = _lined(words, lines).groupBy("video_id", "line").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("last_ms"))
    after = F.coalesce(F.lead("start_ms").over(_video().orderBy("line")), F.col("last_ms") + 200)
    return grouped.select("video_id", "line", "start_ms", F.greatest(F.lit(200), F.least(after, F.col("last_ms") + 80) - F.col("start_ms")).alias("length_ms"))


def keyword_cues(words: DataFrame, keywords: list[str], most: int = 2, edge_ms: int = 4000, gap_ms: int = 12000, length_ms: int = 3500) -> DataFrame:
    """The first keyword hits (pairs of words before single ones) away from both ends and from each other. Words are gone through once."""
    clean = F.lower(F.regexp_replace("word", "[^a-zA-Z0-9]", ""))
    rows = words.select("video_id", "word_idx", "start_ms", clean.alias("one"), F.max("end_ms").over(_video()).alias("total"))
    rows = rows.withColumn("two", F.concat_ws(" ", "one", F.lead("one").over(_video().orderBy("word_idx"))))
    inside = (F.col("start_ms") >= edge_ms) & (F.col("start_ms") < F.greatest(F.lit(edge_ms), F.col("total") - edge_ms) - 1000)
    known = lambda c: F.when(F.col(c).isin(*keywords), F.col(c))
    hits = rows.filter(inside).withColumn("keyword", F.coalesce(known("two"), known("one"))).filter("keyword IS NOT NULL")

    end = F.least(F.col("start_ms") + length_ms, F.greatest(F.lit(edge_ms), F.col("total") - edge_ms))
    hits = hits.select("video_id", "keyword", "start_ms", end.alias("end_ms")).filter(F.col("end_ms") - F.col("start_ms") >= 1000)
    return greedy.first_apart_within(hits.filter(F.col("start_ms") >= gap_ms - 10000), most, gap_ms)


def word_events(words: DataFrame, lines: DataFrame | None = None, hold_ms: int = 350, bump_ms: int = 40) -> DataFrame:
    """One event per word of a line, shown until the next word begins (video_id, line, word_idx, start_ms, end_ms).

    Words of a line that begin together are moved apart by ``bump_ms``, each against the moved one
    before. The last word of a line is held on, not into the next line, and lasts 80 ms at least.
    """
    rows = _lined(words, lines)
    packed = rows.groupBy("video_id", "line").agg(F.sort_array(F.collect_list(F.struct("word_idx", "start_ms", "end_ms"))).alias("w"), F.min("start_ms").alias("first"))
    packed = packed.withColumn("next", F.lead("first").over(_video().orderBy("line")))
    none = F.expr("cast(array() AS array<struct<word_idx:int,start_ms:bigint,end_ms:bigint>>)")
    # where the next word does not begin later, it is moved behind
    moved = lambda done, x: F.when((F.size(done) > 0) & (x["start_ms"] <= F.try_element_at(done, F.lit(-1))["start_ms"]), F.try_element_at(done, F.lit(-1))["start_ms"] + bump_ms).otherwise(x["start_ms"])
    apart = F.aggregate("w", none, lambda done, x: F.concat(done, F.array(F.struct(x["word_idx"].cast("int").alias("word_idx"), moved(done, x).alias("start_ms"), x["end_ms"].alias("end_ms")))))
    packed = packed.withColumn("w", apart)

    def event(x, k):
        held = F.least(x["end_ms"] + hold_ms, F.when(F.col("next") > x["start_ms"], F.col("next")).otherwise(x["end_ms"] + hold_ms))
        last = F.when(held <= x["start_ms"], F.greatest(x["end_ms"], x["start_ms"] + 80)).otherwise(held)
        after = F.get("w", k + 1)["start_ms"]
        return F.struct(x["word_idx"].alias("word_idx"), x["start_ms"].alias("start_ms"), F.coalesce(after, last).alias("end_ms"))

    return packed.select("video_id", "line", F.inline(F.transform("w", event)))


def merge_segments(shots: DataFrame, less_than: int = 35) -> DataFrame:
    """Neighbouring shots (scene, box, x) merged while they stay near the first of their segment: a fold per scene."""
    spans = shots.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("box", "x"))).alias("spans"))
    none = F.expr("cast(array() AS array<struct<x:bigint,shots:bigint>>)")

    def take(done, shot):
        last = F.try_element_at(done, F.lit(-1))
        near = (F.size(done) > 0) & (F.abs(shot["x"] - last["x"]) < less_than)
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["x"].alias("x"), (last["shots"] + 1).alias("shots"))))
        return F.when(near, grown).otherwise(F.concat(done, F.array(F.struct(shot["x"].alias("x"), F.lit(1).cast("long").alias("shots")))))

    return spans.select("scene", F.posexplode(F.aggregate("spans", none, take)).alias("segment", "s")).select("scene", "segment", "s.x", "s.shots")


def damp_jumps(segments: DataFrame, width: int = 600) -> DataFrame:
    """Segments (scene, segment, x) with jumps beyond 15 % of the width damped, each against the damped one before: a fold per scene."""
    limit = round(0.15 * width)
    spans = segments.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("segment", "x"))).alias("spans"))
    none = F.expr("cast(array() AS array<struct<segment:int,x:bigint,damped:bigint>>)")

    def take(done, s):
        last = F.try_element_at(done, F.lit(-1))["damped"]
        jump = s["x"] - last
        step = F.signum(jump.cast("double")).cast("long") * (limit + F.bround(0.35 * (F.abs(jump) - limit)).cast("long"))
        damped = F.when(last.isNotNull() & (F.abs(jump) > limit), last + step).otherwise(s["x"])
        return F.concat(done, F.array(F.struct(s["segment"].alias("segment"), s["x"].alias("x"), damped.alias("damped"))))

    return spans.select("scene", F.explode(F.aggregate("spans", none, take)).alias("s")).select("scene", "s.*")
