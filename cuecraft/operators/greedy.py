"""Greedy choices over long sequences, in parallel.

"Take the first time, then each time at least ``gap`` after the one taken before" looks sequential: every choice needs
the last one. But a stretch of a video is a function of the last time taken before it, and it has few values, one for
each time within its first gap. So stretches are worked out side by side, their functions are chained, and each stretch
then makes its choices from its own start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Gaps of time in a block, and blocks in a stretch. A stretch is one row of at most that much time, whatever the video's length.
BLOCK_GAPS, STRETCH_BLOCKS = 256, 256


def _after(exits: Column, last: Column, gap: int) -> Column:
    """The last time taken at the end of a stretch, from the one taken before it (null: none): exits are (entry, last), by entry."""
    open_ = F.filter(exits, lambda x: last.isNull() | (x["entry"] >= last + gap))
    return F.coalesce(F.get(open_, F.lit(0))["last"], last)


def _walk(times: Column, last: Column, gap: int) -> Column:
    """The last of the times taken."""
    return F.aggregate(times, last, lambda a, t: F.when(a.isNull() | (t >= a + gap), t).otherwise(a))


def _taken(times: Column, last: Column, gap: int) -> Column:
    """The times taken, in order."""
    state = F.struct(last.alias("last"), F.expr("cast(array() AS array<bigint>)").alias("taken"))
    take = lambda a, t: F.when(a["last"].isNull() | (t >= a["last"] + gap), F.struct(t.alias("last"), F.concat(a["taken"], F.array(t)).alias("taken"))).otherwise(a)
    return F.aggregate(times, state, take, lambda a: a["taken"])


def spaced(rows: DataFrame, time: str, gap: int, last: int | None = None, block_gaps: int = BLOCK_GAPS, stretch_blocks: int = STRETCH_BLOCKS) -> DataFrame:
    """Times (video_id, t) of a greedy choice, each at least ``gap`` after the one before, the first at least that after ``last`` if given.

    Rows are dealt by video and stretch of time, so one video with most of the rows is spread over as many tasks as it has
    stretches. In a stretch, blocks tell for each time that may be entered at (those in the first gap, and the first behind it) where
    the choice leaves them; a video's stretches, a row each, are chained in one task. Two exchanges, the second of one
    row a stretch. Equal times are one; null times and null videos: a null time is never taken, a null video is a
    video. An empty table gives an empty result.
    """
    block_ms, stretch_ms = gap * block_gaps, gap * block_gaps * stretch_blocks
    t = F.col(time).cast("long")
    none = F.lit(None).cast("long")
    dealt = rows.filter(t.isNotNull() if last is None else t >= last + gap).select("video_id", t.alias("t"), F.floor(t / stretch_ms).alias("stretch")).repartition("video_id", "stretch")
    blocks = dealt.groupBy("video_id", "stretch", F.floor(F.col("t") / block_ms).alias("block")).agg(F.array_sort(F.collect_set("t")).alias("times"))
    begin = F.col("block") * block_ms + gap
    behind = F.filter("times", lambda x: x >= begin)
    entries = F.concat(F.filter("times", lambda x: x < begin), F.slice(behind, 1, 1))
    exits = F.transform(entries, lambda e: F.struct(e.alias("entry"), _walk(F.col("times"), e - gap, gap).alias("last")))
    blocks = blocks.select("video_id", "stretch", F.struct("block", "times", exits.alias("exits")).alias("b"))
    stretches = blocks.groupBy("video_id", "stretch").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    first, second = F.get("blocks", F.lit(0)), F.get("blocks", F.lit(1))
    ways = F.concat(F.transform(first["exits"], lambda x: x["entry"]), F.transform(F.slice(F.coalesce(second["exits"], F.array().cast("array<struct<entry:bigint,last:bigint>>")), 1, 1), lambda x: x["entry"]))
    through = lambda start: F.aggregate("blocks", start, lambda a, b: _after(b["exits"], a, gap))
    whole = F.transform(ways, lambda e: F.struct(e.alias("entry"), through(e - gap).alias("last")))
    stretches = stretches.select("video_id", "stretch", "blocks", whole.alias("exits"))

    chain = stretches.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("stretch", "exits"))).alias("s"))
    state = F.struct(none.alias("last"), F.expr("cast(array() AS array<struct<stretch:bigint,last:bigint>>)").alias("starts"))
    step = lambda a, s: F.struct(_after(s["exits"], a["last"], gap).alias("last"), F.concat(a["starts"], F.array(F.struct(s["stretch"].alias("stretch"), a["last"].alias("last")))).alias("starts"))
    starts = chain.select(F.col("video_id").alias("__video"), F.inline(F.aggregate("s", state, step, lambda a: a["starts"]))).withColumnRenamed("stretch", "__stretch")
    joined = stretches.join(starts, F.col("video_id").eqNullSafe(F.col("__video")) & (F.col("stretch") == F.col("__stretch")))

    inner = F.struct(F.col("last").alias("last"), F.expr("cast(array() AS array<bigint>)").alias("lasts"))
    each = F.aggregate("blocks", inner, lambda a, b: F.struct(_after(b["exits"], a["last"], gap).alias("last"), F.concat(a["lasts"], F.array(a["last"])).alias("lasts")), lambda a: a["lasts"])
    chosen = F.flatten(F.transform(F.arrays_zip(F.col("blocks").alias("b"), each.alias("last")), lambda z: _taken(z["b"]["times"], z["last"], gap)))
    return joined.select("video_id", F.explode(chosen).alias("t"))


def apart(rows: DataFrame, most: int, spacing: int, hop: int) -> DataFrame:
    """Times (video_id, t) of at most so many rows (video_id, t, soft), the lowest ``soft`` first and then the earliest, each ``spacing`` from all others.

    Times are multiples of ``hop``. A choice rules out fewer than 2 * spacing / hop + 1 times, so the choice is among the first
    ``most`` times that many of a video. These are found by a ranking that each task cuts off before the exchange, and
    only they are folded. Of equal times the lowest counts.
    """
    near = most * (2 * -(-spacing // hop) + 1)
    once = rows.groupBy("video_id", "t").agg(F.min("soft").alias("soft"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("soft", "t"))
    first = once.withColumn("__k", rank).filter(F.col("__k") <= near)
    hits = first.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("soft", "t"))).alias("hits"))
    none = F.expr("cast(array() AS array<bigint>)")
    full = lambda chosen, x: (F.size(chosen) >= most) | F.exists(chosen, lambda c: F.abs(c - x["t"]) < spacing)
    return hits.select("video_id", F.explode(F.aggregate("hits", none, lambda chosen, x: F.when(full(chosen, x), chosen).otherwise(F.concat(chosen, F.array(x["t"]))))).alias("t"))


def first_apart(hits: DataFrame, most: int, gap: int) -> DataFrame:
    """Of hits (video_id, start_ms, end_ms, keyword) at most so many of each video in the order of time, each ``gap`` after the end of the one before.

    One round for each choice: the first hit that is allowed, as an aggregate that each task begins before the exchange.
    A video's hits never meet in one task.
    """
    chosen, last = None, None
    for _ in range(most):
        left = hits
        if last is not None:
            left = hits.join(last, "video_id").filter(F.col("start_ms") >= F.col("__from"))
        found = left.groupBy("video_id").agg(F.min(F.struct("start_ms", "keyword", "end_ms")).alias("h"))
        found = found.select("video_id", "h.keyword", "h.start_ms", "h.end_ms")
        chosen = found if chosen is None else chosen.unionByName(found)
        last = found.select("video_id", (F.col("end_ms") + gap).alias("__from"))
    return chosen


def first_apart_within(hits: DataFrame, most: int, gap: int) -> DataFrame:
    """The choice of ``first_apart`` for hits that are dealt by video already: each round is a window function, so they are worked out once and not shuffled."""
    own = Window.partitionBy("video_id")
    rows = hits.withColumn("__0", F.min(F.struct("start_ms", "keyword", "end_ms")).over(own))
    for k in range(1, most):
        allowed = F.col("start_ms") >= F.col(f"__{k - 1}.end_ms") + gap
        rows = rows.withColumn(f"__{k}", F.min(F.when(allowed, F.struct("start_ms", "keyword", "end_ms"))).over(own))
    chosen = rows.groupBy("video_id").agg(F.first(F.array(*[F.col(f"__{k}") for k in range(most)])).alias("h"))
    found = chosen.select("video_id", F.explode(F.array_compact("h")).alias("h"))
    return found.select("video_id", "h.keyword", "h.start_ms", "h.end_ms")
