"""The slot-by-slot search for clips that pass a rubric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How much two clips may overlap, and the share of sponsor talk that disqualifies one.
OVERLAP_MS, SPONSOR = 10000, 0.55
_CHOSEN = "array<struct<slot:int,k:int,attempt:int>>"


def _search(r: Column, n: Column, chosen: Column, slot: Column, base: Column, limit: Column, threshold: float, attempts: int) -> Column:
    """The row that a slot takes among ``limit`` rows from its base on, null if none: a fold over the offsets.

    Its state is the best row so far with its average and attempt, the attempts made and whether one has passed.
    """
    state = F.struct(F.lit(None).cast("int").alias("k"), F.lit(-1.0).alias("average"), F.lit(None).cast("int").alias("attempt"), F.lit(0).alias("tried"), F.lit(False).alias("done"))

    def step(a: Column, offset: Column) -> Column:
        k = ((base + offset) % n).cast("int")
        x = F.get(r, k)
        clash = F.exists(chosen, lambda c: F.least(x["end_ms"], F.get(r, c["k"])["end_ms"]) - F.greatest(x["start_ms"], F.get(r, c["k"])["start_ms"]) > OVERLAP_MS)
        fit = ~F.coalesce(x["sponsor_prob"] >= SPONSOR, F.lit(False))
        better, passed = fit & F.coalesce(x["average"] > a["average"], F.lit(False)), fit & F.coalesce(x["average"] >= threshold, F.lit(False))
        tried = a["tried"] + 1
        made = F.struct(
            F.when(better | passed, k).otherwise(a["k"]).alias("k"), F.when(better, x["average"]).otherwise(a["average"]).alias("average"),
            F.when(better | passed, tried).otherwise(a["attempt"]).alias("attempt"), tried.alias("tried"), passed.alias("done"),
        )
        return F.when(a["done"] | (a["tried"] == attempts) | clash, a).otherwise(made)

    found = F.aggregate(F.sequence(F.lit(0), limit - 1), state, step)
    good = F.filter(F.array(found), lambda a: a["k"].isNotNull())
    return F.get(F.transform(good, lambda a: F.struct(slot.alias("slot"), a["k"].alias("k"), a["attempt"].alias("attempt"))), F.lit(0))


def critique_select(windows: DataFrame, target: int = 3, threshold: float = 7.0, attempts: int = 4) -> DataFrame:
    """Per video the windows (window, start_ms, end_ms, average, sponsor_prob) that fill its slots.

    Slot i starts at an even stride and takes the first window that passes, else the best
    strictly better one of its attempts, skipping overlaps with chosen ones; a slot that
    finds none in a narrow search looks at all windows. Folds within folds: over slots with the chosen rows as state, and
    over the windows of a search. One video's windows are one row of numbers, bounded by its length. A null average never
    counts, a null sponsor_prob disqualifies nothing; equal windows are told apart by their other numbers.
    """
    item = F.struct(F.col("window").cast("long").alias("window"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.col("average").cast("double").alias("average"), F.col("sponsor_prob").cast("double").alias("sponsor_prob"))
    rows = windows.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("r")).withColumn("n", F.size("r"))
    r, n = F.col("r"), F.col("n")
    stride, narrow = F.greatest(F.lit(1), F.floor(n / max(1, target)).cast("int")), F.least(n, F.lit(attempts * 5))

    def fill(chosen: Column, slot: Column) -> Column:
        search = lambda limit: _search(r, n, chosen, slot, slot * stride % n, limit, threshold, attempts)
        found = F.coalesce(search(narrow), F.when(n > narrow, search(n)))
        return F.concat(chosen, F.filter(F.array(found), lambda c: c.isNotNull()))

    filled = rows.select("video_id", "r", F.aggregate(F.sequence(F.lit(0), F.lit(target - 1)), F.expr(f"cast(array() AS {_CHOSEN})"), fill).alias("chosen"))
    row = lambda c: F.get(r, c["k"])
    out = F.transform("chosen", lambda c: F.struct(c["slot"].alias("slot"), row(c)["window"].alias("window"), row(c)["start_ms"].alias("start_ms"), row(c)["end_ms"].alias("end_ms"), row(c)["average"].alias("average"), c["attempt"].alias("attempt")))
    return filled.select("video_id", F.inline(out))
