"""Topics and niches of whole transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuecraft.functions.text import _let, is_niche_token, is_topic_token
from cuecraft.operators import patterns

#: Bytes of tokens that a task counts at once, one video at least.
BATCH_BYTES = 4 << 20


def bigram_counts(rows: DataFrame, blocked: list[str]) -> DataFrame:
    """Neighbouring tokens (video_id, tokens) that differ and of which none is blocked, counted."""
    pairs = F.arrays_zip(F.col("tokens").alias("x"), F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0))).alias("y"))
    split = rows.select("video_id", F.explode(pairs).alias("p")).select("video_id", "p.*").toDF("video_id", "x", "y").filter("y IS NOT NULL")
    keep = (F.col("x") != F.col("y")) & ~F.col("x").isin(blocked) & ~F.col("y").isin(blocked)
    return split.filter(keep).groupBy("video_id", F.concat_ws(" ", "x", "y").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


def keyword_hits(words: DataFrame, keywords: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Words that a dictionary of (keyword, niche) holds, letters and digits alone compared."""
    known = keywords if isinstance(keywords, DataFrame) else words.sparkSession.createDataFrame(keywords, "keyword string, niche string")
    clean = F.lower(F.regexp_replace("word", "[^a-zA-Z0-9]", ""))
    return words.withColumn("keyword", clean).join(patterns.small(known), "keyword").select("video_id", "word_idx", "niche")


def niche_scores(rows: DataFrame, niches: dict[str, tuple[str, str]] | DataFrame) -> DataFrame:
    """Best two niches of each video (video_id, tokens), one row for every video with a keyword.

    A keyword of one word counts one and the root of its count, one of two words four if it is
    there at all. Three gates: the best score must be 3 at least, hold a strong keyword and
    exceed the second by a quarter; else the video is general. One pass over the tokens, folded
    by video and keyword before the shuffle. The dictionary is a mapping or a table (niche, keyword, strong), of any size.
    """
    known = patterns.small(patterns.keyword_table(rows.sparkSession, niches))
    known = known.withColumn("x", F.get(F.split("keyword", " "), F.lit(0)))
    held = rows.select("video_id", "tokens", F.posexplode("tokens").alias("k", "x")).select("video_id", "x", F.get("tokens", F.col("k") + 1).alias("y"))
    seen = held.join(known, "x").filter(F.when(F.col("several"), F.concat("x", F.lit(" "), "y") == F.col("keyword")).otherwise(is_niche_token(F.col("keyword"))))
    counts = seen.groupBy("video_id", "niche", "keyword", "strong", "several").agg(F.count(F.lit(1)).alias("n"))
    points, hits = F.when(F.col("several"), 4.0).otherwise(1 + F.sqrt("n")), F.when(F.col("several"), 1).otherwise(F.col("n"))
    scores = counts.groupBy("video_id", "niche").agg(F.round(F.sum(points), 6).alias("score"), F.sum(F.when(F.col("strong"), hits).otherwise(0)).alias("strong"))
    best = scores.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "niche", "strong"))).alias("r"))  # a row per niche
    top, second = F.get("r", F.lit(0)), F.coalesce(-F.get("r", F.lit(1))["s"], F.lit(0.0))
    passed = (-top["s"] >= 3) & (top["strong"] >= 1) & (-top["s"] >= 1.25 * second)
    return best.select("video_id", F.when(passed, top["niche"]).otherwise("general").alias("niche"), (-top["s"]).alias("score"), second.alias("second"))


def phrase_overlap(a: Column, b: Column) -> Column:
    """Two phrases share a word, or words of three letters or more of which one begins the other."""
    same = lambda x, y: (x == y) | ((F.length(x) > 2) & (F.length(y) > 2) & (F.startswith(x, y) | F.startswith(y, x)))
    return F.exists(F.split(a, " "), lambda x: F.exists(F.split(b, " "), lambda y: same(x, y)))


def _grouped(rows: DataFrame) -> DataFrame:
    """Token arrays (video_id, parts) of each video."""
    return rows.groupBy("video_id").agg(F.collect_list("tokens").alias("parts"))


def _listed(rows: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Values of n rows, by the ascending number of each value's row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def _counts(videos: DataFrame, least_pairs: int) -> DataFrame:
    """Words and neighbouring pairs of each video (video_id, parts), of three letters or more.

    words: those that repeat, with their number; once: the others; pairs: different neighbours that occur ``least_pairs`` times
    or more, with the word behind their first place unless it is one of them.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    videos.sparkSession.conf.set(setting, str(BATCH_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, parts = len(batch), batch.column(1)
            inner = parts.flatten()
            sizes = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            of_part = np.repeat(np.arange(n), parts.value_lengths().to_numpy(zero_copy_only=False))
            part, video = np.repeat(np.arange(len(sizes)), sizes), np.repeat(of_part, sizes)
            coded = inner.flatten().dictionary_encode()
            words, code = coded.dictionary, coded.indices.fill_null(-1).to_numpy().astype(np.int64)
            long = np.append(pc.greater_equal(pc.utf8_length(words), 3).to_numpy(zero_copy_only=False), False)  # a null is the last one
            kinds = len(words) + 1
            key, times = np.unique((video * kinds + code)[long[code]], return_counts=True)
            again = times > 1
            often = pa.StructArray.from_arrays([words.take(pa.array(key[again] % kinds)), pa.array(times[again].astype(np.int32))], ["phrase", "n"])

            x, y = code[:-1], code[1:]
            at = np.flatnonzero((part[1:] == part[:-1]) & (x != y) & long[x] & long[y])
            both = (video[at] * kinds + x[at]) * kinds + y[at]
            pair, times = np.unique(both, return_counts=True)
            pair, times = pair[times >= least_pairs], times[times >= least_pairs]
            behind = pa.nulls(len(pair), pa.string())
            if least_pairs < 2:
                z = np.append(code, -1)[at + 2]
                z[(np.append(part, -1)[at + 2] != part[at]) | (z == x[at]) | (z == y[at])] = -1
                rank = np.append(np.argsort(pc.sort_indices(words).to_numpy()), -1)
                place = at - np.searchsorted(part, part[at])
                order = np.lexsort((rank[z], place, both))
                lead = z[order[np.searchsorted(both[order], pair)]]
                behind = words.take(pa.array(lead, mask=lead < 0))
            first, second = (words.take(pa.array(k)) for k in (pair // kinds % kinds, pair % kinds))
            pairs = pa.StructArray.from_arrays([pc.binary_join_element_wise(first, second, " "), pa.array(times.astype(np.int32)), behind], ["phrase", "n", "z"])
            single = key[~again]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _listed(key[again] // kinds, n, often), _listed(single // kinds, n, words.take(pa.array(single % kinds))), _listed(pair // kinds // kinds, n, pairs)],
                ["video_id", "words", "once", "pairs"],
            )

    kind = videos.schema["video_id"].dataType.simpleString()
    return videos.select("video_id", "parts").mapInArrow(count, f"video_id {kind}, words array<struct<phrase:string,n:int>>, once array<string>, pairs array<struct<phrase:string,n:int,z:string>>")


def topic_phrases(rows: DataFrame, limit: int = 8, least: float = 0.9) -> DataFrame:
    """Topics (video_id, topics, scores) of token arrays (video_id, tokens).

    Words count the root of their number, neighbouring pairs 1.5 if they repeat and .4 else,
    the word after a pair's first place makes a phrase of three with half of the pair's weight
    (so it takes a lower bound ``least`` to show). The best phrases, the shorter and then the
    earlier in the alphabet of equals, that overlap none taken before stay. One shuffle, of the
    tokens by video: words and pairs are counted within the video's row, and the fold goes through all its
    phrases at or above the bound, judging words until enough are taken; those that weigh one or less are sorted only where
    the others do not suffice. A video without a phrase has no row.
    """
    most = max(1, limit)
    empty = F.expr("cast(named_struct('r', array(), 'words', array()) AS struct<r:array<struct<s:double,n:int,phrase:string>>,words:array<string>>)")
    rank = lambda score, text: F.struct((-score).alias("s"), F.length(text).alias("n"), text.alias("phrase"))
    weight = lambda p: F.when(p["n"] >= 2, 1.5).otherwise(0.4)
    threes = F.transform(F.filter("pairs", lambda p: p["z"].isNotNull()), lambda p: rank(weight(p) / 2, F.concat(p["phrase"], F.lit(" "), p["z"])))
    double = F.transform("pairs", lambda p: rank(weight(p), p["phrase"]))
    shown = lambda *parts: F.sort_array(F.filter(F.concat(*parts), lambda r: r["s"] <= -least))
    heavy = shown(F.transform("words", lambda w: rank(F.sqrt(w["n"]), w["phrase"])), F.filter(double, lambda r: r["s"] < -1))
    light = shown(F.transform("once", lambda w: rank(F.lit(1.0), w)), F.filter(double, lambda r: r["s"] >= -1), threes)
    words = lambda x: F.split(x["phrase"], " ")
    good = lambda ws: F.forall(ws, lambda w: is_topic_token(w))
    # words of topics have three letters or more: they overlap if one begins the other
    held = lambda done, ws: F.exists(ws, lambda w: F.exists(done["words"], lambda d: F.startswith(d, w) | F.startswith(w, d)))
    more = lambda done, x: F.struct(F.concat(done["r"], F.array(x)).alias("r"), F.concat(done["words"], words(x)).alias("words"))
    takes = lambda done, x: (F.size(done["r"]) < most) & _let(words(x), lambda ws: good(ws) & ~held(done, ws))
    fold = lambda r, begun: F.aggregate(r, begun, lambda done, x: F.when(takes(done, x), more(done, x)).otherwise(done))
    kept = _let(fold(heavy, empty), lambda done: F.when(F.size(done["r"]) < most, fold(light, done)).otherwise(done))["r"]
    counted = _counts(_grouped(rows), 1 if least <= 0.75 else 2)
    best = counted.select("video_id", F.inline(F.array(F.struct(kept.alias("r"))))).filter(F.size("r") > 0).withColumn("r", F.slice("r", 1, limit))
    return best.select("video_id", F.transform("r", lambda x: x["phrase"]).alias("topics"), F.transform("r", lambda x: F.round(-x["s"], 3)).alias("scores"))


def video_contexts(rows: DataFrame, niches: dict[str, tuple[str, str]], niche_tags: dict[str, list[str]]) -> DataFrame:
    """Topics, niche and its tags, once for each video with a topic or a keyword, from its tokens (video_id, tokens)."""
    topics = topic_phrases(rows).select("video_id", "topics")
    again = _grouped(rows).select("video_id", F.explode("parts").alias("tokens"))  # the shuffle of the topics, read once more
    made = topics.join(niche_scores(again, niches).select("video_id", "niche"), "video_id", "full")
    tags = F.create_map(*[x for n, own in niche_tags.items() for x in (F.lit(n), F.array(*map(F.lit, own)))])
    niche = F.coalesce("niche", F.lit("general"))
    none = F.expr("cast(array() AS array<string>)")
    return made.select("video_id", F.coalesce("topics", none).alias("topics"), niche.alias("niche"), F.coalesce(F.element_at(tags, niche), F.element_at(tags, F.lit("general"))).alias("niche_tags"))


def with_contexts(videos: DataFrame, contexts: DataFrame, general_tags: list[str]) -> DataFrame:
    """Videos with topics, niche and niche_tags of their context; a silent one, without any, has no topics and is general."""
    joined = videos.join(contexts, "video_id", "left")
    none, tags = F.expr("cast(array() AS array<string>)"), F.array(*map(F.lit, general_tags))
    return joined.withColumns({"topics": F.coalesce("topics", none), "niche": F.coalesce("niche", F.lit("general")), "niche_tags": F.coalesce("niche_tags", tags)})
