"""Named things that transcripts speak of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuecraft import dicts
from cuecraft.functions.text import _let, strip_markers
from cuecraft.operators import patterns

# What each kind of evidence for an entity weighs.
NUMBERED, KEYWORD, COMPOUND, NAME, WORD, FIRST_NAME, INSIDE = 7.5, 7.0, 7.6, 8.0, 6.0, 2.0, 0.25


# White space beyond ASCII.
SPACES = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def entity_text(text: Column) -> Column:
    """Without markers, in ASCII: other letters and digits become underscores, so no word ends or begins at them, other white space
    becomes spaces, and quotes, dashes and all else bars, at which words do end."""
    bare = F.regexp_replace(strip_markers(F.coalesce(text, F.lit(""))), SPACES, " ")
    return F.regexp_replace(F.regexp_replace(bare, r"[^\x00-\x7F\p{L}\p{N}]", "|"), r"[^\x00-\x7F]", "_")


def topical_entities(rows: DataFrame, keywords: list[str] | DataFrame, blocked: list[str] = dicts.BLOCKED, starters: list[str] = dicts.STARTERS, first_names: list[str] = dicts.FIRST_NAMES, least: float = 4.0) -> DataFrame:
    """Entities (video_id, place, entity, score) of texts (video_id, text).

    Evidence: a number with a word or two, a keyword that occurs, two neighbours of which one is a
    keyword, names of several words, single capitalised words (first names count less). A word
    inside a phrase that weighs as much keeps a quarter. Up to six of ``least`` or more, else the
    best four; equals by alphabet. Evidence is summed up before the shuffle, by video and entity. Keywords are a list
    or a table (keyword); those of several words count where they occur, not as neighbours.
    """
    known = keywords if isinstance(keywords, DataFrame) else rows.sparkSession.createDataFrame([(k,) for k in keywords], "keyword string")
    known = known.select(F.lower("keyword").alias("keyword")).filter("keyword <> ''").distinct()
    t = F.col("t")
    point = lambda e, w: F.struct(e.alias("entity"), (w if isinstance(w, Column) else F.lit(w)).alias("w"))
    found = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    numbered = F.transform(found(r"\b\d+\s+[A-Za-z]+(?:\s+[A-Za-z]+)?\b"), lambda e: point(F.initcap(e), NUMBERED))
    skip = [*blocked, *starters]
    part = lambda w: F.when(F.contains(w, F.lit("'")), F.regexp_replace(F.lower(w), "^'+|'+$", "")).otherwise(F.lower(w))
    plain = lambda p: (F.length(p) > 2) & ~p.isin(*skip) & ~p.rlike("^[0-9]+$")
    # a list tells before words are judged which pairs can have a keyword
    near = (lambda p: F.lit(True)) if isinstance(keywords, DataFrame) else (lambda p: p.isin([k.lower() for k in keywords]))

    def pairs_of(words: Column, parts: Column) -> Column:
        def pair(p: Column, k: Column) -> Column:
            q = F.get(parts, k + 1)
            return F.when((near(p) | near(q)) & plain(p) & plain(q), F.struct(F.get(words, k).alias("a"), F.get(words, k + 1).alias("b"), p.alias("__a"), q.alias("__b")))

        return F.filter(F.transform(parts, pair), lambda p: p.isNotNull())

    pairs = _let(found(r"\b[a-zA-Z0-9'-]+\b"), lambda words: _let(F.transform(words, part), lambda parts: pairs_of(words, parts)))
    # possessive, so that Java's matcher goes from word to word in a loop: as a greedy group it calls itself for each word, and a long run overflows the stack
    names = F.transform(found(r"\b[A-Z][a-z]++(?:\s++[A-Z][a-z]++\b)++"), lambda e: point(e, NAME))
    single = F.filter(found(r"\b[A-Z][a-z]{2,}\b"), lambda e: ~F.lower(e).isin(*skip))
    single = F.transform(single, lambda e: point(e, F.when(F.lower(e).isin(*first_names), FIRST_NAME).otherwise(WORD)))
    every = F.filter(F.concat(numbered, names, single), lambda e: e.isNotNull())
    rows = rows.select("video_id", strip_markers(F.coalesce("text", F.lit(""))).alias("raw"), entity_text(F.col("text")).alias("t"))
    hits = patterns.dictionary_hits(rows, known, text="raw").select("video_id", "keyword").distinct()
    beside = rows.select("video_id", F.inline(pairs)).select("video_id", F.concat_ws(" ", "a", "b").alias("entity"), "__a", "__b")
    ones = known.filter(~F.contains("keyword", F.lit(" ")))
    beside = beside.join(patterns.small(ones.toDF("__a")).withColumn("__first", F.lit(True)), "__a", "left").join(patterns.small(ones.toDF("__b")).withColumn("__second", F.lit(True)), "__b", "left").filter("__first OR __second")
    evidence = rows.select("video_id", F.explode(every).alias("e")).select("video_id", "e.*")
    evidence = evidence.unionByName(hits.select("video_id", F.initcap("keyword").alias("entity"), F.lit(KEYWORD).alias("w"))).unionByName(beside.select("video_id", "entity", F.lit(COMPOUND).alias("w")))
    scores = evidence.groupBy("video_id", "entity").agg(F.round(F.sum("w"), 6).alias("score"))
    # a phrase tells each of its words its score, so that the evidence is worked out once
    words = F.when(F.contains("entity", F.lit(" ")), F.split("entity", " ")).otherwise(F.expr("cast(array() AS array<string>)"))
    told = F.transform(words, lambda w: F.struct(w.alias("entity"), F.lit(None).cast("double").alias("score"), F.col("score").alias("phrase")))
    own = F.array(F.struct("entity", "score", F.lit(None).cast("double").alias("phrase")))
    both = scores.select("video_id", F.inline(F.concat(own, told))).groupBy("video_id", "entity").agg(F.max("score").alias("score"), F.max("phrase").alias("phrase"))
    scores = both.filter("score IS NOT NULL").withColumn("score", F.when(F.col("phrase") >= F.col("score"), F.round(F.col("score") * INSIDE, 6)).otherwise(F.col("score")))
    own = Window.partitionBy("video_id")
    ranked = scores.withColumn("place", F.row_number().over(own.orderBy(F.desc("score"), "entity"))).filter("place <= 6")
    good = F.count_if(F.col("score") >= least).over(own)
    return ranked.withColumn("good", good).filter(((F.col("good") > 0) & (F.col("score") >= least)) | ((F.col("good") == 0) & (F.col("place") <= 4))).select("video_id", "place", "entity", "score")


def entity_tag(entity: Column, blocked: list[str] = dicts.BLOCKED, starters: list[str] = dicts.STARTERS) -> Column:
    """The hashtag of an entity's head, its last word of three letters or digits that means something; null without one."""
    words = F.filter(F.regexp_extract_all(F.coalesce(entity, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*blocked, *starters))
    return F.concat(F.lit("#"), F.lower(F.try_element_at(words, F.lit(-1))))
