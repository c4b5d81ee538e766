"""Keywords from dictionary tables against plain searches, and names beside typographic marks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cuecraft.operators import entities, patterns, topics

TEXTS = [
    None, "", "We met “Anna Smith” in Berlin—Paris today", "CAFÉ café cafés é", "it’s a new-york, New York!", "İstanbul a b a b a", "under_score score", "名前 名 前の名前 名", "x.y x y", "don't stop", "a" * 50_000 + " end", "naïve naïf",
]
WORDS = ["anna", "anna smith", "Berlin", "paris", "café", "CAFÉ", "new", "york", "new york", "a b a", "score", "名", "x.y", "y", "don't", "stop", "end", "naïf", "", None, "istanbul"]


def brute(texts, words):
    known = {w.lower() for w in words if w}
    out = []
    for k, t in enumerate(texts):
        low = patterns.lower(t or "")
        for w in known:
            for m in re.finditer(f"(?={re.escape(w)})", low):
                at, end = m.start(), m.start() + len(w)
                word = lambda c: c.isalnum() or c == "_"
                if not (at and word(low[at - 1]) and word(low[at])) and not (end < len(low) and word(low[end - 1]) and word(low[end])):
                    out.append((k, w, at, end))
    return sorted(out)


@pytest.mark.parametrize("piece_chars", [1 << 20, 7])
def test_hits_are_those_of_a_search(spark, piece_chars):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "id long, text string, keyword string").repartition(3)
    dictionary = spark.createDataFrame([(w, 1) for w in WORDS], "keyword string, weight int")
    got = sorted(map(tuple, patterns.dictionary_hits(rows, dictionary, key="id", piece_chars=piece_chars).collect()))
    assert got == brute(TEXTS, WORDS)
    assert patterns.dictionary_hits(rows.filter("false"), dictionary, key="id").count() == 0
    assert patterns.dictionary_hits(rows, dictionary.filter("false"), key="id").count() == 0


def test_thousands_of_keywords_in_one_pass(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(9000)})
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "x", "—"]) for _ in range(300)) for _ in range(40)]
    rows, dictionary = spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(w,) for w in words], "keyword string")
    hits = patterns.dictionary_hits(rows, dictionary, key="id")
    known = set(words)
    assert sorted((r.id, r.keyword, r.start) for r in hits.collect()) == sorted((k, m[0], m.start()) for k, t in enumerate(texts) for m in re.finditer(r"\w+", t) if m[0] in known)


def test_names_beside_typographic_marks(spark):
    rows = spark.createDataFrame([(1, "We met “Anna Smith” in Berlin—Paris today"), (2, "We met Anna Smith in Berlin, Paris today"), (3, "Zoë Müller and Łukasz Nowak"), (4, "Anna Smith’s café"), (5, None)], "video_id long, text string")
    found = {}
    for r in entities.topical_entities(rows, ["paris", "café"], blocked=["and"], starters=["we"], first_names=[]).collect():
        found.setdefault(r.video_id, {})[r.entity] = r.score
    assert found[1] == found[2] and {"Anna Smith", "Berlin Paris", "Paris"} <= set(found[1])
    assert set(found[3]) == {"Nowak"}  # words with other letters are no names of A to Z, nor are their ends
    assert "Anna Smith" in found[4] and found[4]["Café"] == entities.KEYWORD
    table = spark.createDataFrame([("Paris",), ("paris",)], "keyword string")
    assert sorted(map(tuple, entities.topical_entities(rows, table).collect())) == sorted(map(tuple, entities.topical_entities(rows, ["paris"]).collect()))


def test_dictionaries_as_tables(spark):
    niches = {"cave": ("hot_tent camp", "hot_tent"), "money": ("stock", "stock")}
    rows = spark.createDataFrame([(1, "hot tent by the camp camp hot tent stock".split()), (2, ["stock"] * 9), (3, [])], "video_id long, tokens array<string>")
    table = spark.createDataFrame([("cave", "hot_tent", True), ("cave", "camp", None), ("money", "stock", True), ("money", "stock", True)], "niche string, keyword string, strong boolean")
    assert sorted(map(tuple, topics.niche_scores(rows, table).collect())) == sorted(map(tuple, topics.niche_scores(rows, niches).collect()))
    words = spark.createDataFrame([(1, 0, "Stock,"), (1, 1, "x")], "video_id long, word_idx int, word string")
    assert [tuple(r) for r in topics.keyword_hits(words, table.select("keyword", "niche").distinct()).collect()] == [(1, 0, "money")]
    plan = lambda t: t.join(patterns.small(t.withColumnRenamed("niche", "n"), 2), "keyword")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan(table) and "broadcast" in plan(table.filter(F.col("niche") == "cave"))
