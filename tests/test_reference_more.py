"""Rules of the library against plain loops, over whole documents and over odd cases."""

import re

import pytest
from pyspark.sql import functions as F

from cuecraft import dicts
from cuecraft.functions import text as X
from cuecraft.operators import critique, entities, intervals, replies, tables, titles, topics
from cuecraft.sources import clip_records, transcripts

SF = "/root/testdata/sf0.001"


def cleaned(text):
    """The rewrites one after the other, as a loop."""
    s = (text or "").replace("’", "'")
    s = re.sub(r"\[[^\]]*\]|\([^)]*\)", " ", s)
    s = re.sub(r"(?:^|\s)>>+\s*", " ", s)
    for short, full in dicts.CONTRACTIONS.items():
        s = re.sub(rf"\b{short}\b", full, s, flags=re.I)
    s = re.sub(r"\b(\w+)(?:\s+\1\b)+", r"\1", s, flags=re.I)
    s = re.sub(r"\b[A-Z]{2,}(?:\s+[A-Z]{2,})+\b", lambda m: m[0].lower(), s)
    s = re.sub(r"[^A-Za-z0-9'\s%$.,!?]", " ", s)
    return re.sub(r"\s+", " ", s).strip(" ")


ODD = [None, "", ">> well [MUSIC] it's the the BIG NEWS today (laughs) ok", "I'M sure THEY'RE here. STOP IT NOW, can’t WAIT", "a a A b >>> c", "SO GOOD so good", "50% of $3, it's 'quoted'"]


def test_clean_caption_of_whole_documents(spark):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.c, r.t) for r in rows.select("id", X.clean_caption(F.col("text")).alias("c"), X.clean_tokens(F.col("text")).alias("t")).collect()}
    wrong = []
    for k, text in enumerate(texts):
        want = cleaned(text)
        tokens = [w.strip("'") for w in re.findall(r"[a-z0-9][a-z0-9']+", want.lower())]
        tokens = [w for w in tokens if len(w) >= 2 and w not in dicts.FILLERS]
        if got[k] != (want, tokens):
            wrong.append((text or "")[:60])
    assert not wrong


@pytest.mark.parametrize("word,reaction", [("ohhh", True), ("heh", True), ("hah", True), ("hahaha", True), ("nope", True), ("whoa", True), ("hoo", True), ("book", False), ("summer", False), ("heath", False)])
def test_reactions(spark, word, reaction):
    assert spark.range(1).select(X.is_reaction(F.lit(word))).first()[0] is reaction


def test_phrases_of_pairs(spark):
    rows = spark.createDataFrame([(1, "snow cave tents x1 snow cave tents".split()), (2, [])], "video_id long, tokens array<string>")
    got = topics.topic_phrases(rows).collect()
    assert [(r.video_id, r.topics, r.scores) for r in got] == [(1, ["snow cave", "tents"], [1.5, 1.414])]
    assert topics.topic_phrases(rows, least=0.7).first().topics == ["snow cave", "tents"]  # the phrase of three overlaps its pair
    assert topics.topic_phrases(rows, limit=0).first().topics == []


def test_niche_of_two_words(spark):
    niches = {"cave": ("hot_tent camp", "hot_tent"), "money": ("stock", "stock")}
    rows = spark.createDataFrame([(1, ["hot", "tent"]), (2, ["hot", "camp", "tent"]), (3, ["stock"] * 5)], "video_id long, tokens array<string>")
    got = {r.video_id: (r.niche, r.score) for r in topics.niche_scores(rows, niches).collect()}
    assert got == {1: ("cave", 4.0), 2: ("general", 2.0), 3: ("money", pytest.approx(1 + 5**0.5))}


def clips(spark, rows):
    return spark.createDataFrame(rows, "clip_id long, text string, niche string, topics array<string>")


def test_titles_of_two_generators(spark):
    rows = clips(spark, [(1, "some text", "finance", ["index fund", "budget plan"]), (2, None, "general", []), (3, "x", "gaming", ["http"])])
    master = titles.master_titles(rows).collect()
    one = [r for r in master if r.clip_id == 1]
    assert len(one) == 5 and {r.keyword for r in one} == {"index fund", "budget plan"} and [r.pattern for r in one[:2]] == ["p_cost", "p_rule"]
    assert [r.slot for r in one] == [0, 1, 2, 3, 4] and all(r.title.endswith(dicts.SIGNS["finance"]) for r in one)
    assert all("This Moment" in r.title for r in master if r.clip_id == 2)
    assert all(r.pattern.startswith("f_") for r in master if r.clip_id == 3)  # an address may not stand in a title
    calm = [r for r in titles.master_titles(rows, tone="professional").collect() if r.clip_id == 1]
    assert calm[0].framework in dicts.TONES["professional"][0] and not any(r.title.endswith(dicts.SIGNS["finance"]) for r in calm)
    with pytest.raises(ValueError):
        titles.master_titles(rows, tone="shouting")
    seo = titles.seo_titles(rows)
    got = titles.candidates(titles.master_titles(rows), seo, least=5).collect()
    assert {r.pattern[0] for r in got if r.clip_id == 1} == {"p"} and {r.clip_id for r in got} == {1, 2, 3}
    assert titles.seo_titles(rows, limit=0).count() == 0


def test_casing(spark):
    value = lambda c: spark.range(1).select(c).first()[0]
    assert value(X.normalize_casing(F.lit("THE Story Of  The End OF"))) == "THE Story of the End OF"
    assert value(X.title_case(F.lit("the snow of cave"))) == "The Snow of Cave"


def test_entities(spark):
    text = "Outdoor Boys met Alaska in 6 feet of snow. Then snow cave [music] and snow cave again. Anna came."
    rows = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], "video_id long, text string")
    got = [(r.entity, r.score) for r in entities.topical_entities(rows, ["snow"]).orderBy("place").collect()]
    assert got[0] == ("snow cave", 15.2) and ("Outdoor Boys", 8.0) in got and ("Snow", 7.0) in got and ("6 Feet Of", 7.5) in got
    assert not any(e == "Boys" for e, _ in got)
    tags = spark.createDataFrame([("Snow Cave",), ("the and",), (None,)], "e string").select(entities.entity_tag(F.col("e")).alias("t")).collect()
    assert [r.t for r in tags] == ["#cave", None, None]


def test_replies(spark):
    text = "**Niche:** caves\n**Topics Mined:** Snow Cave, , Tent\n1. [Why] Snow Cave Secrets Most People Miss -- 34/100\n2) [ ] The Tent Rule That Saved Us — 99/100\nnoise\n3. [x] Go Go — 5/100\nRecommended: I pick\ntitle # 9"
    row = replies.parse_replies(spark.createDataFrame([(1, text), (2, None)], "reply_id long, text string")).orderBy("reply_id").collect()
    assert (row[0].niche, row[0].topics, row[0].recommended) == ("caves", ["Snow Cave", "Tent"], 4)
    assert [(t.framework, t.stated == t.measured, t.ok) for t in row[0].titles] == [("Why", True, True), ("LLM", False, True), ("x", True, False)]
    assert (row[1].titles, row[1].recommended) == ([], 0)


def test_transcripts_and_tracks(spark):
    raw = spark.createDataFrame([(1, [(" a\nb ", 1.234, None), (" ", 2.0, 1.0)], None), (2, [], "Too Many Requests"), (3, None, None)], "video_id long, snippets array<struct<text:string,start:double,duration:double>>, error string")
    got = {r.video_id: (r.available, r.error, [tuple(s) for s in r.snippets], r.full_text) for r in transcripts.normalize_transcripts(raw).collect()}
    assert got == {1: (True, None, [("a b", 1.23, 0.0)], "a b"), 2: (False, "refused", [], ""), 3: (False, "no captions", [], "")}
    rows = [(1, "de", False, 0, "vtt", "a"), (1, "en-US", True, 1, "vtt", "b"), (1, "en-US", True, 2, "json3", "c"), (2, "fr", True, 0, "json3", "d"), (2, "de", False, 1, "vtt", "e"), (3, "en", True, 0, "vtt", "f"), (3, "en", False, 1, "vtt", "g")]
    picked = transcripts.pick_track(spark.createDataFrame(rows, "video_id long, lang string, auto boolean, pos long, ext string, url string"))
    assert {r.video_id: r.url for r in picked.collect()} == {1: "c", 2: "e", 3: "g"}


def test_clip_records_count_what_they_cannot_read(spark, tmp_path):
    clip_records.write_clips(spark.createDataFrame([(1, "n")], "clip_id long, niche string"), str(tmp_path / "c"))
    (tmp_path / "c" / "x.json").write_text('{"clip_id": 2}\n\n{"clip_id": \n[1]\n7\n')
    records, bad = clip_records.read_clips(spark, str(tmp_path / "c"))
    assert sorted(r.clip_id for r in records.collect()) == [1, 2] and dict(bad.collect()) == {"corrupt": 1, "no object": 2}


def test_subjects_and_ideas(spark):
    rows = spark.createDataFrame([("a", 1, "10 Laptop Fans That Scream"), ("a", 2, "Why Laptop Fans Matter: part two"), ("b", 3, "the of")], "channel_id string, pos long, title string")
    subjects = titles.outlier_subjects(rows)
    got = [r.subject for r in subjects.filter("channel_id = 'a'").orderBy("place").collect()]
    assert got[0] == "Laptop" and "Fans" in got and not any("Laptop" in s for s in got[1:])
    ideas = titles.idea_blueprints(subjects, titles.frame_usage(rows), rows).orderBy("channel_id", "place").collect()
    assert [r.frame for r in ideas if r.channel_id == "b"] == dicts.DEFAULT_FRAMES and {r.subject for r in ideas if r.channel_id == "b"} == {"This Topic"}
    assert [r.learned for r in ideas if r.channel_id == "a"][:2] == [True, True] and len({r.title.lower() for r in ideas if r.channel_id == "a"}) == len([r for r in ideas if r.channel_id == "a"])


def test_hook_script_keeps_to_its_words(spark):
    for wpm in (40, 150, 320):
        script = spark.range(1).select(titles.hook_script(F.lit("About {subject}."), F.lit("Snow Caves"), F.lit("Story"), F.lit(wpm), F.lit(2))).first()[0]
        seconds = int(min(max(min(max(wpm, 50), 300) * 35 / 60 / 0.55, 20), 70))
        assert script.startswith(dicts.OPENERS["story"] + " About snow caves.") and len(script.split()) <= max(30, int(seconds / 60 * wpm)) and script[-1] in ".!?"


def test_word_events_move_equal_starts_apart(spark):
    words = spark.createDataFrame([(1, 0, "a", 0, 300), (1, 1, "b", 0, 400), (1, 2, "c", 0, 500), (1, 3, "d", 2000, 2300)], "video_id long, word_idx int, word string, start_ms long, end_ms long")
    lines = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 1)], "video_id long, word_idx int, line long")
    got = [(r.start_ms, r.end_ms) for r in intervals.word_events(words, lines).orderBy("word_idx").collect()]
    assert got == [(0, 40), (40, 80), (80, 850), (2000, 2650)]


def test_slot_search_looks_at_all_windows_if_few_do_not_suffice(spark):
    rows = [(1, k, 0, 30000, 5.0, 0.9) for k in range(25)] + [(1, 25, 90000, 120000, 6.0, 0.0)]
    rows = spark.createDataFrame(rows, "video_id long, window long, start_ms long, end_ms long, average double, sponsor_prob double")
    assert critique.critique_select(rows, target=1, attempts=30).first().window == 25


def test_clips_without_a_context_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20)], "clip_id long, video_id long")
    there, missing = tables.join_context(rows, spark.createDataFrame([(10, "n")], "video_id long, niche string"))
    assert [r.clip_id for r in there.collect()] == [1] and [r.clip_id for r in missing.collect()] == [2]


def test_topic_phrases_of_a_video_in_many_rows(spark):
    """Rows of one video are counted together, pairs do not cross them; nulls, empty arrays and clashing columns change nothing."""
    one = ["lantern", "harbour", "the", "lantern", "harbour", "glacier", "glacier"]
    rows = [(1, one, 0, "a"), (1, one, 0, "b"), (2, ["meadow"], 1, None), (2, ["lantern"], 1, None), (3, [], 2, "c"), (4, None, 3, "d"), (5, ["glacier", None, "glacier"], 4, "e")]
    table = spark.createDataFrame(rows, "video_id long, tokens array<string>, n int, x string")
    got = {r.video_id: (r.topics, r.scores) for r in topics.topic_phrases(table).collect()}
    # lantern, harbour, glacier: four times each, so 2; the pair "lantern harbour" four times, so 1.5, but its words are taken
    assert got == {1: (["glacier", "harbour", "lantern"], [2.0, 2.0, 2.0]), 2: (["lantern", "meadow"][::-1], [1.0, 1.0]), 5: (["glacier"], [1.414])}
    assert topics.topic_phrases(table.limit(0)).collect() == []
    every = {r.video_id: r.topics for r in topics.topic_phrases(table, least=0.2).collect()}
    assert every[1] == ["glacier", "harbour", "lantern"] and every[2] == ["meadow", "lantern"]


def test_topics_of_a_long_row_are_counted_in_place(spark):
    """Only the bound of a phrase of three needs single pairs; a video's row is sorted and counted without a row for each of its tokens."""
    tokens = [f"{a}{b}an" for a in "bcdfgklmnprtvz" for b in ("or", "il", "un")] * 40 + ["glacier", "harbour"] * 300
    rows = spark.createDataFrame([(1, tokens), (2, ["an", "the", "xx"])], "video_id long, tokens array<string>")
    found = topics.topic_phrases(rows)
    assert "posexplode" not in found._jdf.queryExecution().toString().lower()
    got = found.collect()
    assert [r.video_id for r in got] == [1] and got[0].topics[:2] == ["glacier", "harbour"] and got[0].scores[0] == 17.321
    assert len(got[0].topics) == 8 and not any(" " in t for t in got[0].topics)


def test_stage_directions_and_white_space(spark):
    text = "  a [x]  b\tc\n\nd (y) e  f\r\n"
    assert spark.createDataFrame([(text,)], "t string").select(X.strip_markers(F.col("t"))).first()[0] == "a b c d e  f"


def test_evidence_of_entities_is_worked_out_once(spark):
    """Words inside phrases are told their phrase's score from the same sums: the texts are read for them no second time."""
    rows = spark.createDataFrame([(1, "Glacier Harbour lies north. 'glacier' ice, Harbour Glacier"), (2, None)], "video_id long, text string")
    plans = []
    for keywords in (["glacier"], spark.createDataFrame([("Glacier",)], "keyword string")):
        found = entities.topical_entities(rows, keywords)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        got = {r.entity: r.score for r in found.collect()}
        assert got["Glacier Harbour"] == 15.6 and got["Harbour Glacier"] == 15.6 and got["glacier ice"] == 7.6 and "Harbour" not in got and got["Glacier"] == 19.0
    assert plans == [1, 1]


def test_titles_of_replies_are_judged_once_in_many_tasks(spark, tmp_path):
    """No filter below the titles judges them too, and one split of orders is many tasks."""
    from cuecraft.plans import registry

    parsed = replies.parse_replies(spark.createDataFrame([(1, "1. [Why] Why Markets Move Now -- 20/100"), (2, "none"), (3, None)], "reply_id long, text string"))
    found = replies.reply_titles(parsed)
    assert [(r.reply_id, r.slot, r.framework, r.title, r.stated, r.measured, r.ok) for r in found.collect()] == [(1, 0, "Why", "Why Markets Move Now", 20, 20, True)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("repeated word") == 1
    query = registry.QUERIES["parse_llm_reply"](spark, "/root/testdata/sf0.001")
    assert query.rdd.getNumPartitions() >= 16


@pytest.mark.parametrize("name", ["publication_record", "quality_metrics", "candidates"])
def test_titles_used_twice_are_made_once(spark, name):
    from cuecraft.plans import registry
    from cuecraft.sources import shared

    before = len(shared._named)
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sum("/titles-" in path for path in shared._named[before:]) == 1
