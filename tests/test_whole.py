"""Queries over whole tables and whole texts."""

import re

import pytest
from pyspark.sql import functions as F

from cuecraft import dicts
from cuecraft.plans import registry
from cuecraft.sources import captions


@pytest.mark.parametrize("kind", ["json3", "vtt", "xml", "auto"])
def test_captions_beyond_a_hundred_hours(spark, tmp_path, kind):
    rows = [(i, "a " * 900_001 + f"b. the end {i}. of it") for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES[f"src_caption_{kind}"](spark, str(tmp_path)).select("video_id", "start_ms", "dur_ms", "text").collect()
    want = [(i, s, d, t) for i in range(3) for s, d, t in ((0, 360000800, "a " * 900_001 + "b"), (360000800, 1200, f"the end {i}"), (360002000, 800, "of it"))]
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("kind", ["json3", "vtt", "xml"])
def test_caption_times_beyond_ten_million_seconds(spark, kind):
    rows = [(1, 0, 10_000_000_001, 1234, "x"), (1, 1, 123_456_789_012, 10_000_000_400, "y")]
    cues = spark.createDataFrame(rows, "video_id long, cue_idx int, start_ms long, dur_ms long, text string")
    assert sorted(map(tuple, captions.read(captions.as_files(cues, kind)).collect())) == [(v, s, d, t) for v, _, s, d, t in rows]


def test_title_functions_read_whole_texts(spark, tmp_path):
    filler, profane, blocked = dicts.FILLERS[0], dicts.PROFANE[0], dicts.BLOCKED[0]
    near = "Seven words of which none is wrong, up to sixty code points"
    texts = ["x1 " * 90 + f"late {filler} here and {filler} again", near + " then then it ends", near + " and on it goes... on...", near + " naïve end", near + f" {profane} end", near + " words" * 20,
             "1 " * 60 + f"{blocked} harbour Lights shine bright", near, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {name: {r.video_id: r.value for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} for name in ("filler_hits", "validate_title", "sanitize_phrase")}
    bad = {*dicts.BLOCKED, *dicts.URL_FRAGMENTS}

    def reason(t):
        low = re.findall("[a-z']+", (t or "").lower())
        rules = (
            (not (t or "").strip(), "empty title"),
            (len(t or "") > 100, "title too long"),
            (any(a == b for a, b in zip(low, low[1:])), "title repeats a word"),  # noqa: B905
            ((t or "").count("...") > 1, "multiple ellipses"),
            (len(low) < 3, "title has fewer than 3 words"),
            (not any(len(w) >= 3 for w in low), "no real word in title"),
            (any(c.isalpha() and not c.isascii() for c in t or ""), "non-ascii letter"),
            (bool(set(low) & set(dicts.PROFANE)), "blocked word"),
            (any(re.fullmatch("um+|uh+|erm|hmm+", w) for w in low), "filler word"),
        )
        return next((name for broken, name in rules if broken), None)

    for k, t in enumerate(texts):
        assert got["validate_title"][k] == reason(t)
        if t is not None:
            assert got["filler_hits"][k] == sorted(set(re.findall("[a-z']+", t.lower())) & set(dicts.FILLERS))
            assert got["sanitize_phrase"][k] == " ".join([w for w in re.findall("[A-Za-z][A-Za-z'-]*", t) if len(w) > 2 and w.lower() not in bad][:3])
    assert {"title too long", "title repeats a word", "multiple ellipses", "non-ascii letter", "blocked word"} <= set(got["validate_title"].values())
    assert got["filler_hits"][0] and got["sanitize_phrase"][6] == "harbour Lights shine"


def test_slugs_of_every_page_and_whole_title(spark, tmp_path):
    titles = ["Straße nach Süden", "ÆON Œuvre | Smørrebrød Nr. 2", "One @ Two. Three", "1234", "see https://a.org/x", "a/b", None]
    pages = [(i, f"<html><head><TITLE lang='x'>{t}</TITLE></head>" if i % 2 else f"<title>{t}</title>") for i, t in enumerate(titles[:-1])]
    spark.createDataFrame([*pages, (6, None), (7, "<p>no title</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.slug for r in registry.QUERIES["page_slugs"](spark, str(tmp_path)).collect()}
    assert got == {0: "strasse_nach_suden", 1: "aeon_oeuvre_smorrebrod_nr_2", 2: "one_two_three", 3: "", 4: "", 5: "", 6: "", 7: ""}


def test_slugs_decompose_by_nfkd(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from cuecraft.functions.normal import decomposed
    from cuecraft.functions.text import tag_slug

    one, several = decomposed()
    texts = ["Łódź", "ﬁne ½ cup", "Ⅷ legions", "①②x", "ＦＵＬＬ width", "naïve café", "日本 a", "𝔘nicode 𝄞", "a—b", "Zürich’s", "ｈｔｔｐ", "", None, *("a" + c for c in [*one, *several])]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
    got = {r.id: r.s for r in rows.select("id", tag_slug(F.col("t")).alias("s")).collect()}

    def slug(t):
        for a, b in (("ß", "ss"), ("ẞ", "SS"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("ø", "o"), ("Ø", "O")):
            t = t.replace(a, b)
        if re.search(r"(?i)https?://|www\.|\.com|\.org|\.net/|/|@[\w.]+\.", t):
            return ""
        plain = re.sub("[^a-z0-9]+", "_", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).strip("_")
        return plain if re.search("[a-z]", plain) else ""

    assert {k: v for k, v in got.items() if texts[k] is not None} == {k: slug(t) for k, t in enumerate(texts) if t is not None}


ODD = ["4041 lamps", "9", "7\n8 boats", "\n12 oars", "a 12\n34 b\n\n5 c", "x\n\t\ny", " \n 3\n4\n5", "80\n\n81"]


@pytest.mark.parametrize("kind", ["json3", "vtt", "xml"])
def test_captions_with_digits_at_line_ends(spark, kind):
    rows = [(1, k, 2000 * k, 1500, text) for k, text in enumerate(ODD)]
    cues = spark.createDataFrame(rows, "video_id long, cue_idx int, start_ms long, dur_ms long, text string")
    got = sorted(map(tuple, captions.read(captions.as_files(cues, kind)).collect()))
    assert got == [(v, s, d, re.sub("[ \n]+", " ", t).strip(" ")) for v, _, s, d, t in rows]


def test_a_number_ends_a_cue_in_its_text_alone(spark):
    text = "1\n00:01,000 --> 00:02,000\n12 lamps\n2\n00:03,000 --> 00:04,000 line:80\n9 boats\n3\n00:05,000 --> 00:06,000\nlast"
    got = captions.read(spark.createDataFrame([(1, text)], "video_id long, content string")).collect()
    assert sorted((r.start_ms, r.text) for r in got) == [(1000, "12 lamps"), (3000, "9 boats"), (5000, "last")]


def _numbers(spark, path):
    rows = [(i, f"{i}80 lamps. 12\n34 boats. {i}") for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return [(i, s, d, t) for i, _ in rows for s, d, t in ((0, 800, f"{i}80 lamps"), (800, 1200, "12 34 boats"), (2000, 400, str(i)))]


def test_cues_of_numbers_in_alternate_formats(spark, tmp_path):
    want = _numbers(spark, tmp_path)
    got = registry.QUERIES["src_caption_auto"](spark, str(tmp_path)).select("video_id", "start_ms", "dur_ms", "text").collect()
    assert sorted(map(tuple, got)) == want


def test_files_of_numbers_are_in_no_trouble(spark, tmp_path):
    rows = [(i, f"{i}80\n7") for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["src_caption_errors"](spark, str(tmp_path)).collect()
    assert sorted((r.video_id, r.error) for r in got) == [(0, "empty"), (11, "empty"), (12, "no cues"), (22, "empty")]


def test_cues_of_numbers_in_a_folder(spark, tmp_path):
    want = [r for r in _numbers(spark, tmp_path) if r[0] % 11 > 1 or r[0] % 11 == 1 and r[0] % 3 > 0]
    got = registry.QUERIES["src_caption_folder"](spark, str(tmp_path)).select("video_id", "start_ms", "dur_ms", "text").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("kind", ["json3", "vtt", "xml", "auto"])
def test_markup_and_carriage_returns_in_texts_come_back(spark, kind):
    texts = ["a < b and c > d", "x <b>bold</b> y", "&lt;tag&gt; &amp; co", "more --> 00:01.000", "e\r \r f", "c\rd", "&copy; &copy z &#65"]
    rows = [(v, k, 3000 * k, 2000, t) for v in range(3) for k, t in enumerate(texts)]
    cues = spark.createDataFrame(rows, "video_id long, cue_idx int, start_ms long, dur_ms long, text string")
    files = captions.as_files(cues, kind)
    assert sorted(map(tuple, captions.read(files).collect())) == [(v, s, d, t) for v, _, s, d, t in rows]
    assert captions.trouble(files.withColumn("error", F.lit(None).cast("string"))).filter("error IS NOT NULL").isEmpty()
