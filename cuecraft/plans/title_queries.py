"""Queries of text, topics, titles and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuecraft import dicts
from cuecraft.functions import text as X
from cuecraft.operators import tables, titles, topics
from cuecraft.sources import publog
from cuecraft.plans import bindings as b
from cuecraft.plans import fixtures
from cuecraft.plans import title_sql as Q
from cuecraft.plans.registry import query


def _docs(spark, sf):
    return b.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), "text")


def _one(name, column, sql=None):
    """A query that applies one column function to every document."""

    @query(name, f"SELECT doc_id AS video_id, {sql} AS value FROM documents" if sql else None)
    def run(spark, sf):
        return _docs(spark, sf).select("video_id", column(F.col("text")).alias("value"))


_one("clean_caption", lambda t: F.sha2(X.clean_caption(t), 256), f"sha256({Q.cleaned('text')})")
_one("clean_tokens", lambda t: F.size(X.clean_tokens(t)), f"len({Q.clean_token_list('text')})")
_one("strip_markers", lambda t: F.sha2(X.strip_markers(t), 256), f"sha256({Q.markers_off('text')})")
_one("extract_hook", X.extract_hook, Q.hook("text"))
_one("punchy_quote", X.punchy_quote, Q.quote("text"))
_one("validate_title", lambda t: X.validate_title(t)["reason"], Q.title_reason("text"))
_one("filler_hits", X.filler_hits, Q.fillers_in("text"))
_one("sanitize_phrase", X.sanitize_phrase, Q.sanitized("text"))


@query("title_rotation", f"WITH {Q.rotations('documents', 'doc_id')} SELECT doc_id AS video_id, rotation AS value FROM rot")
def _rotation(spark, sf):
    return _docs(spark, sf).select("video_id", X.title_rotation(F.coalesce("text", F.lit(""))).alias("value"))


def _word_query(name, column, sql):
    @query(name, f"WITH {b.WORDS} SELECT video_id, word_idx, {sql} AS value FROM words")
    def run(spark, sf):
        return b.tokens(b.texts(spark, sf)).select("video_id", "word_idx", column(F.col("word")).alias("value"))


_word_query("profane", lambda w: X.is_profane(w, fixtures.PROFANE), f"lower(regexp_replace(word, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) IN ({Q.listed(fixtures.PROFANE)})")
_word_query("keyword_class", X.keyword_class, "CASE WHEN regexp_matches(word, '^\\d') THEN 'number' WHEN regexp_matches(word, '^[A-Z]{3,}$') THEN 'shout' WHEN regexp_matches(word, '(?i)^(why|how|what)$') THEN 'question' WHEN regexp_matches(word, '^.{9,}$') THEN 'long' END")
_word_query("cap_phrase", lambda w: X.cap_phrase(F.replace(w, F.lit("ß"), F.lit("ss"))), "upper(substr(replace(word, 'ß', 'ss'), 1, 1)) || lower(substr(replace(word, 'ß', 'ss'), 2))")
_word_query("emoji_for", lambda w: F.element_at(F.create_map(*[F.lit(x) for kv in fixtures.EMOJI.items() for x in kv]), F.lower(F.regexp_replace(w, "[^a-zA-Z0-9]", ""))),
            "CASE lower(regexp_replace(word, '[^a-zA-Z0-9]', '', 'g')) " + " ".join(f"WHEN {Q.quoted(k)} THEN {Q.quoted(v)}" for k, v in fixtures.EMOJI.items()) + " END")
_word_query("mask_profane", lambda w: X.mask_profane(w, fixtures.PROFANE), Q.masked("word", fixtures.PROFANE))
_word_query("is_reaction", lambda w: X.is_reaction(F.lower(w)), Q.reaction("lower(word)"))
_word_query("is_usable_topic", X.is_usable_topic, Q.usable_topic("word"))


@query("is_topic_token", f"WITH {b.WORDS} SELECT video_id, word_idx, {Q.topic_token('lower(word)')} AS topic FROM words")
def _topic_token(spark, sf):
    return b.tokens(b.texts(spark, sf)).select("video_id", "word_idx", X.is_topic_token(F.lower("word")).alias("topic"))


@query("is_niche_token", f"WITH {b.WORDS} SELECT video_id, word_idx, {Q.niche_token('lower(word)')} AS niche FROM words")
def _niche_token(spark, sf):
    return b.tokens(b.texts(spark, sf)).select("video_id", "word_idx", X.is_niche_token(F.lower("word")).alias("niche"))


_TITLE = "regexp_extract(coalesce(html, ''), '(?i)<title[^>]*>([^<]*)', 1)"


@query("page_slugs", f"SELECT page_id, {Q.slug('t')} AS slug FROM (SELECT page_id, {_TITLE} AS t FROM pages)")
@query("tag_slug", f"SELECT page_id, {Q.slug('t')} AS slug FROM (SELECT page_id, {_TITLE} AS t FROM pages)")
def _slug(spark, sf):
    """The slug of every page's whole title."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "(?i)<title[^>]*>([^<]*)", 1)
    return b.table(spark, sf, "pages").select("page_id", X.tag_slug(title).alias("slug"))


@query("normalize_casing", f"SELECT o_orderkey, {Q.casing('t')} AS value FROM (SELECT o_orderkey, 'OF The ' || o_orderpriority || ' And The  Rest FROM' AS t FROM orders)")
def _casing(spark, sf):
    text = F.concat(F.lit("OF The "), "o_orderpriority", F.lit(" And The  Rest FROM"))
    return b.table(spark, sf, "orders").select("o_orderkey", X.normalize_casing(text).alias("value"))


@query("title_case_topic", f"SELECT o_orderkey, {Q.title_case('t')} AS value FROM (SELECT o_orderkey, lower('the ' || o_orderpriority || ' of the order') AS t FROM orders)")
def _case(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", X.title_case(F.lower(F.concat(F.lit("the "), "o_orderpriority", F.lit(" of the order")))).alias("value"))


def _tokens(spark, sf):
    return _docs(spark, sf).select("video_id", X.plain_tokens(F.col("text")).alias("tokens"))


@query("niche_score", f"WITH {Q.TOKENS}, {Q.NICHE} SELECT video_id, niche, score, second FROM niche")
def _niche(spark, sf):
    return topics.niche_scores(_tokens(spark, sf), fixtures.NICHES)


@query("niche_density", rf"""WITH t AS (SELECT DISTINCT doc_id AS video_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents), d(niche, token) AS (VALUES {', '.join(f"('{n}', '{k}')" for n, (keys, _) in fixtures.NICHES.items() for k in keys.split())}),
s AS (SELECT video_id, niche, 2 * count(*) AS score FROM t JOIN d USING (token) GROUP BY 1, 2) SELECT video_id, niche, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, niche) AS k FROM s) WHERE k = 1""")
def _density(spark, sf):
    known = F.broadcast(spark.createDataFrame([(n, k) for n, (keys, _) in fixtures.NICHES.items() for k in keys.split()], "niche string, token string"))
    seen = _docs(spark, sf).select("video_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))
    scores = seen.join(known, "token").groupBy("video_id", "niche").agg((2 * F.count(F.lit(1))).alias("score"))
    best = scores.groupBy("video_id").agg(F.min_by(F.struct("niche", "score"), F.struct(-F.col("score"), "niche")).alias("s"))
    return best.select("video_id", "s.niche", "s.score")


def _contexts(spark, sf):
    return topics.video_contexts(_tokens(spark, sf), fixtures.NICHES, fixtures.NICHE_TAGS)


@query("topic_phrases", f"WITH RECURSIVE {Q.TOPICS} SELECT video_id, topics FROM topic")
def _phrases(spark, sf):
    return topics.topic_phrases(_tokens(spark, sf)).select("video_id", "topics")


_OVERLAP = "len(list_filter(string_split(a, ' '), lambda x: len(list_filter(string_split(z, ' '), lambda y: x = y OR (length(x) > 2 AND length(y) > 2 AND (starts_with(x, y) OR starts_with(y, x))))) > 0)) > 0"


@query("phrase_overlap", f"SELECT page_id, {_OVERLAP} AS overlap FROM (SELECT page_id, lower({_TITLE}) AS a, regexp_extract(lower(coalesce(html, '')), '<p>([a-z]+ [a-z]+)', 1) AS z FROM pages)")
def _overlap(spark, sf):
    html = F.coalesce("html", F.lit(""))
    title, start = F.regexp_extract(html, "(?i)<title[^>]*>([^<]*)", 1), F.regexp_extract(F.lower(html), "<p>([a-z]+ [a-z]+)", 1)
    return b.table(spark, sf, "pages").select("page_id", topics.phrase_overlap(F.lower(title), start).alias("overlap"))


@query("video_context", f"WITH RECURSIVE {Q.CONTEXT} SELECT video_id, topics, niche, niche_tags FROM ctx")
def _context(spark, sf):
    return _contexts(spark, sf)


def _clips(spark, sf):
    """clip_id, niche, niche_tags, topics, rotation, hook: worked out once, without the texts, and read from the shared folder by every branch."""
    text = F.coalesce("text", F.lit(""))
    docs = _docs(spark, sf).select("video_id", X.title_rotation(text).alias("rotation"), X.extract_hook(text).alias("hook"))
    rows = topics.with_contexts(docs, _contexts(spark, sf), fixtures.NICHE_TAGS["general"]).withColumnRenamed("video_id", "clip_id")
    return b.written(rows.withColumn("topics", X.select_topics(F.col("topics"), F.array(*map(F.lit, fixtures.STRONG_TOPICS)))), "clips")


_CLIPS = f"WITH RECURSIVE {Q.CLIPS}"


@query("select_topics", f"{_CLIPS} SELECT clip_id, topics FROM clips")
def _select(spark, sf):
    return _clips(spark, sf).select("clip_id", "topics")


@query("clip_topics", f"{_CLIPS} SELECT clip_id, topics[1:4] AS topics FROM clips WHERE len(topics) > 0")
def _clip_topics(spark, sf):
    return _clips(spark, sf).filter(F.size("topics") > 0).select("clip_id", F.slice("topics", 1, 4).alias("topics"))


@query("merge_topics", f"{_CLIPS} SELECT clip_id, {Q.merged('list_transform(topics[2:4], lambda t: upper(t))', 'topics')} AS topics FROM clips")
def _merge(spark, sf):
    return _clips(spark, sf).select("clip_id", X.merge_topics(F.transform(F.slice("topics", 2, 3), F.upper), F.col("topics")).alias("topics"))


def _master(clips, tone="high_energy"):
    return titles.master_titles(clips, tone, signs=fixtures.SIGNS, bonus=fixtures.BONUS_PATTERNS)


def _seo(clips):
    return titles.seo_titles(clips, signs=fixtures.SIGNS, bonus=fixtures.BONUS_PATTERNS)


@query("frameworks_for", f"{_CLIPS}, {Q.frameworks('professional')} SELECT clip_id, list_transform(frameworks, lambda p: p.pattern) AS patterns FROM frame")
def _frameworks(spark, sf):
    rows = _clips(spark, sf)
    found = titles.frameworks_for(F.col("niche"), F.col("rotation"), "professional", bonus=fixtures.BONUS_PATTERNS)
    return rows.select("clip_id", F.transform(found, lambda p: p["pattern"]).alias("patterns"))


@query("master_titles", f"{_CLIPS}, {Q.master()} SELECT * FROM titles")
def _master_titles(spark, sf):
    return _master(_clips(spark, sf))


@query("master_titles_calm", f"{_CLIPS}, {Q.master('professional')} SELECT * FROM titles")
def _calm_titles(spark, sf):
    return _master(_clips(spark, sf), "professional")


@query("validate_master_title", f"{_CLIPS}, t AS (SELECT clip_id, 'Why ' || coalesce(topics[1], 'http') || ' and ' || coalesce(topics[2], 'the and') || ' matter ' || (clip_id % 7) AS t, topics FROM clips) SELECT clip_id, {Q.master_reason('t', 'topics')} AS reason FROM t")
def _validate_master(spark, sf):
    topic = lambda k, other: F.coalesce(F.get("topics", F.lit(k)), F.lit(other))
    t = F.concat(F.lit("Why "), topic(0, "http"), F.lit(" and "), topic(1, "the and"), F.lit(" matter "), (F.col("clip_id") % 7).cast("string"))
    return _clips(spark, sf).withColumn("t", t).select("clip_id", X.validate_master_title(F.col("t"), F.col("topics"))["reason"].alias("reason"))


@query("seo_titles", f"{_CLIPS}, {Q.seo()} SELECT * FROM seo")
def _seo_titles(spark, sf):
    return _seo(_clips(spark, sf))


@query("candidates", f"{_CLIPS}, {Q.master()}, {Q.seo()}, n AS (SELECT clip_id FROM titles GROUP BY 1 HAVING count(*) >= 5) SELECT * FROM titles WHERE clip_id IN (SELECT clip_id FROM n) UNION ALL SELECT * FROM seo WHERE clip_id NOT IN (SELECT clip_id FROM n)")
def _candidates(spark, sf):
    clips = _clips(spark, sf)
    return titles.candidates(b.written(_master(clips), "titles"), _seo(clips), least=5)


@query("score_title", f"{_CLIPS}, {Q.master()}, {Q.RANKED} SELECT titles.clip_id, slot, {Q.score('title', 'hk.topics', 'hook', fixtures.TRENDS)} AS score FROM titles JOIN hk USING (clip_id)")
def _score_title(spark, sf):
    clips = _clips(spark, sf)
    rows = _master(clips).join(clips.select("clip_id", "topics", "hook"), "clip_id")
    return rows.select("clip_id", "slot", X.score_title(F.col("title"), F.col("topics"), F.col("hook"), fixtures.TRENDS).alias("score"))


@query("rank_local", f"{_CLIPS}, {Q.master()}, {Q.RANKED} SELECT clip_id, slot, title, score FROM ranked")
def _rank(spark, sf):
    clips = _clips(spark, sf)
    return titles.rank_titles(_master(clips), clips)


@query("short_title", f"{_CLIPS}, {Q.master()} SELECT clip_id, title FROM titles QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY length(title) > 50, slot) = 1")
def _short(spark, sf):
    return titles.short_title(_master(_clips(spark, sf)))


@query(
    "accept_model_pick",
    f"""{_CLIPS}, {Q.master()}, {Q.RANKED}, a AS (SELECT clip_id, (clip_id % 5)::INT AS slot, (clip_id % 10) / 10.0::DOUBLE AS confidence FROM clips WHERE clip_id % 10 >= 6 AND clip_id % 7 <= 5 AND clip_id % 9 >= 4),
g AS (SELECT clip_id, title AS picked, confidence FROM a JOIN titles USING (clip_id, slot)) SELECT clip_id, coalesce(picked, title) AS title, CASE WHEN picked IS NOT NULL THEN confidence ELSE 0.75::DOUBLE END AS confidence FROM ranked LEFT JOIN g USING (clip_id)""",
)
def _pick(spark, sf):
    clips = _clips(spark, sf)
    made = _master(clips)
    k = F.col("clip_id")
    answers = clips.select("clip_id", (k % 5).cast("int").alias("slot"), (k % 10 / 10).alias("confidence"), (k % 7 / 10).alias("clickbait"), (k % 9 / 10).alias("visual"))
    return titles.accept_model_pick(titles.rank_titles(made, clips), made, answers)


def _tags():
    return X.hashtags(F.col("topics"), F.col("niche_tags"))


@query("hashtags", f"{_CLIPS} SELECT clip_id, {Q.hashtags()} AS tags FROM clips")
def _hashtags(spark, sf):
    return _clips(spark, sf).select("clip_id", _tags().alias("tags"))


@query("metadata_tags", f"{_CLIPS}, t AS (SELECT *, {Q.hashtags()} AS tags FROM clips) SELECT clip_id, {Q.metadata_tags('tags')} AS tags FROM t")
def _meta_tags(spark, sf):
    return _clips(spark, sf).select("clip_id", X.metadata_tags(_tags(), F.col("topics"), F.col("niche")).alias("tags"))


_PACKED = f"{_CLIPS}, {Q.master()}, {Q.RANKED}, p AS (SELECT clips.*, title, score, {Q.hashtags()} AS tags, hook FROM clips JOIN ranked USING (clip_id) JOIN (SELECT clip_id, hook FROM hk) USING (clip_id))"


@query("smart_meta", f"{_PACKED} SELECT clip_id, niche, title, CASE WHEN contains(title, '#shorts') THEN title ELSE title || ' #shorts' END AS youtube_title, score, tags, {Q.metadata_tags('tags')} AS metadata_tags, " + ", ".join(f"{Q.description(n, 'hook')} AS {n}" for n in ("youtube", "tiktok", "instagram")) + " FROM p")
def _smart(spark, sf):
    clips = _clips(spark, sf)
    best = titles.rank_titles(_master(clips), clips).select("clip_id", "title", "score")
    rows = clips.join(best, "clip_id").withColumn("tags", _tags())
    told = lambda p: X.build_description(F.col("title"), F.col("hook"), F.col("topics"), F.col("tags"), F.lit(p))
    return rows.select("clip_id", "niche", "title", X.shorts_title(F.col("title")).alias("youtube_title"), "score", "tags", X.metadata_tags(F.col("tags"), F.col("topics"), F.col("niche")).alias("metadata_tags"), *[told(p).alias(p) for p in ("youtube", "tiktok", "instagram")])


_DECIDED = f"""{_CLIPS}, {Q.master()}, {Q.RANKED}, dec_e AS (SELECT clip_id, list({{'title': title, 'pattern': pattern, 'framework': framework, 'keyword': keyword}} ORDER BY slot) AS made FROM titles GROUP BY 1),
dec_s AS (SELECT clip_id, title AS short FROM titles QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY length(title) > 50, slot) = 1),
dec_d AS (SELECT *, CASE WHEN clip_id % 5 = 0 THEN 'Own ' || clip_id ELSE ranked.title END AS told FROM ranked JOIN dec_e USING (clip_id) JOIN dec_s USING (clip_id) JOIN hk USING (clip_id)), dec_w AS (SELECT *, list_filter(made, lambda c: c.title = told)[1] AS won FROM dec_d)"""


@query(
    "publication_record",
    f"""{_DECIDED} SELECT 'title_decided' AS event, '2024-01-01T00:00:00.000000+00:00' AS decided_at, 'render' AS source, CAST(clip_id AS VARCHAR) AS video_id, clip_id || '_clip_1' AS filename, told AS suggested_title, short AS short_title,
made[1].framework AS winning_framework, coalesce(won.pattern, '') AS winning_pattern, coalesce(won.keyword, '') AS winning_keyword, niche, hook AS hook_text, len(made) AS candidate_count, CASE WHEN clip_id % 4 > 0 THEN clip_id % 31 / 10.0::DOUBLE END AS virality_score,
NULL::DOUBLE AS standalone_probability, 0.5::DOUBLE AS sponsor_probability FROM dec_w JOIN clips USING (clip_id)""",
)
def _publication(spark, sf):
    """Best titles as records in a committed log, one clip in five with a title that none of its candidates has."""
    clips, k = _clips(spark, sf), F.col("clip_id")
    made = b.written(_master(clips), "titles")
    each = made.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("slot", "title", "pattern", "framework", "keyword"))).alias("candidates"))
    rows = titles.rank_titles(made, clips).select("clip_id", "title").join(each, "clip_id").join(titles.short_title(made).withColumnRenamed("title", "short_title"), "clip_id").join(clips.select("clip_id", "niche", "hook"), "clip_id")
    decided = rows.select(
        F.lit("render").alias("source"), k.alias("video_id"), F.concat(k.cast("string"), F.lit("_clip_1")).alias("filename"), F.when(k % 5 == 0, F.concat(F.lit("Own "), k.cast("string"))).otherwise(F.col("title")).alias("suggested_title"),
        "short_title", F.get("candidates", F.lit(0))["framework"].alias("winning_framework"), "niche", F.col("hook").alias("hook_text"), "candidates",
        F.when(k % 4 > 0, k % 31 / 10.0).alias("virality_score"), F.lit(0.5).alias("sponsor_probability"),
    )
    return publog.round_trip(publog.publication_records(decided, F.lit("2024-01-01 00:00:00").cast("timestamp")))


@query("build_description", f"{_CLIPS}, p AS (SELECT *, 'Title ' || clip_id AS title, niche_tags AS tags, {Q.quote('text')} AS hook FROM clips) SELECT clip_id, " + ", ".join(f"{Q.description(n, 'hook')} AS {n}" for n in ("youtube", "tiktok", "instagram")) + " FROM p")
def _describe(spark, sf):
    quotes = _docs(spark, sf).select(F.col("video_id").alias("clip_id"), X.punchy_quote(F.col("text")).alias("hook"))
    rows = _clips(spark, sf).drop("hook").join(quotes, "clip_id").select("clip_id", "topics", "niche_tags", F.concat(F.lit("Title "), F.col("clip_id").cast("string")).alias("title"), "hook")
    told = lambda p: X.build_description(F.col("title"), F.col("hook"), F.col("topics"), F.col("niche_tags"), F.lit(p))
    return rows.select("clip_id", *[told(p).alias(p) for p in ("youtube", "tiktok", "instagram")])


_DEAD = " OR ".join(f"regexp_matches(title, {Q.quoted(p)})" for p in fixtures.DEAD)


@query(
    "quality_metrics",
    f"""{_CLIPS}, {Q.master()}, {Q.RANKED}, e AS (SELECT clip_id, count(*) AS candidates, count(DISTINCT framework) AS frameworks FROM titles GROUP BY 1),
j AS (SELECT ranked.clip_id, title, candidates, frameworks, len({Q.hashtags()}) AS n_tags, topics FROM ranked JOIN e USING (clip_id) JOIN clips USING (clip_id))
SELECT count(*) AS clips, round(count(DISTINCT title) / count(*), 4) AS distinct_ratio, max(length(title)) AS longest, count(*) FILTER (candidates >= 3) AS three_or_more, count(*) FILTER (frameworks >= 2) AS two_frameworks,
round(count(*) FILTER ({_DEAD}) / count(*), 4) AS dead_share, max(n_tags) AS most_tags, count(*) FILTER (len(topics) > 0) AS with_topic FROM j""",
)
def _quality(spark, sf):
    clips = _clips(spark, sf)
    made = b.written(_master(clips), "titles")
    rows = titles.rank_titles(made, clips).select("clip_id", "title").join(clips.select("clip_id", "topics", _tags().alias("tags")), "clip_id")
    return titles.quality_metrics(rows, made, fixtures.DEAD)


_FRAMES = " UNION ALL ".join(f"SELECT channel_id, '{n}' AS frame FROM channel_videos WHERE regexp_matches(title, '{p}')" for n, p in dicts.FRAMES)


@query("frame_usage", f"WITH {b.CHANNEL}, f AS ({_FRAMES}), c AS (SELECT channel_id, frame, count(*) AS n FROM f GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY n DESC, frame) AS place FROM c")
def _frames(spark, sf):
    return titles.frame_usage(b.channel_videos(spark, sf))


_SPARE = ", ".join(f"('{n}', {k})" for k, n in enumerate(dicts.DEFAULT_FRAMES))


@query("frames_or_default", f"""WITH {b.CHANNEL}, f AS ({_FRAMES}), c AS (SELECT channel_id, frame, count(*) AS n FROM f GROUP BY 1, 2), d(frame, k) AS (VALUES {_SPARE}), e AS (SELECT channel_id, frame, n, 0 AS k FROM c UNION ALL SELECT channel_id, frame, 0, k FROM (SELECT DISTINCT channel_id FROM channel_videos), d WHERE (channel_id, frame) NOT IN (SELECT (channel_id, frame) FROM c))
SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY n = 0, n DESC, k, frame) AS place, frame, n FROM e""")
def _all_frames(spark, sf):
    return titles.frames_or_default(b.channel_videos(spark, sf))


_SUBJECTS = """v AS (SELECT channel_id, video_id AS pos, regexp_extract_all(title, '[A-Za-z]+') AS ws FROM channel_videos), u AS (SELECT channel_id, pos, ws, unnest(range(1, len(ws) + 1)) AS k FROM v), w AS (
SELECT channel_id, pos, k, ws[k] AS word FROM u WHERE length(ws[k]) >= 4 UNION ALL SELECT channel_id, pos, k, ws[k] || ' ' || ws[k + 1] FROM u WHERE length(ws[k]) >= 4 AND length(ws[k + 1]) >= 3),
s AS (SELECT channel_id, lower(word) AS subject, count(*) AS n, arg_min(word, (pos, k)) AS shown FROM w GROUP BY 1, 2)"""


@query("subject_freq", f"WITH {b.CHANNEL}, {_SUBJECTS} SELECT channel_id, subject, n, shown FROM s")
def _subjects(spark, sf):
    return titles.subject_freq(b.channel_videos(spark, sf).withColumnRenamed("video_id", "pos"))


_STALE = f"st AS (SELECT doc_id AS clip_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS was FROM documents), sl AS (SELECT * FROM st WHERE was IS NULL OR len(regexp_extract_all(was, '[A-Za-z]+')) < 3 OR contains(lower(was), 'ther') OR contains(lower(was), 'und'))"


@query("retitle_stale", f"{_CLIPS}, {Q.master()}, {Q.RANKED}, {_STALE} SELECT clip_id, was, title FROM sl LEFT JOIN ranked USING (clip_id)")
def _retitled(spark, sf):
    """First words of a text stand for its old title; the new one is the best of the clip's titles."""
    clips = _clips(spark, sf)
    old = _docs(spark, sf).select(F.col("video_id").alias("clip_id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("title"))
    return tables.retitle_stale(old, titles.rank_titles(_master(clips), clips), ["ther", "und"])
