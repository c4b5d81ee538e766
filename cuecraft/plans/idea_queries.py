"""Queries of entities, channel ideas, model replies, transcripts, tracks and clip records."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuecraft import dicts
from cuecraft.functions import scoring
from cuecraft.operators import entities, replies, titles
from cuecraft.plans import bindings as b
from cuecraft.plans import title_sql as Q
from cuecraft.plans.registry import query
from cuecraft.plans.title_queries import _FRAMES
from cuecraft.sources import clip_records, publog, transcripts
from cuecraft.sources.shared import shared_path

KEYWORDS = ["ther", "thon", "rewh", "der"]
_SKIP = Q.listed([*dicts.BLOCKED, *dicts.STARTERS])


def _initcap(e: str) -> str:
    return f"array_to_string(list_transform(string_split({e}, ' '), lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), ' ')"


def _point(e: str, w) -> str:
    return f"{{'entity': {e}, 'w': ({w})::DOUBLE}}"


_PART = "regexp_replace(lower({w}), '^''+|''+$', '', 'g')"


def _plain(w: str) -> str:
    p = _PART.format(w=w)
    return f"coalesce(length({p}) > 2 AND {p} NOT IN ({_SKIP}) AND NOT regexp_matches({p}, '^[0-9]+$'), false)"


_ANY = f"({_PART.format(w='ws[k]')} IN ({Q.listed(KEYWORDS)}) OR {_PART.format(w='ws[k + 1]')} IN ({Q.listed(KEYWORDS)}))"
_TEXT = f"regexp_replace(regexp_replace(regexp_replace({Q.markers_off("coalesce(text, '')")}, '{entities.SPACES}', ' ', 'g'), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '|', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
_ENTITIES = f"""e0 AS (SELECT doc_id AS video_id, {_TEXT} AS t FROM documents), e1 AS (SELECT *, regexp_extract_all(t, '\\b[a-zA-Z0-9''-]+\\b') AS ws FROM e0),
ev AS (SELECT video_id, unnest(list_transform(regexp_extract_all(t, '\\b\\d+\\s+[A-Za-z]+(?:\\s+[A-Za-z]+)?\\b'), lambda x: {_point(_initcap('x'), entities.NUMBERED)})) AS e FROM e1
  UNION ALL SELECT video_id, unnest([{', '.join(f"CASE WHEN regexp_matches(lower(t), '{chr(92)}b{k}{chr(92)}b') THEN {_point(Q.quoted(k.capitalize()), entities.KEYWORD)} END" for k in KEYWORDS)}]) FROM e1
  UNION ALL SELECT video_id, CASE WHEN {_plain('ws[k]')} AND {_plain('ws[k + 1]')} AND {_ANY} THEN {_point("ws[k] || ' ' || ws[k + 1]", entities.COMPOUND)} END FROM (SELECT video_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM e1)
  UNION ALL SELECT video_id, unnest(list_transform(regexp_extract_all(t, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b'), lambda x: {_point('x', entities.NAME)})) FROM e1
  UNION ALL SELECT video_id, unnest(list_transform(list_filter(regexp_extract_all(t, '\\b[A-Z][a-z]{{2,}}\\b'), lambda x: lower(x) NOT IN ({_SKIP})), lambda x: {_point('x', f"CASE WHEN lower(x) IN ({Q.listed(dicts.FIRST_NAMES)}) THEN {entities.FIRST_NAME} ELSE {entities.WORD} END")})) FROM e1),
es AS (SELECT video_id, e.entity AS entity, round(sum(e.w), 6) AS score FROM ev WHERE e IS NOT NULL GROUP BY 1, 2),
ep AS (SELECT video_id, entity, max(phrase) AS phrase FROM (SELECT video_id, unnest(string_split(entity, ' ')) AS entity, score AS phrase FROM es WHERE contains(entity, ' ')) GROUP BY 1, 2),
ef AS (SELECT video_id, entity, CASE WHEN phrase >= score THEN round(score * {entities.INSIDE}, 6) ELSE score END AS score FROM es LEFT JOIN ep USING (video_id, entity)),
er AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, entity) AS place FROM ef QUALIFY place <= 6), eg AS (SELECT *, count(*) FILTER (score >= 4) OVER (PARTITION BY video_id) AS good FROM er),
ent AS (SELECT video_id, place, entity, score FROM eg WHERE (good > 0 AND score >= 4) OR (good = 0 AND place <= 4))"""


def _entities(spark, sf):
    rows = b.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), "text")
    return entities.topical_entities(rows, KEYWORDS)


@query("topical_entities", f"WITH {_ENTITIES} SELECT video_id, place, entity, score FROM ent")
def _topical(spark, sf):
    return _entities(spark, sf)


_HEADS = f"list_filter(regexp_extract_all(entity, '[A-Za-z0-9]+'), lambda w: length(w) > 2 AND lower(w) NOT IN ({_SKIP}))"


@query("entity_tag", f"WITH {_ENTITIES} SELECT video_id, place, '#' || lower({_HEADS}[-1]) AS tag FROM ent")
def _entity_tags(spark, sf):
    return _entities(spark, sf).select("video_id", "place", entities.entity_tag(F.col("entity")).alias("tag"))


# ---------------------------------------------------------------- ideas of channels


def _titles(spark, sf):
    """channel_id, pos, title: parts stand for videos, brands for channels."""
    name = F.concat(F.initcap("p_name"), F.when(F.col("p_size") % 3 == 0, " for Everyone").otherwise(""), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" - "), F.lower("p_type"))).otherwise(""))
    title = F.when(F.col("p_size") % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" "), name)).otherwise(F.concat(F.lit("The "), name))
    return b.table(spark, sf, "part").select(F.col("p_brand").alias("channel_id"), F.col("p_partkey").cast("long").alias("pos"), title.alias("title"))


_NAME = f"{_initcap('p_name')} || CASE WHEN p_size % 3 = 0 THEN ' for Everyone' ELSE '' END || CASE WHEN p_size % 5 = 0 THEN ' - ' || lower(p_type) ELSE '' END"
_CHANNEL_TITLES = f"ct AS (SELECT p_brand AS channel_id, p_partkey::BIGINT AS pos, CASE WHEN p_size % 4 = 0 THEN p_size::VARCHAR || ' ' || {_NAME} ELSE 'The ' || {_NAME} END AS title FROM part)"
_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '^\\s*[\\[(][^\\])]*[\\])]\\s*', ' '), '^\\s*\\d+\\s+', ' '), '[:|–—-]\\s.*$', ' '), '\\([^)]*\\)', ' ', 'g')"
_SUBJECTS = f"""{_CHANNEL_TITLES}, sw0 AS (SELECT channel_id, pos, list_filter(regexp_extract_all({_STRIP}, '[A-Za-z][A-Za-z'']*'), lambda w: lower(w) NOT IN ({Q.listed(dicts.SCAFFOLD)}) AND length(w) > 1) AS w FROM ct),
sw1 AS (SELECT channel_id, pos, w, unnest(range(1, len(w) + 1)) AS k FROM sw0), sw2 AS (SELECT * FROM sw1 WHERE length(w[k]) >= 3 AND NOT regexp_matches(lower(w[k]), '^..+est$|^...+ly$|^.+ing$')),
sw3 AS (SELECT channel_id, pos, 2 * k AS k, w[k] AS shown FROM sw2 UNION ALL SELECT channel_id, pos, 2 * k + 1, w[k] || ' ' || w[k + 1] FROM sw2 WHERE length(w[k + 1]) >= 3),
sw4 AS (SELECT channel_id, lower(shown) AS key, count(*) AS n, arg_min(shown, (pos, k)) AS shown FROM sw3 GROUP BY 1, 2),
sw5 AS (SELECT channel_id, list({{'key': key, 'shown': shown}} ORDER BY n DESC, contains(key, ' '), length(key) DESC, key) AS r FROM sw4 GROUP BY 1),
sw6 AS (SELECT channel_id, list_reduce(r, lambda d, x: CASE WHEN len(d) >= 6 OR len(list_filter(d, lambda y: contains(y.key, x.key) OR contains(x.key, y.key))) > 0 THEN d ELSE list_append(d, x) END, []::STRUCT(key VARCHAR, shown VARCHAR)[]) AS r FROM sw5),
sub AS (SELECT channel_id, CASE WHEN len(r) > 0 THEN list_transform(r, lambda x: x.shown) ELSE ['This Topic'] END AS pool FROM (SELECT DISTINCT channel_id FROM ct) LEFT JOIN sw6 USING (channel_id))"""


@query("outlier_subjects", f"WITH {_SUBJECTS} SELECT channel_id, unnest(range(1, len(pool) + 1)) AS place, unnest(pool) AS subject FROM sub")
def _subjects(spark, sf):
    return titles.outlier_subjects(_titles(spark, sf))


def _picked(values, k: str) -> str:
    return f"[{Q.listed(map(str, values))}][({k} - 1) % {len(values)} + 1]"


_TEMPLATE = "CASE f " + " ".join(f"WHEN {Q.quoted(n)} THEN {Q.quoted(t)}" for n, (t, _) in dicts.IDEAS.items()) + " END"
_OPENING = "CASE frame " + " ".join(f"WHEN {Q.quoted(n)} THEN {Q.quoted(o)}" for n, (_, o) in dicts.IDEAS.items()) + " END"
_LEARNED = _FRAMES.replace("channel_videos", "ct")
_IDEAS = f"""{_SUBJECTS}, fr AS (SELECT channel_id, frame, count(*) AS n FROM ({_LEARNED}) GROUP BY 1, 2), fl AS (SELECT channel_id, list(frame ORDER BY n DESC, frame) AS learned FROM fr GROUP BY 1),
fo AS (SELECT channel_id, pool, coalesce(learned, []::VARCHAR[]) AS learned FROM sub LEFT JOIN fl USING (channel_id)), fp AS (SELECT *, (learned || list_filter([{Q.listed(dicts.DEFAULT_FRAMES)}], lambda f: NOT list_contains(learned, f)))[1:8] AS fs FROM fo),
fq AS (SELECT channel_id, pool, learned, unnest(range(1, len(fs) + 1)) AS place, unnest(fs) AS f FROM fp), fx AS (SELECT *, pool[(place - 1) % len(pool) + 1] AS subject FROM fq),
ft AS (SELECT channel_id, place, f AS frame, list_contains(learned, f) AS learned, subject, replace(replace(replace(replace({_TEMPLATE}, '{{subject}}', subject), '{{minutes}}', {_picked(dicts.MINUTES, 'place')}), '{{days}}', {_picked(dicts.DAYS, 'place')}), '{{count}}', {_picked([5, 6, 7], 'place')}) AS title FROM fx),
fa AS (SELECT *, row_number() OVER (PARTITION BY channel_id, lower(title) ORDER BY place) - 1 AS again FROM ft),
idea AS (SELECT channel_id, place, frame, learned, subject, CASE WHEN again > 0 THEN title || ' (' || coalesce([{Q.listed(dicts.SUFFIXES)}][again], again::VARCHAR) || ')' ELSE title END AS title FROM fa)"""


def _ideas(spark, sf):
    rows = _titles(spark, sf)
    return titles.idea_blueprints(titles.outlier_subjects(rows), titles.frame_usage(rows), rows)


@query("idea_blueprints", f"WITH {_IDEAS} SELECT * FROM idea")
def _blueprints(spark, sf):
    return _ideas(spark, sf)


_FAMILY = "['curiosity', 'story', 'claim', 'none'][place % 4 + 1]"
_WPM = "[40, 150, 320][place % 3 + 1]"
_BEATS = "[" + Q.listed(dicts.BEATS) + "]"
_FIRST = "CASE family " + " ".join(f"WHEN {Q.quoted(k)} THEN {Q.quoted(v)}" for k, v in dicts.OPENERS.items()) + f" ELSE {Q.quoted(next(iter(dicts.OPENERS.values())))} END"
_SCRIPT = f"""{_IDEAS}, hs AS (SELECT *, {_FAMILY} AS family, {_WPM} AS wpm FROM idea), ht AS (SELECT *, greatest(30, CAST(trunc(CAST(trunc(least(greatest(least(greatest(wpm::DOUBLE, 50.0), 300.0) * 35 / 60 / 0.55::DOUBLE, 20.0), 70.0)) AS INT) / 60.0::DOUBLE * wpm) AS INT)) AS target FROM hs),
hb AS (SELECT channel_id, place, target, {_FIRST} || ' ' || replace({_OPENING}, '{{subject}}', lower(subject)) AS start, list_transform(range({len(dicts.BEATS)}), lambda k: {_BEATS}[(place * 3 + k) % {len(dicts.BEATS)} + 1]) AS beats FROM ht),
hg AS (SELECT channel_id, place, target, list_reduce(beats, lambda a, x: CASE WHEN a <> start AND len(string_split(a, ' ')) >= target THEN a ELSE a || ' ' || x END, start) AS s FROM hb),
hc AS (SELECT *, array_to_string(string_split(s, ' ')[1:target], ' ') AS cut FROM hg), hd AS (SELECT *, regexp_extract(cut, '(?s)^(.*[.!?])', 1) AS whole FROM hc)"""


@query("hook_script", f"WITH {_SCRIPT} SELECT channel_id, place, CASE WHEN len(string_split(s, ' ')) <= target THEN s WHEN length(whole) - 1 > target * 0.6 THEN whole ELSE cut END AS script FROM hd")
def _scripts(spark, sf):
    opening = F.create_map(*[F.lit(x) for n, (_, o) in dicts.IDEAS.items() for x in (n, o)])
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), F.col("place") % k)
    script = titles.hook_script(F.element_at(opening, F.col("frame")), F.col("subject"), pick(["curiosity", "story", "claim", "none"], 4), pick([40, 150, 320], 3), F.col("place"))
    return _ideas(spark, sf).select("channel_id", "place", script.alias("script"))


# ---------------------------------------------------------------- replies, transcripts, tracks, records


def _replies(spark, sf):
    """A reply for each order: titles with right and wrong counts, dashes of three kinds, lines of another form."""
    k = F.col("o_orderkey")
    line = lambda n, label, dash, extra: F.concat(F.lit(f"{n}. [{label}] "), F.col("t"), F.lit(f" {extra}"), F.lit(f" {dash} "), (F.length("t") + 1 + len(extra) + k % 2).cast("string"), F.lit("/100"))
    t = F.concat(F.lit("Why "), F.col("topic"), F.lit(" Moves Markets "), (k % 5).cast("string"))
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    rows = orders.repartition(b.tasks(orders), "o_orderkey").withColumn("topic", F.initcap(F.regexp_extract("o_orderpriority", "[A-Z]+", 0))).withColumn("t", t)
    parts = [F.concat(F.lit("**Niche:** "), F.lower("o_orderstatus")), F.concat(F.lit("**Topics Mined:** "), F.lower("topic"), F.lit(", , trade")), line(1, "Why", "--", "Now"), F.lit("2) no title here"), line(2, " ", "—", "and Now"), line(3, "List", "-", "-- Trade"), F.concat(F.lit("Recommended: pick\nTitle # "), (k % 9).cast("string"))]
    return rows.select(k.alias("reply_id"), F.when(k % 11 > 0, F.array_join(F.array(*parts), "\n")).alias("text"))


def _line(n: int, label: str, dash: str, extra: str) -> str:
    return f"'{n}. [{label}] ' || t || ' {extra}' || ' {dash} ' || (length(t) + {1 + len(extra)} + o_orderkey % 2) || '/100'"


_REPLY_LINES = [("'**Niche:** ' || lower(o_orderstatus)"), "'**Topics Mined:** ' || lower(topic) || ', , trade'", _line(1, "Why", "--", "Now"), "'2) no title here'", _line(2, " ", "—", "and Now"), _line(3, "List", "-", "-- Trade"), "'Recommended: pick' || chr(10) || 'Title # ' || (o_orderkey % 9)"]
_RX = replies.TITLE_LINE
_REPLIES = f"""r0 AS (SELECT *, {_initcap("regexp_extract(o_orderpriority, '[A-Z]+')")} AS topic FROM orders), r1 AS (SELECT *, 'Why ' || topic || ' Moves Markets ' || (o_orderkey % 5) AS t FROM r0),
r2 AS (SELECT o_orderkey AS reply_id, CASE WHEN o_orderkey % 11 > 0 THEN {' || chr(10) || '.join(_REPLY_LINES)} ELSE '' END AS text FROM r1),
r3 AS (SELECT reply_id, text, trim(regexp_extract(text, '{replies.NICHE}', 1)) AS niche, list_filter(list_transform(string_split(regexp_extract(text, '{replies.TOPICS}', 1), ','), lambda x: trim(x)), lambda x: x <> '') AS topics, regexp_extract(text, '{replies.RECOMMENDED}', 1) AS pick,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_RX}')) AS lines FROM r2),
r4 AS (SELECT reply_id, niche, topics, CASE WHEN pick = '' THEN 0 ELSE greatest(0, least(4, pick::INT - 1)) END AS recommended, unnest(lines) AS line, unnest(range(len(lines))) AS slot FROM r3),
r5 AS (SELECT *, trim(regexp_extract(line, '{_RX}', 2)) AS label, regexp_extract(line, '{_RX}', 3) AS title, regexp_extract(line, '{_RX}', 4)::INT AS stated FROM r4)"""


@query("parse_llm_reply", f"WITH {_REPLIES} SELECT reply_id, niche, recommended, slot, CASE WHEN label = '' THEN 'LLM' ELSE label END AS framework, title, stated, length(title) AS measured, ({Q.master_reason('title', 'topics')}) IS NULL AS ok FROM r5")
def _parsed(spark, sf):
    return replies.reply_titles(replies.parse_replies(_replies(spark, sf)))


def _raw(spark, sf):
    """Raw snippets of each document's cues: line ends and blank ones among them; some documents have none and an error."""
    c = b.cues(spark, sf)
    text = F.when(F.col("cue_idx") % 7 == 3, F.lit(" \n ")).otherwise(F.concat(F.lit("\n"), F.replace("text", F.lit(" "), F.lit("\n"))))
    snippet = F.struct("cue_idx", text.alias("text"), (F.col("start_ms") / 1000 + 0.001).alias("start"), F.when(F.col("cue_idx") % 5 > 0, F.col("dur_ms") / 1000).alias("duration"))
    packed = c.groupBy("video_id").agg(F.array_sort(F.collect_list(snippet)).alias("s"))
    k = F.col("video_id")
    error = F.when(k % 13 == 0, F.when(k % 2 == 0, "Sign in to confirm").otherwise("no track"))
    return packed.select("video_id", F.when(error.isNull(), F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["duration"].alias("duration")))).alias("snippets"), error.alias("error"))


@query(
    "src_transcript_norm",
    f"""WITH {b.CUES}, x AS (SELECT video_id, count(*) FILTER (cue_idx % 7 <> 3) AS n_snippets, coalesce(string_agg(trim(replace(text, chr(10), ' ')), ' ' ORDER BY cue_idx) FILTER (cue_idx % 7 <> 3), '') AS t,
  round(sum(round(start_ms / 1000 + 0.001::DOUBLE, 2)) FILTER (cue_idx % 7 <> 3), 2) AS starts, round(sum(CASE WHEN cue_idx % 5 > 0 THEN dur_ms / 1000 ELSE 0.0 END) FILTER (cue_idx % 7 <> 3), 2) AS durations FROM cues GROUP BY 1)
SELECT video_id, video_id % 13 <> 0 AS available, CASE WHEN video_id % 13 = 0 THEN CASE WHEN video_id % 2 = 0 THEN 'refused' ELSE 'no captions' END END AS error, CASE WHEN video_id % 13 = 0 THEN 0 ELSE n_snippets END AS n_snippets,
CASE WHEN video_id % 13 = 0 THEN 0.0 ELSE coalesce(starts, 0.0) END AS starts, CASE WHEN video_id % 13 = 0 THEN 0.0 ELSE coalesce(durations, 0.0) END AS durations, sha256(CASE WHEN video_id % 13 = 0 THEN '' ELSE t END) AS text_sha256 FROM x""",
)
def _normalised(spark, sf):
    total = lambda f: F.round(F.aggregate("snippets", F.lit(0.0), lambda a, s: a + s[f]), 2)
    rows = transcripts.normalize_transcripts(_raw(spark, sf))
    return rows.select("video_id", "available", "error", F.size("snippets").cast("long").alias("n_snippets"), total("start").alias("starts"), total("duration").alias("durations"), F.sha2("full_text", 256).alias("text_sha256"))


_LANGS = ["de", "en", "en-orig", "fr", "en-US", "en-GB", "es"]
_EXTS = ["vtt", "srv3", "json3"]
_TRACKS = f"tr AS (SELECT l_orderkey AS video_id, [{Q.listed(_LANGS)}][(l_partkey % {len(_LANGS)} + 1)::INT] AS lang, l_suppkey % 2 = 1 AS auto, l_linenumber::BIGINT AS pos, [{Q.listed(_EXTS)}][(l_linenumber % {len(_EXTS)} + 1)::INT] AS ext, 'u' || l_orderkey || '-' || l_partkey || '-' || l_linenumber AS url FROM lineitem)"


@query(
    "src_caption_lang",
    f"""WITH {_TRACKS}, p AS (SELECT *, coalesce(list_position([{Q.listed(transcripts.LANGUAGES)}], lang), 0) AS place FROM tr), q AS (SELECT *, CASE WHEN place > 0 THEN place * 2 + auto::INT ELSE 100 + auto::INT END AS rank FROM p),
w AS (SELECT *, first_value(lang) OVER o AS l, first_value(auto) OVER o AS a FROM q WINDOW o AS (PARTITION BY video_id ORDER BY rank, pos, url)) SELECT video_id, lang, auto, pos, ext, url FROM w WHERE lang = l AND auto = a QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY ext <> 'json3', pos, url) = 1""",
)
def _track(spark, sf):
    item = b.table(spark, sf, "lineitem")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    url = F.concat(F.lit("u"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber"))
    tracks = item.select(F.col("l_orderkey").alias("video_id"), pick(_LANGS, F.col("l_partkey")).alias("lang"), (F.col("l_suppkey") % 2 == 1).alias("auto"), F.col("l_linenumber").cast("long").alias("pos"), pick(_EXTS, F.col("l_linenumber")).alias("ext"), url.alias("url"))
    return transcripts.pick_track(tracks)


_FIELDS = "clip_id, video_id, title, niche, source, start_ms, end_ms"


def _record_rows(spark, sf):
    return b.clips(spark, sf).select(*_FIELDS.split(", "))


@query("snk_clip_meta", f"WITH {b.CLIPS} SELECT {_FIELDS} FROM clips")
def _written(spark, sf):
    path = shared_path(spark, "clips")
    clip_records.write_clips(_record_rows(spark, sf), path, by="niche")
    return spark.read.schema(clip_records.SCHEMA).json(path).select(*_FIELDS.split(", "))


@query("src_clip_json", f"""WITH {b.CLIPS} SELECT CASE WHEN clip_id % 7 = 0 THEN 'corrupt' WHEN clip_id % 7 = 1 THEN 'no object' ELSE 'read' END AS status, count(*) AS n, coalesce(sum(clip_id) FILTER (clip_id % 7 > 1), 0)::BIGINT AS ids, coalesce(sum(length(title)) FILTER (clip_id % 7 > 1), 0)::BIGINT AS chars FROM clips GROUP BY 1""")
def _clip_json(spark, sf):
    """Records of which some are cut short and some are lists."""
    k, line = F.col("clip_id"), F.to_json(F.struct(*_FIELDS.split(", ")), {"ignoreNullFields": "false"})
    lines = _record_rows(spark, sf).select(F.when(k % 7 == 0, F.concat(F.lit('{"clip_id": '), F.substring(line, 3, 9))).when(k % 7 == 1, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(line).alias("value"))
    path = shared_path(spark, "clip-json")
    lines.write.text(path)
    records, unreadable = clip_records.read_clips(spark, path)
    zero = F.lit(0).cast("long")
    read = records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("clip_id"), zero).alias("ids"), F.coalesce(F.sum(F.length("title")), zero).cast("long").alias("chars")).filter("n > 0")
    return read.select(F.lit("read").alias("status"), "n", "ids", "chars").unionByName(unreadable.select(F.col("reason").alias("status"), "n", zero.alias("ids"), zero.alias("chars")))


_LOG = f"{b.CLIPS}, l AS (SELECT clip_id, source, niche, title, TIMESTAMP '2024-01-01' + to_seconds(clip_id * 37 % 86400) AS published_at FROM clips)"


def _log(spark, sf):
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("clip_id") * 37 % 86400)
    return b.clips(spark, sf).select("clip_id", "source", "niche", "title", at.alias("published_at"))


_AT = "strftime(published_at, '%Y-%m-%dT%H:%M:%S.000000+00:00')"
_RECORD = f"""SELECT 'title_decided' AS event, {_AT} AS decided_at, source, CAST(clip_id AS VARCHAR) AS video_id, '' AS filename, title AS suggested_title, '' AS short_title, '' AS winning_framework, '' AS winning_pattern, '' AS winning_keyword,
niche, '' AS hook_text, 0::BIGINT AS candidate_count, CASE WHEN clip_id % 4 > 0 THEN clip_id % 31 / 10.0::DOUBLE END AS virality_score, NULL::DOUBLE AS standalone_probability, NULL::DOUBLE AS sponsor_probability FROM l"""


@query("snk_publog", f"WITH {_LOG} {_RECORD} UNION ALL {_RECORD} WHERE clip_id % 5 = 0")
def _appended(spark, sf):
    """Two batches in one log, the second tried twice, read back with all sixteen fields."""
    path, k = shared_path(spark, "publog"), F.col("clip_id")
    rows = _log(spark, sf).withColumns({"video_id": k, "suggested_title": F.col("title"), "virality_score": F.when(k % 4 > 0, k % 31 / 10.0)})
    for name, part in (("first", rows), ("second", rows.filter("clip_id % 5 = 0")), ("second", rows.filter("clip_id % 5 = 0"))):
        publog.append_publications(publog.publication_records(part, F.col("published_at")), path, batch=name, must=True)
    return publog.read_log(spark, path)


@query("src_publog", f"WITH {_LOG} SELECT clip_id, source, niche, title, published_at FROM l WHERE clip_id % 4 > 0")
def _read_log(spark, sf):
    """A log in which every fourth record's line is blank, cut short or a list."""
    k, line = F.col("clip_id"), F.to_json(F.struct("clip_id", "source", "niche", "title", "published_at"))
    bad = F.when(k % 3 == 0, " ").when(k % 3 == 1, F.substring(line, 1, 14)).otherwise("[1]")
    path = shared_path(spark, "publog")
    _log(spark, sf).select(F.when(k % 4 > 0, line).otherwise(bad).alias("value")).write.text(path)
    return publog.read_publications(spark, path)


_PER = "CASE WHEN n > 0 THEN round(n::DOUBLE / greatest(s, 1), 1) ELSE 0.0::DOUBLE END"


@query(
    "readability_pacing",
    f"""WITH x AS (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '[^ \\n]+')) AS n, len(regexp_extract_all(coalesce(text, ''), '[.!?]')) AS s, (conv_id * 7 + turn * 13) % 90 + 100 AS wpm FROM conversations), y AS (SELECT *, {_PER} AS per FROM x)
SELECT conv_id, turn, per AS words_per_sentence, CASE WHEN n = 0 THEN 'No Speech in Hook' WHEN wpm > 165 THEN 'Fast Paced' WHEN wpm >= 130 THEN 'Conversational' ELSE 'Slow / Dramatic' END AS pacing,
CASE WHEN n = 0 THEN 'N/A' WHEN per < 14 THEN 'Easy / Conversational' WHEN per < 20 THEN 'Moderate' ELSE 'Complex / Dense' END AS readability FROM y""",
)
def _readability(spark, sf):
    text = F.coalesce("text", F.lit(""))
    wpm = (F.col("conv_id") * 7 + F.col("turn") * 13) % 90 + 100
    made = scoring.readability_pacing(F.regexp_count(text, F.lit(r"[^ \n]+")), F.regexp_count(text, F.lit("[.!?]")), wpm)
    return b.table(spark, sf, "conversations").select("conv_id", "turn", made.alias("r")).select("conv_id", "turn", "r.*")
