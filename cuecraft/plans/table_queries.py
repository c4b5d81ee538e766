"""Queries of joins, aggregations, window functions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuecraft.operators import channels, tables
from cuecraft.plans import bindings as b
from cuecraft.plans.registry import query

_STATS = """stats AS (
  SELECT channel_id, coalesce(CAST(floor(median(views) FILTER (views > 0)) AS BIGINT), 0) AS median_views, coalesce(CAST(floor(avg(views) FILTER (views > 0)) AS BIGINT), 0) AS mean_views,
    coalesce(max(views) FILTER (views > 0), 0) AS max_views, count(*) AS n_videos FROM channel_videos GROUP BY 1),
base AS (SELECT *, CASE WHEN median_views > 0 THEN median_views WHEN mean_views > 0 THEN mean_views ELSE 1 END AS baseline FROM stats),
m AS (SELECT v.*, round(views / baseline, 2) AS multiplier FROM channel_videos v JOIN base USING (channel_id))"""


@query(
    "channel_stats",
    f"""WITH {b.CHANNEL}, {_STATS}, x AS (SELECT channel_id, count(*) FILTER (multiplier >= 1.3) AS outlier_count, max(multiplier) AS top_multiplier FROM m GROUP BY 1)
SELECT channel_id, n_videos, median_views, mean_views, max_views, outlier_count, top_multiplier, round(outlier_count / n_videos, 2) AS outlier_ratio FROM base JOIN x USING (channel_id)""",
)
def _channel_stats(spark, sf):
    return channels.channel_stats(b.channel_videos(spark, sf))


@query(
    "outlier_tiers",
    f"""WITH {b.CHANNEL}, {_STATS} SELECT channel_id, video_id, multiplier, CASE WHEN multiplier >= 4 THEN 'Mega Outlier' WHEN multiplier >= 2 THEN 'Breakout Hit'
  WHEN multiplier >= 1.3 THEN 'Above Average' WHEN multiplier >= 0.7 THEN 'Standard' ELSE 'Underperforming' END AS badge,
  CASE WHEN multiplier >= 4 THEN 1 WHEN multiplier >= 2 THEN 2 WHEN multiplier >= 1.3 THEN 3 WHEN multiplier >= 0.7 THEN 4 ELSE 5 END AS tier,
  row_number() OVER (PARTITION BY channel_id ORDER BY multiplier DESC, views DESC, video_id) AS rank FROM m""",
)
def _outliers(spark, sf):
    return channels.outlier_tiers(b.channel_videos(spark, sf)).select("channel_id", "video_id", "multiplier", "badge", "tier", "rank")


_FOUND = f"""{b.HITS}, f AS (SELECT *, 'c/' || channel_id AS url, CASE WHEN pos % 3 > 0 THEN pos % 1000 END AS subs, CASE WHEN pos % 2 = 0 THEN 'pic' || pos END AS thumbnail FROM search_hits)"""
_PICTURE = f"coalesce(thumbnail, '{channels.THUMBNAIL[0]}' || video_id || '{channels.THUMBNAIL[1]}')"


def _found(spark, sf):
    k = F.col("pos")
    return b.search_hits(spark, sf).withColumns({"url": F.concat(F.lit("c/"), F.col("channel_id").cast("string")), "subs": F.when(k % 3 > 0, k % 1000), "thumbnail": F.when(k % 2 == 0, F.concat(F.lit("pic"), k.cast("string")))})


@query(
    "channel_rollup",
    f"""WITH {_FOUND}, g AS (SELECT channel_id, count(*) AS videos_count, max(views) AS top_views, min(pos) AS pos, arg_min({{'name': name, 'url': url, 'subs': subs, 'thumbnail': {_PICTURE}}}, (pos, name, video_id)) AS x FROM f GROUP BY 1)
SELECT channel_id, videos_count, top_views, x.name AS name, x.url AS url, x.subs AS subs, x.thumbnail AS thumbnail, row_number() OVER (ORDER BY top_views DESC, pos, channel_id) AS place FROM g""",
)
def _rollup(spark, sf):
    return channels.channel_rollup(_found(spark, sf))


@query("channel_samples", f"WITH {_FOUND} SELECT channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY pos, video_id, views) AS place, video_id, 'https://www.youtube.com/watch?v=' || video_id AS url, views, {_PICTURE} AS thumbnail FROM f")
def _samples(spark, sf):
    return channels.channel_samples(_found(spark, sf))


@query(
    "popularity_rank",
    f"WITH {b.CHANNEL} SELECT channel_id, video_id, row_number() OVER (PARTITION BY channel_id ORDER BY views DESC, video_id) AS place FROM channel_videos",
)
def _popularity(spark, sf):
    return channels.popularity_rank(b.channel_videos(spark, sf)).select("channel_id", "video_id", "place")


def _registry(spark, sf):
    return b.table(spark, sf, "lineitem").filter("l_linenumber >= 5").select(F.col("l_orderkey").alias("video_id")).distinct()


@query(
    "anti_processed",
    f"""WITH {b.CHANNEL}, r AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY views DESC, video_id) AS place FROM channel_videos
  WHERE video_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 5)) SELECT channel_id, video_id, place FROM r WHERE place <= 2""",
)
def _anti(spark, sf):
    return channels.next_unprocessed(b.channel_videos(spark, sf), _registry(spark, sf), 2).select("channel_id", "video_id", "place")


@query("except_processed", "SELECT o_orderkey AS video_id FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 5")
def _except(spark, sf):
    return b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id")).subtract(_registry(spark, sf))


@query(
    "semi_rendered",
    f"""WITH {b.CHANNEL} SELECT channel_id, video_id, uploaded, row_number() OVER (PARTITION BY channel_id ORDER BY uploaded DESC, video_id) AS place
FROM channel_videos WHERE video_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def _semi(spark, sf):
    files = b.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("video_id"))
    return tables.semi_rendered(b.channel_videos(spark, sf), files)


@query(
    "dates_left",
    f"""WITH {b.CHANNEL}, f AS (SELECT l_orderkey AS video_id, max(l_shipdate) AS d FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT channel_id, video_id, coalesce(d, uploaded) AS uploaded FROM channel_videos LEFT JOIN f USING (video_id)""",
)
def _dates(spark, sf):
    feed = b.table(spark, sf, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("video_id")).agg(F.max("l_shipdate").alias("uploaded"))
    return channels.with_dates(b.channel_videos(spark, sf), feed).select("channel_id", "video_id", "uploaded")


@query(
    "src_channel_feed",
    f"""WITH {b.CHANNEL} SELECT channel_id, video_id, coalesce(nullif(CASE WHEN video_id % 11 = 0 THEN '' ELSE title END, ''), 'Untitled Video') AS title,
  CASE WHEN views % 700 > 0 THEN printf('%d:%02d', views % 700 // 60, views % 700 % 60) ELSE 'N/A' END AS duration,
  'https://i.ytimg.com/vi/' || video_id || '/hqdefault.jpg' AS thumbnail FROM channel_videos WHERE video_id % 13 <> 0""",
)
def _feed(spark, sf):
    from cuecraft.sources.feeds import normalize_channel_videos

    raw = b.channel_videos(spark, sf).select(
        "channel_id",
        F.when(F.col("video_id") % 13 != 0, F.col("video_id")).alias("video_id"),
        F.when(F.col("video_id") % 11 == 0, "").otherwise(F.col("title")).alias("title"),
        F.when(F.col("views") % 2 == 0, F.lit(None)).otherwise(F.lit(None)).cast("string").alias("thumbnail"),
        (F.col("views") % 700).alias("duration_seconds"),
    )
    return normalize_channel_videos(raw).select("channel_id", "video_id", "title", "duration", "thumbnail")


@query(
    "registry_upsert",
    """WITH e AS (SELECT user_id AS video_id, ts AS processed_at, event_type AS status, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS n, event_id FROM events),
u AS (SELECT video_id, n, processed_at, min(status) AS status FROM e GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY processed_at DESC, n DESC) AS k FROM u) SELECT video_id, processed_at, status FROM r WHERE k = 1""",
)
def _upsert(spark, sf):
    events = b.table(spark, sf, "events").select(F.col("user_id").alias("video_id"), F.col("ts").alias("processed_at"), F.col("event_type").alias("status"), "event_id")
    part = lambda k: events.filter(F.col("event_id") % 2 == k).groupBy("video_id", "processed_at").agg(F.min("status").alias("status"))
    return channels.registry_upsert(part(0), part(1))


@query("token_counts", r"""SELECT doc_id AS video_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9'']+')) AS token FROM documents) GROUP BY 1, 2""")
def _token_counts(spark, sf):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9][a-z0-9']+"), F.lit(0))
    return tables.token_counts(b.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), tokens.alias("tokens")))


_TOK = r"""t AS (SELECT doc_id AS video_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9'']+') AS a FROM documents)"""


@query(
    "bigram_counts",
    f"""WITH {_TOK} SELECT video_id, phrase, count(*) AS n FROM (SELECT video_id, x || ' ' || y AS phrase FROM (SELECT video_id, unnest(a[1:len(a) - 1]) AS x, unnest(a[2:]) AS y FROM t WHERE len(a) > 1)
WHERE x <> y AND x NOT IN ('the', 'of', 'and') AND y NOT IN ('the', 'of', 'and')) GROUP BY 1, 2""",
)
def _bigrams(spark, sf):
    from cuecraft.operators.topics import bigram_counts

    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9][a-z0-9']+"), F.lit(0))
    rows = b.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), tokens.alias("tokens"))
    return bigram_counts(rows, ["the", "of", "and"])


@query("full_text", f"WITH {b.CUES} SELECT video_id, string_agg(text, ' ' ORDER BY cue_idx) AS full_text FROM cues GROUP BY 1")
def _full_text(spark, sf):
    return tables.full_text(b.cues(spark, sf))


@query(
    "snippet_union",
    f"WITH {b.CLIPS} SELECT video_id, count(*) AS n_clips, sha256(string_agg(text, ' ' ORDER BY clip_id)) AS text_sha256 FROM clips GROUP BY 1",
)
def _snippets(spark, sf):
    return tables.snippet_union(b.clips(spark, sf)).select("video_id", "n_clips", F.sha2("text", 256).alias("text_sha256"))


@query(
    "hook_body_split",
    f"""WITH {b.CUES}, g AS (SELECT video_id, coalesce(sum(n_tok) FILTER (start_ms <= 60000), 0) AS hook_words, sum(n_tok) AS total_words, count(*) FILTER (start_ms <= 60000) AS hook_cues,
  count(*) FILTER (start_ms > 60000) AS body_cues, max(start_ms + dur_ms) FILTER (start_ms <= 60000) AS hook_end, max(start_ms + dur_ms) AS last_end FROM cues GROUP BY 1)
SELECT video_id, hook_cues, body_cues, CAST(hook_words AS BIGINT) AS hook_words, greatest(10000, least(hook_end, 70000)) AS hook_ms,
  CAST(hook_words AS BIGINT) * 60000 // greatest(10000, least(hook_end, 70000)) AS hook_wpm, CAST(total_words AS BIGINT) * 60000 // greatest(1000, last_end) AS overall_wpm FROM g""",
)
def _hook_body(spark, sf):
    from cuecraft.operators.pacing import hook_body_split

    return hook_body_split(b.cues(spark, sf))


@query(
    "niche_disagreement",
    f"WITH {b.CLIPS}, g AS (SELECT video_id, count(DISTINCT niche) AS niches FROM clips GROUP BY 1) SELECT count(*) AS videos, count(*) FILTER (niches > 1) AS disagreeing FROM g",
)
def _disagreement(spark, sf):
    from cuecraft.operators.corpus import niche_disagreement

    return niche_disagreement(b.clips(spark, sf))


@query(
    "upload_outcome",
    """SELECT user_id AS clip_id, bool_or(event_type = 'purchase') AS success, count(*) AS attempts,
  coalesce(string_agg(event_type || ':' || event_id, '; ' ORDER BY event_id) FILTER (event_type = 'error'), '') AS errors FROM events GROUP BY 1""",
)
def _outcome(spark, sf):
    from cuecraft.operators.corpus import upload_outcome

    e = b.table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ok"),
                    F.when(F.col("event_type") == "error", F.concat_ws(":", "event_type", "event_id")).alias("error"))
    return upload_outcome(rows)


@query(
    "upload_history_append",
    """SELECT user_id AS clip_id, count(*) AS n, CAST(list(event_type ORDER BY ts, event_id) AS VARCHAR[]) AS history FROM events GROUP BY 1""",
)
def _history(spark, sf):
    from cuecraft.operators.corpus import upload_history

    e = b.table(spark, sf, "events").select(F.col("user_id").alias("clip_id"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("result"))
    return upload_history(e)


@query(
    "best_clip",
    f"""WITH {b.CLIPS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY virality DESC, rubric DESC, clip_id) AS k FROM clips)
SELECT video_id, clip_id, virality, rubric FROM r WHERE k = 1""",
)
def _best(spark, sf):
    return tables.best_clip(b.clips(spark, sf))


@query(
    "pause_before",
    f"WITH {b.WORDS} SELECT video_id, word_idx, start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY word_idx) AS pause_ms FROM words",
)
def _pause(spark, sf):
    return tables.pause_before(b.words(spark, sf)).select("video_id", "word_idx", "pause_ms")


@query(
    "cue_boundary",
    rf"""WITH {b.CUES}, c AS (SELECT *, lag(start_ms + dur_ms) OVER w AS prev_end, lag(text) OVER w AS prev_text FROM cues WINDOW w AS (PARTITION BY video_id ORDER BY cue_idx))
SELECT video_id, cue_idx, prev_text IS NULL OR start_ms - prev_end >= 180 OR regexp_matches(rtrim(prev_text, ' ' || chr(10)), '[.!?]["'')\]]*$') AS opens FROM c""",
)
def _boundary(spark, sf):
    from cuecraft.operators.windows import cue_boundary

    return cue_boundary(b.cues(spark, sf)).select("video_id", "cue_idx", "opens")


@query(
    "loudness_threshold",
    f"WITH {b.LEVELS} SELECT video_id, sum(db10) / count(*) / 10 + 7 AS mean_bound, quantile_cont(db10, 0.9) / 10 AS p90 FROM levels GROUP BY 1",
)
def _loudness(spark, sf):
    return tables.loudness_bounds(b.levels(spark, sf))


@query(
    "static_shot_pairs",
    f"""WITH {b.DETECTIONS}, s AS (SELECT scene, box, x, lead(x) OVER (PARTITION BY scene ORDER BY box, x) AS nx FROM detections)
SELECT scene, box, abs(nx - x) AS shift FROM s WHERE nx IS NOT NULL AND abs(nx - x) <= 25""",
)
def _static(spark, sf):
    from cuecraft.operators.shots import static_shot_pairs

    return static_shot_pairs(b.detections(spark, sf))


@query(
    "runner_up",
    f"""WITH {b.CLIPS}, g AS (SELECT video_id, niche, sum(virality) AS score FROM clips GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM g WINDOW w AS (PARTITION BY video_id ORDER BY score DESC, niche))
SELECT video_id, niche, CAST(score AS BIGINT) AS score, CAST(second AS BIGINT) AS second FROM r WHERE k = 1""",
)
def _runner(spark, sf):
    return tables.runner_up(b.clips(spark, sf).groupBy("video_id", "niche").agg(F.sum("virality").alias("score")))


@query(
    "overlap_join",
    f"""WITH {b.CLIPS} SELECT x.video_id, x.clip_id AS a, y.clip_id AS b, least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms) AS overlap_ms FROM clips x JOIN clips y
ON x.video_id = y.video_id AND x.clip_id < y.clip_id WHERE least(x.end_ms, y.end_ms) - greatest(x.start_ms, y.start_ms) > 10000""",
)
def _overlap(spark, sf):
    from cuecraft.operators.windows import overlap_pairs

    return overlap_pairs(b.clips(spark, sf), "clip_id")


@query("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _topk(spark, sf):
    return tables.topk_global(b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 100)


@query(
    "topk_group",
    "SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3",
)
def _topk_group(spark, sf):
    rows = b.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return tables.topk_group(rows, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "k")


@query(
    "stable_priority_sort",
    "SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END, c_name, c_custkey) AS place FROM customer",
)
def _priority(spark, sf):
    from cuecraft.operators.ordering import global_place

    rows = b.table(spark, sf, "customer")
    return global_place(rows, [F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(1), F.col("c_name"), F.col("c_custkey")]).select("c_custkey", "place")


@query("union_candidates", "SELECT o_orderkey AS id, 'order' AS kind FROM orders UNION ALL SELECT l_orderkey, 'line' FROM lineitem")
def _union(spark, sf):
    a = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    return a.unionByName(b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("line").alias("kind")))


@query(
    "distinct_ci",
    "SELECT lower(o_orderpriority) AS word, arg_min(CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END, o_orderkey) AS shown, min(o_orderkey) AS pos FROM orders GROUP BY 1",
)
def _distinct(spark, sf):
    from cuecraft.operators.ordering import distinct_ci

    shown = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return distinct_ci(b.table(spark, sf, "orders").select(shown.alias("shown"), F.col("o_orderkey").alias("pos")))


@query("intersect_tokens", "SELECT l_suppkey AS k FROM lineitem INTERSECT SELECT c_custkey FROM customer")
def _intersect(spark, sf):
    return b.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k")).intersect(b.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")))


@query(
    "keyword_semi",
    f"""WITH {b.WORDS} SELECT video_id, word_idx, niche FROM (SELECT video_id, word_idx, lower(regexp_replace(word, '[^a-zA-Z0-9]', '', 'g')) AS w FROM words)
JOIN (VALUES ('the', 'common'), ('ther', 'fixture'), ('thon', 'fixture'), ('orre', 'fixture')) AS d(keyword, niche) ON w = keyword""",
)
def _keywords(spark, sf):
    from cuecraft.operators.topics import keyword_hits

    return keyword_hits(b.tokens(b.texts(spark, sf)), [("the", "common"), ("ther", "fixture"), ("thon", "fixture"), ("orre", "fixture")])


_BORDERED = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
_PARTS = f"p AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS k FROM (SELECT id, regexp_extract_all(lower(text), '{_BORDERED}') AS t FROM src)), one AS (SELECT id, t[k] AS keyword FROM p WHERE length(t[k]) >= 3 AND regexp_matches(t[k], '^[\\p{{L}}\\p{{N}}_]')), two AS (SELECT id, t[k] || ' ' || t[k + 2] AS keyword FROM p WHERE t[k + 1] = ' ' AND k + 2 <= len(t))"


@query(
    "dictionary_hits",
    f"""WITH dict AS (SELECT DISTINCT keyword FROM (WITH src AS (SELECT item_id AS id, text FROM benchmark), {_PARTS} SELECT keyword FROM one UNION ALL SELECT keyword FROM two)),
found AS (WITH src AS (SELECT doc_id AS id, text FROM documents), {_PARTS} SELECT id, keyword FROM one UNION ALL SELECT id, keyword FROM two)
SELECT keyword, count(*) AS n, count(DISTINCT id) AS texts FROM found JOIN dict USING (keyword) GROUP BY 1""",
)
def _dictionary(spark, sf):
    """All words and pairs of words of the benchmark, thousands, looked up in all documents."""
    from cuecraft.operators.patterns import dictionary_hits

    parts = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_BORDERED), F.lit(0))
    one = F.filter("t", lambda w: (F.length(w) >= 3) & w.rlike(r"^[\p{L}\p{N}_]"))
    two = F.transform("t", lambda w, k: F.when(F.get("t", k + 1) == " ", F.concat(w, F.lit(" "), F.get("t", k + 2))))
    words = b.table(spark, sf, "benchmark").select(parts.alias("t")).select(F.explode(F.concat(one, two)).alias("keyword")).filter("keyword IS NOT NULL").distinct()
    hits = dictionary_hits(b.table(spark, sf, "documents"), words, key="doc_id")
    return hits.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("texts"))


@query(
    "join_context",
    f"""WITH {b.CLIPS}, c AS (SELECT video_id, arg_max(niche, clip_id) AS context FROM clips WHERE source = 'full_transcript' GROUP BY 1) SELECT clip_id, video_id, context FROM clips JOIN c USING (video_id)""",
)
def _context(spark, sf):
    rows = b.clips(spark, sf)
    contexts = rows.filter("source = 'full_transcript'").groupBy("video_id").agg(F.max_by("niche", "clip_id").alias("context"))
    return tables.join_context(rows, contexts)[0].select("clip_id", "video_id", "context")
