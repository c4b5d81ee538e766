"""Queries of windows, intervals and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuecraft import dicts
from cuecraft.functions import scoring
from cuecraft.operators import corpus, critique, intervals, shots, windows
from cuecraft.plans import bindings as b
from cuecraft.plans.registry import query



def _windows_sql(cues: str) -> str:
    """w: the windows over a table of cues; z: each cue of each of them."""
    return rf"""{cues}, c AS (SELECT *, start_ms + dur_ms AS e, max(start_ms + dur_ms) OVER (PARTITION BY video_id) AS total FROM cues),
x AS (SELECT *, unnest(range(CAST(greatest(0, ceil((start_ms - 58500) / 20000)) AS BIGINT), CAST(least(floor((total - 35000) / 20000), floor(e / 20000)) AS BIGINT) + 1)) AS win FROM c WHERE total >= 35000),
y AS (SELECT *, first_value(start_ms) OVER (PARTITION BY video_id, win ORDER BY cue_idx) AS first FROM x WHERE start_ms <= least(win * 20000 + 58500, total)),
z AS (SELECT * FROM (SELECT *, max(e - first) OVER (PARTITION BY video_id, win ORDER BY cue_idx) AS over FROM y) WHERE over <= 58500),
g AS (SELECT video_id, win, min(start_ms) AS start_ms, max(e) AS end_ms, count(*) AS n_cues, string_agg(trim(replace(text, chr(10), ' ')), ' ' ORDER BY cue_idx) AS text FROM z GROUP BY 1, 2),
h AS (SELECT * FROM g WHERE end_ms - start_ms BETWEEN 35000 AND 58500),
w AS (SELECT * FROM (SELECT *, lag(start_ms) OVER o AS ps, lag(end_ms) OVER o AS pe FROM h WINDOW o AS (PARTITION BY video_id ORDER BY win)) WHERE ps IS NULL OR ps <> start_ms OR pe <> end_ms)"""


_WINDOWS = _windows_sql(b.CUES)

def scored_sql(windows: str) -> str:
    """s: the offline scores of the texts in w."""
    return rf"""{windows}, t AS (SELECT video_id, win, start_ms, end_ms, regexp_replace(lower(text), '[^\x00-\x7F]', 'z', 'g') AS t, greatest(1, len(regexp_extract_all(text, '\S+'))) AS n FROM w),
v AS (SELECT *, round(greatest(0.0::DOUBLE, least(3.0::DOUBLE, 1.0::DOUBLE + CASE WHEN regexp_matches(substr(t, 1, 80), '{scoring.HOOK}') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
  + least(0.8::DOUBLE, 25.0::DOUBLE * len(regexp_extract_all(t, '{scoring.STAKES}')) / n) + least(0.3::DOUBLE, 0.1::DOUBLE * len(regexp_extract_all(t, '\b\d+\b')))
  - least(0.6::DOUBLE, 10.0::DOUBLE * len(regexp_extract_all(t, '{scoring.FILLER}')) / n))), 2) AS virality,
  CASE WHEN regexp_matches(t, '{scoring.DANGLING}') THEN 0.4::DOUBLE ELSE 0.65::DOUBLE END AS standalone, CASE WHEN regexp_matches(t, '{scoring.SPONSOR}') THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS sponsor,
  CASE WHEN regexp_matches(t, '{scoring.STORY}') THEN 'compelling_story' ELSE 'high_value_insight' END AS category FROM t),
s AS (SELECT *, CASE WHEN sponsor >= 0.5 THEN round(greatest(0.0::DOUBLE, round(virality * 0.7::DOUBLE + standalone * 3.0::DOUBLE * 0.3::DOUBLE, 2) - 3.0::DOUBLE), 2)
  ELSE round(virality * 0.7::DOUBLE + standalone * 3.0::DOUBLE * 0.3::DOUBLE, 2) END AS score FROM v)"""


_SCORED = scored_sql(_WINDOWS)


def _scored(spark, sf, snap=False):
    rows = windows.sliding_windows(b.cues(spark, sf), snap=snap)
    return rows.withColumn("h", scoring.heuristic_score(F.col("text")))


@query("sliding_windows", f"WITH {_WINDOWS} SELECT video_id, win AS \"window\", start_ms, end_ms, n_cues, sha256(text) AS text_sha256 FROM w")
def _windows(spark, sf):
    rows = windows.sliding_windows(b.cues(spark, sf), snap=False)
    return rows.select("video_id", "window", "start_ms", "end_ms", "n_cues", F.sha2("text", 256).alias("text_sha256"))


_LONGER = "CASE WHEN cue_idx % 3 = 0 THEN dur_ms * 4 WHEN cue_idx % 7 = 1 THEN dur_ms * 2 ELSE dur_ms END"


@query("sliding_windows_auto", "WITH " + _windows_sql(b.CUES.replace("cues AS (", "plain AS (", 1) + f", cues AS (SELECT * REPLACE ({_LONGER} AS dur_ms) FROM plain)") + ' SELECT video_id, win AS "window", start_ms, end_ms, n_cues, sha256(text) AS text_sha256 FROM w')
def _auto_windows(spark, sf):
    """Windows over cues that stay on while the next ones come, as automatic captions do."""
    rows = windows.sliding_windows(b.cues(spark, sf).withColumn("dur_ms", F.expr(_LONGER)), snap=False)
    return rows.select("video_id", "window", "start_ms", "end_ms", "n_cues", F.sha2("text", 256).alias("text_sha256"))


@query("cue_window_join", f"WITH {_WINDOWS} SELECT video_id, count(DISTINCT win) AS windows, count(*) AS pairs FROM z GROUP BY 1")
def _cue_window(spark, sf):
    rows = windows.cue_windows(b.cues(spark, sf))
    return rows.groupBy("video_id").agg(F.count_distinct("window").alias("windows"), F.count(F.lit(1)).alias("pairs"))


_OPENS = r"""ob AS (SELECT *, lag(start_ms + dur_ms) OVER o AS prev_end, lag(text) OVER o AS prev_text FROM cues WINDOW o AS (PARTITION BY video_id ORDER BY cue_idx)),
oc AS (SELECT video_id, cue_idx, prev_text IS NULL OR start_ms - prev_end >= 180 OR regexp_matches(rtrim(prev_text, ' ' || chr(10)), '[.!?]["'')\]]*$') AS opens FROM ob),
od AS (SELECT *, coalesce(lead(opens) OVER (PARTITION BY video_id ORDER BY cue_idx), true) AS closes FROM oc)"""
_ITEM = "{'s': y.start_ms::BIGINT, 'e': y.e::BIGINT, 'o': opens, 'c': closes, 'g': regexp_matches(y.text, '" + dicts.GREETING.replace("'", "''") + "'), 't': trim(replace(y.text, chr(10), ' '))}"
_LAST_TRUE = "list_max(list_filter(list_transform(items, lambda x, k: CASE WHEN k > s AND items[n].e - x.e <= 12000 AND x.c THEN k END), lambda k: k IS NOT NULL))"
_FIRST_TRUE = "list_min(list_filter(list_transform(items, lambda x, k: CASE WHEN k > head AND x.s - items[head + 1].s <= 8000 AND ((k = head + 1 AND head > 0) OR x.o) THEN k END), lambda k: k IS NOT NULL))"
_HEAD = "least(3, n - 1, coalesce(list_min(list_filter(list_transform(items, lambda x, k: CASE WHEN NOT x.g THEN k END), lambda k: k IS NOT NULL)) - 1, n))"
_SNAPPED = f"""{_WINDOWS}, {_OPENS}, i0 AS (SELECT y.video_id, y.win, list({_ITEM} ORDER BY y.cue_idx) AS items, count(*) AS n FROM z y JOIN od USING (video_id, cue_idx) GROUP BY 1, 2),
i1 AS (SELECT *, {_HEAD} AS head FROM i0), i2 AS (SELECT *, coalesce({_FIRST_TRUE} - 1, head) AS s FROM i1), i3 AS (SELECT *, coalesce({_LAST_TRUE}, n) AS z FROM i2),
i4 AS (SELECT video_id, win, items, items[s + 1 : z] AS cut, items[head + 1 : n] AS rest FROM i3), i5 AS (SELECT video_id, win, CASE WHEN cut[-1].e - cut[1].s >= 35000 THEN cut WHEN rest[-1].e - rest[1].s >= 35000 THEN rest ELSE items END AS w FROM i4),
i6 AS (SELECT video_id, win, w[1].s AS start_ms, w[-1].e AS end_ms, len(w) AS n_cues, array_to_string(list_transform(w, lambda x: x.t), ' ') AS text FROM i5 WHERE w[-1].e - w[1].s BETWEEN 35000 AND 58500),
snapped AS (SELECT * FROM (SELECT *, lag(start_ms) OVER o AS ps, lag(end_ms) OVER o AS pe FROM i6 WINDOW o AS (PARTITION BY video_id ORDER BY win)) WHERE ps IS NULL OR ps <> start_ms OR pe <> end_ms)"""


@query("snap_window", f'WITH {_SNAPPED} SELECT video_id, win AS "window", start_ms, end_ms, n_cues, sha256(text) AS text_sha256 FROM snapped')
def _snap(spark, sf):
    rows = windows.sliding_windows(b.cues(spark, sf), snap=True)
    return rows.select("video_id", "window", "start_ms", "end_ms", "n_cues", F.sha2("text", 256).alias("text_sha256"))


_PACING = f"""{_WINDOWS}, pc AS (SELECT y.video_id, y.win, list(y.e - y.start_ms ORDER BY y.cue_idx) AS d FROM y JOIN w ON w.video_id = y.video_id AND w.win = y.win WHERE y.e - y.first <= 58500 GROUP BY 1, 2),
ps AS (SELECT *, CASE WHEN len(d) > 2 THEN len(list_filter(d[2 : len(d) - 1], lambda x: x BETWEEN 1200 AND 2500)) / (len(d) - 2)::DOUBLE ELSE 0.5::DOUBLE END AS share FROM pc),
pt AS (SELECT video_id, win, d[1] AS initial_ms, d[-1] AS payoff_ms, CASE WHEN d[1] >= 2500 THEN 4 ELSE 0 END + CASE WHEN share >= 0.4 THEN 3 ELSE 0 END + CASE WHEN d[-1] >= 3000 THEN 3 ELSE 0 END AS tenths FROM ps)"""


@query("pacing_profile", f'WITH {_PACING} SELECT video_id, win AS "window", initial_ms, payoff_ms, tenths / 10.0::DOUBLE AS cadence_score, tenths >= 6 AS follows_4phase FROM pt')
def _pacing(spark, sf):
    return windows.sliding_windows(b.cues(spark, sf), snap=False).select("video_id", "window", "pacing.*")


@query("text_heuristic_score", f'WITH {_SCORED} SELECT video_id, win AS "window", virality AS virality_score, standalone AS standalone_prob, sponsor AS sponsor_prob, category, score AS composite_score FROM s')
def _heuristic(spark, sf):
    return _scored(spark, sf).select("video_id", "window", "h.*")


@query("composite_score", "SELECT clip, round(v * 0.7::DOUBLE + s * 3.0::DOUBLE * 0.3::DOUBLE, 2) AS score FROM (SELECT o_orderkey AS clip, (o_custkey % 31) / 10.0::DOUBLE AS v, (o_orderkey % 11) / 10.0::DOUBLE AS s FROM orders)")
def _composite(spark, sf):
    o = b.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("clip"), scoring.composite_score((F.col("o_custkey") % 31) / 10.0, (F.col("o_orderkey") % 11) / 10.0, F.lit(0.0)).alias("score"))


@query(
    "greedy_non_overlap",
    f"""WITH RECURSIVE {_SCORED}, r AS (SELECT video_id, win, start_ms, end_ms, score, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, win) AS k FROM s),
f(video_id, k, chosen) AS (SELECT video_id, 0::BIGINT, []::STRUCT(a BIGINT, z BIGINT, win BIGINT, score DOUBLE)[] FROM (SELECT DISTINCT video_id FROM r)
  UNION ALL SELECT f.video_id, f.k + 1, CASE WHEN len(chosen) >= 3 OR len(list_filter(chosen, lambda c: least(c.z, r.end_ms) - greatest(c.a, r.start_ms) > 10000)) > 0 THEN chosen
    ELSE list_append(chosen, {{'a': r.start_ms::BIGINT, 'z': r.end_ms::BIGINT, 'win': r.win::BIGINT, 'score': r.score::DOUBLE}}) END FROM f JOIN r ON r.video_id = f.video_id AND r.k = f.k + 1),
l AS (SELECT video_id, arg_max(chosen, k) AS chosen FROM f GROUP BY 1)
SELECT video_id, i AS rank, chosen[i].win AS "window", chosen[i].a AS start_ms, chosen[i].z AS end_ms, chosen[i].score AS score FROM (SELECT video_id, chosen, unnest(range(1, len(chosen) + 1)) AS i FROM l)""",
)
def _greedy(spark, sf):
    rows = _scored(spark, sf).select("video_id", "window", "start_ms", "end_ms", F.col("h.composite_score").alias("score"))
    return windows.select_non_overlapping(rows)


@query(
    "stride_sample",
    f"""WITH {_WINDOWS}, n AS (SELECT video_id, win, row_number() OVER (PARTITION BY video_id ORDER BY win) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM w)
SELECT video_id, win AS "window" FROM n WHERE n <= 12 OR i IN (SELECT j * n.n // 12 FROM range(12) AS q(j))""",
)
def _stride(spark, sf):
    return windows.stride_sample(windows.sliding_windows(b.cues(spark, sf), snap=False), 12).select("video_id", "window")


def _rubric(spark, sf, snap=True):
    rows = _scored(spark, sf, snap=snap)
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
    made = scoring.rubric(F.col("text"), F.col("h.virality_score"), F.col("h.standalone_prob"), F.col("h.sponsor_prob"), F.col("h.category"), seconds, F.col("pacing.follows_4phase"))
    return rows.withColumn("rubric", made)


_HOOKED = f"regexp_matches(substr(t, 1, 60), '{scoring.HOOK}')"
_RUBRIC = f"""{_SCORED}, {_PACING[len(_WINDOWS) + 2 :]}, q0 AS (SELECT s.*, (s.end_ms - s.start_ms) / 1000.0::DOUBLE AS d, n / greatest(1.0::DOUBLE, (s.end_ms - s.start_ms) / 1000.0::DOUBLE) AS rate, tenths >= 6 AS four, {_HOOKED} AS hk FROM s JOIN pt USING (video_id, win)),
q1 AS (SELECT *, CASE WHEN hk AND virality >= 2.0 THEN 9 WHEN hk AND virality >= 1.5 THEN 8 WHEN hk OR virality >= 1.2 THEN 7 WHEN virality >= 0.8 THEN 6 ELSE 5 END AS hook0,
  CASE WHEN standalone >= 0.8 THEN 9 WHEN standalone >= 0.65 THEN 8 WHEN standalone >= 0.45 THEN 7 WHEN standalone >= 0.3 THEN 6 WHEN standalone >= 0.15 THEN 5 ELSE 4 END AS clarity0,
  CASE WHEN rate BETWEEN 2.2 AND 3.8 AND d BETWEEN 30 AND 52 THEN 9 WHEN rate BETWEEN 1.8 AND 4.2 AND d BETWEEN 25 AND 60 THEN 8 WHEN rate >= 1.4 THEN 7 ELSE 5 END AS pacing0,
  CASE WHEN virality >= 2.2 THEN 9 WHEN virality >= 1.6 THEN 8 WHEN virality >= 1.1 THEN 7 ELSE 5 END AS payoff0,
  CASE WHEN category = 'high_value_insight' AND virality >= 1.8 THEN 9 WHEN virality >= 1.2 THEN 8 ELSE 7 END AS share0 FROM q0),
q2 AS (SELECT video_id, win, CASE WHEN sponsor >= 0.5 THEN least(hook0, 3) ELSE hook0 END AS hook, CASE WHEN sponsor >= 0.5 THEN least(clarity0, 3) ELSE clarity0 END AS clarity,
  CASE WHEN four THEN least(10, greatest(pacing0 + 1, 9)) ELSE pacing0 END AS pacing, CASE WHEN sponsor >= 0.5 THEN least(payoff0, 2) ELSE payoff0 END AS payoff, CASE WHEN sponsor >= 0.5 THEN least(share0, 2) ELSE share0 END AS shareability, 9 AS subtitles FROM q1)"""


@query(
    "rubric_scores",
    f"""WITH {_RUBRIC} SELECT video_id, win AS "window", hook, clarity, pacing, payoff, shareability, subtitles, round((hook + clarity + pacing + payoff + shareability + subtitles) / 6.0::DOUBLE, 1) AS average,
list_sort([{', '.join(f"{{'s': {n}, 'k': {k}, 'n': '{n}'}}" for k, n in enumerate(scoring.CRITERIA))}])[1].n AS lowest FROM q2""",
)
def _rubric_scores(spark, sf):
    return _rubric(spark, sf, snap=False).select("video_id", "window", "rubric.*")


def _slot(slot: int, attempts: int = 4, threshold: float = 7.0) -> str:
    """Two tables: the search of one slot in a few rows, then, if it finds none, in all."""
    k = f"(({slot} * stride + x) % n + 1)"
    clash = f"len(list_filter(chosen, lambda c: least(r[{k}].z, r[c.k].z) - greatest(r[{k}].a, r[c.k].a) > 10000)) > 0"
    better = f"{{'t': st.t + 1, 'b': {k}, 'v': r[{k}].v, 'tries': st.t + 1, 'done': r[{k}].v >= {threshold}}}"
    step = f"CASE WHEN st.done OR st.t = {attempts} OR {clash} THEN st WHEN r[{k}].s < 0.55 AND (r[{k}].v > st.v OR r[{k}].v >= {threshold}) THEN {better} ELSE {{'t': st.t + 1, 'b': st.b, 'v': st.v, 'tries': st.tries, 'done': false}} END"
    start = "{'t': 0::BIGINT, 'b': 0::BIGINT, 'v': -1.0::DOUBLE, 'tries': 0::BIGINT, 'done': false}"
    fold = lambda limit: f"list_reduce(range({limit}), lambda st, x: {step}, {start})"
    narrow = f"least(n, {attempts * 5})"
    return f"""n{slot} AS (SELECT *, {fold(narrow)} AS f FROM c{slot}), a{slot} AS (SELECT * EXCLUDE (f), CASE WHEN f.b = 0 AND n > {narrow} THEN {fold('n')} ELSE f END AS f FROM n{slot}),
c{slot + 1} AS (SELECT * EXCLUDE (f, chosen), CASE WHEN f.b > 0 THEN list_append(chosen, {{'slot': {slot}, 'k': f.b, 'tries': f.tries}}) ELSE chosen END AS chosen FROM a{slot})"""


_CRITIQUE = f"""{_RUBRIC}, cw AS (SELECT s.video_id, s.win, s.start_ms, s.end_ms, s.sponsor, round((hook + clarity + pacing + payoff + shareability + subtitles) / 6.0::DOUBLE, 1) AS average FROM s JOIN q2 USING (video_id, win)),
c0 AS (SELECT video_id, list({{'w': win, 'a': start_ms::BIGINT, 'z': end_ms::BIGINT, 'v': average, 's': sponsor}} ORDER BY win) AS r, count(*) AS n, greatest(1, count(*) // 3) AS stride, []::STRUCT(slot INT, k BIGINT, tries BIGINT)[] AS chosen FROM cw GROUP BY 1), {_slot(0)}, {_slot(1)}, {_slot(2)},
picked AS (SELECT video_id, r, unnest(chosen) AS c FROM c3)"""


@query("critique_search", f'WITH {_CRITIQUE} SELECT video_id, c.slot AS slot, r[c.k].w AS "window", r[c.k].a AS start_ms, r[c.k].z AS end_ms, r[c.k].v AS average, c.tries::INT AS attempt FROM picked')
def _critique_search(spark, sf):
    rows = _rubric(spark, sf, snap=False).select("video_id", "window", "start_ms", "end_ms", F.col("rubric.average").alias("average"), F.col("h.sponsor_prob").alias("sponsor_prob"))
    return critique.critique_select(rows)


_TAKEN = f"""{_SCORED}, sr AS (SELECT video_id, list({{'a': start_ms, 'z': end_ms}} ORDER BY score DESC, win) AS r FROM s GROUP BY 1),
taken AS (SELECT video_id, len(list_reduce(r, lambda d, x: CASE WHEN len(d) >= 3 OR len(list_filter(d, lambda c: least(c.z, x.z) - greatest(c.a, x.a) > 10000)) > 0 THEN d ELSE list_append(d, x) END, []::STRUCT(a BIGINT, z BIGINT)[])) AS found FROM sr)"""


@query("shortfall_report", f"WITH {_TAKEN} SELECT doc_id AS video_id, coalesce(found, 0) AS found FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN taken ON video_id = doc_id WHERE coalesce(found, 0) < 3")
def _shortfall(spark, sf):
    rows = _scored(spark, sf).select("video_id", "window", "start_ms", "end_ms", F.col("h.composite_score").alias("score"))
    return corpus.shortfall_report(windows.select_non_overlapping(rows), b.table(spark, sf, "documents").select(F.col("doc_id").alias("video_id")), 3)


@query(
    "range_suggestions",
    """WITH v AS (SELECT o_orderkey AS video_id, CAST(floor(o_totalprice) AS BIGINT) % 900 AS n FROM orders), p AS (SELECT *, CAST(round(n / 2) AS BIGINT) AS h, CAST(least(300, round(n * 0.25::DOUBLE)) AS BIGINT) AS i FROM v),
q AS (SELECT *, CAST(greatest(i + 60, round(n * 0.65::DOUBLE)) AS BIGINT) AS c FROM p)
SELECT video_id, 'Full Video' AS label, 0 AS start_s, n AS end_s FROM q UNION ALL SELECT video_id, 'First Half', 0, h FROM q WHERE n BETWEEN 120 AND 419 UNION ALL SELECT video_id, 'Second Half', h, n FROM q WHERE n BETWEEN 120 AND 419
UNION ALL SELECT video_id, 'Opening / Intro', 0, i FROM q WHERE n >= 420 UNION ALL SELECT video_id, 'Middle Section', i, c FROM q WHERE n >= 420 UNION ALL SELECT video_id, 'Climax / Ending', c, n FROM q WHERE n >= 420""",
)
def _ranges(spark, sf):
    rows = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), (F.floor("o_totalprice").cast("long") % 900).alias("seconds"))
    return windows.range_suggestions(rows)


@query(
    "merge_intervals",
    f"""WITH {b.WORDS}, p AS (SELECT video_id, greatest(0, start_ms - 60) AS s, end_ms + 60 AS e FROM words WHERE length(word) >= 9),
q AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + 80 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e) AS k FROM q) SELECT video_id, min(s) AS start_ms, max(e) AS end_ms FROM i GROUP BY video_id, k""",
)
def _merge(spark, sf):
    return intervals.merge_intervals(b.words(spark, sf).filter(F.length("word") >= 9))


_PAIRS = f"""{b.SILENCE}, e AS (SELECT *, lag(kind) OVER w AS pk, lag(ts_ms) OVER w AS pt, lead(kind) OVER w AS nk, max(ts_ms) OVER (PARTITION BY video_id) AS total FROM silence_events WINDOW w AS (PARTITION BY video_id ORDER BY seq)),
pairs AS (SELECT video_id, total, CASE WHEN kind = 'start' THEN ts_ms WHEN pk = 'start' THEN pt ELSE 0 END AS start_ms, CASE WHEN kind = 'end' THEN ts_ms ELSE total END AS end_ms FROM e WHERE kind = 'end' OR nk IS NULL)"""


@query("silence_pairs", f"WITH {_PAIRS} SELECT video_id, start_ms, end_ms FROM pairs WHERE end_ms > start_ms")
def _silence(spark, sf):
    return intervals.silence_pairs(b.silence_events(spark, sf)).select("video_id", "start_ms", "end_ms")


@query(
    "keep_intervals",
    f"""WITH {_PAIRS}, a AS (SELECT DISTINCT video_id, start_ms + 350 AS start_ms, end_ms, total FROM pairs WHERE end_ms > start_ms AND start_ms > 0), l AS (SELECT * FROM a WHERE end_ms - start_ms >= 250),
k AS (SELECT video_id, total, coalesce(lag(greatest(least(total, start_ms + 200), end_ms - 50)) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms), 0) AS s, least(total, start_ms + 200) AS e FROM l
  UNION ALL SELECT x.video_id, x.total, coalesce(y.s, 0), x.total FROM (SELECT DISTINCT video_id, total FROM a) x LEFT JOIN (SELECT video_id, max(end_ms - 50) AS s FROM l GROUP BY 1) y USING (video_id)),
m AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, max(e - s) OVER (PARTITION BY video_id) AS longest FROM k WHERE e - s >= 150) SELECT video_id, s AS start_ms, e AS end_ms FROM m WHERE NOT (n = 1 AND longest >= total - 200)""",
)
def _keep(spark, sf):
    rows = intervals.silence_pairs(b.silence_events(spark, sf)).filter("start_ms > 0").withColumn("start_ms", F.col("start_ms") + 350).distinct()
    return intervals.keep_intervals(rows)


@query(
    "level_spikes",
    f"""WITH RECURSIVE {b.LEVELS}, m AS (SELECT video_id, sum(db10) / count(*) AS mean FROM levels GROUP BY 1), c AS (SELECT video_id, hop * 200 AS t FROM levels JOIN m USING (video_id) WHERE db10 > mean + 70),
r(video_id, t) AS (SELECT video_id, min(t) FROM c GROUP BY 1 UNION ALL SELECT r.video_id, (SELECT min(c.t) FROM c WHERE c.video_id = r.video_id AND c.t >= r.t + 2200) FROM r WHERE r.t IS NOT NULL)
SELECT video_id, t AS start_ms, t + 1200 AS end_ms FROM r WHERE t IS NOT NULL""",
)
def _spikes(spark, sf):
    return intervals.level_spikes(b.levels(spark, sf))


@query(
    "level_peaks",
    f"""WITH {b.LEVELS}, p AS (SELECT video_id, quantile_cont(db10, 0.9) AS p90 FROM levels GROUP BY 1), h AS (SELECT video_id, list((hop * 250)::BIGINT ORDER BY db10 DESC, hop) AS r FROM levels JOIN p USING (video_id) WHERE db10 >= p90 GROUP BY 1),
k AS (SELECT video_id, unnest(list_reduce(r, lambda d, x: CASE WHEN len(d) >= 4 OR len(list_filter(d, lambda c: abs(c - x) < 7000)) > 0 THEN d ELSE list_append(d, x) END, []::BIGINT[])) AS t FROM h) SELECT video_id, t AS start_ms, t + 1250 AS end_ms FROM k""",
)
def _peaks(spark, sf):
    return intervals.level_peaks(b.levels(spark, sf))


@query(
    "change_points",
    f"""WITH RECURSIVE {b.LEVELS}, d AS (SELECT video_id, hop * 150 AS t, db10 FROM levels), c AS (SELECT video_id, t FROM d WHERE db10 > 280),
r(video_id, t) AS (SELECT DISTINCT video_id, 0::BIGINT FROM d UNION ALL SELECT r.video_id, (SELECT min(c.t) FROM c WHERE c.video_id = r.video_id AND c.t >= r.t + 800) FROM r WHERE r.t IS NOT NULL)
SELECT video_id, t AS t_ms FROM r WHERE t IS NOT NULL UNION SELECT video_id, max(t) FROM d GROUP BY 1""",
)
def _changes(spark, sf):
    return intervals.change_points(b.frame_diffs(spark, sf))


def _lines(full: str) -> str:
    """lines: video_id, word_idx, start_ms, end_ms, word, line, for a rule of when a line is full."""
    return f"""{b.WORDS}, l0 AS (SELECT *, coalesce(start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY word_idx) > 320, true) AS pause FROM words), l1 AS (SELECT *, sum(pause::INT) OVER (PARTITION BY video_id ORDER BY word_idx) AS run FROM l0),
l2 AS (SELECT video_id, run, list({{'i': word_idx::BIGINT, 's': start_ms::BIGINT, 'e': end_ms::BIGINT, 'z': length(word)::BIGINT}} ORDER BY word_idx) AS ws FROM l1 GROUP BY 1, 2),
l3 AS (SELECT video_id, unnest(list_reduce(ws, lambda a, x: CASE WHEN a.n = 0 OR {full} THEN {{'n': 1::BIGINT, 'b': x.s, 'o': list_append(a.o, x.i)}} ELSE {{'n': a.n + 1, 'b': a.b, 'o': a.o}} END, {{'n': 0::BIGINT, 'b': 0::BIGINT, 'o': []::BIGINT[]}}).o) AS word_idx FROM l2),
lines AS (SELECT words.*, sum((l3.word_idx IS NOT NULL)::INT) OVER (PARTITION BY words.video_id ORDER BY words.word_idx) - 1 AS line FROM words LEFT JOIN l3 ON l3.video_id = words.video_id AND l3.word_idx = words.word_idx)"""


_SPAN, _LEN = _lines("a.n >= 3 OR x.e - a.b > 1500"), _lines("a.n >= 4 OR (a.n >= 3 AND x.z > 5)")
_GROUPED = "g AS (SELECT video_id, line, min(start_ms) AS start_ms, max(end_ms) AS last_ms, string_agg(word, ' ' ORDER BY word_idx) AS text FROM lines GROUP BY 1, 2), n AS (SELECT *, lead(start_ms) OVER (PARTITION BY video_id ORDER BY line) AS after FROM g)"


@query("phrase_chunks", f"WITH {_SPAN} SELECT video_id, word_idx, line::BIGINT AS line FROM lines")
def _chunks(spark, sf):
    return intervals.chunk_words(b.words(spark, sf))


@query("phrase_chunks_len", f"WITH {_LEN}, {_GROUPED} SELECT video_id, line::BIGINT AS line, start_ms, greatest(200, least(coalesce(after, last_ms + 200), last_ms + 80) - start_ms) AS length_ms FROM n")
def _chunks_len(spark, sf):
    return intervals.line_spans(intervals.chunk_words(b.words(spark, sf), rule="len", keep=("start_ms", "end_ms")))


@query("caption_events", f"WITH {_SPAN}, {_GROUPED}, e AS (SELECT *, least(last_ms + 350, coalesce(after - 20, last_ms + 350)) AS held FROM n) SELECT video_id, line::BIGINT AS line, start_ms, CASE WHEN held <= start_ms THEN greatest(last_ms, start_ms + 80) ELSE held END AS end_ms, text FROM e")
def _captions(spark, sf):
    return intervals.caption_events(intervals.chunk_words(b.words(spark, sf), keep=("start_ms", "end_ms", "word")))


_HELD = "CASE WHEN next > start_ms THEN least(end_ms + 350, next) ELSE end_ms + 350 END"


@query(
    "caption_word_events",
    f"""WITH {_SPAN}, r AS (SELECT video_id, line, word_idx, start_ms - start_ms % 1000 AS start_ms, end_ms FROM lines), f AS (SELECT video_id, line, lead(min(start_ms)) OVER (PARTITION BY video_id ORDER BY line) AS next,
  list({{'i': word_idx::BIGINT, 's': start_ms::BIGINT, 'e': end_ms::BIGINT}} ORDER BY word_idx) AS w FROM r GROUP BY 1, 2),
m AS (SELECT video_id, line, next, list_reduce(w, lambda d, x: list_append(d, {{'i': x.i, 's': CASE WHEN len(d) > 0 AND x.s <= d[-1].s THEN d[-1].s + 40 ELSE x.s END, 'e': x.e}}), []::STRUCT(i BIGINT, s BIGINT, e BIGINT)[]) AS w FROM f),
x AS (SELECT video_id, line, next, unnest(w) AS w, unnest(w[2:] || [NULL]) AS after FROM m), y AS (SELECT video_id, line, next, w.i AS word_idx, w.s AS start_ms, w.e AS end_ms, after.s AS after FROM x)
SELECT video_id, line::BIGINT AS line, word_idx::INT AS word_idx, start_ms, coalesce(after, CASE WHEN {_HELD} <= start_ms THEN greatest(end_ms, start_ms + 80) ELSE {_HELD} END) AS end_ms FROM y""",
)
def _word_events(spark, sf):
    """Words whose starts fall on whole seconds, so that some begin together."""
    lined = intervals.chunk_words(b.words(spark, sf), keep=("start_ms", "end_ms"))
    return intervals.word_events(lined.withColumn("start_ms", F.col("start_ms") - F.col("start_ms") % 1000))


@query("karaoke_spans", f"WITH {_SPAN}, k AS (SELECT *, lead(start_ms) OVER (PARTITION BY video_id, line ORDER BY word_idx) - end_ms AS gap FROM lines) SELECT video_id, word_idx, line::BIGINT AS line, greatest(8, round_even((end_ms - start_ms) / 10, 0)::BIGINT) AS fill_cs, CASE WHEN gap > 50 THEN round_even(gap / 10, 0)::BIGINT ELSE 0 END AS gap_cs FROM k")
def _karaoke(spark, sf):
    return intervals.karaoke_spans(intervals.chunk_words(b.words(spark, sf), keep=("start_ms", "end_ms")))


_CUE_WORDS = ["the", "ther", "of the", "thon", "was"]
_KNOWN = ", ".join(f"'{k}'" for k in _CUE_WORDS)


@query(
    "keyword_cues",
    f"""WITH {b.WORDS}, a AS (SELECT video_id, word_idx, start_ms, lower(regexp_replace(word, '[^a-zA-Z0-9]', '', 'g')) AS one, max(end_ms) OVER (PARTITION BY video_id) AS total FROM words), t AS (SELECT *, one || coalesce(' ' || lead(one) OVER (PARTITION BY video_id ORDER BY word_idx), '') AS two FROM a),
h AS (SELECT video_id, start_ms, total, CASE WHEN two IN ({_KNOWN}) THEN two WHEN one IN ({_KNOWN}) THEN one END AS keyword FROM t WHERE start_ms >= 4000 AND start_ms < greatest(4000, total - 4000) - 1000),
l AS (SELECT video_id, list({{'s': start_ms::BIGINT, 'k': keyword, 'e': least(start_ms + 3500, greatest(4000, total - 4000))::BIGINT}} ORDER BY start_ms, keyword) AS r FROM h WHERE keyword IS NOT NULL GROUP BY 1),
k AS (SELECT video_id, unnest(list_reduce(r, lambda d, x: CASE WHEN len(d) < 2 AND x.s - coalesce(d[-1].e, -10000) >= 12000 AND x.e - x.s >= 1000 THEN list_append(d, x) ELSE d END, []::STRUCT(s BIGINT, k VARCHAR, e BIGINT)[])) AS c FROM l) SELECT video_id, c.k AS keyword, c.s AS start_ms, c.e AS end_ms FROM k""",
)
def _keyword_cues(spark, sf):
    return intervals.keyword_cues(b.words(spark, sf), _CUE_WORDS)


_D = b.DETECTIONS


@query(
    "dominant_cluster",
    f"""WITH {_D}, c AS (SELECT *, x + w / 2 AS cx, w * h AS area FROM detections), l AS (SELECT scene, cx AS main FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY area DESC, box, cx) AS k FROM c) WHERE k = 1)
SELECT scene, count(*) AS n, median(cx) AS centre, min(x) AS x0, max(x + w) AS x1 FROM c JOIN l USING (scene) WHERE abs(cx - main) <= 300 GROUP BY 1""",
)
def _cluster(spark, sf):
    return shots.dominant_cluster(b.detections(spark, sf))


@query(
    "wide_scenes",
    f"WITH {_D}, f AS (SELECT scene, t, count(*) AS n, min(x) AS x0, max(x + w) AS x1 FROM detections GROUP BY 1, 2) SELECT scene, max(n) >= 3 OR max(x1) - min(x0) > 528 AS wide FROM f GROUP BY 1",
)
def _wide(spark, sf):
    return shots.wide_scenes(b.detections(spark, sf))


@query("motion_centroid", f"WITH {_D} SELECT scene, sum(x * w) / sum(w) AS centroid FROM detections GROUP BY 1 HAVING avg(w) >= 100")
def _motion(spark, sf):
    return shots.motion_centroid(b.detections(spark, sf).withColumnRenamed("w", "motion"), 100)


_SEGMENTS = f"""{_D}, sg AS (SELECT scene, list({{'x': x::BIGINT, 'n': 1::BIGINT}} ORDER BY box, x) AS r FROM detections GROUP BY 1),
sm AS (SELECT scene, list_reduce(r, lambda d, s: CASE WHEN len(d) > 0 AND abs(s.x - d[-1].x) < 35 THEN list_append(d[1 : len(d) - 1], {{'x': d[-1].x, 'n': d[-1].n + 1}}) ELSE list_append(d, s) END, []::STRUCT(x BIGINT, n BIGINT)[]) AS r FROM sg),
seg AS (SELECT scene, unnest(range(len(r)))::INT AS segment, unnest(r).x AS x, unnest(r).n AS shots FROM sm)"""


@query("merge_segments", f"WITH {_SEGMENTS} SELECT scene, segment, x, shots FROM seg")
def _segments(spark, sf):
    return intervals.merge_segments(b.detections(spark, sf))


_JUMP = "(s.x - d[-1].y)"
_DAMPED = f"d[-1].y + sign({_JUMP})::BIGINT * (90 + round_even(0.35::DOUBLE * (abs({_JUMP}) - 90), 0)::BIGINT)"


@query(
    "damp_jumps",
    f"""WITH {_SEGMENTS}, dl AS (SELECT scene, list({{'k': segment::BIGINT, 'x': x, 'y': x}} ORDER BY segment) AS r FROM seg GROUP BY 1),
dd AS (SELECT scene, unnest(list_reduce(r, lambda d, s: list_append(d, {{'k': s.k, 'x': s.x, 'y': CASE WHEN len(d) > 0 AND abs({_JUMP}) > 90 THEN {_DAMPED} ELSE s.x END}}), []::STRUCT(k BIGINT, x BIGINT, y BIGINT)[])) AS s FROM dl) SELECT scene, s.k::INT AS segment, s.x AS x, s.y AS damped FROM dd""",
)
def _damp(spark, sf):
    return intervals.damp_jumps(intervals.merge_segments(b.detections(spark, sf)))


@query(
    "shot_labels",
    f"""WITH {_D}, o AS (SELECT scene, box, w, row_number() OVER (PARTITION BY scene ORDER BY box, x, w) AS k, count(*) OVER (PARTITION BY scene) AS n FROM detections)
SELECT scene, k AS box, CASE WHEN w > 150 THEN 'wide' WHEN w % 8 <> 0 THEN 'medium close-up' ELSE 'talking head' END AS framing, CASE WHEN k = n THEN 'cut-on-action' WHEN k % 2 = 1 THEN 'L-cut' ELSE 'J-cut' END AS cut FROM o""",
)
def _labels(spark, sf):
    from pyspark.sql import Window

    own = Window.partitionBy("scene").orderBy("box", "x", "w")
    rows = b.detections(spark, sf).select("scene", F.row_number().over(own).alias("box"), (F.col("w") > 150).alias("wide"), (F.col("w") % 8).alias("faces"))
    return shots.shot_labels(rows)


@query(
    "classify_hook_frameworks",
    "WITH t AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), f AS (SELECT conv_id, turn, list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in scoring.FRAMEWORKS)
    + "], lambda x: x IS NOT NULL) AS f FROM t) SELECT conv_id, turn, CASE WHEN len(f) > 0 THEN f ELSE ['" + scoring.NO_FRAMEWORK + "'] END AS frameworks FROM f",
)
def _frameworks(spark, sf):
    return b.table(spark, sf, "conversations").select("conv_id", "turn", scoring.classify_hook_frameworks(F.col("text")).alias("frameworks"))
