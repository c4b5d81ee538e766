"""The DuckDB SQL of tokens, topics, titles and tags, built from the same dictionaries as the queries."""

from __future__ import annotations

from cuecraft import dicts
from cuecraft.plans import fixtures


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(map(quoted, words))


def structs(rows, names: str = "pattern framework template") -> str:
    fields = names.split()
    return "[" + ", ".join("{" + ", ".join(f"'{n}': {quoted(v)}" for n, v in zip(fields, row, strict=True)) + "}" for row in rows) + "]"


def stretched(w: str) -> str:
    return f"len(list_filter(range(1, length({w}) - 1), lambda i: substr({w}, i, 1) = substr({w}, i + 1, 1) AND substr({w}, i, 1) = substr({w}, i + 2, 1))) > 0"


def reaction(w: str) -> str:
    return f"({stretched(w)} OR regexp_matches(lower({w}), '^[^aeiou]*[aeiou]{{2,}}$|^(h[aeiou]){{2,}}h*$|^({'|'.join(dicts.INTERJECTIONS)})+h*$'))"


def topic_token(w: str) -> str:
    return f"(length({w}) >= 3 AND {w} NOT IN ({listed(dicts.BLOCKED)}) AND NOT regexp_matches({w}, '[0-9'']|^..+est$|^...+ly$') AND NOT {reaction(w)})"


def niche_token(w: str) -> str:
    return f"(length({w}) >= 2 AND {w} NOT IN ({listed(dicts.BLOCKED)}) AND NOT contains({w}, '''') AND NOT {reaction(w)})"


def usable_topic(t: str) -> str:
    bad = listed([*dicts.BLOCKED, *dicts.FILLERS, *dicts.PROFANE, *dicts.URL_FRAGMENTS])
    return f"(len(list_filter(string_split(lower({t}), ' '), lambda w: length(w) < 3 OR w IN ({bad}) OR suffix(w, 'ing'))) = 0)"


def cap(t: str) -> str:
    return f"(upper(substr({t}, 1, 1)) || lower(substr({t}, 2)))"


def title_case(t: str) -> str:
    p = f"string_split({t}, ' ')"
    return f"array_to_string(list_transform({p}, lambda w, k: CASE WHEN k > 1 AND k < len({p}) AND lower(w) IN ({listed(dicts.SMALL_WORDS)}) THEN lower(w) ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ')"


def casing(t: str) -> str:
    p = f"string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' ')"
    return f"array_to_string(list_transform({p}, lambda w, k: CASE WHEN k > 1 AND k < len({p}) AND lower(regexp_replace(w, '[^A-Za-z''-]', '', 'g')) IN ({listed(dicts.SMALL_WORDS)}) THEN lower(w) ELSE w END), ' ')"


def words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[A-Za-z'']+')"


def title_reason(t: str) -> str:
    w = words(t)
    return f"""CASE WHEN {t} IS NULL OR trim({t}) = '' THEN 'empty title' WHEN length({t}) > 100 THEN 'title too long'
  WHEN len(list_filter({w}, lambda one, k: k > 1 AND one = {w}[k - 1])) > 0 THEN 'title repeats a word' WHEN length({t}) - length(replace({t}, '...', '')) > 3 THEN 'multiple ellipses'
  WHEN len({w}) < 3 THEN 'title has fewer than 3 words' WHEN len(list_filter({w}, lambda one: length(one) >= 3)) = 0 THEN 'no real word in title'
  WHEN regexp_matches(regexp_replace({t}, '[A-Za-z]', '', 'g'), '\\p{{L}}') THEN 'non-ascii letter' WHEN len(list_filter({w}, lambda one: one IN ({listed(dicts.PROFANE)}))) > 0 THEN 'blocked word'
  WHEN len(list_filter({w}, lambda one: regexp_matches(one, '^(um+|uh+|erm|hmm+)$'))) > 0 THEN 'filler word' END"""


def master_reason(t: str, topics: str) -> str:
    w = words(t)
    spots = f"(CASE WHEN len({topics}) > 0 THEN flatten(list_transform({topics}, lambda one: string_split(lower(one), ' '))) ELSE {w} END)"
    return f"""CASE WHEN ({title_reason(t)}) IS NOT NULL THEN 'gate: ' || ({title_reason(t)}) WHEN len(list_filter({spots}, lambda one: one IN ({listed(dicts.URL_FRAGMENTS)}))) > 0 THEN 'URL fragment'
  WHEN len(list_distinct({w})) < len({w}) THEN 'repeated word' WHEN len(list_filter({w}, lambda one: length(one) >= 3)) < 3 THEN 'fewer than 3 real words'
  WHEN len({topics}) > 0 AND len(list_filter({topics}, lambda one: contains(lower(substr({t}, 1, 45)), lower(one)))) = 0 THEN 'no topic early on' END"""


def fillers_in(t: str) -> str:
    return f"list_sort(list_distinct(list_filter({words(t)}, lambda x: x IN ({listed(dicts.FILLERS)}))))"


def sanitized(t: str) -> str:
    return f"array_to_string(list_filter(regexp_extract_all({t}, '[A-Za-z][A-Za-z''-]*'), lambda w: length(w) > 2 AND lower(w) NOT IN ({listed([*dicts.BLOCKED, *dicts.URL_FRAGMENTS])}))[1:3], ' ')"


def slug(t: str) -> str:
    """NFKD in two steps, single characters and longer ones, from the tables that the library generates."""
    from cuecraft.functions.normal import SPELLED, decomposed

    one, several = decomposed()
    s = t
    for letter, spelled in SPELLED:
        s = f"replace({s}, '{letter}', '{spelled}')"
    s = f"translate({s}, {quoted(''.join(one))}, {quoted(''.join(one.values()))})"
    keys, values = listed(several), listed(several.values())
    s = f"list_transform([{s}], lambda s: CASE WHEN regexp_matches(s, '[^\\x00-\\x7F]') THEN array_to_string(list_transform(string_split(s, ''), lambda c: coalesce(([{values}])[list_position([{keys}], c)], c)), '') ELSE s END)[1]"
    s = f"lower(regexp_replace({s}, '[^\\x00-\\x7F]', '', 'g'))"
    s = f"trim(regexp_replace({s}, '[^a-z0-9]+', '_', 'g'), '_')"
    return f"CASE WHEN regexp_matches({t}, '(?i)https?://|www\\.|\\.com|\\.org|\\.net/|/|@[\\w.]+\\.') OR NOT regexp_matches({s}, '[a-z]') THEN '' ELSE {s} END"


#: Characters of words, and white space, as Unicode has them.
_W, _S = "\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}", "\\s\\x0B\\x{85}\\p{Z}"


def _pieces(t: str) -> str:
    """Words and what lies between them, by turns."""
    return f"regexp_extract_all({t}, '[{_W}]+|[^{_W}]+')"


def _changed(text: str, value: str) -> str:
    """The text with each piece x, the k-th of p, in place of which its value stands."""
    return f"list_transform([{_pieces(text)}], lambda p: array_to_string(list_transform(p, lambda x, k: {value}), ''))[1]"


def cleaned(t: str) -> str:
    """The rewrites of captions over lists of words: each is compared with the one before and the one behind."""
    s = f"regexp_replace(regexp_replace(replace(coalesce({t}, ''), '’', ''''), '\\[[^\\]]*\\]|\\([^)]*\\)', ' ', 'g'), '(?:^|[{_S}])>>+[{_S}]*', ' ', 'g')"
    short, long = f"[{listed(dicts.CONTRACTIONS)}]", f"[{listed(dicts.CONTRACTIONS.values())}]"
    said = lambda k: f"lower(p[{k}] || p[{k} + 1] || p[{k} + 2])"
    at = lambda k: f"coalesce(p[{k} + 1] = '''' AND list_contains({short}, {said(k)}), false)"
    s = _changed(s, f"CASE WHEN {at('k')} THEN ({long})[list_position({short}, {said('k')})] WHEN k > 1 AND {at('(k - 1)')} OR k > 2 AND {at('(k - 2)')} THEN '' ELSE x END")
    blank = lambda k: f"regexp_full_match(p[{k}], '[{_S}]+')"
    again = f"regexp_full_match(x, '[{_W}]+') AND k > 2 AND {blank('k - 1')} AND lower(p[k - 2]) = lower(x)"
    before = f"{blank('k')} AND k > 1 AND lower(p[k - 1]) = lower(p[k + 1])"
    s = _changed(s, f"CASE WHEN coalesce({again}, false) OR coalesce({before}, false) THEN '' ELSE x END")
    loud = lambda k: f"coalesce(regexp_full_match(p[{k}], '[A-Z]{{2,}}'), false)"
    s = _changed(s, f"CASE WHEN {loud('k')} AND (k > 2 AND {blank('k - 1')} AND {loud('k - 2')} OR coalesce({blank('k + 1')}, false) AND {loud('k + 2')}) THEN lower(x) ELSE x END")
    return f"trim(regexp_replace(regexp_replace({s}, '[^A-Za-z0-9''{_S}%$.,!?]', ' ', 'g'), '[{_S}]+', ' ', 'g'))"


def clean_token_list(t: str) -> str:
    raw = f"list_transform(regexp_extract_all(lower({cleaned(t)}), '[a-z0-9][a-z0-9'']+'), lambda w: trim(w, ''''))"
    return f"list_filter({raw}, lambda w: length(w) >= 2 AND w NOT IN ({listed(dicts.FILLERS)}))"


def masked(w: str, roots) -> str:
    part = lambda k: f"regexp_extract({w}, '^([^\\p{{L}}\\p{{N}}_]*)([\\p{{L}}\\p{{N}}_]+)([^\\p{{L}}\\p{{N}}_]*)$', {k})"
    n = f"length({part(2)})"
    stars = f"CASE WHEN {n} <= 2 THEN repeat('*', {n}) ELSE substr({part(2)}, 1, 1) || repeat('*', {n} - 1) END"
    return f"CASE WHEN lower(regexp_replace({w}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) NOT IN ({listed(roots)}) THEN {w} WHEN {n} = 0 THEN '****' ELSE {part(1)} || {stars} || {part(3)} END"


def markers_off(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace({t}, '\\[[^\\]]*\\]|\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g'))"


def hook(t: str, most: int = 140) -> str:
    parts = f"list_transform(string_split(regexp_replace({markers_off(t)}, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda p: trim(p))"
    good = f"list_filter({parts}, lambda p: len(regexp_extract_all(p, '[A-Za-z]+')) >= 4 AND p <> upper(p))[1]"
    return f"coalesce(CASE WHEN length({good}) <= {most} THEN {good} ELSE regexp_extract({good}, '^(.{{1,{most}}})(?:\\s|$)', 1) END, '')"


def quote(t: str) -> str:
    clauses = f"list_filter(list_transform(string_split_regex({markers_off(t)}, '[.!?,;]'), lambda c: trim(c)), lambda c: len(regexp_extract_all(c, '\\S+')) BETWEEN 4 AND 12)"
    low = "regexp_replace(lower(c), '[^\\x00-\\x7F]', 'z', 'g')"  # other letters are no ends of words
    score = f"4 * len(regexp_extract_all({low}, '\\b({'|'.join(dicts.TRIGGERS)})\\b')) + CASE WHEN regexp_matches({low}, '^(i|you|we)\\b') THEN 2 ELSE 0 END"
    return f"coalesce(list_sort(list_transform({clauses}, lambda c, k: {{'s': -({score}), 'k': k, 'c': c}}))[1].c, '')"


def score(title: str, topics: str, hook_text: str, trends: dict[str, float] | None = None) -> str:
    low = f"lower({title})"
    found = f"lower(list_filter({topics}, lambda x: contains({low}, lower(x)))[1])"
    add = lambda c, p: f"CASE WHEN {c} THEN {p}::DOUBLE ELSE 0.0::DOUBLE END"
    hooks = " + ".join(add(f"regexp_matches({low}, '{p}')", w) for p, w in dicts.HOOK_WEIGHTS)
    named = lambda t: f"contains({low}, {quoted(t)})" if " " in t else f"list_contains({words(title)}, {quoted(t)})"
    trend = " + ".join(add(named(t), w) for t, w in (trends or {"": 0}).items())
    terms = [
        f"CASE WHEN {found} IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {trend})) ELSE 0.0::DOUBLE END", add(f"regexp_matches({title}, '[\\x{{10000}}-\\x{{10FFFF}}]')", 0.5), add(f"{found} IS NOT NULL", 2.0), add(f"contains(substr({low}, 1, 45), {found})", 1.0), add(f"{found} = lower({topics}[1])", 0.6), f"least(4.0::DOUBLE, {hooks})", add(f"contains(lower({hook_text}), {found})", 1.5),
        add(f"regexp_matches({title}, '\\d')", 0.5), add(f"len({words(title)}) BETWEEN 6 AND 12", 1.0), add(f"length({title}) BETWEEN 25 AND 60", 1.0), add(f"len({fillers_in(title)}) > 0", -3.0), add(f"{found} IS NULL", -3.0), add(f"length({title}) > 85", -1.0),
    ]
    return f"round({' + '.join(terms)}, 2)"


# ---------------------------------------------------------------- common table expressions

TOKENS = f"tok AS (SELECT doc_id AS video_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ({listed(dicts.FILLERS)})) AS tokens FROM documents)"

_CLASH = "len(list_filter(q.chosen, lambda c: len(list_filter(string_split(c, ' '), lambda x: len(list_filter(r.ws, lambda y: x = y OR (length(x) > 2 AND length(y) > 2 AND (starts_with(x, y) OR starts_with(y, x))))) > 0)) > 0)) = 0"
TOPICS = f"""{TOKENS}, tk AS (SELECT video_id, unnest(range(1, len(tokens) + 1)) AS k, tokens FROM tok), tw AS (SELECT video_id, k, tokens[k] AS t FROM tk),
good AS (SELECT t FROM (SELECT DISTINCT t FROM tw) WHERE {topic_token('t')}),
us AS (SELECT tw.video_id, tw.k, good.t FROM tw LEFT JOIN good ON good.t = tw.t), ws AS (SELECT *, lead(t) OVER (PARTITION BY video_id ORDER BY k) AS t2 FROM us),
ph AS (SELECT video_id, t AS phrase, sqrt(count(*)) AS score FROM ws WHERE t IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT video_id, t || ' ' || t2, CASE WHEN count(*) >= 2 THEN 1.5 ELSE 0.4 END FROM ws WHERE t IS NOT NULL AND t2 IS NOT NULL AND t <> t2 GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, length(phrase), phrase) AS k, string_split(phrase, ' ') AS ws FROM ph WHERE score >= 0.9),
pick(video_id, n, last, chosen) AS (SELECT DISTINCT video_id, 0, 0::BIGINT, []::VARCHAR[] FROM rk
  UNION ALL SELECT q.video_id, q.n + 1, min(r.k), list_append(any_value(q.chosen), arg_min(r.phrase, r.k)) FROM pick q JOIN rk r ON r.video_id = q.video_id AND r.k > q.last WHERE q.n < 8 AND {_CLASH} GROUP BY q.video_id, q.n),
topic AS (SELECT video_id, arg_max(chosen, n) AS topics FROM pick GROUP BY 1)"""

_KEYS = ", ".join(f"({quoted(n)}, {quoted(k.replace('_', ' '))}, {k in strong.split()}, {'_' in k})" for n, (keys, strong) in fixtures.NICHES.items() for k in keys.split())
NICHE = f"""d(niche, keyword, strong, several) AS (VALUES {_KEYS}), nt AS (SELECT video_id, k, tokens[k] AS t, tokens[k] || ' ' || tokens[k + 1] AS tt FROM (SELECT video_id, tokens, unnest(range(1, len(tokens) + 1)) AS k FROM tok)),
nc AS (SELECT video_id, niche, keyword, strong, several, count(*) AS n FROM d JOIN nt ON (d.keyword = nt.t OR d.keyword = nt.tt) WHERE several OR {niche_token('keyword')} GROUP BY ALL),
ns AS (SELECT video_id, niche, round(sum(CASE WHEN several THEN 4.0::DOUBLE ELSE 1 + sqrt(n) END), 6) AS score, sum(CASE WHEN NOT strong THEN 0 WHEN several THEN 1 ELSE n END) AS strong FROM nc GROUP BY 1, 2),
nr AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, niche) AS k, coalesce(lead(score) OVER (PARTITION BY video_id ORDER BY score DESC, niche), 0.0::DOUBLE) AS second FROM ns),
niche AS (SELECT video_id, CASE WHEN score >= 3 AND strong >= 1 AND score >= 1.25 * second THEN niche ELSE 'general' END AS niche, score, second FROM nr WHERE k = 1)"""

_TAGS = "CASE coalesce(niche.niche, 'general') " + " ".join(f"WHEN {quoted(n)} THEN [{listed(t)}]" for n, t in fixtures.NICHE_TAGS.items()) + " END"
CONTEXT = f"{TOPICS}, {NICHE}, ctx AS (SELECT video_id, coalesce(topics, []) AS topics, coalesce(niche.niche, 'general') AS niche, {_TAGS} AS niche_tags FROM topic FULL JOIN niche USING (video_id))"

_STRONG = listed(fixtures.STRONG_TOPICS)
SELECTED = f"""list_transform(list_sort(list_transform(list_filter(topics, lambda t: {usable_topic('t')}), lambda t, k: {{'r': CASE WHEN contains(t, ' ') THEN CASE WHEN t IN ({_STRONG}) THEN 0 ELSE 1 END WHEN t IN ({_STRONG}) THEN 2 ELSE 3 END,
  'n': -length(t), 'k': k, 't': t}})), lambda x: x.t)[1:6]"""
_ALL = f"SELECT doc_id AS clip_id, text, coalesce(niche, 'general') AS niche, coalesce(niche_tags, [{listed(fixtures.NICHE_TAGS['general'])}]) AS niche_tags, coalesce(topics, []) AS topics FROM documents LEFT JOIN ctx ON doc_id = video_id"
CLIPS = f"{CONTEXT}, clips AS (SELECT clip_id, text, niche, niche_tags, {SELECTED} AS topics FROM ({_ALL}))"


def _crc_table() -> str:
    rows = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        rows.append(n)
    return "[" + ", ".join(map(str, rows)) + "]::UBIGINT[]"


def rotations(table: str, key: str = "clip_id", name: str = "rot") -> str:
    """crc32 mod 997 of the text, as a fold over its bytes."""
    bytes_of = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT)"
    fold = f"list_reduce(x, lambda a, y: xor(a >> 8, ({_crc_table()})[(xor(a & 255, y) + 1)::BIGINT]), 4294967295::UBIGINT)"
    return f"{name} AS (SELECT {key}, (xor({fold}, 4294967295::UBIGINT) % 997)::INT AS rotation FROM (SELECT {key}, {bytes_of} AS x FROM {table}))"


def _turned(every: str, by: str) -> str:
    return f"({every}[{by} % len({every}) + 1 : len({every})] || {every}[1 : {by} % len({every})])"


def _filled(template: str, values: dict[str, str]) -> str:
    for name, value in values.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return template


def _signed(title: str) -> str:
    return f"CASE WHEN sign <> '' AND length({title} || ' ' || sign) <= 100 THEN {title} || ' ' || sign ELSE {title} END"


_CORE, _SEO, _SPARE = structs(dicts.CORE_PATTERNS), structs(dicts.SEO_PATTERNS), structs(dicts.FALLBACK_PATTERNS)
_OWN = "CASE niche " + " ".join(f"WHEN {quoted(n)} THEN {structs(rows[:2])}" for n, rows in fixtures.BONUS_PATTERNS.items()) + " ELSE []::STRUCT(pattern VARCHAR, framework VARCHAR, template VARCHAR)[] END"
_SIGN = "CASE niche " + " ".join(f"WHEN {quoted(n)} THEN {quoted(s)}" for n, s in fixtures.SIGNS.items()) + " END"
_NO_TITLES = "[]::STRUCT(pattern VARCHAR, framework VARCHAR, title VARCHAR, keyword VARCHAR)[]"


def _made(pattern: str, title: str, keyword: str) -> str:
    return f"{{'pattern': {pattern}.pattern, 'framework': {pattern}.framework, 'title': {title}, 'keyword': {keyword}}}"


def _firsts(titles: str) -> str:
    return f"list_reduce({titles}, lambda done, x: CASE WHEN len(list_filter(done, lambda d: lower(d.title) = lower(x.title))) > 0 THEN done ELSE list_append(done, x) END, {_NO_TITLES})"


def frameworks(tone: str = "high_energy") -> str:
    """frame: clip_id, rotation, sign, frameworks of each clip."""
    first = dicts.TONES[tone][0]
    picked = f"(own || list_filter({_turned('core', 'rotation')}, lambda p: len(list_filter(own, lambda o: o.pattern = p.pattern)) = 0))[1:5]"
    tone_in = f"p.framework IN ({listed(first)})" if first else "true"
    sign = _SIGN if dicts.TONES[tone][1] else "''"
    return f"""{rotations('clips')}, own AS (SELECT clips.*, rotation, {_OWN} AS own, {_CORE} AS core, {sign} AS sign FROM clips JOIN rot USING (clip_id)),
pk AS (SELECT * EXCLUDE (own, core), {picked} AS picked FROM own), frame AS (SELECT * EXCLUDE (picked), list_filter(picked, lambda p: {tone_in}) || list_filter(picked, lambda p: NOT ({tone_in})) AS frameworks FROM pk)"""


def spare() -> str:
    return f"list_transform({_turned(_SPARE, 'rotation')}, lambda p: {_made('p', _signed(_filled('p.template', {'cap': cap('niche')})), 'niche')})"


def master(tone: str = "high_energy") -> str:
    """titles: clip_id, slot, pattern, framework, title, keyword."""
    topic = lambda k: f"tops[(({k}) - 1 + rotation) % len(tops) + 1]"
    title = _filled(casing("p.template"), {"kw": title_case(topic("k")), "kw2": title_case(topic("k + 1")), "n": "'3'"})
    return f"""{frameworks(tone)}, tops AS (SELECT *, CASE WHEN len(topics) > 0 THEN topics ELSE ['this moment'] END AS tops FROM frame),
mp AS (SELECT *, unnest(frameworks) AS p, unnest(range(1, len(frameworks) + 1)) AS k FROM tops), mt AS (SELECT *, {title} AS bare, {topic('k')} AS kw FROM mp),
mu AS (SELECT *, {_made('p', "CASE WHEN sign <> '' THEN bare || ' ' || sign ELSE bare END", 'kw')} AS x FROM mt), mv AS (SELECT clip_id, k, x FROM mu WHERE ({master_reason('x.title', 'tops')}) IS NULL),
mg AS (SELECT clip_id, list(x ORDER BY k) AS good FROM mv GROUP BY 1),
sp AS (SELECT clip_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS k FROM (SELECT clip_id, {spare()} AS s FROM tops)),
sg AS (SELECT clip_id, (list(x ORDER BY k))[1:5] AS spare FROM sp WHERE ({master_reason('x.title', '[]::VARCHAR[]')}) IS NULL GROUP BY 1),
mz AS (SELECT clip_id, CASE WHEN good IS NOT NULL THEN {_firsts('good')} ELSE spare END AS t FROM tops LEFT JOIN mg USING (clip_id) LEFT JOIN sg USING (clip_id)),
titles AS (SELECT clip_id, slot, x.pattern, x.framework, x.title, x.keyword FROM (SELECT clip_id, unnest(t) AS x, unnest(range(len(t))) AS slot FROM mz))"""


def seo() -> str:
    """seo: clip_id, slot, pattern, framework, title, keyword."""
    own = "CASE niche " + " ".join(f"WHEN {quoted(n)} THEN {structs([*rows, *dicts.SEO_PATTERNS])}" for n, rows in fixtures.BONUS_PATTERNS.items()) + f" ELSE {_SEO} END"
    topic = lambda k: f"tops[({k} + rotation) % len(tops) + 1]"
    counts = "[" + listed(map(str, dicts.COUNTS)) + "]"
    title = _filled("p.template", {"kw": "kw", "kw2": "kw2", "n": f"{counts}[(k + rotation) % {len(dicts.COUNTS)} + 1]", "cap": cap("kw")})
    both = f"({_firsts(f'coalesce(good, {_NO_TITLES})')})[1:5] || coalesce(spare, {_NO_TITLES})"
    return f"""{rotations('clips', name='srot')}, so AS (SELECT clips.* EXCLUDE (topics), rotation, {_SIGN} AS sign, {own} AS every, list_filter(list_transform(topics, lambda t: {sanitized('t')}), lambda t: t <> '') AS tops FROM clips JOIN srot USING (clip_id)),
sk AS (SELECT *, unnest(range(len(every))) AS k FROM so), sx AS (SELECT *, every[(k + rotation) % len(every) + 1] AS p, {topic('k')} AS kw, {topic('(k + 1)')} AS kw2 FROM sk WHERE len(tops) > 0), st AS (SELECT *, {title} AS bare FROM sx),
su AS (SELECT clip_id, k, {_made('p', _signed('bare'), 'kw')} AS x FROM st), sv AS (SELECT clip_id, list(x ORDER BY k) AS good FROM su WHERE ({title_reason('x.title')}) IS NULL GROUP BY 1),
sw AS (SELECT clip_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS k FROM (SELECT clip_id, {spare()} AS s FROM so)), sz AS (SELECT clip_id, list(x ORDER BY k) AS spare FROM sw WHERE ({title_reason('x.title')}) IS NULL GROUP BY 1),
sa AS (SELECT clip_id, ({_firsts(both)})[1:5] AS t FROM so LEFT JOIN sv USING (clip_id) LEFT JOIN sz USING (clip_id)),
seo AS (SELECT clip_id, slot, x.pattern, x.framework, x.title, x.keyword FROM (SELECT clip_id, unnest(t) AS x, unnest(range(len(t))) AS slot FROM sa))"""


_HOOK_OF_TEXT = hook("coalesce(text, '')")
RANKED = f"""hk AS (SELECT clip_id, topics, {_HOOK_OF_TEXT} AS hook FROM clips), rs AS (SELECT titles.clip_id, slot, title, {score('title', 'topics', 'hook')} AS score FROM titles JOIN hk USING (clip_id)),
ranked AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, slot) = 1)"""


def _distinct_ci(rows: str) -> str:
    return f"list_reduce({rows}, lambda d, x: CASE WHEN len(list_filter(d, lambda y: lower(y) = lower(x))) > 0 THEN d ELSE list_append(d, x) END, []::VARCHAR[])"


def merged(first: str, second: str) -> str:
    both = f"{first} || {second}"
    return f"({_distinct_ci(both)})[1:6]"


def _uniq(rows: str) -> str:
    return f"list_reduce({rows}, lambda d, x: CASE WHEN list_contains(d, x) THEN d ELSE list_append(d, x) END, []::VARCHAR[])"


def hashtags() -> str:
    bad = listed([*dicts.BLOCKED, *dicts.URL_FRAGMENTS])
    body = f"replace({slug('t')}, '_', '')"
    own = f"list_transform(list_filter(list_transform(topics[1:3], lambda t: {body}), lambda s: length(s) >= 3 AND s NOT IN ({bad}) AND NOT regexp_matches(s, '[0-9]')), lambda s: '#' || s)"
    budget = "least(2, greatest(0, 4 - least(3, len(topics))))"
    first = _uniq(f"['#Shorts'] || niche_tags[1:{budget}] || {own}")
    last = _uniq(f"({first})[1:5] || ['#fyp']")
    return f"({last})[1:5]"


def metadata_tags(tags: str) -> str:
    slugs = f"list_filter(list_transform(topics[1:6], lambda t: {slug('t')}), lambda s: s <> '')"
    several = f"flatten(list_transform({slugs}, lambda s: CASE WHEN regexp_matches(s, '[^s]s$') AND length(s) >= 7 THEN [replace(s, '_', ' '), regexp_replace(s, 's$', '')] ELSE [replace(s, '_', ' ')] END))"
    every = f"[replace(niche, '_', ' ')] || {several} || list_transform({tags}[1:4], lambda t: regexp_replace(t, '^#+', ''))"
    seen = f"list_filter({every}, lambda x: x IS NOT NULL AND x <> '')"
    return f"({_distinct_ci(seen)})[1:15]"


def description(platform: str, hook_text: str) -> str:
    mark = "chr(34)"
    quote_text = f"CASE WHEN {hook_text} <> '' THEN {mark} || {hook_text} || {mark} END"
    about = "CASE WHEN len(topics) > 0 THEN 'About: ' || array_to_string(topics[1:3], ', ') END"
    line, gap = "array_to_string(tags, ' ')", "chr(10) || chr(10)"
    return {"tiktok": f"concat_ws(' ', title, {line})", "instagram": f"concat_ws({gap}, title, {quote_text}, {line})", "youtube": f"concat_ws({gap}, title, {quote_text}, {about}, {line})"}[platform]
