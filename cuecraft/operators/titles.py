"""Title candidates from patterns and topics, and the choice among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuecraft import dicts
from cuecraft.functions import text as X


_PATTERN = "pattern framework template"
_TITLE = "array<struct<pattern:string,framework:string,title:string,keyword:string>>"


def frameworks_for(niche: Column, rotation: Column, tone: str = "high_energy", limit: int = 5, core=dicts.CORE_PATTERNS, bonus=dicts.BONUS_PATTERNS, tones=dicts.TONES) -> Column:
    """Patterns (pattern, framework, template) of a niche: two of its own, then the core ones from the rotation on.

    A tone puts its frameworks first and drops none; an unknown tone is an error.
    """
    if tone not in tones:
        raise ValueError(f"unknown tone {tone!r}; one of {sorted(tones)}")
    every, n = X.literal(core, _PATTERN), len(core)
    own = X.literal([], _PATTERN)
    for name, rows in bonus.items():
        own = F.when(niche == name, X.literal(rows[:2], _PATTERN)).otherwise(own)
    start = F.pmod(rotation, F.lit(n)).cast("int")
    turned = F.concat(F.slice(every, start + 1, F.lit(n)), F.slice(every, F.lit(1), start))
    rest = F.filter(turned, lambda p: ~F.exists(own, lambda o: o["pattern"] == p["pattern"]))
    picked = F.slice(F.concat(own, rest), 1, limit)
    first = tones[tone][0]
    if not first:
        return picked
    return X._let(picked, lambda rows: F.concat(F.filter(rows, lambda p: p["framework"].isin(*first)), F.filter(rows, lambda p: ~p["framework"].isin(*first))))


def _filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def _signed(title: Column, sign: Column) -> Column:
    longer = F.concat(title, F.lit(" "), sign)
    return F.when((sign != "") & (F.length(longer) <= X.MAX_TITLE), longer).otherwise(title)


def _first_of_equals(titles: Column) -> Column:
    """Titles once each whatever their case."""
    none = F.expr(f"cast(array() AS {_TITLE})")
    seen = lambda done, x: F.exists(done, lambda d: F.lower(d["title"]) == F.lower(x["title"]))
    return F.aggregate(titles, none, lambda done, x: F.when(seen(done, x), done).otherwise(F.concat(done, F.array(x))))


def _made(pattern: Column, title: Column, keyword: Column) -> Column:
    return F.struct(pattern["pattern"].alias("pattern"), pattern["framework"].alias("framework"), title.alias("title"), keyword.alias("keyword"))


def _fallbacks(niche: Column, rotation: Column, sign: Column, patterns=dicts.FALLBACK_PATTERNS) -> Column:
    """Valid titles of a niche alone, from the rotation on."""
    every, n = X.literal(patterns, _PATTERN), len(patterns)
    start = F.pmod(rotation, F.lit(n)).cast("int")
    turned = F.concat(F.slice(every, start + 1, F.lit(n)), F.slice(every, F.lit(1), start))
    made = F.transform(turned, lambda p: _made(p, _signed(_filled(p["template"], {"cap": X.cap_phrase(niche)}), sign), niche))
    return F.filter(made, lambda t: X.validate_title(t["title"])["ok"])


def _sign_of(niche: Column, signs: dict[str, str]) -> Column:
    found = F.create_map(*[F.lit(x) for pair in signs.items() for x in pair])
    return F.coalesce(F.element_at(found, niche), F.element_at(found, F.lit("general")), F.lit(""))


def _rows(clips: DataFrame, made: Column) -> DataFrame:
    rows = clips.select("clip_id", F.posexplode(made).alias("slot", "t"))
    return rows.select("clip_id", "slot", "t.pattern", "t.framework", "t.title", "t.keyword")


def _rotated(clips: DataFrame) -> DataFrame:
    return clips if "rotation" in clips.columns else clips.withColumn("rotation", X.title_rotation(F.coalesce("text", F.lit(""))))


def master_titles(clips: DataFrame, tone: str = "high_energy", limit: int = 5, signs: dict[str, str] = dicts.SIGNS, **patterns) -> DataFrame:
    """Valid titles (clip_id, slot, pattern, framework, title, keyword) of clips (clip_id, niche, topics, and rotation or the text it comes from).

    The pattern in place s takes topic (s + rotation) mod n, so neither repeats between clips.
    Titles that break a rule are dropped, equal ones stay once; slots are counted over those that
    stay. A clip without any gets titles of its niche alone. Everything is worked out in the
    clip's row: nothing is shuffled.
    """
    rows = _rotated(clips).withColumn("topics", F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.array(F.lit("this moment"))))
    rows = rows.withColumn("frameworks", frameworks_for(F.col("niche"), F.col("rotation"), tone, limit, **patterns))
    sign = _sign_of(F.col("niche"), signs) if dicts.TONES[tone][1] else F.lit("")
    topic = lambda k: F.get("topics", F.pmod(k + F.col("rotation"), F.size("topics")))
    values = lambda k: {"kw": X.title_case(topic(k)), "kw2": X.title_case(topic(k + 1)), "n": F.lit("3"), "cap": F.initcap(topic(k))}
    title = lambda p, k: F.when(sign != "", F.concat(_filled(X.normalize_casing(p["template"]), values(k)), F.lit(" "), sign)).otherwise(_filled(X.normalize_casing(p["template"]), values(k)))
    made = F.transform("frameworks", lambda p, k: _made(p, title(p, k), topic(k)))
    rows = rows.withColumn("made", made)
    rows = rows.withColumn("made", _first_of_equals(F.filter("made", lambda t: X.validate_master_title(t["title"], F.col("topics"))["ok"])))
    none = F.expr("cast(array() AS array<string>)")
    spare = F.slice(F.filter(_fallbacks(F.col("niche"), F.col("rotation"), sign), lambda t: X.validate_master_title(t["title"], none)["ok"]), 1, limit)
    return _rows(rows, F.when(F.size("made") > 0, F.col("made")).otherwise(spare))


def seo_titles(clips: DataFrame, limit: int = 5, signs: dict[str, str] = dicts.SIGNS, patterns=dicts.SEO_PATTERNS, bonus=dicts.BONUS_PATTERNS, counts: list[int] = dicts.COUNTS) -> DataFrame:
    """The second generator, over the same clips: all patterns of the niche and the general ones.

    Step s takes pattern, topic and number at s + rotation; topics are cut to words that may stand in a title.
    What is missing to ``limit`` is filled up with titles of the niche alone.
    """
    rows = _rotated(clips).withColumn("topics", F.filter(F.transform("topics", X.sanitize_phrase), lambda t: t != ""))
    general = X.literal(patterns, _PATTERN)
    every = general
    for name, own in bonus.items():
        every = F.when(F.col("niche") == name, F.concat(X.literal(own, _PATTERN), general)).otherwise(every)
    sign, n = _sign_of(F.col("niche"), signs), F.array(*[F.lit(str(x)) for x in counts])
    rows = rows.withColumn("every", every).withColumn("sign", sign)
    turn = lambda k: k + F.col("rotation")
    pattern = lambda k: F.get("every", F.pmod(turn(k), F.size("every")))
    topic = lambda k: F.get("topics", F.pmod(turn(k), F.size("topics")))
    values = lambda k: {"kw": topic(k), "kw2": topic(k + 1), "n": F.get(n, F.pmod(turn(k), F.lit(len(counts)))), "cap": X.cap_phrase(topic(k))}
    made = F.transform(F.sequence(F.lit(0), F.size("every") - 1), lambda k: _made(pattern(k), _signed(_filled(pattern(k)["template"], values(k)), F.col("sign")), topic(k)))
    made = F.when(F.size("topics") > 0, made).otherwise(F.expr(f"cast(array() AS {_TITLE})"))
    rows = rows.withColumn("made", made)
    good = F.slice(_first_of_equals(F.filter("made", lambda t: X.validate_title(t["title"])["ok"])), 1, limit)
    rows = rows.withColumn("made", good).withColumn("spare", _fallbacks(F.col("niche"), F.col("rotation"), F.col("sign")))
    return _rows(rows, F.slice(_first_of_equals(F.concat("made", "spare")), 1, limit))


def candidates(master: DataFrame, seo: DataFrame, least: int = 3) -> DataFrame:
    """Titles of the first generator for clips where it made ``least`` or more, else those of the second."""
    enough = master.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("clip_id")
    return master.join(enough, "clip_id", "left_semi").unionByName(seo.join(enough, "clip_id", "left_anti"))


def rank_titles(titles: DataFrame, clips: DataFrame) -> DataFrame:
    """The best title of each clip by score; the earliest slot of equals."""
    hook = F.col("hook") if "hook" in clips.columns else X.extract_hook(F.coalesce("text", F.lit("")))
    rows = titles.join(clips.select("clip_id", "topics", hook.alias("__hook")), "clip_id")
    rows = rows.withColumn("score", X.score_title(F.col("title"), F.col("topics"), F.col("__hook")))
    best = rows.groupBy("clip_id").agg(F.max_by(F.struct("slot", "title", "score"), F.struct("score", -F.col("slot"))).alias("s"))
    return best.select("clip_id", "s.slot", "s.title", "s.score")


def short_title(titles: DataFrame, most: int = 50) -> DataFrame:
    """The first title that is short enough, else the first."""
    key = F.struct((F.length("title") > most).alias("long"), "slot")
    return titles.groupBy("clip_id").agg(F.min_by("title", key).alias("title"))


def accept_model_pick(ranked: DataFrame, titles: DataFrame, answers: DataFrame) -> DataFrame:
    """The model's pick (clip_id, slot, confidence, clickbait, visual) where it is valid and sure, else the local one."""
    good = answers.filter("confidence >= 0.6 AND clickbait <= 0.5 AND visual >= 0.4").join(titles.select("clip_id", "slot", F.col("title").alias("picked")), ["clip_id", "slot"])
    joined = ranked.join(good.select("clip_id", "picked", "confidence"), "clip_id", "left")
    return joined.select("clip_id", F.coalesce("picked", "title").alias("title"), F.when(F.col("picked").isNotNull(), F.col("confidence")).otherwise(0.75).alias("confidence"))


def frame_usage(titles: DataFrame, frames=dicts.FRAMES) -> DataFrame:
    """How often each channel's titles show each frame, most used first."""
    shown = F.array_compact(F.array(*[F.when(F.col("title").rlike(p), n) for n, p in frames]))
    counts = titles.select("channel_id", F.explode(shown).alias("frame")).groupBy("channel_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("channel_id").orderBy(F.desc("n"), "frame")))


def frames_or_default(titles: DataFrame, frames=dicts.FRAMES, default: list[str] = dicts.DEFAULT_FRAMES) -> DataFrame:
    """The frames of each channel (channel_id, place, frame, n), most used first, then the default ones it does not use, in their order."""
    used = frame_usage(titles, frames)
    spare = F.explode(F.arrays_zip(F.array(*map(F.lit, default)).alias("frame"), F.sequence(F.lit(1), F.lit(len(default))).alias("k"))).alias("d")
    rest = titles.select("channel_id").distinct().select("channel_id", spare).select("channel_id", "d.frame", F.lit(0).cast("long").alias("n"), "d.k").join(used.select("channel_id", "frame"), ["channel_id", "frame"], "left_anti")
    every = used.select("channel_id", "frame", "n", F.col("place").alias("k")).unionByName(rest)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("channel_id").orderBy(F.col("n") == 0, "k"))).select("channel_id", "place", "frame", "n")


def subject_freq(titles: DataFrame) -> DataFrame:
    """Subjects of each channel's titles, words of four letters or more alone and with the word behind them, with the form first seen."""
    words = F.regexp_extract_all("title", F.lit("[A-Za-z]+"), F.lit(0))
    rows = titles.select("channel_id", "pos", words.alias("w"))
    behind = lambda k: F.get("w", k + 1)
    one = lambda w, k: F.struct(F.when(F.length(w) >= 4, w).alias("word"), k.alias("k"))
    two = lambda w, k: F.struct(F.when((F.length(w) >= 4) & (F.length(behind(k)) >= 3), F.concat(w, F.lit(" "), behind(k))).alias("word"), k.alias("k"))
    seen = rows.select("channel_id", "pos", F.inline(F.concat(F.transform("w", one), F.transform("w", two)))).filter("word IS NOT NULL")
    return seen.groupBy("channel_id", F.lower("word").alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.min_by("word", F.struct("pos", "k")).alias("shown"))


def quality_metrics(best: DataFrame, made: DataFrame, dead: list[str] = dicts.DEAD) -> DataFrame:
    """Gates of a corpus in one row: best titles (clip_id, title, topics, tags) and all candidates (clip_id, framework).

    Clips, share of distinct titles, longest title, clips with three candidates or more and with two frameworks, share of dead
    templates, most tags of a clip, clips with a topic.
    """
    each = made.groupBy("clip_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("framework").alias("frameworks"))
    n, worn = F.count(F.lit(1)), F.lit(False)
    for pattern in dead:
        worn = worn | F.col("title").rlike(pattern)
    return best.join(each, "clip_id").agg(
        n.alias("clips"), F.round(F.count_distinct("title") / n, 4).alias("distinct_ratio"), F.max(F.length("title")).alias("longest"), F.count_if(F.col("candidates") >= 3).alias("three_or_more"),
        F.count_if(F.col("frameworks") >= 2).alias("two_frameworks"), F.round(F.count_if(worn) / n, 4).alias("dead_share"), F.max(F.size("tags")).alias("most_tags"), F.count_if(F.size("topics") > 0).alias("with_topic"),
    )


def _stripped(title: Column, scaffold: list[str]) -> Column:
    """Words of a title that may be its subject: no bracketed opening, no count, nothing past a dash or a colon."""
    t = F.regexp_replace(title, r"^\s*[\[(][^\])]*[\])]\s*", " ")
    t = F.regexp_replace(t, r"^\s*\d+\s+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[:|\u2013\u2014-]\s.*$", " "), r"\([^)]*\)", " ")
    return F.filter(F.regexp_extract_all(t, F.lit("[A-Za-z][A-Za-z']*"), F.lit(0)), lambda w: ~F.lower(w).isin(*scaffold) & (F.length(w) > 1))


def _may_be_subject(word: Column) -> Column:
    w = F.lower(word)
    return (F.length(w) >= 3) & ~w.rlike("^..+est$|^...+ly$|^.+ing$")


def outlier_subjects(titles: DataFrame, scaffold: list[str] = dicts.SCAFFOLD, most: int = 6, fallback: str = "This Topic") -> DataFrame:
    """What each channel's titles (channel_id, pos, title) talk about: channel_id, place, subject.

    Words and pairs of neighbours are counted whatever their case and shown as first seen. Frequent
    ones come first, single words before pairs, longer before shorter; one that holds or is held by
    a subject before it is left out. A channel without any gets the fallback.
    """
    words = titles.select("channel_id", "pos", _stripped(F.col("title"), scaffold).alias("w"))
    good = lambda k: _may_be_subject(F.get("w", k))
    two = lambda w, k: F.when((F.length(F.get("w", k + 1)) >= 3), F.concat(w, F.lit(" "), F.get("w", k + 1)))
    found = F.flatten(F.transform("w", lambda w, k: F.when(good(k), F.array(F.struct(w.alias("shown"), (2 * k).alias("k")), F.struct(two(w, k).alias("shown"), (2 * k + 1).alias("k")))).otherwise(F.array())))
    rows = words.select("channel_id", "pos", F.explode(found).alias("f")).filter("f.shown IS NOT NULL")
    counts = rows.groupBy("channel_id", F.lower("f.shown").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min_by("f.shown", F.struct("pos", "f.k")).alias("shown"))
    order = F.struct((-F.col("n")).alias("n"), F.contains("key", F.lit(" ")).alias("pair"), (-F.length("key")).alias("size"), "key", "shown")
    ranked = counts.groupBy("channel_id").agg(F.array_sort(F.collect_list(order)).alias("r"))
    none = F.expr("cast(array() AS array<struct<key:string,shown:string>>)")
    held = lambda done, x: F.exists(done, lambda d: F.contains(d["key"], x["key"]) | F.contains(x["key"], d["key"]))
    take = lambda done, x: F.when((F.size(done) >= most) | held(done, x), done).otherwise(F.concat(done, F.array(F.struct(x["key"].alias("key"), x["shown"].alias("shown")))))
    kept = ranked.select("channel_id", F.transform(F.aggregate("r", none, take), lambda x: x["shown"]).alias("kept"))
    every = titles.select("channel_id").distinct().join(kept, "channel_id", "left")
    chosen = F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.array(F.lit(fallback)))
    return every.select("channel_id", F.posexplode(chosen).alias("place", "subject")).withColumn("place", F.col("place") + 1)


def hook_script(opening: Column, subject: Column, framework: Column, wpm: Column, variant: Column, openers=dicts.OPENERS, beats: list[str] = dicts.BEATS) -> Column:
    """A spoken opening: the family's opener, the frame's sentence, beats from a place on until the words suffice.

    The number of words follows from the speed; what is beyond it is cut at the last sentence
    that ends past six tenths of it, else at the word.
    """
    speed = F.least(F.greatest(wpm.cast("double"), F.lit(50.0)), F.lit(300.0))
    seconds = F.least(F.greatest(speed * 35 / 60 / 0.55, F.lit(20.0)), F.lit(70.0)).cast("int")
    target = F.greatest(F.lit(30), (seconds / 60.0 * wpm).cast("int"))
    first = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in openers.items() for x in pair]), F.lower(F.trim(framework))), F.lit(next(iter(openers.values()))))
    start = F.concat_ws(" ", first, F.replace(opening, F.lit("{subject}"), F.lower(subject)))
    size = lambda s: F.size(F.split(s, " "))
    lines, n = F.array(*map(F.lit, beats)), len(beats)
    turned = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.get(lines, F.pmod(variant * 3 + k, F.lit(n))))
    # the first beat always comes, the next ones while words are missing
    grown = F.aggregate(turned, F.struct(start.alias("s"), F.lit(True).alias("more")), lambda a, x: F.when(a["more"], X._let(F.concat(a["s"], F.lit(" "), x), lambda s: F.struct(s.alias("s"), (size(s) < target).alias("more")))).otherwise(a), lambda a: a["s"])

    def trimmed(script: Column) -> Column:
        cut = F.array_join(F.slice(F.split(script, " "), F.lit(1), target), " ")
        whole = F.regexp_extract(cut, r"(?s)^(.*[.!?])", 1)
        return F.when(size(script) <= target, script).when(F.length(whole) - 1 > target * 0.6, whole).otherwise(cut)

    return X._let(grown, trimmed)


def idea_blueprints(subjects: DataFrame, frames: DataFrame, channels: DataFrame, ideas=dicts.IDEAS, defaults: list[str] = dicts.DEFAULT_FRAMES, most: int = 8) -> DataFrame:
    """Up to ``most`` ideas of each channel: channel_id, place, frame, learned, subject, title.

    A channel's frames (channel_id, place, frame) in order, then the default ones it does not
    show; idea i takes subject i mod their number (channel_id, place, subject) and its numbers
    in turn. A title that a channel has already gets a suffix.
    """
    none = F.expr("cast(array() AS array<string>)")
    learned = frames.groupBy("channel_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "frame"))), lambda x: x["frame"]).alias("learned"))
    pool = subjects.groupBy("channel_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "subject"))), lambda x: x["subject"]).alias("pool"))
    rows = channels.select("channel_id").distinct().join(learned, "channel_id", "left").join(pool, "channel_id", "left")
    rows = rows.withColumn("learned", F.coalesce("learned", none)).withColumn("pool", F.when(F.size("pool") > 0, F.col("pool")).otherwise(F.array(F.lit("This Topic"))))
    order = F.slice(F.concat("learned", F.array_except(F.array(*map(F.lit, defaults)), F.col("learned"))), 1, most)
    template = F.create_map(*[F.lit(x) for k, (title, _) in ideas.items() for x in (k, title)])
    pick = lambda values, k: F.get(F.array(*[F.lit(str(v)) for v in values]), F.pmod(k, F.lit(len(values))))
    subject = lambda k: F.get("pool", F.pmod(k, F.size("pool")))
    title = lambda f, k: _filled(F.element_at(template, f), {"subject": subject(k), "minutes": pick(dicts.MINUTES, k), "days": pick(dicts.DAYS, k), "count": pick([5, 6, 7], k)})
    made = F.transform(order, lambda f, k: F.struct(f.alias("frame"), F.array_contains("learned", f).alias("learned"), subject(k).alias("subject"), title(f, k).alias("title")))
    out = rows.select("channel_id", F.posexplode(made).alias("place", "i")).select("channel_id", (F.col("place") + 1).alias("place"), "i.*")
    again = F.row_number().over(Window.partitionBy("channel_id", F.lower("title")).orderBy("place")) - 1
    suffix = F.get(F.array(*map(F.lit, dicts.SUFFIXES)), again - 1)
    return out.withColumn("title", F.when(again > 0, F.concat("title", F.lit(" ("), F.coalesce(suffix, again.cast("string")), F.lit(")"))).otherwise(F.col("title")))
