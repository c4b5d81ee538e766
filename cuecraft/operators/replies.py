"""Replies of a model in a fixed form, read line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuecraft.functions.text import _let, validate_master_title

# The form of a reply's lines.
TITLE_LINE = r"^\s*(\d)\s*[.)]\s*\[([^\]]*)\]\s*(.+?)\s*(?:--|—|–|-)\s*(\d+)\s*/\s*100\s*$"
NICHE, TOPICS, RECOMMENDED = r"(?i)\*\*Niche:\*\*[ \t]*([^\n]+)", r"(?i)\*\*Topics Mined:\*\*[ \t]*([^\n]+)", r"(?is)recommended:.*?title\s*#\s*(\d)"


def parse_replies(replies: DataFrame) -> DataFrame:
    """Replies (reply_id, text) as reply_id, niche, topics, titles, recommended.

    Titles hold slot, framework, title, stated and measured length, and whether the title may be
    used; a wrong count is kept and shown, not trusted. recommended counts from 0 to 4, 0 without
    one. Lines of another form are left out; a null reply has no titles.
    """
    text = F.coalesce("text", F.lit(""))
    topics = F.filter(F.transform(F.split(F.regexp_extract(text, TOPICS, 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = replies.select("reply_id", F.trim(F.regexp_extract(text, NICHE, 1)).alias("niche"), topics.alias("topics"), text.alias("text"))
    part = lambda line, k: F.regexp_extract(line, TITLE_LINE, k)
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(TITLE_LINE))
    label = lambda x: _let(F.trim(part(x, 2)), lambda name: F.when(name == "", "LLM").otherwise(name))
    found = F.transform(lines, lambda x, k: F.struct(k.alias("slot"), label(x).alias("framework"), part(x, 3).alias("title"), part(x, 4).cast("int").alias("stated")))
    rows = rows.withColumn("found", found)
    titles = F.transform("found", lambda t: F.struct(t["slot"], t["framework"], t["title"], t["stated"], F.length(t["title"]).alias("measured"), validate_master_title(t["title"], F.col("topics"))["ok"].alias("ok")))
    pick = F.regexp_extract("text", RECOMMENDED, 1)
    recommended = F.when(pick == "", 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(4), pick.cast("int") - 1)))
    return rows.select("reply_id", "niche", "topics", titles.alias("titles"), recommended.alias("recommended"))


def reply_titles(parsed: DataFrame) -> DataFrame:
    """One row for each title of parsed replies."""
    # the plain explode would have every title judged once more, in a filter for its size before rows are dealt
    return parsed.select("reply_id", "niche", "recommended", F.explode_outer("titles").alias("t")).filter("t IS NOT NULL").select("reply_id", "niche", "recommended", "t.*")
