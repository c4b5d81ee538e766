"""Thousands of keywords found in texts in one pass, and dictionaries as tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of keywords in one automaton, which is some hundred times as many bytes in each Python worker.
PIECE_CHARS = 1 << 20
#: Rows up to which a dictionary table is sent to every task; a larger one is joined.
SMALL_ROWS = 1 << 16
_automata: dict[str, object] = {}


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The table, to be sent to every task if it has at most so many rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def keyword_table(spark: SparkSession, niches: dict[str, tuple[str, str]] | DataFrame) -> DataFrame:
    """niche, keyword, strong, several (words): from a mapping or from a table of the first three; ``_`` joins words of a keyword."""
    if isinstance(niches, DataFrame):
        word = F.replace("keyword", F.lit("_"), F.lit(" "))
        return niches.select("niche", word.alias("keyword"), F.coalesce("strong", F.lit(False)).alias("strong"), F.contains(word, F.lit(" ")).alias("several")).distinct()
    rows = [(n, k.replace("_", " "), k in strong.split(), "_" in k) for n, (keys, strong) in niches.items() for k in keys.split()]
    return spark.createDataFrame(rows, "niche string, keyword string, strong boolean, several boolean")


def lower(text: str) -> str:
    """In lower case, code point by code point, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _inside(text: str, at: int) -> bool:
    """Whether a word goes on across this place: a letter, digit or underscore stands on both sides."""
    if not 0 < at < len(text):
        return False
    a, b = text[at - 1], text[at]
    return (a.isalnum() or a == "_") and (b.isalnum() or b == "_")


def _hits(automaton, text: str | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, keyword) of the occurrences that begin and end with a word."""
    low = lower(text or "")
    for last, keyword in automaton.iter(low):
        start = last + 1 - len(keyword)
        if not _inside(low, start) and not _inside(low, last + 1):
            yield start, last + 1, keyword


def _automaton(name: str, keywords: list[str]):
    """One automaton of each kind in a Python worker."""
    if name not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for keyword in keywords:
            made.add_word(keyword, keyword)
        made.make_automaton()
        _automata.clear()
        _automata[name] = made
    return _automata[name]


def dictionary_hits(rows: DataFrame, dictionary: DataFrame, key: str = "video_id", text: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Every occurrence (key, keyword, start, end) of a dictionary's keywords in texts, places in code points.

    Keywords (column keyword) count in lower case and may hold any characters; an occurrence begins and ends
    where no word goes on, words being of letters and digits of any script and ``_``. Occurrences may
    overlap. One pass over the texts for each ``piece_chars`` code points of dictionary: each piece's automaton is
    sent once and a larger dictionary takes more passes, with the same result.

    Null and empty texts and keywords have no hits, repeated keywords count once, repeated rows each. Without a
    dictionary, or rows, the result is empty. The key may be of any type and null; other columns are left out.
    """
    words = dictionary.select(F.lower("keyword").alias("keyword")).filter("keyword <> ''").distinct()
    chars = words.agg(F.sum(F.length("keyword"))).first()[0] or 0
    pieces = max(1, -(-chars // piece_chars))
    dealt = F.pmod(F.xxhash64("keyword"), F.lit(pieces))
    schema = f"key {rows.schema[key].dataType.simpleString()}, keyword string, start long, `end` long"
    found = None
    for piece in range(pieces):
        part = words.filter(dealt == piece).toArrow()["keyword"].to_pylist()
        made = _pass(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), part, schema)
        found = made if found is None else found.unionByName(made)
    return found.withColumnRenamed("key", key)


def _pass(rows: DataFrame, keywords: list[str], schema: str) -> DataFrame:
    sent, name = rows.sparkSession.sparkContext.broadcast(keywords), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.value:
            return
        automaton = _automaton(name, sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                hits = [(at + k, *hit) for k, value in enumerate(texts) for hit in _hits(automaton, value)]
                if hits:
                    owner, start, end, keyword = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(keyword, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["key", "keyword", "start", "end"])

    return rows.mapInArrow(run, schema)
