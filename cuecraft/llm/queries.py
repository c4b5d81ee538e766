"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import as_log, format_chat, read_chat
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup, normalised
from .html_text import extract_text
from .html_text import fit as fit_layouts
from .infill import fill_in_middle, restored
from .lm import score_documents
from .ngram_join import similar
from .packing import pack
from .rans import ids_round_trip
from .repeats import repeated
from .tokens import tokenizer_path
from .toxicity import THRESHOLD, fit, held_out, score_toxicity
from .trie import conversation_trie
from .warc import warc_round_trip


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256))
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, fit_layouts(pages)).select("page_id", "url", "text", "n_chars")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("repeated_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeated(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("repeated_spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(_read(spark, sf_dir, "documents"), percent=85, n=4)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.size + y.size - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, low) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT b, low FROM reach JOIN both_ways ON a = reach.doc_id WHERE low < b
)
SELECT doc_id, coalesce(max(n.size), 0) AS n_shingles, min(low) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_round_trip(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_round_trip(_read(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def contaminated(hits: DataFrame) -> DataFrame:
    """With the contract's rule: a twentieth of the words is hit."""
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = contaminated(decontaminate(docs, _read(spark, sf_dir, "benchmark")))
    names = F.array_sort(F.transform("hit_items", lambda x: x.cast("string")))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), h AS (SELECT dw.doc_id, bw.item_id, dw.n, dw.i FROM dw JOIN bw USING (n, s)),
hw AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_read(spark, sf_dir, "conversations"))


#: crc32 is folded bit by bit; a node is known by the digests of its turns.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos, g, n FROM (
    SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL)
), own AS (SELECT conv_id, list(g ORDER BY pos) AS g, list(n ORDER BY pos) AS n FROM t GROUP BY conv_id),
c AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(length(CAST(conv_id AS VARCHAR))), lambda k: [CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(k + 1 AS BIGINT), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 6 AS h FROM own
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.g[1:h], []), c.g[h + 1:]) AS g, list_concat(coalesce(b.n[1:h], []), c.n[h + 1:]) AS n
  FROM c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), p AS (
  SELECT conv_id, d, len(g) AS size, array_to_string(g[1:d], ',') AS k, CASE WHEN d > 0 THEN array_to_string(g[1:d - 1], ',') END AS up, coalesce(n[d], 0) AS chars
  FROM (SELECT *, unnest(range(len(g) + 1)) AS d FROM r)
), v AS (
  SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = size), '')) AS ends_sha256 FROM p GROUP BY d, k
), kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN kids USING (d, k)),
below AS (
  SELECT p.d, p.k, w.saved, w.n_children FROM w JOIN p ON p.conv_id = w.conv_id AND p.d <= w.d
), sums AS (SELECT d, k, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM below GROUP BY 1, 2)
SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM w JOIN sums s USING (d, k) LEFT JOIN v q ON q.d = w.d - 1 AND q.k = w.up
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return made.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        "prefix_chars",
        "middle_chars",
        F.sha2("fim_text", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim_text"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    [CAST('0x' || substr(s, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS h FROM d
), c AS (
  SELECT doc_id, t, w, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (SELECT *, array_to_string(w[1:a], '') AS x, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS y FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || y || '<M>' || m ELSE '<S>' || y || '<P>' || x || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

#: Fixed value: what both rows of conversation -1 say.
PROBE = "</s>[INST] ok [/INST]"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{PROBE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    read = read_chat(format_chat(as_log(rows.unionByName(probe))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP13_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|SAYS\])', '\1\\\2\3', 'g') AS x, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\]|SAYS\])', '\1\\\2\3', 'g') AS r FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(x) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE length(r) + 19 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_packing": op3_packing,
    "op4_repeats": op4_repeats,
    "op5_ngram_join": op5_ngram_join,
    "op6_token_ids": op6_token_ids,
    "op7_warc": op7_warc,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_toxicity": op10_toxicity,
    "op8_decontamination": op8_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_chat_formatting": op13_chat_formatting,
}
ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op5_ngram_join": OP5_SQL,
    "op8_decontamination": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_chat_formatting": OP13_SQL,
}
