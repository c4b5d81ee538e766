"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _quoted, bit_words, materialise, replaced

#: The characters that do not count, the ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix: int = 64,
    filter_bits: int = 22,
) -> DataFrame:
    """All input columns with keep_id, group_size and kept.

    Texts are equal when they are once ASCII white space is deleted. Of equal texts the one
    with the most code points stays, then the smallest id.

    Length and prefix hash are counted over narrow rows. Prefix groups of two or more go
    into a bitmap of fixed size (2**filter_bits bits, sent to every task); only rows whose
    bit is set have their full text hashed. A bit set by chance costs a hash, never a
    wrong result. Rows whose bit is not set are alone and pass without a shuffle; the others are
    joined with the groups of two or more. Groups are folded before the shuffle, so a group with a
    third of all rows is a few rows per task; the join back may be split by adaptive execution.

    Null text counts as empty; empty texts form one group. A null id sorts first, so it
    stays. Repeated rows with the id that stays all stay: they are the same document. An
    empty table gives an empty result. Input columns called keep_id, group_size or kept
    are replaced; others pass through.
    """
    docs = replaced(docs, ["keep_id", "group_size", "kept"])
    row_id = _quoted(id_col)
    text = normalised(_quoted(text_col))
    narrow = docs.select(
        F.length(text).alias("__len"),
        F.xxhash64(F.length(text), F.substring(text, 1, prefix)).alias("__prefix"),
    )
    narrow = materialise(narrow, "dedup-keys")
    lengths = narrow.groupBy("__len").count().filter("count > 1").select("__len")
    groups = (
        narrow.join(lengths, "__len", "left_semi").groupBy("__len", "__prefix").count().filter("count > 1")
    )
    words = materialise(bit_words(groups, "__prefix", filter_bits), "dedup-bits")

    keyed = docs.withColumn("__prefix", F.xxhash64(F.length(text), F.substring(text, 1, prefix)))
    slot = F.pmod(F.col("__prefix"), F.lit(1 << filter_bits))
    keyed = keyed.withColumn("__word", F.shiftright(slot, 6)).join(F.broadcast(words), "__word", "left")
    again = F.coalesce(
        F.call_function("bit_get", F.col("__bits"), (slot % 64).cast("int")) == 1, F.lit(False)
    )
    keyed = keyed.withColumn("__hashed", again).drop("__word", "__bits", "__prefix")
    hashed = keyed.filter("__hashed").withColumn("__full", F.sha2(text, 256))
    order = F.struct((-F.length(F.coalesce(_quoted(text_col), F.lit("")))).alias("n"), row_id.alias("id"))
    groups = hashed.groupBy("__full").agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__size")).filter("__size > 1")
    groups = materialise(groups.select("__full", F.col("__first.id").alias("__keep"), "__size"), "dedup-groups")
    joined = hashed.join(groups, "__full", "left")
    keep = F.when(F.col("__size").isNull(), row_id).otherwise(F.col("__keep"))

    def result(rows: DataFrame, keep: Column, size: Column) -> DataFrame:
        return rows.select(*[_quoted(c) for c in docs.columns], keep.alias("keep_id"), size.alias("group_size"), row_id.eqNullSafe(keep).alias("kept"))

    one = F.lit(1).cast("long")
    return result(joined, keep, F.coalesce("__size", one)).unionByName(result(keyed.filter("NOT __hashed"), row_id, one))
