"""Five stages from raw documents to packed sequences, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuecraft.llm.common import bit_words, materialise, with_bit
from cuecraft.llm.decontaminate import decontaminate
from cuecraft.llm.exact_dedup import exact_dedup
from cuecraft.llm.ngram_join import similar
from cuecraft.llm.packing import pack
from cuecraft.llm.queries import contaminated
from cuecraft.llm.tokens import tokenizer_path
from cuecraft.llm.toxicity import THRESHOLD, fit, score_toxicity


#: Bits of the filter that tells which documents may be near copies; a bit set by chance costs a join, never a row.
FILTER_BITS = 24


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Null and empty texts are scored as texts without words. Repeated rows have one score. Without
    usable labels every score is alike and low: all stay. No documents, no result.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).filter(F.col("toxic_score") < THRESHOLD).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    Null and empty texts are equal, so one of them stays. Repeated rows of the document that
    stays all stay.
    """
    return exact_dedup(docs).filter("kept").select(*docs.columns)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document with the smallest id.

    Five words to a shingle, similarity of 0.8 or more. Documents without words link with
    nothing and stay, as do those with a null id. Ids are joined, not texts: only rows whose
    bit is set in a filter of the dropped ids are shuffled.
    """
    dropped = materialise(similar(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    words = materialise(bit_words(dropped.select(F.xxhash64("doc_id").alias("key")), "key", FILTER_BITS), "near-bits")
    marked = with_bit(docs.withColumn("__key", F.xxhash64("doc_id")), "__key", words, FILTER_BITS, "__may")
    joined = marked.filter("__may").join(dropped, "doc_id", "left_anti")
    return marked.filter("NOT __may").select(*docs.columns).unionByName(joined.select(*docs.columns))


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is benchmark text; those without words stay."""
    hits = contaminated(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return hits.filter(~F.col("contaminated")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; one without text is a single end id."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", distinct_texts),
    ("ngram_join", no_near_copies),
    ("decontamination", not_contaminated),
    ("packing", packed),
]

#: The first stage is a trained model, which SQL can't express; tests hold each stage against brute force on what it reads.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
