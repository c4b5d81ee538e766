"""Harmonic packing of token sequences.

A document is cut into pieces of a reciprocal of the capacity, capacity // k tokens for the
smallest k that fits what is left, and a short tail. A piece of class k shares its sequence
with k - 1 others of the class, so each class fills its sequences by count alone.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import _quoted, lean, materialise, shuffle_width, slices
from .tokens import Encoder

END_ID = 1


def cut(n: int, capacity: int, tail: int) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens."""
    pieces = [(capacity, 1)] * (n // capacity)
    left = n % capacity
    while left > tail:
        k = -(-capacity // left)
        while capacity // k > left:
            k += 1
        pieces.append((capacity // k, k))
        left -= capacity // k
    return pieces + ([(left, capacity // left)] if left else [])


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    tail: int = 128,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its text's ids and one end id (1); start counts from its first
    token. Sequence ids run from 0 without gaps, offsets in a sequence too.

    Texts are encoded once and the pieces written, without ids. Pieces are dealt to buckets
    by hash; a bucket numbers its own pieces of each class behind those of the buckets
    before it, which takes the counts of (class, bucket) alone. What does not fill a
    sequence, fewer than k pieces of class k, is bounded by the capacity whatever the input,
    and goes to one task that fits longest pieces first.

    Null and empty texts are a single end id. A null id passes through, repeated rows are
    packed each. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")],
            T.StructField("class", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer, keep_space=True)
        for batch in slices(batches, "text"):
            ids, first = encoder.encode(batch.column(1), END_ID)
            raw = memoryview(ids.astype("<u4")).cast("B")
            owner, rows = [], []
            for k, (start, stop) in enumerate(itertools.pairwise(first.tolist())):
                at = 0
                for length, kind in cut(stop - start, capacity, tail):
                    rows.append((at, length, zlib.crc32(raw[4 * (start + at) : 4 * (start + at + length)]), stop - start, kind))
                    owner.append(k)
                    at += length
            table = np.array(rows, np.int64).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(x) for x in table[:4]], pa.array(table[4].astype(np.int32))], schema.names
            )

    texts = docs.select(_quoted(id_col), F.coalesce(_quoted(text_col), F.lit("")).alias("text"))
    pieces = materialise(texts.mapInArrow(lean(run), schema), "pieces")
    width = shuffle_width(docs.sparkSession)
    bucket = F.pmod(F.xxhash64(_quoted(id_col), "start"), F.lit(width)).alias("bucket")
    counts = pieces.groupBy("class", bucket).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    behind = counts.select("class", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    totals = sorted((r["class"], r["n"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect())  # at most ``capacity`` classes
    classes, base = [], 0
    for k, n in totals:
        classes.append((k, n // k * k, base))
        base += n // k
    classes = docs.sparkSession.createDataFrame(classes, "class int, whole long, base long")
    own = Window.partitionBy("bucket", "class").orderBy(_quoted(id_col), "start")
    placed = (
        pieces.withColumn("bucket", bucket)
        .repartition(width, "bucket")
        .withColumn("rank", F.row_number().over(own).cast("long") - 1)
        .join(behind, ["class", "bucket"])
        .join(F.broadcast(classes), "class")
        .withColumn("index", F.col("before") + F.col("rank"))
    )
    placed = placed.withColumn("sequence_id", F.when(F.col("index") < F.col("whole"), F.col("base") + F.floor(F.col("index") / F.col("class"))))
    columns = [*schema.names[:5], "sequence_id"]
    placed = materialise(placed.select(*map(_quoted, columns), "index"), "placed")
    inside = Window.partitionBy("sequence_id").orderBy("index")
    whole = placed.filter("sequence_id IS NOT NULL").withColumn(
        "offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    )
    out = T.StructType([*schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    rest = placed.filter("sequence_id IS NULL").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda rows: _fit(rows, capacity, base)[out.names], out)
    return whole.select(*map(_quoted, out.names)).unionByName(rest)


def _fit(rows, capacity: int, base: int):
    """Longest piece first, each into the first open sequence with room."""
    rows = rows.sort_values(["length", rows.columns[0], "start"], ascending=[False, True, True], kind="stable")
    room: list[int] = []
    where, offset = [], []
    first = 0  # sequences before it are full
    for length in rows["length"]:
        k = next((k for k in range(first, len(room)) if room[k] >= length), len(room))
        if k == len(room):
            room.append(capacity)
        where.append(base + k)
        offset.append(capacity - room[k])
        room[k] -= length
        while first < len(room) and room[first] == 0:
            first += 1
    return rows.assign(sequence_id=where, offset=offset)
