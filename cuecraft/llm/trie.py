"""The trie of all conversations' prefixes, with what sharing each prefix saves.

A count-min sketch over prefix digests screens them first: an estimate of one proves that one conversation
alone has the prefix, so its tail is written where it lies. Only prefixes that may be shared are shuffled and
grouped exactly. Sums over subtrees are sums over a node's members, so no step goes down the trie level by level.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, lean, materialise, mix

#: Bytes of a prefix digest. Rows of the sketch, and the bounds of its cells in all rows together, a byte each.
DIGEST, ROWS = 16, 2
CELLS = (1 << 12, 1 << 26)
CHUNK = 1 << 13
#: The longest head that is taken from a conversation's base, and how many share a base.
HEADS, BASE = 6, 100
ROOT = hashlib.sha256(b"root").digest()[:DIGEST]
_NONE = hashlib.sha256(b"").hexdigest()


class CountMin:
    """Counts of digests, never too low: each adds to one cell a row, an estimate is the smallest of its cells. Cells stop at 255."""

    def __init__(self, width: int, cells: np.ndarray | None = None):
        self.width = width
        self.cells = np.zeros((ROWS, width), np.uint8) if cells is None else cells.reshape(ROWS, width)

    def _slots(self, digests: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        words = digests.view("<u8").reshape(len(digests), DIGEST // 8)
        for row in range(ROWS):
            yield row, (mix(words[:, 0] + np.uint64(row) * words[:, 1]) % np.uint64(self.width)).astype(np.int64)

    def add(self, digests: np.ndarray) -> None:
        for row, slot in self._slots(digests):
            found, n = np.unique(slot, return_counts=True)
            self.cells[row, found] = np.minimum(self.cells[row, found] + n, 255)

    def estimate(self, digests: np.ndarray) -> np.ndarray:
        low = np.full(len(digests), 255, np.uint8)
        for row, slot in self._slots(digests):
            np.minimum(low, self.cells[row, slot], out=low)
        return low


def width_for(prefixes: int, cells: tuple[int, int] = CELLS) -> int:
    """Cells of a row: eight for each prefix, between the bounds. Beyond the upper one more prefixes are grouped exactly, with the same result."""
    wanted = 1 << max(0, (8 * prefixes - 1).bit_length())
    return max(cells[0], min(cells[1], ROWS * wanted)) // ROWS


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DIGEST)


def sketch(keys: DataFrame, key: str, width: int) -> CountMin:
    """The sketch of a column of digests: one of fixed size a task, added up chunk by chunk.

    Only chunks that are not all zeros are shuffled. The sum has ROWS * width bytes, whatever the table's size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CountMin(width)
        for batch in batches:
            if batch.num_rows:
                own.add(_digests(batch.column(0)))
        flat = own.cells.reshape(-1)
        for at in range(0, len(flat), CHUNK):
            part = flat[at : at + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // CHUNK], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(cells, np.uint8)
                if chunk == at:
                    held = np.minimum(held + part, 255)
                    continue
                if at is not None:
                    yield _chunk(at, held)
                at, held = chunk, part.astype(np.uint16)
        if at is not None:
            yield _chunk(at, held)

    counted = keys.select(key).mapInArrow(lean(count), "chunk long, cells binary")
    summed = counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lean(total), "chunk long, cells binary").toArrow()
    flat = np.zeros(ROWS * width, np.uint8)
    for chunk, cells in zip(summed["chunk"].to_pylist(), summed["cells"].to_pylist(), strict=True):
        flat[chunk * CHUNK : chunk * CHUNK + len(cells)] = np.frombuffer(cells, np.uint8)
    return CountMin(width, flat)


def _chunk(at: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([cells.astype(np.uint8).tobytes()], pa.binary())], names=["chunk", "cells"])


# ---------------------------------------------------------------- prefixes


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """Narrow rows (conv_id, pos, digest, chars) of all rebuilt conversations; pos 0 has no turn and is there for each one.

    The turns of c are the first h of c - c % 100, h = crc32(c) % 6, then its own after its first h. Texts
    don't leave the scan: rows carry a turn's digest and size. A base gives its first turns, five at
    most, to a hundred conversations at most.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)), 1, DIGEST)
    own = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = materialise(rows.select("conv_id", F.row_number().over(own).cast("long").alias("pos"), "digest", "chars"), "turns")
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("long")
    first = F.array_sort(F.collect_list(F.struct("pos", "digest", "chars")))
    bases = rows.filter((F.col("conv_id") % BASE == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(first.alias("__first"))
    each = rows.filter("pos = 1").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"))
    none = F.lit(None).cast("binary")
    root = F.array(F.struct(F.lit(0).cast("long").alias("pos"), none.alias("digest"), F.lit(0).cast("long").alias("chars")))
    head = F.coalesce(F.filter("__first", lambda t: t["pos"] <= F.col("h")), F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>"))
    heads = each.join(bases, "base", "left").select("conv_id", F.inline(F.concat(root, head)))
    return heads.unionByName(rows.filter(F.col("pos") > h))


def prefixes(turns: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation: conv_id, depth, key, parent (digests), chars of its last turn, rest of it and all behind it, length.

    The digest of a prefix is one over its parent's and its last turn's, carried along sorted rows, so a conversation of any length is a stream.
    """
    order = Window.partitionBy("conv_id").orderBy("pos")
    total = F.sum("chars").over(Window.partitionBy("conv_id"))
    before = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars")
    length = F.count(F.lit(1)).over(Window.partitionBy("conv_id")) - 1
    rows = turns.select("conv_id", "digest", "chars", (F.row_number().over(order) - 1).cast("long").alias("depth"), (total - before).alias("rest"), length.alias("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, hashlib.sha256
        for batch in batches:
            keys, parents = [], []
            for depth, digest in zip(batch.column("depth").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                parents.append(key if depth else None)
                key = sha(key + digest).digest()[:DIGEST] if depth else ROOT
                keys.append(key)
            made = [pa.array(keys, pa.binary()), pa.array(parents, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), *made, batch.column("chars"), batch.column("rest"), batch.column("length")], names=["conv_id", "depth", "key", "parent", "chars", "rest", "length"])

    sorted_rows = rows.sortWithinPartitions("conv_id", "depth")
    return sorted_rows.mapInArrow(lean(run), "conv_id long, depth long, key binary, parent binary, chars long, rest long, length long")


_sketches: dict = {}
kept.append(_sketches)


def screened(rows: DataFrame, counts: CountMin) -> DataFrame:
    """With whether a prefix, and its parent, may have more than one member: their estimates are over one."""
    spark = rows.sparkSession
    sent, width, name = spark.sparkContext.broadcast(zlib.compress(counts.cells.tobytes(), 1)), counts.width, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _sketches:
            _sketches.clear()
            _sketches[name] = CountMin(width, np.frombuffer(zlib.decompress(sent.value), np.uint8))
        held = _sketches[name]
        for batch in batches:
            if batch.num_rows:
                maybe = held.estimate(_digests(batch.column("key"))) > 1
                above = held.estimate(_digests(batch.column("parent").fill_null(ROOT))) > 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe), pa.array(above)], names=[*batch.schema.names, "maybe", "maybe_parent"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(lean(run), f"{schema}, maybe boolean, maybe_parent boolean")


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows (key, conv_id): SHA-256 of the ids, ascending, joined by commas.

    One digest is one sequence of bytes, so a key's ids, eight bytes each, pass through one task; none are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != at:
                    if at is not None:
                        done.append((at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256(b"%d" % conv)
                else:
                    sha.update(b",%d" % conv)
            if done:
                yield _pairs(done)
        if at is not None:
            yield _pairs([(at, sha.hexdigest())])

    return ends.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(lean(run), "key binary, ends_sha256 string")


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, values = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.string())], names=["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, cells: tuple[int, int] = CELLS) -> DataFrame:
    """Every node of the trie over conversations' turns (conv_id, pos, digest, chars; a row with pos 0 for each conversation).

    A node is a distinct sequence of first turns; members are the conversations that begin with it.
    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A conversation owns the nodes of which it is the smallest member: those from some depth on. So, over a
    node's members, children are the members that own their node one deeper, leaves the members that own a
    childless end, and what the subtree saves is all members' rest of characters less what they own of it. These
    are two groupings of prefixes that may be shared, pre-aggregated in each task, and one join by conversation, whatever the depth.

    A hot prefix is a few rows a task in the groupings; in joins its rows may be split by adaptive execution. ``cells``
    bounds the sketch, not the result. An empty table gives no nodes, not even a root.
    """
    rows = materialise(prefixes(turns), "prefixes")
    rows = materialise(screened(rows, sketch(rows, "key", width_for(rows.count(), cells))), "screened")
    shared, single = rows.filter("maybe"), rows.filter("NOT maybe")
    end = F.col("depth") == F.col("length")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    nodes = shared.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.min(F.struct("conv_id", "rest")).alias("__own"), F.count_if(end).alias("__ends"),
    )
    nodes = materialise(nodes.select("key", "parent", "depth", "n_convs", F.col("__own.conv_id").alias("owner"), F.col("__own.rest").alias("rest"), (F.col("__ends") == F.col("n_convs")).alias("leaf")), "nodes")
    tails = single.filter("maybe_parent OR depth = 0")
    owned = nodes.select(F.col("owner").alias("conv_id"), "depth", "rest", "leaf").unionByName(tails.select("conv_id", "depth", "rest", F.lit(True).alias("leaf")))
    owners = owned.groupBy("conv_id").agg(F.min(F.struct("depth", "rest")).alias("__first"), F.max("leaf").alias("leaf"))
    owners = materialise(owners.select("conv_id", F.col("__first.depth").alias("__from"), F.col("__first.rest").alias("__all"), "leaf"), "owners")

    members = shared.join(owners, "conv_id", "left")
    mine = F.when(F.col("__from").isNull(), zero).when(F.col("depth") >= F.col("__from"), F.col("rest")).otherwise(F.col("__all"))
    child = (F.col("__from") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    sums = members.groupBy("key").agg(F.count_if(child).alias("n_children"), F.count_if("leaf").alias("n_leaves"), F.sum(F.col("rest") - mine).alias("saved_tokens"))

    above = nodes.select(F.col("key").alias("parent"), F.col("owner").alias("__above"))
    root = F.broadcast(above.filter(F.col("parent") == F.lit(ROOT)))

    def with_parent(part: DataFrame, own: str) -> DataFrame:
        """Children of the root, which may be most rows, meet its one row without a shuffle."""
        part, name = part.withColumn("__own", F.col(own)), F.when(F.col("depth") > 0, F.coalesce("__above", "__own")).alias("parent_conv_id")
        top = part.filter("depth <= 1").join(root, "parent", "left")
        return top.unionByName(part.filter("depth > 1").join(above, "parent", "left")).select("*", name).drop("__own", "__above", "parent")

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    exact = with_parent(nodes.select("key", "parent", "depth", "n_convs", "owner"), "owner").join(sums, "key")
    exact = exact.join(end_digests(shared.filter(end)), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))
    alone = single.select(
        "conv_id", "depth", "parent", "maybe_parent", one.alias("n_convs"), (~end).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_NONE).alias("ends_sha256"),
    )
    first = with_parent(alone.filter("maybe_parent"), "conv_id")
    rest = alone.filter("NOT maybe_parent").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return exact.withColumnRenamed("owner", "conv_id").select(*names).unionByName(first.select(*names)).unionByName(rest.select(*names))


def conversation_trie(conversations: DataFrame, cells: tuple[int, int] = CELLS) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text); see ``rebuilt_turns`` and ``prefix_trie``.

    Turns are in the order of turn (null first), equal ones in that of the digest of role and text. Null roles and texts
    are empty. Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own.
    A negative id's base is the next multiple of a hundred towards zero. Other columns are left out. Turns are told apart
    by 128 bits of SHA-256.
    """
    return prefix_trie(rebuilt_turns(conversations), cells)
