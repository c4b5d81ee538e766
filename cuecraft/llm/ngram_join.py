"""Near copies: a Jaccard join over word n-grams as a blocked sparse matrix product.

Rows of the incidence matrix are distinct n-gram sets, columns n-grams. Two sets that are
near enough share one of the rarest n-grams of each (the prefix that the size bound leaves),
so sets meet on those and fall into blocks no link leaves. A block's rows are multiplied
with each other, overlap counts of the pairs add up, and pairs below the bound that their
sizes give are dropped before and after.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _quoted, bitmap_of, in_bitmap, lean, materialise, mix, shuffle_width, slices
from .graph import components

#: So many of the most frequent n-grams at most go last in the order of n-grams, by their counts.
FREQUENT = 1 << 20
#: n-grams that a task holds before it sums up.
HELD = 1 << 20
#: Sets that one task multiplies at a time; a larger component is cut by size, a larger part into tiles.
BLOCK_BYTES, TILE_BYTES = 4 << 20, 6 << 20
#: Prefix n-grams in one column block; the number of blocks grows with the table.
COLUMNS = 1 << 21
#: Sets that meet in a task without the shorter prefix of any are taken to meet anyway beyond this number.
CROWD = 64
#: Bits of the filters of block members and of shared n-grams; a bit set by chance never changes a result.
FILTER_BITS, SHARED_BITS = 24, 25


def gram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, owner, first): each text's distinct n-grams, ascending; few words are one n-gram."""
    sizes = np.diff(words.first)
    hashes, at = words.grams(n)
    parts, owners = [hashes], [words.doc[at]]
    for m in range(1, n):
        hashes, at = words.grams(m)
        keep = sizes[words.doc[at]] == m
        parts.append(hashes[keep])
        owners.append(words.doc[at[keep]])
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(hashes)
    order = order[_by_owner(owner[order], words.n_docs)]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, owner, np.searchsorted(owner, np.arange(words.n_docs + 1))


def _by_owner(owner: np.ndarray, n: int) -> np.ndarray:
    """A stable order by owner; small numbers are sorted by their digits."""
    return np.argsort(owner.astype(np.uint16) if n <= 1 << 16 else owner, kind="stable")


def set_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit key per set, 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes * np.uint64(0xD1342543DE82EF95)))])
    size = np.diff(first)
    keys = mix(sums[first[1:]] - sums[first[:-1]] + size.astype(np.uint64))
    return np.where(size > 0, keys, np.uint64(0)).view(np.int64)


def _prefix(size: np.ndarray, percent: int) -> np.ndarray:
    return size + (-percent * size) // 100 + 1


def _ceil(a, b: int):
    return -(-a // b)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(_quoted(id_col).cast("long").alias("doc_id"), _quoted(text_col).alias("text"))


def _survey(n: int):
    """Key and size of each text's set, and how often n-grams occur twice or more in a task."""
    names = ["doc_id", "size", "key", "gram", "count"]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        grams = np.concatenate(held)
        held.clear()
        grams.sort()
        edges = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1], [True]]))
        count = np.diff(edges)
        grams, count = grams[edges[:-1][count > 1]].view(np.int64), count[count > 1]
        none = pa.nulls(len(grams), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(grams), pa.array(count.astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "text"):
            hashes, _, first = gram_sets(Words(batch.column(1)), n)
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(set_keys(hashes, first)), none, none], names)
            held.append(hashes)
            size += len(hashes)
            if size > 4 * HELD:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return run, "doc_id long, size long, key long, gram long, count long"


def _classes_of_size(size: np.ndarray, percent: int) -> np.ndarray:
    """Classes of sizes so wide that sizes near enough to link are in one or in neighbouring ones."""
    return np.floor(np.log(np.maximum(size, 1)) / (np.log(100 / percent) * (1 + 1e-9))).astype(np.int64)


class Order:
    """A weight for each n-gram: 0 for those that nothing is known of, 1 for shared ones, more by the count of frequent ones."""

    def __init__(self, frequent: pa.Table, shared: np.ndarray | None = None):
        grams = frequent["gram"].to_numpy().view(np.uint64)
        at = np.argsort(grams)
        self.grams, self.shared = grams[at], shared
        self.weights = np.minimum(1024 * np.log2(frequent["n"].to_numpy()[at] + 1.0), 65535).astype(np.uint16)
        self.filter = np.zeros(1 << (SHARED_BITS - 6), np.int64)
        slot = self.slots(self.grams)
        np.bitwise_or.at(self.filter, slot >> 6, np.int64(1) << (slot & 63))

    @staticmethod
    def slots(grams: np.ndarray) -> np.ndarray:
        return (grams & np.uint64((1 << SHARED_BITS) - 1)).view(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        slot = self.slots(grams)
        weight = np.zeros(len(grams), np.uint16) if self.shared is None else in_bitmap(self.shared, slot).astype(np.uint16)
        own = np.flatnonzero(in_bitmap(self.filter, slot))
        if len(own):
            at = np.minimum(np.searchsorted(self.grams, grams[own]), len(self.grams) - 1)
            found = self.grams[at] == grams[own]
            weight[own[found]] = self.weights[at[found]]
        return weight


def _ordered(batch: pa.RecordBatch, n: int, order) -> tuple[np.ndarray, ...]:
    """n-grams of each set, rare ones first, with owner, size and key of the sets and each n-gram's rank."""
    hashes, owner, first = gram_sets(Words(batch.column(1)), n)
    key, size = set_keys(hashes, first), np.diff(first)
    at = np.argsort(order.value(hashes), kind="stable")  # of one set the n-grams ascend already
    at = at[_by_owner(owner[at], len(size))]
    return hashes[at], owner, size, key, np.arange(len(hashes)) - np.repeat(first[:-1], size)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once."""
    at = np.unique(mix(a.view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + mix(b.view(np.uint64))), return_index=True)[1]
    return a[at], b[at]


def _by_pair(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """An order by major, then minor; few majors come twice."""
    at = np.argsort(major)
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = major[at[1:]] == major[at[:-1]]
    twice = np.flatnonzero(same[:-1] | same[1:])
    at[twice] = at[twice][np.lexsort((minor[at[twice]], major[at[twice]]))]
    return at


def _shared(n: int, percent: int, order, blocks: int):
    """Prefix n-grams by column block, each with one set that has it and whether the task saw another."""

    def summed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, key = (np.concatenate(x) for x in zip(*held, strict=True))
        at = _by_pair(gram, key)
        gram, key = gram[at], key[at]
        lead = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        several = key[lead] != key[np.append(lead[1:], len(key)) - 1]
        gram, key = gram[lead], key[lead]
        block = (gram % np.uint64(blocks)).astype(np.int64)
        at = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[at], np.arange(blocks + 1))
        for k in range(blocks):
            own = at[cuts[k] : cuts[k + 1]]
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (gram[own], key[own], several[own])]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *blobs], ["block", "grams", "keys", "several"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in slices(batches, "text"):
            hashes, owner, size, key, rank = _ordered(batch, n, order)
            take = rank < _prefix(size, percent)[owner]
            held.append((hashes[take], key[owner[take]]))
            total += len(held[-1][0])
            if total > HELD:
                yield from summed(held)
                held, total = [], 0
        if total:
            yield from summed(held)

    return run, "block int, grams binary, keys binary, several binary"


def _shared_block(table: pa.Table) -> pa.Table:
    """n-grams of the block that two sets or more have."""
    kinds = {"grams": np.uint64, "keys": np.int64, "several": bool}
    gram, key, several = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]]) for c, t in kinds.items())
    at = _by_pair(gram, key)
    gram, key, several = gram[at], key[at], several[at]
    again = np.flatnonzero((gram[1:] == gram[:-1]) & (key[1:] != key[:-1])) + 1
    return pa.table({"slot": Order.slots(np.unique(np.concatenate([gram[again], gram[several]])))})


def _meetings(n: int, percent: int, order, blocks: int):
    """Where sets may meet, by column block: prefix n-grams with a class of sizes.

    A set shows all of its prefix to sets of its class of sizes, and the shorter prefix that
    a link to a larger set needs to those of the next class too. A meeting counts only if the
    shorter prefix of one of its sets is there; a task that knows of one keeps a single set
    for the meeting, and the edges to that.
    """
    names = ["block", "meetings", "keys", "sure", "a", "b"]

    def summed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        meet, key, sure = (np.concatenate(x) for x in zip(*held, strict=True))
        at = _by_pair(meet, key)
        meet, key, sure = meet[at], key[at], sure[at]
        lead = np.ones(len(meet), bool)
        lead[1:] = meet[1:] != meet[:-1]
        group = np.cumsum(lead) - 1
        some = ((np.bincount(group, sure) > 0) | (np.bincount(group) > CROWD))[group]
        low = key[lead][group]
        joined = some & (key != low)
        edges = np.stack(_distinct(key[joined], low[joined]))
        again = np.zeros(len(meet), bool)
        again[1:] = (meet[1:] == meet[:-1]) & (key[1:] == key[:-1])
        keep = np.where(some, lead, ~again)
        meet, key, sure = meet[keep], key[keep], some[keep]
        block = (meet % np.uint64(blocks)).astype(np.int64)
        at = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[at], np.arange(blocks + 1))
        owner = edges[0] % blocks
        for k in range(blocks):
            own, mine = at[cuts[k] : cuts[k + 1]], edges[:, owner == k]
            blobs = (meet[own], key[own], sure[own], mine[0], mine[1])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in slices(batches, "text"):
            hashes, owner, size, key, rank = _ordered(batch, n, order)
            short = rank < (size - _ceil(2 * percent * size, 100 + percent) + 1)[owner]
            kind = _classes_of_size(size, percent)[owner].astype(np.uint64)
            step = np.uint64(0x9E3779B97F4A7C15)
            take = rank < _prefix(size, percent)[owner]
            held.append((mix(hashes[take] + kind[take] * step), key[owner[take]], short[take]))
            held.append((mix(hashes[short] + (kind[short] + np.uint64(1)) * step), key[owner[short]], short[short]))
            total += len(held[-1][0]) + len(held[-2][0])
            if total > HELD:
                yield from summed(held)
                held, total = [], 0
        if total:
            yield from summed(held)

    return run, "block int, meetings binary, keys binary, sure binary, a binary, b binary"


def _join_block(table: pa.Table) -> pa.Table:
    """Edges between the sets of each meeting that counts, and those that tasks have found."""
    kinds = {"meetings": np.uint64, "keys": np.int64, "sure": bool, "a": np.int64, "b": np.int64}
    meet, key, sure, a, b = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]]) for c, t in kinds.items())
    at = _by_pair(meet, key)
    meet, key, sure = meet[at], key[at], sure[at]
    lead = np.ones(len(meet), bool)
    lead[1:] = meet[1:] != meet[:-1]
    group = np.cumsum(lead) - 1
    some = np.bincount(group, sure)[group] > 0 if len(group) else np.zeros(0, bool)
    low = key[lead][group]
    joined = some & (key != low)
    a, b = _distinct(np.concatenate([key[joined], a]), np.concatenate([low[joined], b]))
    return pa.table({"a": a, "b": b})


def _slots(keys: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Place of a set and the row that stands for it in the filter."""
    ids = ids.fill_null(-1).to_numpy(zero_copy_only=False)
    return (mix(keys.view(np.uint64) + mix(ids.view(np.uint64))) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_slots(batch.column(0).to_numpy(), batch.column(1)))], ["slot"])


def block_links(sizes: np.ndarray, grams: list[np.ndarray], tile: np.ndarray, mixed: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all sets of a block that links connect: a spanning forest of them.

    ``tile`` and ``mixed``: two sets of one tile are not compared where the block joins two tiles.
    """
    _, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    known = np.bincount(owner, minlength=len(sizes))  # entries in columns of more than one row
    rank = np.lexsort((-known, sizes))
    place = np.empty(len(sizes), np.int64)
    place[rank] = np.arange(len(sizes))
    at = np.lexsort((column, count[column], place[owner]))
    column, owner = column[at], place[owner[at]]
    n, e, tile, mixed = sizes[rank], known[rank], tile[rank], mixed[rank]
    first = np.searchsorted(owner, np.arange(len(n) + 1))
    alone = n - e
    index = np.clip(n - _ceil(2 * percent * n, 100 + percent) + 1 - alone, 0, e)
    probe = np.clip(_prefix(n, percent) - alone, 0, e)
    within = np.arange(len(owner)) - first[:-1][owner]
    probing = np.flatnonzero(within < probe[owner])
    order = np.argsort(column[probing], kind="stable")
    probing_column, probing_owner = column[probing][order], owner[probing][order]
    starts = np.searchsorted(probing_column, np.arange(len(count) + 1))
    mine = np.zeros(len(count), bool)
    label = np.arange(len(n))
    links = []
    for a in range(len(n)):
        own = column[first[a] : first[a] + index[a]]
        if not len(own):
            continue
        near = np.concatenate([probing_owner[starts[c] : starts[c + 1]] for c in own])
        near = near[(near > a) & (label[near] != label[a])]
        if not len(near):
            continue
        near = np.unique(near)
        need = _ceil(percent * (n[a] + n[near]), 100 + percent)
        near = near[(100 * n[a] >= percent * n[near]) & (np.minimum(e[a], e[near]) >= need) & ~(mixed[near] & (tile[near] == tile[a]))]
        if not len(near):
            continue
        mine[column[first[a] : first[a + 1]]] = True
        length = first[near + 1] - first[near]
        edge = np.cumsum(length) - length
        entries = np.arange(length.sum()) - np.repeat(edge, length) + np.repeat(first[near], length)
        overlap = np.add.reduceat(mine[column[entries]].astype(np.int64), edge)
        mine[column[first[a] : first[a + 1]]] = False
        for b in near[(100 + percent) * overlap >= percent * (n[a] + n[near])]:
            if label[b] != label[a]:
                links.append((int(rank[a]), int(rank[b])))
                label[label == label[b]] = label[a]
    return links


def _multiply(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def product() -> pa.RecordBatch:
            keys, sets = np.array([x[0] for x in held], np.int64), [x[1] for x in held]
            tile = np.array([x[2] for x in held])
            links = block_links(np.array([len(x) for x in sets]), sets, tile, np.array([x[3] for x in held]), percent)
            links = np.array(links, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(keys[links[:, 0]]), pa.array(keys[links[:, 1]])], ["a", "b"])

        for batch in batches:
            blobs = batch.column(batch.schema.names.index("grams"))
            for k, row in enumerate(batch.drop_columns(["grams"]).to_pylist()):
                block = (row["root"], row["part"], row["i"], row["j"])
                if block != last and size > BLOCK_BYTES:
                    yield product()
                    held, size = [], 0
                last = block
                grams = np.frombuffer(blobs[k].as_buffer(), np.uint64)
                held.append((row["key"], grams, row["tile"], row["i"] != row["j"]))
                size += grams.nbytes
        if held:
            yield product()

    return run


def _most_frequent(counts: DataFrame) -> pa.Table:
    """All n-grams from some count on, at most FREQUENT, found by a histogram of counts: nothing is sorted."""
    counts = materialise(counts, "counts")
    level = F.when(F.col("n") < 4096, F.col("n").cast("double")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))))
    least, total = None, 0
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some 4,200 rows at most
        total += row["count"]
        if total > FREQUENT:
            break
        least = row["level"]
    return counts.filter(F.col("n") >= F.lit(least) if least is not None else F.lit(False)).select("gram", "n").toArrow()


def similar(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, the smallest id that links reach.

    Words are runs of anything but ASCII white space, A-Z count as a-z. A document's set is
    its distinct runs of n words, all its words where there are fewer. Two documents link
    when 100 * intersection >= percent * union.

    Equal sets are one row of the matrix, whatever their number. n-grams are ordered by how
    often they occur (at most FREQUENT by their counts, then those that sets share as far as a
    filter of fixed size tells, the rest as rare), so a common passage is in no prefix of a text
    with enough else; the order decides only how much work there is. Meetings are folded per task to one
    row for each n-gram and joined in column blocks of about COLUMNS n-grams, however large the
    table. Components of them give the blocks, and a block of more than BLOCK_BYTES is cut by
    classes of sizes, and further into tiles that are multiplied pair by pair. Only links that join
    something leave a task.

    Null and empty texts have no set, no link and are their own component. Repeated rows are
    equal sets; a null id never names a component of others. An empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    run, schema = _survey(n)
    survey = materialise(texts.mapInArrow(lean(run), schema), "survey")
    rows = survey.filter("key IS NOT NULL").select("doc_id", "size", "key")
    frequent = _most_frequent(survey.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("count").alias("n")))
    entries = rows.agg(F.sum("size")).first()[0] or 0
    blocks = max(shuffle_width(spark), math.ceil(entries * (100 - percent) / 100 / COLUMNS))

    # n-grams that tasks met only once each but that sets share go behind those that none share
    order = spark.sparkContext.broadcast(Order(frequent))
    run, schema = _shared(n, percent, order, blocks)
    shared = bitmap_of(texts.mapInArrow(lean(run), schema).groupBy("block").applyInArrow(_shared_block, "slot long"), "slot", SHARED_BITS)
    order.destroy()
    order = spark.sparkContext.broadcast(Order(frequent, shared))
    run, schema = _meetings(n, percent, order, blocks)
    edges = texts.mapInArrow(lean(run), schema).groupBy("block").applyInArrow(_join_block, "a long, b long")
    nodes = materialise(components(edges), "blocks")
    order.destroy()

    classes = materialise(rows.filter("size > 0").groupBy("key").agg(F.min("doc_id").alias("low"), F.max("size").alias("size")), "classes")
    member = nodes.withColumnRenamed("node", "key").join(classes, "key")
    # a component too large for one block is cut by classes of sizes: links stay in a class or join neighbours
    kind = F.floor(F.log(F.col("size")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
    large = member.groupBy("root").agg((F.sum("size") * 8 > BLOCK_BYTES).alias("large"))
    parts = F.explode(F.when(F.col("large"), F.array(kind, kind + 1)).otherwise(F.array(F.lit(0)))).alias("part")
    member = materialise(member.join(large, "root").select("key", "low", "size", "root", parts), "parts")
    tiles = member.groupBy("root", "part").agg(F.ceil(F.sum("size") * 8 / TILE_BYTES).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    member = materialise(member.join(tiles, ["root", "part"]).select("key", "low", "root", "part", "tiles", tile.alias("tile")), "members")
    wanted = spark.sparkContext.broadcast(bitmap_of(member.select("key", "low").mapInArrow(lean(_slot_rows), "slot long"), "slot", FILTER_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, _, first = gram_sets(Words(batch.column(1)), n)
            keys = set_keys(hashes, first)
            slot = _slots(keys, batch.column(0))
            at = np.flatnonzero(in_bitmap(wanted.value, slot) & (np.diff(first) > 0))
            grams = pa.array([hashes[first[k] : first[k + 1]].tobytes() for k in at], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys[at]), batch.column(0).take(pa.array(at)), grams], ["key", "doc_id", "grams"])

    made = texts.mapInArrow(lean(sets), "key long, doc_id long, grams binary").withColumnRenamed("key", "own")
    rows_of = made.join(member, (F.col("own") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("low")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    placed = rows_of.select("key", "grams", "root", "part", "tile", other)
    placed = placed.select("root", "part", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "key", "grams", "tile")
    placed = placed.repartition(4 * shuffle_width(spark), "root", "part", "i", "j").sortWithinPartitions("root", "part", "i", "j", "key")
    found = components(placed.mapInArrow(lean(_multiply(percent)), "a long, b long")).withColumnRenamed("node", "key")

    linked = found.join(classes, "key").select("key", "root", "low")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(linked.join(lowest, "root").select("key", "component_id"), "key", "left").select(
        "key", F.coalesce("component_id", "low").alias("component_id")
    )
    some = rows.filter("size > 0").join(named, "key")
    columns = [F.col("doc_id").alias(id_col), F.col("size").alias("n_shingles")]
    return some.select(*columns, F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(
        rows.filter("size = 0").select(*columns, F.col("doc_id").alias("component_id"))
    )
