"""Repeated passages, byte for byte, by an enhanced suffix array over sampled suffixes.

Of every window of ``length`` bytes the ``gram`` bytes with the smallest hash are an
anchor, so two equal windows have an anchor at the same place. Only suffixes that begin at
anchors are sorted: those of one gram lie next to each other in the suffix array and one
task has them all. A stack scan of their common-prefix lengths yields the intervals of the
prefix tree; inside an interval the texts before the anchors are sorted in turn, which
tells how far each occurrence extends to the left together with another one. Where both
sides add up to ``length`` bytes, the repeat is maximal and belongs to all its occurrences.

A gram with very many different surroundings is cut into parts of the tree: two occurrences in one repeat that share r
bytes to the right, r rounded down to a multiple of PART_STEP, share all but PART_STEP of ``length`` bytes in a place known by
r, so they meet in the part of that string, and each part is a suffix array of its own. Parts that are crowded still
go on with a step of one: there a part is a node of ``length`` bytes, and all its occurrences are a repeat group by that alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hasher, _quoted, bit_words, bitmap_of, buffers, in_bitmap, lean, materialise, mix, replaced, slices, with_bit

GRAM = 100
FILTER_BITS = 24
#: Suffixes with different surroundings that are sorted together: those of one gram or, where it has more, of one part of it.
GROUP_ROWS = 1 << 13
#: A crowded gram is dealt by what lies around it, all strings that reach so many bytes (a multiple of this) to the right.
PART_STEP = 50
BATCH_BYTES = 4 << 20
#: A longer text is read in pieces of so many windows, which overlap.
LONG = 1 << 20
#: Surroundings that a task remembers to have sent; sent again they do no harm.
SENT = 1 << 18
#: Anchors with equal surroundings beyond this number are dealt to SALTS tasks where they meet their extents.
HOT_ROWS, SALTS = 1 << 12, 128


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, windows: tuple[int, int] | None = None) -> tuple[np.ndarray, Hasher]:
    """Positions of the anchors of all windows (or of those that start in a range) that lie inside one text.

    33 bits of a hash decide, then the place from the left, so equal windows have their anchor
    at one place whatever they are read with.
    """
    hasher = Hasher(data)
    n, width = len(data) - gram + 1, length - gram + 1
    sizes = np.diff(offsets)
    if n < width or not (sizes >= length).any():
        return np.zeros(0, np.int64), hasher
    at = np.arange(n)
    bits = np.uint64(31)
    keys = (hasher(at, at + gram) >> bits << bits) | at.astype(np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    inside = np.repeat(offsets[1:], sizes)[: len(least)] >= np.arange(len(least)) + length
    if windows:
        inside[: windows[0]] = inside[windows[1] :] = False
    return np.unique((least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)), hasher


class Sites:
    """Anchors of a batch of texts with what surrounds them, as far as a window with the anchor reaches."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int, windows: tuple[int, int] | None = None, before: int = 0, after: int = 0, behind: int = -1):
        """``before`` and ``after``: bytes of the one text that are not here; only anchors past ``behind`` count."""
        at, hasher = anchors(data, offsets, length, gram, windows)
        at = at[at > behind]
        self.data, self.hasher = data, hasher
        self.doc = np.searchsorted(offsets, at, "right") - 1
        self.at = at - offsets[self.doc] + before
        self.left = np.minimum(self.at, length - gram)
        self.right = np.minimum(offsets[self.doc + 1] - at + after, length)
        self.start, self.end = at - self.left, at + self.right
        self.gram = hasher(at, at + gram).view(np.int64)
        around = hasher(self.start, self.end) + (self.left * 65536 + self.right).astype(np.uint64)
        self.around = mix(around).view(np.int64)

    @classmethod
    def of(cls, column: pa.Array, length: int, gram: int) -> Iterator[Sites]:
        """The sites of a batch; those of a single long text in several pieces."""
        data, offsets = buffers(column)
        if len(offsets) != 2 or len(data) <= LONG:
            yield cls(data, offsets, length, gram)
            return
        last = -1  # anchors of later windows never lie further to the left
        for a in range(0, len(data) - length + 1, LONG):
            low, high = max(0, a - length), min(len(data), a + LONG + 2 * length)
            part = data[low:high]
            sites = cls(part, np.array([0, len(part)]), length, gram, (a - low, a - low + LONG), low, len(data) - high, last - low)
            last = max(last, int(sites.at.max(initial=-1)))
            yield sites

    def __len__(self) -> int:
        return len(self.at)

    def parts(self, own: np.ndarray, length: int, gram: int, step: int = PART_STEP) -> tuple[np.ndarray, np.ndarray]:
        """(index into own, hash) of the strings of length - step bytes about those anchors that end a multiple of step behind them."""
        at, found = self.start[own] + self.left[own], []
        for right in range(gram, length + 1, step):
            left = max(0, length - step - right)
            fits = np.flatnonzero((self.left[own] >= left) & (self.right[own] >= right))
            h = mix(self.hasher(at[fits] - left, at[fits] + right) + np.uint64(right)).view(np.int64)
            found.append(np.stack([fits, h]))
        both = np.concatenate(found, axis=1)
        return both[0], both[1]


def _lengths(rows: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Of the common beginnings of rows of bytes."""
    differ = rows != other
    found = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.minimum(found, np.minimum(size, other_size))


def _matrix(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(len(texts), width)


def scan(grams: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each occurrence extends to the left and right in repeats of ``length`` bytes; 0, 0: in none.

    ``lefts`` are reversed. Occurrences of different grams never share an interval.
    """
    m = len(rights)
    order = sorted(range(m), key=lambda k: (grams[k], rights[k]))
    grams, lefts, rights = grams[order], [lefts[k] for k in order], [rights[k] for k in order]
    right, left = _matrix(rights, length), _matrix(lefts, max(1, length - gram))
    right_size, left_size = np.array([len(x) for x in rights]), np.array([len(x) for x in lefts])
    common = np.zeros(m + 1, np.int64)
    common[1:m] = _lengths(right[1:], right_size[1:], right[:-1], right_size[:-1])
    common[1:m][(grams[1:] != grams[:-1]) | (common[1:m] < gram)] = 0
    beside = np.zeros(m, np.int64)
    beside[1:] = _lengths(left[1:], left_size[1:], left[:-1], left_size[:-1])
    rank = np.empty(m, np.int64)
    rank[sorted(range(m), key=lefts.__getitem__)] = np.arange(m)
    reach_left, reach_right = np.zeros(m, np.int64), np.zeros(m, np.int64)

    def interval(depth: int, low: int, high: int) -> None:
        if high == low + 1:
            own, far = np.array([low, high]), np.array([beside[high]] * 2)
        else:
            own = low + np.argsort(rank[low : high + 1])
            near = _lengths(left[own[1:]], left_size[own[1:]], left[own[:-1]], left_size[own[:-1]])
            far = np.maximum(np.concatenate([[0], near]), np.concatenate([near, [0]]))
        keep = far + depth >= length
        own, far = own[keep], far[keep]
        reach_left[own] = np.maximum(reach_left[own], far)
        reach_right[own] = np.maximum(reach_right[own], depth)

    stack = [(0, 0)]
    for k in range(1, m + 1):
        depth, low = int(common[k]), k - 1
        while stack[-1][0] > depth:
            inner, low = stack.pop()
            interval(inner, low, k - 1)
        if stack[-1][0] < depth:
            stack.append((depth, low))
    back = np.empty(m, np.int64)
    back[order] = np.arange(m)
    return reach_left[back], reach_right[back]


def _filter(rows: DataFrame) -> np.ndarray:
    """A filter of fixed size over the hashes in column around."""
    return bitmap_of(rows, "around", FILTER_BITS)


def _in(bitmap: np.ndarray, around: np.ndarray) -> np.ndarray:
    return in_bitmap(bitmap, around & ((1 << FILTER_BITS) - 1))


def repeated(docs: DataFrame, length: int = 400, gram: int = GRAM, text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """All columns of docs with repeated_spans (start, end in bytes of UTF-8) and kept (the other bytes).

    A byte is repeated if a string of ``length`` bytes that covers it also starts anywhere
    else in the table, in the same text too; overlaps count. Spans are maximal runs.

    About one anchor in (length - gram) / 2 bytes leaves a task, with hashes of its gram and
    of its surroundings. Equal surroundings are one row with a count, so copies cost no
    comparisons; grams with different ones have one copy of each sorted, those with more than ``group_rows``
    different ones part by part. Texts are joined with their spans by their digest, so rows with
    equal texts get equal spans.

    Null texts are empty; texts shorter than ``length`` bytes have no repeats. An empty table
    gives an empty result; input columns with the names of the results are replaced.
    """
    spark = docs.sparkSession
    docs = replaced(docs, ["repeated_spans", "kept"])
    text = F.coalesce(_quoted(text_col), F.lit(""))
    digest = F.unhex(F.md5(text.cast("binary")))
    texts = docs.select(text.alias("text"), digest.alias("digest"))
    only = texts.select("text")

    def sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for s in Sites.of(batch.column(0), length, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.gram), pa.array(s.around), batch.column(1).take(pa.array(s.doc)), pa.array(s.at), *(pa.array(x.astype(np.int32)) for x in (s.left, s.right))],
                    ["gram", "around", "digest", "at", "left", "right"],
                )

    found = materialise(texts.mapInArrow(lean(sites), "gram long, around long, digest binary, at long, left int, right int"), "anchors")
    kinds = found.groupBy("gram", "around").agg(F.count(F.lit(1)).alias("n"), F.max("left").alias("left"), F.max("right").alias("right"))
    kinds = materialise(kinds, "kinds")
    several = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).filter("all > 1")
    kinds = materialise(kinds.join(several.select("gram", "kinds"), "gram"), "repeated-kinds")
    copies = kinds.filter((F.col("n") > 1) & (F.col("left") + F.col("right") >= length)).select("gram", "around", "left", "right")

    mixed = spark.sparkContext.broadcast(_filter(kinds.filter((F.col("kinds") > 1) & (F.col("kinds") <= group_rows))))
    crowded, dealt, sorted_parts = kinds.filter(F.col("kinds") > group_rows), None, None
    if crowded.limit(1).count():
        crowd = spark.sparkContext.broadcast(_filter(crowded))
        members = materialise(_parts(only, crowd, length, gram).join(crowded.select("gram", "around"), ["gram", "around"], "left_semi"), "parts")
        sizes = materialise(members.groupBy("part").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "part-sizes")
        sorted_parts = spark.sparkContext.broadcast(bitmap_of(sizes.filter(F.col("kinds") <= group_rows), "part", FILTER_BITS))
        dealt = materialise(members.join(sizes.filter(F.col("kinds") > group_rows), "part", "left_semi").select("gram", "around").distinct(), "nodes")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            for s in Sites.of(batch.column(0), length, gram):
                if len(seen) > SENT:
                    seen.clear()
                new = lambda places: np.array([k for k in np.flatnonzero(places) if s.around[k] not in seen and not seen.add(s.around[k])], np.int64)  # noqa: E731, B023
                own = new(_in(mixed.value, s.around))
                group = s.gram[own]
                if sorted_parts is not None:
                    some = new(_in(crowd.value, s.around))
                    index, part = s.parts(some, length, gram)
                    keep = in_bitmap(sorted_parts.value, part & ((1 << FILTER_BITS) - 1))
                    own, group = np.concatenate([own, some[index[keep]]]), np.concatenate([group, part[keep]])
                raw = s.data.tobytes() if len(own) else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group), pa.array(s.around[own]), pa.array(s.left[own].astype(np.int32)), pa.array([raw[s.start[k] : s.end[k]] for k in own], pa.binary()), pa.array(s.gram[own])],
                    ["part", "around", "left", "bytes", "gram"],
                )

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def scanned() -> pa.RecordBatch:
            l, r = scan(np.array([x[0] for x in held], np.int64), [x[3][: x[2]][::-1] for x in held], [x[3][x[2] :] for x in held], length, gram)
            own = np.flatnonzero(r)
            around = np.array([x[1] for x in held], np.int64)
            gram_of = np.array([x[4] for x in held], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(gram_of[own]), pa.array(around[own]), pa.array(l[own].astype(np.int32)), pa.array(r[own].astype(np.int32))], names)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if row[:2] == last:
                    continue  # another task's copy
                if last and row[0] != last[0] and size > BATCH_BYTES:
                    yield scanned()
                    held, size = [], 0
                last = row[:2]
                held.append(row)
                size += len(row[3])
        if held:
            yield scanned()

    names = ["gram", "around", "left", "right"]
    schema = "gram long, around long, left int, right int"
    sampled = only.mapInArrow(lean(surroundings), "part long, around long, left int, bytes binary, gram long").repartition("part").sortWithinPartitions("part", "around")
    reach = copies.unionByName(sampled.mapInArrow(lean(extents), schema))
    if dealt is not None and dealt.limit(1).count():
        reach = reach.unionByName(_nodes(only, dealt, length, gram))
    reach = reach.groupBy("gram", "around").agg(F.max("left").alias("l"), F.max("right").alias("r"))
    # equal surroundings that come very often are dealt to many tasks, each with a row of their extents
    hot = materialise(bit_words(kinds.filter(F.col("n") > HOT_ROWS), "around", FILTER_BITS), "hot-bits")
    salts = F.array(*map(F.lit, range(SALTS)))
    extent = with_bit(reach, "around", hot, FILTER_BITS, "hot")
    extent = extent.select("gram", "around", "l", "r", F.explode(F.when(F.col("hot"), salts).otherwise(F.array(F.lit(0)))).alias("salt"))
    place = with_bit(found.select("gram", "around", "digest", "at"), "around", hot, FILTER_BITS, "hot")
    place = place.withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0))
    spans = (
        place.join(extent, ["gram", "around", "salt"])
        .groupBy("digest")
        .agg(F.collect_set(F.struct((F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r")).alias("end"))).alias("spans"))
    )
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([*docs.schema.fields, T.StructField("repeated_spans", span), T.StructField("kept", T.BinaryType())])
    joined = docs.withColumn("__digest", digest).join(spans.withColumnRenamed("digest", "__digest"), "__digest", "left")
    return joined.select(*[_quoted(c) for c in docs.columns], F.col("spans").alias("__spans")).mapInArrow(lean(_cutter(text_col)), out)


def _parts(only: DataFrame, crowd, length: int, gram: int) -> DataFrame:
    """(gram, around, part) of the surroundings in a filter, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            for s in Sites.of(batch.column(0), length, gram):
                if len(seen) > SENT:
                    seen.clear()
                own = np.array([k for k in np.flatnonzero(_in(crowd.value, s.around)) if s.around[k] not in seen and not seen.add(s.around[k])], np.int64)
                index, part = s.parts(own, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(s.gram[own][index]), pa.array(s.around[own][index]), pa.array(part)], ["gram", "around", "part"])

    return only.mapInArrow(lean(run), "gram long, around long, part long").distinct()


def _nodes(only: DataFrame, crowded: DataFrame, length: int, gram: int) -> DataFrame:
    """Extents in crowded parts: from the nodes of ``length`` bytes, told by hash and place of the anchor, that two surroundings or more have."""
    wanted = only.sparkSession.sparkContext.broadcast(_filter(crowded))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, "text"):
            for s in Sites.of(batch.column(0), length, gram):
                if len(seen) > SENT:
                    seen.clear()
                for k in np.flatnonzero(_in(wanted.value, s.around)):
                    if s.around[k] in seen:
                        continue
                    seen.add(s.around[k])
                    shift = np.arange(-s.left[k], s.right[k] - length + 1)
                    at = s.start[k] + s.left[k] + shift
                    n = len(shift)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, s.gram[k])), pa.array(np.full(n, s.around[k])), pa.array(shift.astype(np.int32)), pa.array(s.hasher(at, at + length).view(np.int64))],
                        ["gram", "around", "shift", "window"],
                    )

    rows = only.mapInArrow(lean(windows), "gram long, around long, shift int, window long").distinct()
    rows = materialise(rows.join(crowded.select("gram", "around"), ["gram", "around"], "left_semi"), "windows")
    # equal windows have their anchor at one place, so one occurrence is not counted again for its other anchors
    place = ["gram", "shift", "window"]
    twice = rows.groupBy(*place).count().filter("count > 1").select(*place)
    return rows.join(twice, place).groupBy("gram", "around").agg((-F.min("shift")).alias("left"), (F.max("shift") + length).alias("right"))


def _cutter(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, text_col):
            column = batch.column(batch.schema.names.index(text_col))
            spans, kept = [], []
            for text, found in zip(column.to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                raw, runs, parts, at = (text or "").encode(), [], [], 0
                for span in sorted((x["start"], x["end"]) for x in found or ()):
                    if runs and span[0] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], span[1])
                    else:
                        runs.append({"start": span[0], "end": span[1]})
                for x in runs:
                    parts.append(raw[at : x["start"]])
                    at = x["end"]
                spans.append(runs)
                kept.append(b"".join(parts) + raw[at:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, kind), pa.array(kept, pa.binary())], [*batch.schema.names[:-1], "repeated_spans", "kept"])

    return run
