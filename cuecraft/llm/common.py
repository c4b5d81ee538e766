"""Helpers that the operators of this subpackage share.

Work that leaves the JVM runs on Arrow batches: a text column arrives as one byte
buffer with offsets, so hashing and word splitting are numpy passes over the buffer.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; arrays are about 40 times as large.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch that goes to a Python worker, unless the session has set less.
BATCH_BYTES = 4 << 20
_written: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = "file://" + tempfile.mkdtemp(prefix="cuecraft-")  # one machine: the driver's folder is everyone's
        spark.conf.set("spark.checkpoint.dir", base)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def sweep() -> int:
    """Deletes what this process's operators have written to the shared folder; to be called once results are stored elsewhere."""
    from .files import delete

    count = len(_written)
    while _written:
        delete(_written.pop())
    return count


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, work is done once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replaced(df: DataFrame, names: list[str]) -> DataFrame:
    """Without columns that an operator is about to add under the same names."""
    lower = {n.lower() for n in names}
    return df.select(*[_quoted(c) for c in df.columns if c.lower() not in lower])


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- memory of Python workers

#: Seconds after a worker's last task at which it lets go of what it kept for the next one.
IDLE_S = 3.0
#: What is kept from task to task: dictionaries that are emptied when the worker idles.
kept: list[dict] = []
_tasks, _timer, _lock = 0, None, threading.Lock()


def release() -> None:
    """Returns freed memory to the system: Arrow's pool and, where the C library can, the heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _bytes(size: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = size.lower().removesuffix("b")
    return int(size[:-1]) * units[size[-1]] if size[-1:] in units else int(size)


def _idle() -> None:
    with _lock:
        if _tasks == 0:
            for held in kept:
                held.clear()
            _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
            release()


def _begin() -> None:
    global _tasks, _timer
    with _lock:
        _tasks += 1
        if _timer is not None:
            _timer.cancel()
            _timer = None


def _end() -> None:
    global _tasks, _timer
    release()
    with _lock:
        _tasks -= 1
        if _tasks == 0:
            _timer = threading.Timer(IDLE_S, _idle)
            _timer.daemon = True
            _timer.start()


def lean(run: Callable) -> Callable:
    """A function over batches whose worker gives memory back when the task ends, and all it keeps when it idles.

    Texts may be long, so the session's bound on the bytes of a batch is lowered to BATCH_BYTES;
    ten thousand rows a batch would fill both sides' buffers.
    """
    spark, setting = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is not None and _bytes(spark.conf.get(setting, "64m")) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        try:
            yield from run(batches)
        finally:
            _end()

    return task


# ---------------------------------------------------------------- filters of fixed size


def bit_words(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A bitmap of hashed keys as rows of 64 bits: at most 2**(bits-6) rows, however many keys."""
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    return keys.select(
        F.shiftright(slot, 6).alias("__word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("__bit"),
    ).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def with_bit(rows: DataFrame, key: str, words: DataFrame, bits: int, name: str) -> DataFrame:
    """With a column that tells whether the key's bit is set in a bitmap, whose rows go to every task."""
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    word, mask = f"__{name}_word", f"__{name}_bits"
    words = words.select(F.col("__word").alias(word), F.col("__bits").alias(mask))
    bit = F.coalesce(F.call_function("bit_get", F.col(mask), (slot % 64).cast("int")) == 1, F.lit(False))
    return rows.withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(words), word, "left").withColumn(name, bit).drop(word, mask)


def bitmap_of(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    words = bit_words(keys, key, bits).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[words["__word"].to_numpy()] = words["__bits"].to_numpy()
    return bitmap


def in_bitmap(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1


# ---------------------------------------------------------------- bytes of texts

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: The white space that texts are split at, and what counts as a letter or digit
#: (ASCII ones, and every byte of other characters).
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = ~SPACE
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """64-bit hashes of any slice of a buffer, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self._down = _pow(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


#: Slices of up to so many bytes are hashed eight bytes at a time.
SHORT = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of a buffer: short ones by their bytes, long ones from prefix sums."""
    at_byte = eights(data)
    h = mix((at_byte[starts] & _MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(8, SHORT, 8):
        own = np.flatnonzero(sizes > k)
        if not len(own):
            break
        part = at_byte[starts[own] + k] & _MASKS[np.minimum(sizes[own] - k, 8)]
        h[own] = mix(h[own] * np.uint64(0x9FB21C651E98DF25) + part)
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        h[long] = Hasher(data)(starts[long], starts[long] + sizes[long])
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after the other, and where each begins. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = buffers(batch.column(batch.schema.names.index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Words:
    """Words of a batch of texts: position, owner and hash, with A-Z in lower case."""

    def __init__(self, column: pa.Array, word_bytes: np.ndarray = NOT_SPACE):
        data, self.offsets = buffers(column)
        self.n_docs = len(self.offsets) - 1
        self.data = LOWER[data]
        inside = word_bytes[self.data] if len(data) else np.zeros(0, bool)
        edges = self.offsets[:-1][self.offsets[:-1] < len(data)]
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before[edges] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, self.offsets)  # of each document, and the end
        self.hash = hash_slices(self.data, self.starts, self.ends - self.starts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of n words of one document, and the index of its first word."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:count] == self.doc[n - 1 :])
        return chain(self.hash, at, n), at


def chain(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each index on."""
    h = np.full(len(at), np.uint64(n), np.uint64)
    for j in range(n):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + hashes[at + j])
    return h
