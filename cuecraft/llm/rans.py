"""Token ids in binary files, coded by a range asymmetric numeral system.

A file holds blocks of whole documents, ascending by id, and one table of token
frequencies that all its blocks share. A block is coded by up to 2048 interleaved coders,
one step of all of them at a time, with checkpoints at which decoding can begin, and
checksums of what is stored and of the ids.

    magic, blocks, footer (zlib: table and index), length and crc32 of the footer, magic
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _quoted, lean, materialise, shared_dir, shuffle_width, slices
from .files import Ranges, create, new_file
from .tokens import Encoder

MAGIC = b"RANSIDS1"
BITS = 18  # the frequencies of a table add up to 2**BITS
LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
LANES = 2048
#: Steps between checkpoints.
STRIDE = 256
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 24
BLOCK_RUN = 4
END_ID = 1


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2**BITS, one at least for each token that occurs."""
    total, seen = int(counts.sum()), counts > 0
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(seen, np.maximum(1, counts * ((1 << BITS) - int(seen.sum())) // total), 0)
    freq[np.argmax(freq)] += (1 << BITS) - int(freq.sum())
    return freq


class Coder:
    """Encodes and decodes blocks by one table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint64)
        self._owner: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> bytes:
        lanes = max(1, min(LANES, len(ids)))
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        limit = self.freq << np.uint64(63 - BITS)
        words, marks, count = [], [], 0
        for step in range(steps - 1, -1, -1):
            row = ids[step * lanes : (step + 1) * lanes]
            x, f = state[: len(row)], self.freq[row]
            over = x >= limit[row]
            out = (x[over] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            count += len(out)
            x[over] >>= np.uint64(32)
            q = x // f
            x[:] = (q << np.uint64(BITS)) + (x - q * f) + self.start[row]
            if step % STRIDE == 0:
                marks.append((step, count, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        head = struct.pack("<QIII", len(ids), lanes, len(marks), count)
        body = b"".join(struct.pack("<QQ", s, count - left) + x.astype("<u8").tobytes() for s, left, x in reversed(marks)) + stream.tobytes()
        return head + struct.pack("<II", zlib.crc32(head + body), zlib.crc32(ids.astype("<u4").tobytes())) + body

    def parts(self, block: bytes, mark: int = 0, marks: int | None = None) -> Iterator[np.ndarray]:
        """The ids checkpoint by checkpoint, from one on, of as many as asked for (all: None).

        Each part is decoded from the states of its own checkpoint alone, so a block of any size
        takes the memory of one part.
        """
        if self._owner is None:
            self._owner = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        n, lanes, n_marks, count = struct.unpack_from("<QIII", block)
        crc, of_ids = struct.unpack_from("<II", block, 20)
        if zlib.crc32(memoryview(block)[28:], zlib.crc32(block[:20])) != crc:
            raise ValueError("a block's checksum is another")
        last = n_marks if marks is None else min(n_marks, mark + marks)
        size, steps, seen = 16 + 8 * lanes, -(-n // lanes), 0
        stream = np.frombuffer(block, "<u4", count, 28 + n_marks * size)
        for k in range(mark, last):
            first, at = struct.unpack_from("<QQ", block, 28 + k * size)
            state = np.frombuffer(block, "<u8", lanes, 28 + k * size + 16).astype(np.uint64)
            part = self._steps(state, stream, at, n, first, min(first + STRIDE, steps))
            if mark == 0:
                seen = zlib.crc32(part.astype("<u4"), seen)
            yield part
        if mark == 0 and last == n_marks and seen != of_ids:
            raise ValueError("the ids' checksum is another")

    def _steps(self, state: np.ndarray, stream: np.ndarray, at: int, n: int, first: int, stop: int) -> np.ndarray:
        """The ids of all lanes from one step to another."""
        lanes = len(state)
        out = np.empty((stop - first) * lanes, np.uint32)
        mask = np.uint64((1 << BITS) - 1)
        for step in range(first, stop):
            width = min(lanes, n - step * lanes)
            x = state[:width]
            slot = x & mask
            ids = self._owner[slot]
            x[:] = self.freq[ids] * (x >> np.uint64(BITS)) + slot - self.start[ids]
            under = np.flatnonzero(x < LOW)
            x[under] = (x[under] << np.uint64(32)) | stream[at : at + len(under)]
            at += len(under)
            out[(step - first) * lanes : (step - first) * lanes + width] = ids
        return out[: min(n, stop * lanes) - first * lanes]

    def decode(self, block: bytes, mark: int = 0, marks: int | None = None) -> np.ndarray:
        """The parts in one array."""
        return np.concatenate([np.zeros(0, np.uint32), *self.parts(block, mark, marks)])


class _File:
    """Gathers the documents of one file and writes it."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size
        self.docs, self.parts, self.tokens = [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.parts.append(ids)
        self.tokens += len(ids)

    def write(self) -> tuple[str, int, int]:
        ids = np.concatenate(self.parts)
        freq = frequencies(np.bincount(ids, minlength=self.size))
        coder, path, index = Coder(freq), new_file(self.folder, ".rans"), []
        with create(path) as out:
            out.write(MAGIC)
            at, k, done = len(MAGIC), 0, 0
            while k < len(self.docs):
                n, last = self.docs[k][1], k + 1
                while last < len(self.docs) and n + self.docs[last][1] <= BLOCK_TOKENS:
                    n += self.docs[last][1]
                    last += 1
                block = coder.encode(ids[done : done + n])
                out.write(block)
                index.append({"at": at, "bytes": len(block), "first": done, "tokens": n, "docs": self.docs[k:last]})
                at, done, k = at + len(block), done + n, last
            used = np.flatnonzero(freq)
            footer = zlib.compress(json.dumps({"size": self.size, "ids": used.tolist(), "freq": freq[used].tolist(), "blocks": index}).encode())
            out.write(footer + struct.pack("<QI", len(footer), zlib.crc32(footer)) + MAGIC)
        return path, len(self.docs), self.tokens


def read_footer(source: Ranges, path: str) -> dict:
    size = source.open(path).size()
    length, crc = struct.unpack("<QI", source.read(path, size - 20, 12))
    if source.read(path, size - 8, 8) != MAGIC:
        raise ValueError(f"{path}: not a file of ids")
    footer = source.read(path, size - 20 - length, length)
    if zlib.crc32(footer) != crc:
        raise ValueError(f"{path}: the footer's checksum is another")
    return json.loads(zlib.decompress(footer))


def coder_of(footer: dict) -> Coder:
    freq = np.zeros(footer["size"], np.int64)
    freq[footer["ids"]] = footer["freq"]
    return Coder(freq)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, ascending by id, and returns (path, part, nth, docs, tokens) per file.

    Each text is encoded once. Rows are dealt by ranges of the id, those of one id further by
    their text's hash, so that no id is bound to one task. Only files that the returned table
    names count. Null texts are empty: an end id alone; null ids come first.
    """
    rows = docs.select(_quoted(id_col).cast("long").alias("doc_id"), F.coalesce(_quoted(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer, keep_space=False)
        part, made, file = TaskContext.get().partitionId(), [], _File(folder, encoder.size)
        for batch in slices(batches, "text"):
            ids, first = encoder.encode(batch.column(1), END_ID)
            for doc_id, start, stop in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                file.add(doc_id, ids[start:stop])
                if file.tokens >= FILE_TOKENS:
                    made.append(file.write())
                    file = _File(folder, encoder.size)
        if file.docs:
            made.append(file.write())
        if made:
            yield pa.RecordBatch.from_pylist(
                [{"path": p, "part": part, "nth": k, "docs": d, "tokens": t} for k, (p, d, t) in enumerate(made)],
                pa.schema([("path", pa.string()), ("part", pa.int32()), ("nth", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]),
            )

    return materialise(rows.mapInArrow(lean(run), "path string, part int, nth int, docs long, tokens long"), "rans-files")


def read_ids(files: DataFrame, keep_ids: bool = False) -> DataFrame:
    """One row (doc_id, start, n_tokens, ids_crc32) per document, decoded from the files; with its ids if asked for.

    Blocks are dealt to tasks in short runs. start adds up the files before (one row each), the
    blocks and the documents before.
    """
    order = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("first", F.coalesce(F.sum("tokens").over(order), F.lit(0)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Ranges()
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = read_footer(source, path)["blocks"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found)), pa.array(range(len(found)), pa.int32()), pa.array([first + x["first"] for x in found], pa.int64())],
                    ["path", "block", "first"],
                )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, last, footer, coder = Ranges(), None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != last:
                    last, footer = row["path"], read_footer(source, row["path"])
                    coder = coder_of(footer)
                block = footer["blocks"][row["block"]]
                parts = coder.parts(source.read(last, block["at"], block["bytes"]))
                held, out, at = np.zeros(0, "<u4"), [], 0
                for doc_id, n in block["docs"]:
                    crc, left, ids = 0, n, []
                    while left:
                        if not len(held):
                            held = next(parts).astype("<u4")
                        piece, held = held[:left], held[left:]
                        crc, left = zlib.crc32(piece, crc), left - len(piece)
                        if keep_ids:
                            ids += piece.tolist()
                    out.append((doc_id, row["first"] + at, n, crc) + (ids,) * keep_ids)
                    at += n
                if next(parts, None) is not None:  # past the last part the ids' checksum is compared
                    raise ValueError(f"{last}: a block has more ids than its index says")
                types = [pa.int64()] * 4 + [pa.list_(pa.int32())] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    found = files.select("path", "first").mapInArrow(lean(blocks), "path string, block int, first long")
    width = shuffle_width(files.sparkSession)
    run = F.floor(F.col("block") / BLOCK_RUN)  # a footer is read once for a run of blocks
    return found.repartition(width, F.col("path"), run).sortWithinPartitions("path", "block").mapInArrow(lean(decode), schema)


def ids_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all texts' ids and reads the files back: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_dir(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, tokenizer, id_col, text_col))
