"""Folders of whole files and committed logs as Spark data sources, in batch and as streams.

Register once a session with ``register(spark)``, then

    spark.read.format("cuecraft_files").option("path", folder).load()
    spark.readStream.format("cuecraft_files").option("path", folder).option("seen", log_folder).load()
    records.write.format("cuecraft_log").option("batch", "2024-05-01").mode("append").save(log)
    spark.read.format("cuecraft_log").load(log)

Files are opened in tasks, each of which takes a run of them; the driver handles names and sizes. Paths may lie
in any store that Arrow opens. A file that can't be read is a row with its error, never a failed job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bounds of one task's run of files, and of an Arrow batch: parameters run_bytes and run_files, and fixed.
RUN_BYTES, RUN_FILES, BATCH_BYTES = 64 << 20, 4096, 4 << 20
FILES = "path string, name string, size long, content string, error string"
LINES = "path string, value string, error string"
COMMITS, DATA = "_commits", "_data"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def _read(path: str) -> bytes:
    store, at = open_store(path)
    with store.open_input_stream(at) as file:
        return file.read()


def _write(path: str, data: bytes) -> None:
    """A file that is there whole or not at all: written under another name, then moved."""
    store, at = open_store(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    staged = f"{at}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(staged) as out:
        out.write(data)
    store.move(staged, at)


def _listed(path: str, hidden: bool = False) -> list[tuple[str, int]]:
    """(path, size) of all files below a folder, by path; names that begin with ``_`` or ``.`` are not data. No folder, no files."""
    store, at = open_store(path)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    own = lambda f: hidden or not any(p[:1] in "_." for p in f.path.removeprefix(at).strip("/").split("/"))
    return sorted((prefix + f.path, f.size or 0) for f in found if f.type == fs.FileType.File and not f.path.endswith(".tmp") and own(f))


@dataclass
class Run(InputPartition):
    """What one task reads."""

    files: list[tuple[str, int]]


def runs(files: list[tuple[str, int]], options) -> list[Run]:
    most_bytes, most_files = int(options.get("run_bytes", RUN_BYTES)), int(options.get("run_files", RUN_FILES))
    made: list[Run] = []
    held = 0
    for path, size in files:
        if not made or held + size > most_bytes or len(made[-1].files) >= most_files:
            made.append(Run([]))
            held = 0
        made[-1].files.append((path, size))
        held += size
    return made


def whole_files(run: Run) -> Iterator[pa.RecordBatch]:
    """Path, name, size and content of each file, or the error; bytes that are no UTF-8 become U+FFFD."""
    rows: list[tuple] = []
    held = 0
    names = [c.split()[0] for c in FILES.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    for path, size in run.files:
        try:
            raw, error = _read(path), None
            content = raw.decode("utf-8", "replace").removeprefix("﻿")
            held += len(raw)
        except Exception as failure:  # one file that can't be read must not end the job
            content, error = None, f"{type(failure).__name__}: {failure}"[:500]
        rows.append((path, path.rsplit("/", 1)[-1], size, content, error))
        if held >= BATCH_BYTES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def log_lines(run: Run) -> Iterator[pa.RecordBatch]:
    """The lines of each file; one that can't be read is a row with its error."""
    for path, _ in run.files:
        try:
            store, at = open_store(path)
            rest = b""
            with store.open_input_stream(at) as file:
                while data := file.read(BATCH_BYTES):
                    *lines, rest = (rest + data).split(b"\n")
                    if lines:
                        yield _line_batch(path, lines)
            if rest:
                yield _line_batch(path, [rest])
        except Exception as failure:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.nulls(1, pa.string()), pa.array([f"{type(failure).__name__}: {failure}"[:500]])], names=["path", "value", "error"])


def _line_batch(path: str, lines: list[bytes]) -> pa.RecordBatch:
    text = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
    return pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), text, pa.nulls(len(lines), pa.string())], names=["path", "value", "error"])


class _Batch(DataSourceReader):
    def __init__(self, source):
        self.source = source

    def partitions(self) -> list[Run]:
        return runs(self.source.files(), self.source.options) or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        yield from self.source.rows(partition)


class _Stream(DataSourceStreamReader):
    """New files of a folder. What has been found stands in numbered lists under the folder ``seen``, each written once before its
    batch runs, so a restarted query reads the very same files again and no file is skipped for its time or name."""

    def __init__(self, source):
        self.source, self.log = source, source.options["seen"].rstrip("/")
        self.known, self.last = set(), 0

    def _load(self) -> None:
        lists = [p for p, _ in _listed(self.log) if p.endswith(".json")]
        for path in lists:
            n = int(path.rsplit("/", 1)[-1].removesuffix(".json"))
            if n > self.last:
                self.known.update(p for p, _ in json.loads(_read(path)))
        self.last = max([self.last, *(int(p.rsplit("/", 1)[-1].removesuffix(".json")) for p in lists)])

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        self._load()
        new = [f for f in self.source.files() if f[0] not in self.known]
        most = int(self.source.options.get("max_files", 0))
        if new:
            _write(f"{self.log}/{self.last + 1:09d}.json", json.dumps(new[: most or None]).encode())
            self._load()
        return {"lists": self.last}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        files = [tuple(f) for n in range(start["lists"] + 1, end["lists"] + 1) for f in json.loads(_read(f"{self.log}/{n:09d}.json"))]
        return runs(files, self.source.options)

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        yield from self.source.rows(partition)


class Files(DataSource):
    """All files of a folder, whole: path, name, size, content, error. Options: path, run_bytes, run_files; for streams seen and max_files.

    Written to, it makes one file of each row (name, content), named by the row.
    """

    @classmethod
    def name(cls) -> str:
        return "cuecraft_files"

    def schema(self) -> str:
        return FILES

    def files(self) -> list[tuple[str, int]]:
        return _listed(self.options["path"].rstrip("/"))

    rows = staticmethod(whole_files)

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are only added to a folder: use mode append")
        return _FileWriter(self.options["path"].rstrip("/"))


@dataclass
class Done(WriterCommitMessage):
    files: list[str]
    rows: int


class _FileWriter(DataSourceWriter):
    """One file a row. A name that is written twice, by a task that ran again too, holds the last one whole."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Done:
        n = 0
        for row in iterator:
            _write(f"{self.path}/{row['name']}", (row["content"] or "").encode())
            n += 1
        return Done([], n)

    def commit(self, messages) -> None: ...

    def abort(self, messages) -> None: ...


# ---------------------------------------------------------------- committed logs


def committed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files that a log's commits name, in the order of the commits' names."""
    found: dict[str, int] = {}
    for commit, _ in _listed(f"{path}/{COMMITS}", hidden=True):
        for name, size in json.loads(_read(commit)):
            found[f"{path}/{DATA}/{name}"] = size
    return list(found.items())


class Log(DataSource):
    """An append-only log of lines. A batch is there from the moment its commit is, whole and once, however often its tasks or itself are tried.

    Rows (value) are written to files that nobody reads until a small file, named by the batch, lists them. A batch
    whose commit is there already is not added again: give retries the same ``batch`` (streams use their batch's number and
    the option ``writer``). One process at a time may write a batch. Reading gives path, value and error of each line.
    """

    @classmethod
    def name(cls) -> str:
        return "cuecraft_log"

    def schema(self) -> str:
        return LINES

    def files(self) -> list[tuple[str, int]]:
        return committed(self.options["path"].rstrip("/"))

    rows = staticmethod(log_lines)

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a log is only appended to: use mode append")
        return _LogWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _LogStreamWriter(self.options)


class _Appends:
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.batch = options.get("batch") or uuid.uuid4().hex
        self.stream = options.get("writer", "stream")

    def write(self, iterator) -> Done:
        """Lines of one task in one file of a name of its own; no rows, no file."""
        name, n, size = f"{uuid.uuid4().hex}.jsonl", 0, 0
        store, at = open_store(f"{self.path}/{DATA}/{name}")
        out = None
        try:
            for row in iterator:
                line = row["value"]
                if line is None:
                    continue
                if "\n" in line or "\r" in line:
                    raise ValueError("a record of the log is one line")
                if out is None:
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(at)
                size += out.write(line.encode() + b"\n") or 0
                n += 1
        finally:
            if out is not None:
                out.close()
        return Done([name] if n else [], n)

    def _commit(self, messages, batch: str) -> None:
        target = f"{self.path}/{COMMITS}/{batch}.json"
        store, at = open_store(target)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            self._drop(messages)
            return
        files = []
        for name in [f for m in messages if m is not None for f in m.files]:
            own, place = open_store(f"{self.path}/{DATA}/{name}")
            files.append((name, own.get_file_info(place).size))
        _write(target, json.dumps(files).encode())

    def _drop(self, messages) -> None:
        """What no commit names is never read; it is deleted only to save space."""
        for name in [f for m in messages if m is not None for f in m.files]:
            store, at = open_store(f"{self.path}/{DATA}/{name}")
            if store.get_file_info(at).type != fs.FileType.NotFound:
                store.delete_file(at)


class _LogWriter(_Appends, DataSourceWriter):
    def commit(self, messages) -> None:
        self._commit(messages, self.batch)

    def abort(self, messages) -> None:
        self._drop(messages)


class _LogStreamWriter(_Appends, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        self._commit(messages, f"{self.stream}-{batchId:012d}")

    def abort(self, messages, batchId: int) -> None:
        self._drop(messages)


def register(spark: SparkSession) -> SparkSession:
    """The session, which knows both sources from now on."""
    for source in (Files, Log):
        spark.dataSource.register(source)
    return spark
