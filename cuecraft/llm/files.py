"""Files in the shared folder that tasks write and read by range, on any store that Arrow opens."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def new_file(folder: str, suffix: str) -> str:
    """A name that no other attempt of any task uses: what a lost attempt wrote is never read."""
    return f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{suffix}"


def create(path: str):
    store, at = open_store(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(at)


def delete(path: str) -> None:
    """A folder and all in it; one that is not there is no error."""
    store, at = open_store(path)
    if store.get_file_info(at).type != fs.FileType.NotFound:
        store.delete_dir(at)


class Ranges:
    """Random reads of files; the last file stays open."""

    def __init__(self):
        self._path, self._file = None, None

    def open(self, path: str):
        if path != self._path:
            store, at = open_store(path)
            self._path, self._file = path, store.open_input_file(at)
        return self._file

    def read(self, path: str, offset: int, length: int) -> bytes:
        data = self.open(path).read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{path}: {length} bytes at {offset} asked for, {len(data)} there")
        return data
