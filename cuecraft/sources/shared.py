"""Names of new folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from cuecraft.sources.folders import open_store

_named: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a machine's own folder stands in for it only where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = "file://" + tempfile.mkdtemp(prefix="cuecraft-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _named.append(path)
    return path


def sweep() -> int:
    """Deletes what this process has written under names of ``shared_path``; to be called once results are stored elsewhere."""
    count = len(_named)
    while _named:
        store, at = open_store(_named.pop())
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)
    return count


def written(rows: DataFrame, name: str) -> DataFrame:
    """Written to a new shared folder and read back: worked out once, and nothing before it runs again."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
