"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, on one machine alone, below a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str:
    """A file: URI as a plain path; others stay."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def open_fs(uri: str):
    """The file system and the path on it of a URI or a local path, in tasks too."""
    from pyarrow import fs

    uri = local_path(uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and there when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The rows of a group-by-group step that one task holds.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *by: Column | str, task_rows: int = TASK_ROWS) -> DataFrame:
    """df, of about `rows` rows, dealt by its keys (or evenly) over tasks of some task_rows rows, and over all cores: what a task sorts or works through does not grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows)), *by)
