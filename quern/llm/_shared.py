"""What the operators share: the cluster's shared folder, files in it, and words of text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python operator holds as words at a time.
SLICE_BYTES = 2 << 20
#: Rows of some dozen bytes that are broadcast, at most, once they are counted; parts by which a frequent key is spread otherwise.
BROADCAST_ROWS, SALTS = 100_000, 16


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine, where that is unset, a new temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/quern-{name}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def materialised(df: DataFrame, name: str, block_bytes: int | None = None) -> DataFrame:
    """df as a table written in the shared folder: it is computed once and outlives lost executors.

    block_bytes: the size of a file's parts that tasks can read apart, for tables whose readers do more work than their writer.
    """
    return materialised_at(df, name, block_bytes)[0]


def materialised_at(df: DataFrame, name: str, block_bytes: int | None = None) -> tuple[DataFrame, str]:
    """materialised(), and where it is, for discard()."""
    path = shared_path(df.sparkSession, name)
    (df.write.option("parquet.block.size", block_bytes) if block_bytes else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing reads any more, on whatever file system they are."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def looked_up(left: DataFrame, right: DataFrame, on: list[str], salt: F.Column, how: str = "left", rows: int | None = None) -> DataFrame:
    """left joined with right, which has a short row for each key of `on`; rows: how many, if known (else they are counted).

    Up to BROADCAST_ROWS are broadcast. Of more, each is there for SALTS parts, into which salt deals left's rows, so that a
    key that a third of them has meets its row in as many tasks.
    """
    if (right.count() if rows is None else rows) <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    parts = right.withColumn("__quern_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return left.withColumn("__quern_salt", F.pmod(salt, F.lit(SALTS))).join(parts, [*on, "__quern_salt"], how).drop("__quern_salt")


def open_fs(uri: str):
    """The file system and path of a URI or local path, for use on executors too."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def make_folder(uri: str) -> str:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    return uri


class AtomicFile:
    """A file that shows under its name only when it is complete; a retried task replaces it."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out, self.size = self.fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name that no other task or attempt uses; what was written is then told by the manifest alone."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"


_C = ctypes.CDLL(None)


def give_back() -> None:
    """Return memory that a worker's allocators hold on to: workers live on from task to task, two beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def fresh(strings: pa.Array) -> pa.Array:
    """The strings as large_string (null: empty) in buffers of their own: some kernels misread those of a slice."""
    return pc.fill_null(strings.take(pa.array(np.arange(len(strings)))), "").cast(pa.large_string())


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in runs of rows of about `limit` bytes of text at most (a longer text is alone), with the texts; null: empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(start, end - start), fresh(texts.slice(start, end - start))
        start = end
    give_back()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words and all words: maximal runs outside space and 0x09-0x0D; lower: A-Z in lower case."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(words), 0)
    if pc.all(full).as_py() is False:
        kept = full.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        words = words.filter(full)
    return offsets, words


def string_parts(strings: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a large_string array without nulls and where each string starts and ends in them."""
    if strings.type != pa.large_string():
        strings = strings.cast(pa.large_string())
    ends = np.frombuffer(strings.buffers()[1], dtype=np.int64, count=strings.offset + len(strings) + 1)[strings.offset :] if len(strings) else np.zeros(1, np.int64)
    data = strings.buffers()[2] if len(strings) else None
    raw = data.to_pybytes()[ends[0] : ends[-1]] if data is not None else b""
    return raw, ends - ends[0]


def unit_hash(*columns, seed: int) -> F.Column:
    """A uniform number in [0, 1) that depends on the columns and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double")) / F.lit(float(1 << 53))
