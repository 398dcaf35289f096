"""Files read by range inside tasks: heads of any number of named files, and a data source that lists a folder in parallel.

No file is opened on the driver. A file that cannot be read is a row with E_READ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quern.schemas import SNIFFED_BYTES
from quern.shared import open_fs


class Ranges:
    """Bytes of a file, got as they are asked for; what lies beyond the end is missing."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size, self.taken = read, size, 0
        self._at, self._held = 0, b""

    @classmethod
    def of(cls, data: bytes) -> Ranges:
        return cls(lambda at, n: data[at : at + n], len(data))

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from `at` on. Small reads come out of blocks, so that a walk over parts costs few calls."""
        n = max(0, min(n, self.size - at))
        if n > BLOCK_BYTES:
            self.taken += n
            return self.read(at, n)
        if not (self._at <= at and at + n <= self._at + len(self._held)):
            self._at, self._held = at, self.read(at, min(BLOCK_BYTES, self.size - at))
            self.taken += len(self._held)
        return self._held[at - self._at : at - self._at + n]


#: Bytes of one read of a walk.
BLOCK_BYTES = 4096


def with_file(path: str, use: Callable[[Ranges], dict]) -> dict:
    """What `use` makes of a file; a failure to open or read it is {"error": "E_READ"}."""
    from pyarrow import ArrowException

    try:
        if not path:
            raise OSError("no path")
        fs, where = open_fs(path)
        with fs.open_input_file(where) as handle:
            return use(Ranges(lambda at, n: handle.read_at(n, at), handle.size()))
    except (OSError, ArrowException):
        return {"error": "E_READ"}


def read_heads(paths: DataFrame, path_column: str = "path", most: int = SNIFFED_BYTES) -> DataFrame:
    """paths with length long, head binary and error: the first `most` bytes of each file, read where the row is.

    A file that is not there, is a folder or can't be read has E_READ and nulls, as does a null path. Other columns stay; those with the added names give way.
    """
    paths = paths.drop(*[c for c in ("length", "head", "error") if c != path_column])
    schema = StructType([*paths.schema.fields, *StructType.fromDDL("length long, head binary, error string").fields])
    at = paths.columns.index(path_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # some MB of heads at a time
                part = batch.slice(start, 256)
                rows = [with_file(p, lambda r: {"length": r.size, "head": r.read(0, min(most, r.size)), "error": None}) for p in part.column(at).to_pylist()]
                added = [pa.array([r.get(c) for r in rows], t) for c, t in (("length", pa.int64()), ("head", pa.binary()), ("error", pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "length", "head", "error"])

    return paths.mapInArrow(run, schema)


@dataclass
class _Places(InputPartition):
    """Files to read, and folders to walk, of one task."""

    files: Sequence[str]
    folders: Sequence[str]


class HeadSource(DataSource):
    """spark.read.format("quern_heads").load(folder): (path, length, head, error) of the files below a folder.

    Options: bytes, of a head; recursive, whether folders below count (true); tasks, how many to deal the folder's entries
    to at most. The driver lists the entries of the folder itself alone; tasks walk what is below. Hidden files and folders,
    and those whose name begins with an underscore, are passed over. A folder that can't be listed is a row with E_READ.
    """

    @classmethod
    def name(cls) -> str:
        return "quern_heads"

    def schema(self) -> str:
        return "path string, length long, head binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(dict(self.options))


def _listed(path: str) -> tuple[list[str], list[str]]:
    """Files and folders in a folder, in order of their names."""
    from pyarrow import fs as pfs

    fs, where = open_fs(path)
    info = sorted(fs.get_file_info(pfs.FileSelector(where)), key=lambda i: i.base_name)
    shown = [i for i in info if not i.base_name.startswith((".", "_"))]
    prefix = path[: len(path) - len(where)] if path.endswith(where) else ""
    return [prefix + i.path for i in shown if i.type == pfs.FileType.File], [prefix + i.path for i in shown if i.type == pfs.FileType.Directory]


class _HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("bytes", SNIFFED_BYTES))
        self.recursive, self.tasks = options.get("recursive", "true").lower() == "true", int(options.get("tasks", 200))

    def partitions(self) -> Sequence[InputPartition]:
        files, folders = _listed(self.path)
        folders = folders if self.recursive else []
        n = max(1, min(self.tasks, len(files) + len(folders)))
        return [_Places(files[k::n], folders[k::n]) for k in range(n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, _Places)
        files, open_ = list(partition.files), list(partition.folders)
        while files or open_:
            for path in files:
                row = with_file(path, lambda r: {"length": r.size, "head": r.read(0, min(self.most, r.size))})
                yield path, row.get("length"), row.get("head"), row.get("error")
            files = []
            if open_:
                folder = open_.pop()
                try:
                    files, more = _listed(folder)
                    open_ += more
                except OSError:
                    yield folder, None, None, "E_READ"


def heads_below(spark: SparkSession, path: str, most: int = SNIFFED_BYTES, recursive: bool = True) -> DataFrame:
    """The rows of HeadSource for a folder."""
    from quern import reachable

    reachable(spark)
    spark.dataSource.register(HeadSource)
    return spark.read.format("quern_heads").option("bytes", most).option("recursive", str(recursive).lower()).load(path)
