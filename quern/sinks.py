"""Sinks: staged files that show together or not at all, JSON documents and events."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quern.shared import open_fs


def write_staged(outputs: DataFrame) -> DataFrame:
    """outputs (file, path, content) to (file, written, error): a file's outputs are written beside their places and renamed once all are there.

    A retried task writes the same bytes again. Where one of them cannot be written or renamed, what stood in the others'
    places is put back, and the file is a row with E_WRITE.
    """
    kind = dict(outputs.dtypes)["file"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        staged, moved, error, mark = [], [], None, uuid.uuid4().hex
        try:
            for path, content in zip(table.column("path").to_pylist(), table.column("content").to_pylist(), strict=True):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                staged.append((f"{path}.{mark}.part", path))
                with open(staged[-1][0], "wb") as f:
                    f.write(content)
            for part, path in staged:
                old = f"{path}.{mark}.old" if os.path.exists(path) else None
                if old:
                    os.replace(path, old)
                moved.append((old, path))
                os.replace(part, path)
        except OSError as e:
            error = f"E_WRITE: {e.strerror}"
            for old, path in reversed(moved):
                if old:
                    os.replace(old, path)
                elif os.path.exists(path):
                    os.remove(path)
            moved = []
        for left in [part for part, _ in staged] + [old for old, _ in moved if old]:
            if os.path.exists(left):
                os.remove(left)
        return pa.table({"file": pa.array([key[0].as_py()], table.schema.field("file").type), "written": pa.array([0 if error else len(staged)], pa.int64()), "error": pa.array([error], pa.string())})

    return outputs.select("file", "path", "content").groupBy("file").applyInArrow(run, f"file {kind}, written long, error string")


@dataclass
class _Staged(WriterCommitMessage):
    """What a task has written: (staged, target) for each file."""

    files: list[tuple[str, str]]


class FileSink(DataSource):
    """df.write.format("quern_files").mode("append").save(): rows (path, content) as files, on the file systems that paths name, all of them or none.

    Tasks write each file beside its place, under a hidden name of their own. When all tasks have ended well, the driver
    renames them; should one fail to take its place, those before it leave theirs and what stood there comes back. A failed
    or lost task leaves hidden files at most, which abort() removes. Of rows that repeat a path one is written. Where several
    files have a path that can't be written nothing is, and the write raises E_WRITE.
    """

    @classmethod
    def name(cls) -> str:
        return "quern_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter([f.name for f in schema.fields])


class _FileWriter(DataSourceWriter):
    def __init__(self, columns: list[str]):
        self.columns = columns

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        done: dict[str, str] = {}
        try:
            for row in iterator:
                path, content = row["path"], bytes(row["content"] or b"")
                fs, target = open_fs(path)
                staged = os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{uuid.uuid4().hex}.part")
                fs.create_dir(os.path.dirname(target), recursive=True)
                if path in done:
                    continue
                done[path] = staged
                with fs.open_output_stream(staged) as out:
                    out.write(content)
        except Exception as e:
            self._remove(done.items())
            raise OSError(f"E_WRITE: {e}") from e
        return _Staged([(staged, path) for path, staged in done.items()])

    def _remove(self, files) -> None:
        for path, staged in files:
            with contextlib.suppress(OSError):
                open_fs(path)[0].delete_file(staged)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileType

        files = {path: staged for m in messages if m is not None for staged, path in m.files}
        moved: list[tuple] = []
        try:
            for path, staged in files.items():
                fs, target = open_fs(path)
                kind = fs.get_file_info(target).type
                if kind == FileType.Directory:
                    raise OSError(f"{path} is a folder")
                old = f"{staged}.old" if kind == FileType.File else None
                if old:
                    fs.move(target, old)
                moved.append((fs, old, target))
                fs.move(staged, target)
        except Exception as e:
            for fs, old, target in reversed(moved):
                with contextlib.suppress(OSError):
                    fs.delete_file(target)
                if old:
                    fs.move(old, target)
            self._remove(files.items())
            raise OSError(f"E_WRITE: {e}") from e
        for fs, old, _ in moved:
            if old:
                with contextlib.suppress(OSError):
                    fs.delete_file(old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._remove([(path, staged) for m in messages if m is not None for staged, path in m.files])


def write_all(outputs: DataFrame) -> str | None:
    """Write the files of outputs (path, content), all of them or none; E_WRITE if they could not be. Their number alone bounds what the driver holds: a path each."""
    from quern import reachable

    reachable(outputs.sparkSession)
    outputs.sparkSession.dataSource.register(FileSink)
    try:
        outputs.select("path", "content").write.format("quern_files").mode("append").save()
    except Exception as e:
        if "E_WRITE" in str(e):
            return "E_WRITE"
        raise
    return None


def existing(paths: DataFrame) -> DataFrame:
    """The rows of paths (path) that are files or folders now, as tasks see them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([p is not None and os.path.lexists(p) for p in batch.column(0).to_pylist()], pa.bool_()))

    return paths.select("path").distinct().mapInArrow(run, "path string")


def batch_writer(path: str):
    """For foreachBatch: each batch as a table below path, by its number. A batch that runs again after a failure replaces itself, so that its rows are there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def json_documents(results: DataFrame) -> DataFrame:
    """A JSON document a row; fields that are null are left out."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))


def write_events(results: DataFrame, path: str) -> None:
    """Events as lines of JSON."""
    json_documents(results).write.text(path)


def server_sent(events: DataFrame) -> DataFrame:
    """events (type, …) as blocks of a server-sent stream."""
    return events.select(F.concat(F.lit("event: "), "type", F.lit("\ndata: "), F.to_json(F.struct(*events.columns)), F.lit("\n\n")).alias("value"))


def sse_batches(texts: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(event, data) of chunks of a server-sent stream, however they are cut."""
    held = ""
    for text in texts:
        held += text.replace("\r\n", "\n")
        *blocks, held = held.split("\n\n")
        for block in blocks:
            lines = block.split("\n")
            data = "\n".join(x[5:].removeprefix(" ") for x in lines if x.startswith("data:"))
            if data:
                yield next((x[6:].strip() for x in lines if x.startswith("event:")), "message"), data
