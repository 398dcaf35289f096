"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames. A skippable frame after them maps each record to its frame and the offset in
the decompressed frame, and the seek table of the Zstandard seekable format ends the file, so that one record costs one frame.
A bundle starts with a warcinfo record. A response's block is an HTTP response with the payload as its body; a revisit names
the record it refers to by identifier and address, as the standard has it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._shared import AtomicFile, attempt_name, looked_up, make_folder, materialised, open_fs, shared_path

#: Numbers of the Zstandard seekable format: a skippable frame, the seek table's end, and the index frame that is ours.
SKIPPABLE, SEEKABLE, INDEX = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5C
#: Bytes of records in a frame, about, and of compressed frames in a file, about.
FRAME_BYTES, FILE_BYTES = 1 << 20, 256 << 20
#: Payloads of fewer bytes are never stored as revisits.
REVISIT_BYTES = 100
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BundleWriter:
    """Writes one bundle: add() records, then close()."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.file, self.limit = AtomicFile(uri), frame_bytes
        self.codec = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.pending, self.pending_bytes = [], 0
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[bytes, int, int, int]] = []

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append((record_id.encode(), len(self.frames), self.pending_bytes, len(record)))
        self.pending.append(record)
        self.pending_bytes += len(record)
        if self.pending_bytes >= self.limit:
            self._flush()

    def _flush(self) -> None:
        if self.pending:
            data = self.codec.compress(b"".join(self.pending))
            self.file.write(data)
            self.frames.append((len(data), self.pending_bytes))
            self.pending, self.pending_bytes = [], 0

    def close(self) -> None:
        self._flush()
        entries = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<IQQ", *at) for k, *at in self.index)
        body = self.codec.compress(struct.pack("<Q", len(self.index)) + entries)
        self.file.write(struct.pack("<II", INDEX, len(body)) + body)
        frames = [*self.frames, (8 + len(body), 0)]
        table = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


class BundleReader:
    """Reads records of a bundle by identifier, or all in order; each frame on its own."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        self.codec = zstandard.ZstdDecompressor()
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {uri}")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, full in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, full))
            at += packed
        at, packed, _ = self.frames.pop()
        magic, length = struct.unpack("<II", self.file.read_at(8, at))
        if magic != INDEX or length != packed - 8:
            raise ValueError(f"no index in {uri}")
        body, self.index, at = self.codec.decompress(self.file.read_at(length, at + 8)), {}, 8
        for _ in range(struct.unpack_from("<Q", body)[0]):
            (n,) = struct.unpack_from("<H", body, at)
            self.index[body[at + 2 : at + 2 + n].decode()] = struct.unpack_from("<IQQ", body, at + 2 + n)
            at += 22 + n

    def frame(self, number: int) -> bytes:
        at, packed, full = self.frames[number]
        return self.codec.decompress(self.file.read_at(packed, at), max_output_size=full)

    def record(self, record_id: str) -> bytes:
        number, start, length = self.index[record_id]
        return self.frame(number)[start : start + length]

    def records(self) -> Iterator[tuple[str, bytes]]:
        now, data = -1, b""
        for record_id, (number, start, length) in self.index.items():
            if number != now:
                now, data = number, self.frame(number)
            yield record_id, data[start : start + length]

    def close(self) -> None:
        self.file.close()


def page_record_id(page_id: int | None, digest: str, *more: object) -> str:
    """A record's identifier: the same wherever it is asked for. more tells records apart that repeat a page and its payload."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, (page_id, digest, *more))))}"


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record(kind: str, record_id: str, fields: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_info(name: str) -> bytes:
    """The record that starts a bundle."""
    return _record("warcinfo", page_record_id(None, name), [f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def build_record(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: int | None, page_id: int | None, refers_url: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit's block is the HTTP head alone; its payload's length and digest are in the record's head."""
    head = [] if url is None else ["WARC-Target-URI: " + _one_line(url)]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{page_record_id(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}"]
        head += [] if refers_url is None else ["WARC-Refers-To-Target-URI: " + _one_line(refers_url)]
    else:
        block += payload
    return _record(kind, record_id, [*head, "Content-Type: application/http; msgtype=response"], block)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields (names in lower case) and the payload: the block, without the head of an HTTP response."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["content-type"].startswith("application/http") else block


def classified(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to, refers_url) of each row; see write_archives."""
    each = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"))
    each = each.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    # digests, ids and addresses alone are shuffled
    long = each.where(F.octet_length("html") >= REVISIT_BYTES).select("digest", "page_id", "url")
    first = long.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    first = materialised(first.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "repeated")
    # long addresses count as rows more
    weight = first.agg(F.count("*") + F.coalesce(F.sum(F.octet_length("first_url")), F.lit(0)) / 128).first()[0]
    dealt = looked_up(each, first, ["digest"], F.hash("page_id", "url"), rows=int(weight))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return dealt.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Write a record for each row of pages into bundles below folder; returns the manifest (file, records long, bytes long).

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of REVISIT_BYTES bytes or more those with the
    smallest id are responses, the others (null ids too) are revisits of it; if none of them has an id, all are responses, as
    shorter payloads always are. Rows are never dropped, repeated ones get records of their own. Other columns are ignored.
    """
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, count, files, seen = None, "", 0, [], set()

        def done() -> None:
            writer.close()
            files.append((name, count, writer.file.size))

        for batch in batches:
            for page_id, url, html, digest, kind, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name, count, seen = attempt_name("pages", f"-{len(files):04d}.warc.zst"), 0, set()
                    writer = BundleWriter(f"{folder}/{name}")
                    writer.add(page_record_id(None, name), build_info(name))
                record_id = page_record_id(page_id, digest)
                if record_id in seen:
                    record_id = page_record_id(page_id, digest, name, count)
                seen.add(record_id)
                writer.add(record_id, build_record(kind, record_id, url, html.encode(), digest, refers_to, page_id, refers_url))
                count += 1
                if writer.file.size >= FILE_BYTES:
                    done()
                    writer = None
        if writer is not None:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), *(pa.array([f[k] for f in files], pa.int64()) for k in (1, 2))], names=["file", "records", "bytes"])

    return materialised(classified(pages, id_column, url_column, html_column).mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Read every record of the manifest's bundles back: (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    A response's length and digest are taken from its payload, and must agree with its head; a revisit's come from its head, its payload is null.
    """
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                reader = BundleReader(f"{folder}/{name}")
                for record_id, record in reader.records():
                    head, block = parse_record(record)
                    if head["warc-type"] == "warcinfo":
                        continue
                    kind, digest, length = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:"), int(head["x-payload-length"])
                    if kind == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != length):
                        raise ValueError(f"{name}: {record_id} is damaged")
                    number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                    rows.append((number("x-page-id"), head.get("warc-target-uri"), block if kind == "response" else None, length, digest, kind, number("x-refers-to-page")))
                    held += len(block)
                    if held >= 8 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                        rows, held = [], 0
                reader.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    # a task reads few files: they are the unit of work here, not rows
    parts = max(1, min(2000, manifest.count()))
    return manifest.select("file").repartition(parts, "file").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages into bundles in the shared folder and return what read_archives finds there."""
    folder = shared_path(pages.sparkSession, "warc")
    return read_archives(pages.sparkSession, folder, write_archives(pages, folder))
