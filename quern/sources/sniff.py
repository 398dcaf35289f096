"""Formats by their first bytes, in built-in functions, and containers taken apart in Arrow batches."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.schemas import SNIFFED_BYTES

#: What may stand before an SVG's root: a byte order mark, white space, instructions, comments and a document type.
_SVG = "^(?:\\x{EF}\\x{BB}\\x{BF})?(?s:\\s|<\\?.*?\\?>|<!--.*?-->|<!DOCTYPE(?:[^>\\[]|\\[.*?\\])*>)*<svg[\\s/>]"


def _hex(content: Column, start: int, length: int) -> Column:
    return F.hex(F.substring(content, start, length))


def brands(content: Column) -> Column:
    """The major and the compatible brands of an ISO media file as text; the minor version between them is no brand."""
    size = F.conv(_hex(content, 1, 4), 16, 10).cast("long")
    last = F.least(size, F.octet_length(content).cast("long")) - 3
    more = F.when(last >= 17, F.transform(F.sequence(F.lit(17).cast("long"), last, F.lit(4).cast("long")), lambda at: F.decode(F.substr(content, at.cast("int"), F.lit(4)), "ISO-8859-1"))).otherwise(F.array().cast("array<string>"))
    major = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    return F.when(_hex(content, 5, 4) == "66747970", F.concat(F.array(major), more)).otherwise(F.array().cast("array<string>"))


def detected_format(content: Column) -> Column:
    """png, jpeg, webp, avif or svg by the first bytes, else null; an SVG's prolog is read up to SNIFFED_BYTES."""
    head = F.substring(content, 1, SNIFFED_BYTES)
    out = F.when(_hex(content, 1, 8) == "89504E470D0A1A0A", "png").when(_hex(content, 1, 3) == "FFD8FF", "jpeg")
    out = out.when((_hex(content, 1, 4) == "52494646") & (_hex(content, 9, 4) == "57454250"), "webp")
    out = out.when(F.arrays_overlap(brands(content), F.array(F.lit("avif"), F.lit("avis"))), "avif")
    return out.when(F.decode(head, "ISO-8859-1").rlike(_SVG), "svg")


def is_avif_sequence(content: Column) -> Column:
    return F.array_contains(brands(content), "avis")


def gzip_sizes(files: DataFrame) -> DataFrame:
    """files (id, content) to (id, gzip_bytes) at the highest level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(gzip.compress(x or b"", 9, mtime=0)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "gzip_bytes"])

    return files.select("id", "content").mapInArrow(run, "id long, gzip_bytes long")


def _mapped(files: DataFrame, schema: str, arrow: pa.Schema, rows) -> DataFrame:
    """files, row by row, to the rows that rows(row) gives, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for row in batch.to_pylist() for r in rows(row)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.mapInArrow(run, schema)


def sample_packet(name: bytes) -> bytes:
    """The packet that a sample carries."""
    return b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/" photoshop:Credit="' + name + b'"/></rdf:RDF></x:xmpmeta>'


def sample_avif(coded: bytes) -> bytes:
    """The boxes of an AVIF whose only item is an image of these coded bytes, one pixel wide."""
    from quern.sources.containers import build_box as box

    entry = box("infe", bytes([2, 0, 0, 0]) + b"\0\1\0\0av01\0")
    size = box("iprp", box("ipco", box("ispe", bytes(4) + b"\0\0\0\1\0\0\0\1")) + box("ipma", bytes(4) + b"\0\0\0\1\0\1\1\1"))
    head, body = box("ftyp", b"avif\0\0\0\0avifmif1"), b""
    for _ in range(2):  # offsets have a fixed width: the second time the place of the data is known
        at = len(head) + len(body) + 8
        places = box("iloc", bytes(4) + b"\x44\0\0\1\0\1\0\0\0\1" + at.to_bytes(4, "big") + len(coded).to_bytes(4, "big"))
        body = box("meta", bytes(4) + box("pitm", bytes(4) + b"\0\1") + places + box("iinf", bytes(4) + b"\0\1" + entry) + size)
    return head + body + box("mdat", coded)


def sample_files(names: DataFrame, kind: str) -> DataFrame:
    """names (id, name) to (id, format, content): a small file of the kind that carries the name as metadata."""

    def build(row: dict) -> list[dict]:
        import numpy as np

        from quern.sources import containers as C

        name = row["name"].encode()
        packet = sample_packet(name)
        if kind == "png":
            side = row["id"] % 5 + 1
            content = C.with_xmp(C.png_of(np.full((side, side, 3), row["id"] % 256, np.uint8), row["name"]), "png", packet)
        elif kind == "jpeg":
            bare = C.JPEG_MAGIC + C.build_jpeg_segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + C.build_jpeg_segment(0xFE, name) + C.build_jpeg_segment(0xDB, b"\0" * 65) + b"\xff\xda\0\2" + name + b"\xff\xd9"
            content = C.with_xmp(bare, "jpeg", packet)
        elif kind == "avif":
            content = C.with_xmp(sample_avif(name), "avif", packet)
        else:
            content = C.with_xmp(C.build_webp([C.build_riff_chunk("VP8 ", name), C.build_riff_chunk("EXIF", b"II*\0\x08\0\0\0\0\0")]), "webp", packet, (4, 4))
        return [{"id": row["id"], "format": kind, "content": content}]

    arrow = pa.schema([("id", pa.int64()), ("format", pa.string()), ("content", pa.binary())])
    return _mapped(names.select("id", "name"), "id long, format string, content binary", arrow, build)


def container_rows(files: DataFrame, kind: str) -> DataFrame:
    """files (id, content) to (id, number, kind, start, end, bytes): a row for each chunk, segment or box."""

    def take_apart(row: dict) -> list[dict]:
        from quern.sources import containers as C

        reader = {"png": C.png_chunks, "jpeg": C.jpeg_segments, "webp": C.riff_chunks, "avif": C.boxes}[kind]
        return [{"id": row["id"], "number": n, "kind": p.kind, "start": p.start, "end": p.end, "bytes": len(p.payload)} for n, p in enumerate(reader(row["content"] or b""))]

    arrow = pa.schema([("id", pa.int64()), ("number", pa.int32()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.int64())])
    return _mapped(files.select("id", "content"), "id long, number int, kind string, start long, end long, bytes long", arrow, take_apart)


def stripped_files(files: DataFrame) -> DataFrame:
    """files (id, format, content) to (id, format, bytes, stripped_bytes, removed, rights, error): damaged files are rows with an error."""

    def strip(row: dict) -> list[dict]:
        from quern.sources import containers as C

        out = {"id": row["id"], "format": row["format"], "bytes": len(row["content"] or b""), "stripped_bytes": None, "removed": None, "rights": None, "error": None}
        try:
            data, removed = C.STRIP[row["format"]](row["content"])
            out |= {"stripped_bytes": len(data), "removed": ",".join(removed), "rights": json.dumps(C.read_rights(row["content"], row["format"]), sort_keys=True)}
        except (KeyError, TypeError, ValueError, IndexError) as e:
            out["error"] = f"E_DECODE: {str(e).splitlines()[0] if str(e) else type(e).__name__}"
        return [out]

    arrow = pa.schema([("id", pa.int64()), ("format", pa.string()), ("bytes", pa.int64()), ("stripped_bytes", pa.int64()), ("removed", pa.string()), ("rights", pa.string()), ("error", pa.string())])
    return _mapped(files.select("id", "format", "content"), "id long, format string, bytes long, stripped_bytes long, removed string, rights string, error string", arrow, strip)
