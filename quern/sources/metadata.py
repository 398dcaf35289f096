"""Metadata of files row by row in Arrow batches: rights read and written, what a strip keeps, facts of SVGs. A damaged file is a row with an error."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

RIGHTS = "struct<creator:array<string>,credit:string,copyright:array<struct<lang:string,value:string>>,webStatement:string,licensorUrl:array<string>,digitalSourceType:string>"


def _each(files: DataFrame, columns: list[str], schema: str, of: Callable[[dict], dict]) -> DataFrame:
    """A row (id, …, error) for each file; what cannot be read has nulls and an error."""
    fields = to_arrow_schema(_parse_datatype_string(f"id long, {schema}, error string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    found = of(row) | {"error": None}
                except (ValueError, TypeError, KeyError, IndexError, struct.error) as e:
                    found = {"error": f"E_DECODE: {str(e).splitlines()[0] if str(e) else type(e).__name__}"}
                rows.append({"id": row["id"]} | found)
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return files.select("id", *columns).mapInArrow(run, f"id long, {schema}, error string")


def with_packets(files: DataFrame) -> DataFrame:
    """files (id, format, content, packet) to (id, format, content, error): the packet in place of any there is; null takes it out."""

    def of(row: dict) -> dict:
        from quern.sources import containers

        packet = row["packet"]
        out = containers.with_xmp(row["content"], row["format"], None if packet is None else packet.encode(), (1, 1))
        if out is None:
            raise ValueError("the packet does not fit the format")
        return {"format": row["format"], "content": out}

    return _each(files, ["format", "content", "packet"], "format string, content binary", of)


def rights_read(files: DataFrame) -> DataFrame:
    """files (id, format, content) to (id, rights, error)."""

    def of(row: dict) -> dict:
        from quern.sources import containers

        return {"rights": containers.read_rights(row["content"], row["format"])}

    return _each(files, ["format", "content"], f"rights {RIGHTS}", of)


def kept_by_strip(files: DataFrame) -> DataFrame:
    """JPEG files (id, content) to (id, removed, orientation, profile, error): kinds that a strip takes out, and the orientation and profile that it leaves."""

    def of(row: dict) -> dict:
        from quern.sources import containers as C

        data, removed = C.strip_jpeg(row["content"])
        parts = list(C.jpeg_segments(data))
        exif = next((p.payload[len(C.EXIF_JPEG) :] for p in parts if p.payload.startswith(C.EXIF_JPEG)), b"")
        turned = next((int.from_bytes(v[:2], "little" if exif[:2] == b"II" else "big") for tag, _, v in C.exif_entries(exif) if tag == C.ORIENTATION_TAG), None)
        return {"removed": removed, "orientation": turned, "profile": any(p.payload.startswith(C.ICC_JPEG) for p in parts)}

    return _each(files, ["content"], "removed array<string>, orientation int, profile boolean", of)


def svg_facts(files: DataFrame) -> DataFrame:
    """files (id, text) to (id, viewBox, title, referencedIds, metadata, error)."""

    def of(row: dict) -> dict:
        from quern.sources import svg

        return svg.inspect_svg(row["text"])

    return _each(files, ["text"], "viewBox string, title string, referencedIds array<string>, metadata array<string>", of)


def sample_carriers(names: DataFrame) -> DataFrame:
    """names (id, name) to JPEG files (id, content, error): EXIF with an artist, a copyright and an orientation from 1 to 8, IIM with two by-lines
    and a credit, and a profile in two parts, the second one first, which is sRGB for even ids.
    """

    def of(row: dict) -> dict:
        from quern.sources import containers as C

        name, order = row["name"].encode(), "<" if row["id"] % 2 else ">"
        values = [name + b"; Second\0", b" held by \0" + name + b"\0"]
        at = 8 + 2 + 12 * 3 + 4
        entries = struct.pack(order + "HHIHH", C.ORIENTATION_TAG, 3, 1, row["id"] % 8 + 1, 0)
        for tag, value in zip((C.ARTIST_TAG, C.COPYRIGHT_TAG), values, strict=True):
            entries += struct.pack(order + "HHII", tag, 2, len(value), at)
            at += len(value)
        exif = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, 3) + entries + bytes(4) + b"".join(values)
        said = lambda d, v: bytes([0x1C, 2, d]) + struct.pack(">H", len(v)) + v
        iim = b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + (said(80, name) + said(80, b"Other") + said(110, b"Credit " + name) if row["id"] % 3 else b"")
        title = b"sRGB\0" if row["id"] % 2 == 0 else b"Wide\0"
        profile = bytes(128) + struct.pack(">I4sII", 1, b"desc", 144, 12 + len(title)) + b"desc" + bytes(4) + struct.pack(">I", len(title)) + title
        parts = [C.build_jpeg_segment(0xE2, C.ICC_JPEG + bytes([n + 1, 2]) + profile[n * 100 : n * 100 + 100]) for n in (1, 0)]
        return {"content": C.JPEG_MAGIC + C.build_jpeg_segment(0xE1, C.EXIF_JPEG + exif) + C.build_jpeg_segment(0xED, iim) + b"".join(parts) + b"\xff\xda\0\2scan\xff\xd9"}

    return _each(names, ["name"], "content binary", of)
