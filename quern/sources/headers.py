"""What a file's header says of its image: size, alpha, depth, orientation, profile, kinds of metadata, animation. No pixel is decoded, and parts that say none of it are stepped over."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources import containers as C
from quern.sources.ranges import Ranges, with_file

# Fixed values of the formats.
_FRAMES = {m for m in range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
_ALPHA_TYPES = ("urn:mpeg:mpegB:cicp:systems:auxiliary:alpha", "urn:mpeg:hevc:2015:auxid:1")
_IPTC_JPEG = b"Photoshop 3.0\0"
#: Bytes of one part that are read, at most; larger ones are damage.
_MOST = 64 << 20


class Animated(ValueError):
    """The file has several images in time."""


class Unsupported(ValueError):
    """The file is of no format that is read."""


def _need(r: Ranges, at: int, n: int) -> bytes:
    out = r.get(at, n) if n <= _MOST else b""
    if len(out) < n:
        raise C.Damaged("the header is cut short")
    return out


def orientation_of(exif: bytes) -> int:
    """1 to 8; 1 where nothing sound is said."""
    order = "<" if exif[:2] == b"II" else ">"
    for tag, kind, value in C.exif_entries(exif):
        if tag == C.ORIENTATION_TAG and kind == 3 and len(value) >= 2:
            (found,) = struct.unpack_from(order + "H", value)
            return found if 1 <= found <= 8 else 1
    return 1


def _facts(width: int, height: int, alpha: bool, depth: int, exif: bytes | None, icc: bytes | None, kinds: set[str], lossless: bool | None = None, turned: bool | None = None) -> dict:
    """turned: whether the image is shown on its side, where not the EXIF says it."""
    if not width or not height:
        raise C.Damaged("the image has no size")
    orientation = 1 if exif is None or turned is not None else orientation_of(exif)
    if orientation >= 5 or turned:
        width, height = height, width
    if exif is not None:
        kinds |= {"exif"} | ({"gps"} if C.has_gps(exif) else set())
    return {"width": width, "height": height, "alpha": alpha, "depth": 16 if depth > 8 else 8, "orientation": orientation, "icc": None if icc is None else "srgb" if C.is_srgb(icc) else "non-srgb", "kinds": sorted(kinds), "lossless": lossless}


def png(r: Ranges) -> dict:
    """Chunks before the image data; an acTL among them makes it an animation."""
    at, head, alpha, exif, icc, kinds = 8, None, False, None, None, set()
    while True:
        size, kind = struct.unpack(">I4s", _need(r, at, 8))
        if head is None and (kind != b"IHDR" or size != 13):
            raise C.Damaged("the first chunk is no header")
        if kind == b"IHDR":
            head = struct.unpack(">IIBB", _need(r, at + 8, 10))
        elif kind == b"IDAT":
            break
        elif kind == b"acTL":
            raise Animated
        elif kind == b"tRNS":
            alpha = True
        elif kind == b"eXIf":
            exif = _need(r, at + 8, size)
        elif kind == b"iCCP":
            rest = _need(r, at + 8, size).partition(b"\0")[2]
            try:
                icc = zlib.decompressobj().decompress(rest[1:], 1 << 24)
            except zlib.error:
                icc = None
        elif kind in (b"tEXt", b"zTXt", b"iTXt"):
            keyword = r.get(at + 8, min(size, 80)).partition(b"\0")[0]
            kinds.add("xmp" if kind == b"iTXt" and keyword == C.XMP_KEYWORD else "text")
        elif kind == b"IEND":
            raise C.Damaged("there is no image data")
        at += 12 + size
    width, height, depth, colour = head
    return _facts(width, height, alpha or colour in (4, 6), depth, exif, icc, kinds)


def jpeg(r: Ranges) -> dict:
    """Segments before the first scan."""
    at, frame, exif, profile, kinds = 2, None, None, [], set()
    while True:
        while (mark := _need(r, at, 2)) == b"\xff\xff":
            at += 1
        if mark[0] != 0xFF or mark[1] in (0xD9, 0xDA):
            break
        marker = mark[1]
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        (size,) = struct.unpack(">H", _need(r, at + 2, 2))
        if size < 2:
            raise C.Damaged("a segment has no size")
        if marker in _FRAMES:
            frame = struct.unpack(">BHH", _need(r, at + 4, 5))
        elif marker == 0xFE:
            kinds.add("comment")
        elif marker in (0xE1, 0xE2, 0xED):
            body = _need(r, at + 4, size - 2)
            if body.startswith(C.EXIF_JPEG) and marker == 0xE1:
                exif = exif if exif is not None else body[len(C.EXIF_JPEG) :]
            elif body.startswith(C.XMP_JPEG) and marker == 0xE1:
                kinds.add("xmp")
            elif body.startswith(C.ICC_JPEG) and marker == 0xE2 and len(body) >= 14:
                profile.append((body[12], body[14:]))
            elif body.startswith(_IPTC_JPEG) and marker == 0xED:
                kinds.add("iptc")
        at += 2 + size
    if frame is None:
        raise C.Damaged("there is no frame")
    depth, height, width = frame
    return _facts(width, height, False, depth, exif, b"".join(b for _, b in sorted(profile, key=lambda p: p[0])) if profile else None, kinds)


def webp(r: Ranges) -> dict:
    """Chunk heads, and the first bytes of the image's."""
    end = min(r.size, 8 + struct.unpack("<I", _need(r, 4, 4))[0])
    at, size, alpha, frames, exif, icc, kinds, lossless, canvas = 12, None, False, 0, None, None, set(), None, None
    while at + 8 <= end:
        kind, n = struct.unpack("<4sI", _need(r, at, 8))
        if at + 8 + n > end:
            break
        if kind == b"VP8X":
            head = _need(r, at + 8, 10)
            alpha, canvas = bool(head[0] & 0x10), (1 + int.from_bytes(head[4:7], "little"), 1 + int.from_bytes(head[7:10], "little"))
        elif kind == b"VP8 " and size is None:
            head = _need(r, at + 8, 10)
            if head[0] & 1 or head[3:6] != b"\x9d\x01\x2a":
                raise C.Damaged("the frame is no key frame")
            size, lossless = tuple(x & 0x3FFF for x in struct.unpack("<HH", head[6:10])), False
        elif kind == b"VP8L" and size is None:
            head = _need(r, at + 8, 5)
            bits = int.from_bytes(head[1:5], "little")
            if head[0] != 0x2F:
                raise C.Damaged("the lossless image has no mark")
            size, alpha, lossless = (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)), bool(bits >> 28 & 1), True
        elif kind == b"ALPH":
            alpha = True
        elif kind == b"ANMF":
            frames += 1
        elif kind == b"EXIF":
            exif = _need(r, at + 8, n).removeprefix(C.EXIF_JPEG)
        elif kind == b"ICCP":
            icc = _need(r, at + 8, n)
        elif kind == b"XMP ":
            kinds.add("xmp")
        at += 8 + n + n % 2
    if frames > 1:
        raise Animated
    if size is None and not frames:
        raise C.Damaged("there is no image")
    return _facts(*(canvas or size or (0, 0)), alpha, 8, exif, icc, kinds, lossless)


def _properties(file, data: bytes) -> dict[int, list[C.Part]]:
    """The properties of each item."""
    from quern.sources.avif import Fields, _body

    box = file.inner.get("iprp")
    parts = {p.kind: p for p in C.boxes(data, _body(box), box.end)} if box else {}
    if not {"ipco", "ipma"} <= set(parts):
        return {}
    all_of = list(C.boxes(data, _body(parts["ipco"]), parts["ipco"].end))
    f = Fields(data, _body(parts["ipma"]), parts["ipma"].end)
    head = f.number(4)
    out: dict[int, list[C.Part]] = {}
    for _ in range(f.number(4)):
        item = f.number(4 if head >> 24 else 2)
        for _ in range(f.number(1)):
            index = f.number(2) & 0x7FFF if head & 1 else f.number(1) & 0x7F
            if 1 <= index <= len(all_of):
                out.setdefault(item, []).append(all_of[index - 1])
    return out


def avif(r: Ranges) -> dict:
    """The brands, then the item tables, which are one box; metadata items are read where they are."""
    from quern.sources import avif as A

    at, meta = 0, None
    while at + 8 <= r.size and meta is None:
        size, kind = struct.unpack(">I4s", _need(r, at, 8))
        size = int.from_bytes(_need(r, at + 8, 8), "big") if size == 1 else size or r.size - at
        if size < 8:
            raise C.Damaged("a box has no size")
        if kind == b"ftyp":
            body = _need(r, at + 8, size - 8)
            if b"avis" in [body[:4], *(body[k : k + 4] for k in range(8, len(body), 4))]:
                raise Animated
        if kind == b"meta":
            meta = _need(r, at, size)
        at += size
    if meta is None:
        raise Unsupported if at == r.size else C.Damaged("there are no items")
    file = A.File(meta)  # a file of that box alone: items' places are those in the whole
    primary, of = file.primary(), _properties(file, meta)
    own = {p.kind: p.payload for p in reversed(of.get(primary, []))}
    if "ispe" not in own or len(own["ispe"]) < 12:
        raise C.Damaged("the primary item has no size")
    width, height = struct.unpack_from(">II", own["ispe"], 4)
    depth = max(own["pixi"][5:], default=8) if "pixi" in own else (12 if own["av1C"][2] & 0x20 else 10) if len(own.get("av1C", b"")) > 2 and own["av1C"][2] & 0x40 else 8
    aux = {number for box, _, number, to in file.references() if box.kind == "auxl" and primary in to}
    alpha = any(p.kind == "auxC" and p.payload[4:].partition(b"\0")[0].decode("latin1") in _ALPHA_TYPES for item in aux for p in of.get(item, []))
    icc = next((p.payload[4:] for p in of.get(primary, []) if p.kind == "colr" and p.payload[:4] in (b"prof", b"rICC")), None)
    exif, kinds = None, set()
    for item in file.table.items:
        kind = next((k for n, k, _ in file.entries if n == item.id), "")
        if kind == "exif" and exif is None:
            where = [r.get(a, b - a) for a, b in item.ranges()] if item.construction == A.IN_FILE and not item.reference else [file.item_data(item)]
            exif = A.exif_block(b"".join(where))
        elif kind == "xmp":
            kinds.add("xmp")
    turned = bool(own.get("irot", b"\0")[0] & 1)
    return _facts(width, height, alpha, depth, exif, icc, kinds, turned=turned)


def inspect(r: Ranges) -> dict:
    """format, bytes and the facts of a PNG, JPEG, WebP or AVIF, or error: E_UNSUPPORTED_FORMAT, E_ANIMATED or E_DECODE."""
    head = r.get(0, 64)
    brand = head[4:8] == b"ftyp" and {head[8:12], *(r.get(16, min(4096, int.from_bytes(head[:4], "big") - 16))[k : k + 4] for k in range(0, 4096, 4))} & {b"avif", b"avis"}
    kind = "png" if head[:8] == C.PNG_MAGIC else "jpeg" if head[:3] == b"\xff\xd8\xff" else "webp" if head[:4] == b"RIFF" and head[8:12] == b"WEBP" else "avif" if brand else None
    out = {"format": kind, "bytes": r.size}
    try:
        if kind is None:
            raise Unsupported
        return out | {"png": png, "jpeg": jpeg, "webp": webp, "avif": avif}[kind](r) | {"error": None}
    except Animated:
        return out | {"error": "E_ANIMATED"}
    except Unsupported:
        return out | {"error": "E_UNSUPPORTED_FORMAT"}
    except (ValueError, TypeError, KeyError, IndexError, struct.error):
        return out | {"error": "E_DECODE"}


_ADDED = "format string, bytes long, width long, height long, alpha boolean, depth int, orientation int, icc string, kinds array<string>, lossless boolean, error string"


def _with_facts(df: DataFrame, source: str, of) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(_ADDED)
    kept = df.drop(*[f.name for f in added.fields if f.name != source])
    columns = [c for c in kept.columns if c != source or source == "path"]
    fields, arrow = [kept.schema[c] for c in columns], to_arrow_schema(added)
    at = kept.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(batch.column(at)[k]) for k in range(batch.num_rows)]
            facts = [pa.array([r.get(f.name) for r in rows], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), *facts], names=[*columns, *arrow.names])

    return kept.mapInArrow(run, StructType([*fields, *added.fields]))


def inspected_contents(files: DataFrame, content_column: str = "content") -> DataFrame:
    """files with what inspect() says in place of their content. Null and empty contents are E_UNSUPPORTED_FORMAT; other columns stay, those of the same names give way."""

    def of(value: pa.BinaryScalar) -> dict:
        data = value.as_buffer() if value.is_valid else None  # no copy: a header is little of a file
        return inspect(Ranges(lambda at, n: data.slice(at, n).to_pybytes(), data.size) if data is not None else Ranges.of(b""))

    return _with_facts(files, content_column, of)


def inspected_files(paths: DataFrame) -> DataFrame:
    """paths (path, ...) with what inspect() says of the files there, read by range; a file that can't be read is E_READ."""
    return _with_facts(paths, "path", lambda value: with_file(value.as_py(), inspect))


def summary(facts: DataFrame) -> DataFrame:
    """Facts with kinds as one text, as reports show them."""
    return facts.withColumn("kinds", F.array_join("kinds", ","))
