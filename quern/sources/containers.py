"""Image containers byte by byte: parts as rows, builders, metadata removal and rights packets. Plain Python, called in Arrow batches."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed values of the formats.
PNG_MAGIC, JPEG_MAGIC = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"
PNG_SHOWN = {b"tRNS", b"gAMA", b"cHRM", b"sRGB", b"sBIT", b"bKGD", b"pHYs", b"cICP", b"mDCV", b"cLLI", b"acTL", b"fcTL", b"fdAT"}
XMP_JPEG, EXIF_JPEG, ICC_JPEG, ADOBE_JPEG = b"http://ns.adobe.com/xap/1.0/\0", b"Exif\0\0", b"ICC_PROFILE\0", b"Adobe"
XMP_KEYWORD = b"XML:com.adobe.xmp"
SRGB_NAMES = ("sRGB", "sRGB IEC61966-2.1", "sRGB built-in")
GPS_TAG, ARTIST_TAG, COPYRIGHT_TAG, ORIENTATION_TAG = 0x8825, 0x013B, 0x8298, 0x0112


class Damaged(ValueError):
    """The bytes end too early or don't follow their format."""


@dataclass(frozen=True)
class Part:
    kind: str
    start: int
    end: int
    payload: bytes


def png_chunks(data: bytes) -> Iterator[Part]:
    """Chunks up to IEND; a chunk that is cut short ends them."""
    at = len(PNG_MAGIC)
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        end = at + 12 + size
        if end > len(data):
            return
        kind = data[at + 4 : at + 8].decode("latin1")
        yield Part(kind, at, end, data[at + 8 : end - 4])
        if kind == "IEND":
            return
        at = end


def jpeg_segments(data: bytes) -> Iterator[Part]:
    """Segments up to the scan or the end; fill bytes between them are passed over."""
    at = 2
    while at + 1 < len(data) and data[at] == 0xFF:
        while at + 1 < len(data) and data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1] if at + 1 < len(data) else 0xD9
        if marker in (0xD9, 0xDA):
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            yield Part(f"{marker:02X}", at, at + 2, b"")
            at += 2
            continue
        if at + 4 > len(data):
            return
        (size,) = struct.unpack_from(">H", data, at + 2)
        if size < 2 or at + 2 + size > len(data):
            return
        yield Part(f"{marker:02X}", at, at + 2 + size, data[at + 4 : at + 2 + size])
        at += 2 + size


def riff_chunks(data: bytes) -> Iterator[Part]:
    """Chunks of a WebP file; each starts at an even place."""
    end = min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]) if len(data) >= 12 else 0
    at = 12
    while at + 8 <= end:
        (size,) = struct.unpack_from("<I", data, at + 4)
        if at + 8 + size > end:
            return
        yield Part(data[at : at + 4].decode("latin1"), at, min(end, at + 8 + size + size % 2), data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[Part]:
    """ISO media boxes: 32-bit and 64-bit sizes, size 0 to the end, uuid types."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end:
            return
        yield Part(kind.decode("latin1"), at, at + size, data[at + head : at + size])
        at += size


def exif_entries(exif: bytes) -> list[tuple[int, int, bytes]]:
    """(tag, type, value) of the first directory, in either byte order; none where it is damaged."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(exif[:4])
    if order is None or len(exif) < 10:
        return []
    (at,) = struct.unpack_from(order + "I", exif, 4)
    if at + 2 > len(exif):
        return []
    (count,) = struct.unpack_from(order + "H", exif, at)
    out, sizes = [], {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    for k in range(count):
        place = at + 2 + 12 * k
        if place + 12 > len(exif):
            break
        tag, kind, number = struct.unpack_from(order + "HHI", exif, place)
        size = sizes.get(kind, 1) * number
        where = place + 8 if size <= 4 else struct.unpack_from(order + "I", exif, place + 8)[0]
        if where + size <= len(exif):
            out.append((tag, kind, exif[where : where + size]))
    return out


def has_gps(exif: bytes) -> bool:
    return any(tag == GPS_TAG for tag, *_ in exif_entries(exif))


def orientation_block(exif: bytes) -> bytes | None:
    """An EXIF block with the orientation alone, or None where there is none to keep."""
    for tag, kind, value in exif_entries(exif):
        if tag == ORIENTATION_TAG and kind == 3 and len(value) >= 2:
            number = int.from_bytes(value[:2], "little" if exif[:2] == b"II" else "big")
            if 2 <= number <= 8:
                return b"II*\0\x08\0\0\0" + struct.pack("<HHHIHHI", 1, ORIENTATION_TAG, 3, 1, number, 0, 0)
    return None


def build_png_chunk(kind: str, payload: bytes) -> bytes:
    body = kind.encode("latin1") + payload
    return struct.pack(">I", len(payload)) + body + struct.pack(">I", zlib.crc32(body))


def build_jpeg_segment(marker: int, payload: bytes) -> bytes:
    if len(payload) > 65_533:
        raise ValueError("the payload does not fit a segment")
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def build_riff_chunk(kind: str, payload: bytes) -> bytes:
    return kind.encode("latin1") + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)


def build_box(kind: str, payload: bytes) -> bytes:
    return struct.pack(">I", len(payload) + 8) + kind.encode("latin1") + payload


def build_webp(chunks: list[bytes]) -> bytes:
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def spliced(data: bytes, edits: list[tuple[int, int, bytes]]) -> bytes:
    """data with half-open ranges replaced, in order of start, then end."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: e[:2]):
        if start < at:
            raise ValueError("edits overlap")
        out += [data[at:start], new]
        at = end
    return b"".join([*out, data[at:]])


def is_srgb(icc: bytes) -> bool:
    """Whether a profile's description is one of the exact names of sRGB."""
    if len(icc) < 132:
        return False
    (count,) = struct.unpack_from(">I", icc, 128)
    for k in range(min(count, 100)):
        if 144 + 12 * k > len(icc):
            break
        tag, at, size = struct.unpack_from(">4sII", icc, 132 + 12 * k)
        if tag == b"desc":
            body = icc[at : at + size]
            if body[:4] == b"desc" and len(body) >= 12:
                return body[12 : 12 + max(0, struct.unpack_from(">I", body, 8)[0] - 1)].decode("latin1") in SRGB_NAMES
            if body[:4] == b"mluc" and len(body) >= 28:
                length, place = struct.unpack_from(">II", body, 20)
                return body[place : place + length].decode("utf-16-be", "replace") in SRGB_NAMES
    return False


def strip_png(data: bytes) -> tuple[bytes, list[str]]:
    """A PNG without chunks that do not change what it shows, and the kinds that went; of EXIF the orientation stays."""
    out, gone = [PNG_MAGIC], set()
    for part in png_chunks(data):
        keep = part.kind[0].isupper() or part.kind.encode() in PNG_SHOWN
        if part.kind == "iCCP":
            name, _, rest = part.payload.partition(b"\0")
            keep = not is_srgb(zlib.decompressobj().decompress(rest[1:], 1 << 24)) if rest else False
        turned = orientation_block(part.payload) if part.kind == "eXIf" else None
        if keep or turned == part.payload:
            out.append(data[part.start : part.end])
        else:
            gone.add(part.kind)
            out += [build_png_chunk("eXIf", turned)] if turned else []
    return b"".join(out), sorted(gone)


def strip_jpeg(data: bytes) -> tuple[bytes, list[str]]:
    """A JPEG with its tables, frame and scans, JFIF and Adobe heads and a profile that is not sRGB."""
    out, gone, at = [JPEG_MAGIC], set(), 2
    profile = b"".join(p.payload[14:] for p in sorted((p for p in jpeg_segments(data) if p.kind == "E2" and p.payload.startswith(ICC_JPEG)), key=lambda p: p.payload[12]))
    for part in jpeg_segments(data):
        at, marker = part.end, int(part.kind, 16)
        app = 0xE0 <= marker <= 0xEF or marker == 0xFE
        keep = not app or marker == 0xE0 and part.payload.startswith(b"JFIF\0") or marker == 0xEE and part.payload.startswith(ADOBE_JPEG)
        if marker == 0xE2 and part.payload.startswith(ICC_JPEG):
            keep = not is_srgb(profile)
        turned = orientation_block(part.payload[6:]) if marker == 0xE1 and part.payload.startswith(EXIF_JPEG) else None
        if keep or turned is not None and EXIF_JPEG + turned == part.payload:
            out.append(data[part.start : part.end])
        else:
            out += [build_jpeg_segment(0xE1, EXIF_JPEG + turned)] if turned else []
            gone.add("comment" if marker == 0xFE else "xmp" if part.payload.startswith(XMP_JPEG) else "exif" if part.payload.startswith(EXIF_JPEG) else "icc" if marker == 0xE2 else "other")
    end = data.rfind(b"\xff\xd9")
    if end < at:
        raise Damaged("the image has no end")
    return b"".join([*out, data[at : end + 2]]), sorted(gone)


def strip_webp(data: bytes) -> tuple[bytes, list[str]]:
    """A WebP without EXIF, XMP, an sRGB profile and unknown chunks; the flags of VP8X follow."""
    shown, out, gone = {"VP8 ", "VP8L", "VP8X", "ALPH", "ANIM", "ANMF"}, [], set()
    turned = next((orientation_block(p.payload) for p in riff_chunks(data) if p.kind == "EXIF"), None)
    kept_icc = any(p.kind == "ICCP" and not is_srgb(p.payload) for p in riff_chunks(data))
    for part in riff_chunks(data):
        if part.kind == "VP8X":
            flags = part.payload[0] & ~0b1100 & (0xFF if kept_icc else ~0b100000) | (0b1000 if turned else 0)
            out.append(build_riff_chunk("VP8X", bytes([flags & 0xFF]) + part.payload[1:]))
        elif part.kind in shown or part.kind == "ICCP" and kept_icc or part.kind == "EXIF" and part.payload == turned:
            out.append(build_riff_chunk(part.kind, part.payload))
        else:
            gone.add(part.kind.strip())
            out += [build_riff_chunk("EXIF", turned)] if part.kind == "EXIF" and turned else []
    return build_webp(out), sorted(gone)


def strip_avif(data: bytes) -> tuple[bytes, list[str]]:
    """An AVIF without EXIF and XMP items and sRGB profiles."""
    from quern.sources import avif

    return avif.stripped(data)


STRIP = {"png": strip_png, "jpeg": strip_jpeg, "webp": strip_webp, "avif": strip_avif}


def xmp_of(data: bytes, kind: str) -> bytes | None:
    """The XMP packet a file carries, or None."""
    if kind == "png":
        for part in png_chunks(data):
            if part.kind == "iTXt" and part.payload.startswith(XMP_KEYWORD + b"\0"):
                flags, rest = part.payload[len(XMP_KEYWORD) + 1 : len(XMP_KEYWORD) + 3], part.payload[len(XMP_KEYWORD) + 3 :]
                text = rest.split(b"\0", 2)[2]
                return zlib.decompressobj().decompress(text, 1 << 24) if flags[:1] == b"\1" else text
    elif kind == "jpeg":
        return next((p.payload[len(XMP_JPEG) :] for p in jpeg_segments(data) if p.kind == "E1" and p.payload.startswith(XMP_JPEG)), None)
    elif kind == "webp":
        return next((p.payload for p in riff_chunks(data) if p.kind == "XMP "), None)
    elif kind == "avif":
        from quern.sources import avif

        return avif.xmp_of(data)
    return None


def with_xmp(data: bytes, kind: str, packet: bytes | None, size: tuple[int, int] | None = None) -> bytes | None:
    """The file with this XMP packet in place of any it has; None where the format cannot hold it. size: for a WebP without VP8X."""
    if kind == "png":
        own = [build_png_chunk("iTXt", XMP_KEYWORD + b"\0\0\0\0\0" + packet)] if packet is not None else []
        out = [PNG_MAGIC]
        for part in png_chunks(data):
            if part.kind == "iTXt" and part.payload.startswith(XMP_KEYWORD + b"\0"):
                continue
            out.append(data[part.start : part.end])
            if part.kind == "IHDR":
                out += own
        return b"".join(out)
    if kind == "jpeg":
        if packet is not None and len(XMP_JPEG) + len(packet) > 65_533:
            return None
        cuts = [(p.start, p.end, b"") for p in jpeg_segments(data) if p.kind == "E1" and p.payload.startswith(XMP_JPEG)]
        first = next((p for p in jpeg_segments(data)), None)
        at = first.end if first is not None and first.kind == "E0" else 2
        new = [(at, at, build_jpeg_segment(0xE1, XMP_JPEG + packet))] if packet is not None else []
        return spliced(data, [*new, *cuts])
    if kind == "webp":
        chunks = [p for p in riff_chunks(data) if p.kind != "XMP "]
        if packet is None and not any(p.kind == "VP8X" for p in chunks):
            return build_webp([build_riff_chunk(p.kind, p.payload) for p in chunks])
        if not any(p.kind == "VP8X" for p in chunks):
            width, height = size or (1, 1)
            alpha = any(p.kind in ("ALPH", "VP8L") for p in chunks)
            head = bytes([0b10000 if alpha else 0, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
            chunks.insert(0, Part("VP8X", 0, 0, head))
        flag = lambda p: bytes([p.payload[0] & ~0b100 | (0b100 if packet is not None else 0)]) + p.payload[1:]
        body = [build_riff_chunk(p.kind, flag(p) if p.kind == "VP8X" else p.payload) for p in chunks]
        return build_webp(body + ([build_riff_chunk("XMP ", packet)] if packet is not None else []))
    if kind == "avif":
        from quern.sources import avif

        return avif.with_xmp(data, packet)
    raise ValueError(f"no packets in {kind}")


_NS = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "dc": "http://purl.org/dc/elements/1.1/", "photoshop": "http://ns.adobe.com/photoshop/1.0/", "xmpRights": "http://ns.adobe.com/xap/1.0/rights/",
    "plus": "http://ns.useplus.org/ldf/xmp/1.0/", "Iptc4xmpExt": "http://iptc.org/std/Iptc4xmpExt/2008-02-29/", "xml": "http://www.w3.org/XML/1998/namespace",
}


def _q(name: str) -> str:
    prefix, local = name.split(":")
    return f"{{{_NS[prefix]}}}{local}"


def read_xmp(packet: bytes) -> dict:
    """Rights fields of a packet; broken XML has none. x-default comes first among languages."""
    try:
        root = ET.fromstring(packet.decode("utf-8", "replace").lstrip("\ufeff"))
    except ET.ParseError:
        return {}
    out: dict = {}
    for about in root.iter(_q("rdf:Description")):
        def items(name: str, about=about) -> list[ET.Element]:
            node = about.find(_q(name))
            return [] if node is None else node.findall(f".//{_q('rdf:li')}") or [node]

        text = lambda e: "".join(e.itertext()).strip()
        for field, name in (("credit", "photoshop:Credit"), ("webStatement", "xmpRights:WebStatement"), ("digitalSourceType", "Iptc4xmpExt:DigitalSourceType")):
            node = about.find(_q(name))
            value = about.get(_q(name)) or (None if node is None else node.get(_q("rdf:resource")) or text(node))
            if value and value.strip():
                out.setdefault(field, value.strip())
        if creators := [text(e) for e in items("dc:creator") if text(e)]:
            out.setdefault("creator", creators)
        lines = [{"lang": e.get(_q("xml:lang"), "x-default"), "value": text(e)} for e in items("dc:rights") if text(e)]
        if lines:
            out.setdefault("copyright", sorted(lines, key=lambda x: x["lang"] != "x-default"))
        urls = [u.strip() for e in items("plus:Licensor") for u in (*(text(x) for x in e.iter(_q("plus:LicensorURL"))), e.get(_q("plus:LicensorURL")) or "") if u.strip()]
        if urls:
            out.setdefault("licensorUrl", urls)
    return out


def read_iim(resources: bytes) -> dict:
    """By-line, credit and copyright notice of IPTC datasets; UTF-8 where they say so, else Latin-1."""
    at, coded, found = 0, "latin1", []
    while at + 5 <= len(resources):
        if resources[at] != 0x1C:
            at += 1
            continue
        record, dataset, size = resources[at + 1], resources[at + 2], struct.unpack_from(">H", resources, at + 3)[0]
        value = resources[at + 5 : at + 5 + size]
        if size & 0x8000 or len(value) < size:
            break
        if (record, dataset) == (1, 90) and value == b"\x1b%G":
            coded = "utf-8"
        found.append((record, dataset, value))
        at += 5 + size
    text = lambda n: [v.decode(coded, "replace").strip() for r, d, v in found if (r, d) == (2, n) and v.strip()]
    out = {"creator": text(80)} if text(80) else {}
    out |= {"credit": text(110)[0]} if text(110) else {}
    return out | ({"copyright": [{"lang": "x-default", "value": text(116)[0]}]} if text(116) else {})


def read_exif_rights(exif: bytes) -> dict:
    """Artist and copyright; parts between NULs are trimmed and joined."""

    def text(raw: bytes) -> str:
        try:
            value = raw.decode("utf-8")
        except UnicodeDecodeError:
            value = raw.decode("latin1")
        return ", ".join(p.strip() for p in value.split("\0") if p.strip())

    out = {}
    for tag, _, value in exif_entries(exif):
        if tag == ARTIST_TAG and text(value):
            out["creator"] = [p.strip() for p in text(value).split(";") if p.strip()]
        if tag == COPYRIGHT_TAG and text(value):
            out["copyright"] = [{"lang": "x-default", "value": text(value)}]
    return out


def read_rights(data: bytes, kind: str) -> dict:
    """Rights of a file: XMP, then IPTC, then EXIF; the first carrier of a field wins."""
    exif = iim = b""
    if kind == "jpeg":
        for p in jpeg_segments(data):
            exif = exif or (p.payload[6:] if p.kind == "E1" and p.payload.startswith(EXIF_JPEG) else b"")
            iim = iim or (p.payload if p.kind == "ED" else b"")
    elif kind == "png":
        exif = next((p.payload for p in png_chunks(data) if p.kind == "eXIf"), b"")
    elif kind == "webp":
        exif = next((p.payload for p in riff_chunks(data) if p.kind == "EXIF"), b"")
    elif kind == "avif":
        from quern.sources import avif

        exif = avif.exif_of(data)
    packet = xmp_of(data, kind)
    return read_exif_rights(exif) | read_iim(iim) | (read_xmp(packet) if packet else {})


def png_of(pixels, text: str | None = None) -> bytes:
    """A PNG of a uint8 array of height, width and 3 or 4 channels."""
    height, width, channels = pixels.shape
    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    extra = build_png_chunk("tEXt", b"Comment\0" + text.encode("latin1", "replace")) if text is not None else b""
    return PNG_MAGIC + build_png_chunk("IHDR", head) + extra + build_png_chunk("IDAT", zlib.compress(rows, 9)) + build_png_chunk("IEND", b"")


def pixels_of(png: bytes):
    """A uint8 array of an 8-bit RGB or RGBA PNG that is not interlaced."""
    import numpy as np

    head = next((p.payload for p in png_chunks(png) if p.kind == "IHDR"), b"")
    if len(head) != 13:
        raise Damaged("the image has no head")
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    if depth != 8 or colour not in (2, 6) or interlace:
        raise Damaged("only 8-bit RGB and RGBA without interlacing are read")
    n = 3 if colour == 2 else 4
    raw = zlib.decompress(b"".join(p.payload for p in png_chunks(png) if p.kind == "IDAT"))
    out, above = np.zeros((height, width * n), np.uint8), np.zeros(width * n, np.int64)
    for y in range(height):
        kind, line = raw[y * (width * n + 1)], np.frombuffer(raw, np.uint8, width * n, y * (width * n + 1) + 1).astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            for i in range(width * n):
                a, b, c = (line[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
                if kind == 4:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                else:
                    guess = a if kind == 1 else (a + b) // 2
                line[i] = (line[i] + guess) & 255
        above = line & 255
        out[y] = above
    return out.reshape(height, width, n)
