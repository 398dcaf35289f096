import struct
import zlib

import pytest

from quern.sources import headers as H
from quern.sources import ranges as R


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def png(*more, width=3, height=2, depth=8, colour=2):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + b"".join(more) + chunk(b"IDAT", b"x" * 50_000) + chunk(b"tEXt", b"Late\0text") + chunk(b"IEND", b"")


def exif(orientation, gps=False):
    entries = [struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0)] + ([struct.pack("<HHII", 0x8825, 4, 1, 99)] if gps else [])
    return b"II*\0\x08\0\0\0" + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"


def riff(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def avif(alpha=False, depth=8, turn=None, brand=b"avif", exif_item=None, pixi=True):
    infe = lambda n, kind: box(b"infe", b"\2\0\0\0", struct.pack(">HH", n, 0), kind, b"\0")
    full = b"\0" * 4
    properties = [box(b"ispe", full, struct.pack(">II", 640, 480)), box(b"auxC", full, b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha\0"), box(b"pixi", full, bytes([3, depth, depth, depth])), box(b"irot", bytes([turn or 0])), box(b"av1C", bytes([0x81, 0, 0x40 if depth == 10 else 0, 0]))]
    own = [1, 5] + ([3] if pixi else []) + ([4] if turn is not None else [])
    ipma = box(b"ipma", full, struct.pack(">I", 2), b"\0\1", bytes([len(own), *own]), b"\0\2", bytes([2, 1, 2]))
    payload = (b"\0\0\0\0" + exif_item) if exif_item else b""
    items = b"".join([infe(1, b"av01"), infe(2, b"av01"), infe(3, b"Exif") if exif_item else b""])
    ftyp = box(b"ftyp", brand, full, b"mif1", b"miaf")

    def meta(at):
        iloc = box(b"iloc", full, b"\x44\x00", struct.pack(">H", 1), struct.pack(">HHHII", 3, 0, 1, at, len(payload))) if exif_item else box(b"iloc", full, b"\x44\x00\0\0")
        iref = box(b"iref", full, box(b"auxl", struct.pack(">HHH", 2, 1, 1))) if alpha else b""
        return box(b"meta", full, box(b"pitm", full, b"\0\1"), iloc, box(b"iinf", full, struct.pack(">H", 3 if exif_item else 2), items), iref, box(b"iprp", box(b"ipco", *properties), ipma))

    at = len(ftyp) + len(meta(0)) + 8
    return ftyp + meta(at) + box(b"mdat", payload, b"\0" * 9000)


def facts(data):
    r = R.Ranges.of(data)
    return H.inspect(r), r


def only(data, *names):
    got, _ = facts(data)
    return tuple(got.get(n) for n in names)


def test_png():
    assert only(png(), "format", "width", "height", "alpha", "depth", "orientation", "icc", "kinds", "error") == ("png", 3, 2, False, 8, 1, None, [], None)
    assert only(png(depth=16, colour=6), "alpha", "depth") == (True, 16)
    assert only(png(chunk(b"PLTE", b"abc"), chunk(b"tRNS", b"\0"), colour=3), "alpha") == (True,)
    assert only(png(chunk(b"eXIf", exif(6, gps=True)), chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0<x/>"), chunk(b"zTXt", b"k\0\0")), "width", "height", "orientation", "kinds") == (2, 3, 6, ["exif", "gps", "text", "xmp"])
    assert only(png(chunk(b"acTL", b"\0" * 8)), "format", "error") == ("png", "E_ANIMATED")
    assert only(png()[:40], "error") == ("E_DECODE",) and only(b"\x89PNG\r\n\x1a\n", "error") == ("E_DECODE",) and only(png(width=0), "error") == ("E_DECODE",)
    assert only(png(chunk(b"iCCP", b"x\0\0broken")), "icc", "error") == (None, None)


def test_headers_alone_are_read():
    _, r = facts(png())
    assert r.taken <= 2 * R.BLOCK_BYTES
    big = riff((b"VP8X", bytes([0x0C, 0, 0, 0]) + b"\1\0\0\2\0\0"), (b"VP8 ", b"\x10\0\0\x9d\x01\x2a\2\0\3\0" + b"\0" * 200_000), (b"EXIF", exif(3)), (b"XMP ", b"<x/>"))
    got, r = facts(big)
    assert (got["width"], got["height"], got["orientation"], got["kinds"]) == (2, 3, 3, ["exif", "xmp"]) and r.taken < 20_000


def test_jpeg():
    seg = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    sof = lambda m=0xC0, depth=8: seg(m, struct.pack(">BHHB", depth, 20, 30, 1) + b"\1\x11\0")
    scan = seg(0xDA, b"\1\1\0\0\x3f\0") + b"\xff\xfe\0\4zz" + b"\xff\xd9"
    assert only(b"\xff\xd8" + sof() + scan, "format", "width", "height", "alpha", "depth", "orientation", "kinds") == ("jpeg", 30, 20, False, 8, 1, [])
    assert only(b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + exif(8)) + seg(0xFE, b"hi") + seg(0xED, b"Photoshop 3.0\0") + b"\xff\xff\xff" + sof(0xC2, 12)[1:] + scan, "width", "depth", "orientation", "kinds") == (20, 16, 8, ["comment", "exif", "iptc"])
    assert only(b"\xff\xd8" + seg(0xC4, b"\0" * 19) + scan, "error") == ("E_DECODE",) and only(b"\xff\xd8\xff\xe0\0", "error") == ("E_DECODE",)
    assert only(b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + exif(9)) + sof() + scan, "orientation", "width") == (1, 30)
    assert only(b"\xff\xd8" + seg(0xE2, b"ICC_PROFILE\0\1\1" + b"\0" * 140) + sof() + scan, "icc") == ("non-srgb",)


def test_webp():
    lossless = lambda w, h, a: b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14 | a << 28)
    assert only(riff((b"VP8L", lossless(16384, 5, 1))), "width", "height", "alpha", "lossless") == (16384, 5, True, True)
    assert only(riff((b"VP8L", lossless(1, 1, 0))), "width", "alpha", "lossless") == (1, False, True)
    vp8 = b"\x10\0\0\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 300, 200)
    assert only(riff((b"VP8 ", vp8)), "width", "height", "alpha", "lossless", "depth") == (300, 200, False, False, 8)
    canvas = bytes(4) + (299).to_bytes(3, "little") + (199).to_bytes(3, "little")
    assert only(riff((b"VP8X", canvas), (b"ALPH", b"\0"), (b"VP8 ", vp8)), "alpha") == (True,)
    frame = (b"ANMF", b"\0" * 16)
    assert only(riff((b"VP8X", canvas), frame, frame), "error") == ("E_ANIMATED",) and only(riff((b"VP8X", canvas), frame), "width", "error") == (300, None)
    assert only(riff((b"VP8 ", b"\x11" + vp8[1:])), "error") == ("E_DECODE",) and only(riff((b"XMP ", b"x")), "error") == ("E_DECODE",)


def test_avif():
    assert only(avif(), "format", "width", "height", "alpha", "depth", "error") == ("avif", 640, 480, False, 8, None)
    assert only(avif(alpha=True, depth=10, turn=1), "width", "height", "alpha", "depth", "orientation") == (480, 640, True, 16, 1)
    assert only(avif(depth=10, pixi=False), "depth") == (16,) and only(avif(turn=2), "width") == (640,)
    assert only(avif(exif_item=exif(6, gps=True)), "kinds", "orientation", "width") == (["exif", "gps"], 1, 640)
    assert only(avif(brand=b"avis"), "error") == ("E_ANIMATED",) and only(avif()[:100], "error") == ("E_DECODE",)
    assert only(box(b"ftyp", b"avif", b"\0" * 4), "error") == ("E_UNSUPPORTED_FORMAT",)


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"\0" * 300, b"RIFF\4\0\0\0WAVE"])
def test_other_files(data):
    assert only(data, "format", "error") == (None, "E_UNSUPPORTED_FORMAT")


def test_damage_anywhere_is_told():
    for data in (png(chunk(b"eXIf", exif(6))), avif(alpha=True, exif_item=exif(2)), riff((b"VP8X", bytes(10)), (b"VP8 ", b"\x10\0\0\x9d\x01\x2a\2\0\3\0"))):
        for cut in range(0, min(len(data), 700), 7):
            got, _ = facts(data[:cut])
            assert got["error"] in (None, "E_DECODE", "E_UNSUPPORTED_FORMAT", "E_ANIMATED")


def test_columns_stay_and_nulls_are_told(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png())
    rows = [(1, bytearray(png()), "x"), (2, None, "y"), (3, bytearray(b""), None)]
    frame = spark.createDataFrame(rows, "id long, content binary, width string").withColumnRenamed("width", "bytes")
    got = {r["id"]: (r["width"], r["error"]) for r in H.inspected_contents(frame).collect()}
    assert got == {1: (3, None), 2: (None, "E_UNSUPPORTED_FORMAT"), 3: (None, "E_UNSUPPORTED_FORMAT")}
    paths = spark.createDataFrame([(str(tmp_path / "a.png"),), (str(tmp_path),), (str(tmp_path / "none"),), (None,), (f"file://{tmp_path}/a.png",)], "path string")
    assert [(r["width"], r["error"]) for r in H.inspected_files(paths).collect()] == [(3, None), (None, "E_READ"), (None, "E_READ"), (None, "E_READ"), (3, None)]
    assert [(r["length"], r["error"]) for r in R.read_heads(paths, most=5).collect()] == [(len(png()), None), (None, "E_READ"), (None, "E_READ"), (None, "E_READ"), (len(png()), None)]
    assert H.inspected_contents(frame.limit(0)).count() == 0


def test_folders_are_listed_in_tasks(spark, tmp_path):
    for name in ("a/x.bin", "a/b/y.bin", "z.bin", "_temporary/no.bin", ".hidden"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * 10)
    below = lambda **more: sorted((r["path"].removeprefix(str(tmp_path)), r["length"], bytes(r["head"])) for r in R.heads_below(spark, str(tmp_path), 4, **more).collect())
    assert below() == [("/a/b/y.bin", 90, b"a/b/"), ("/a/x.bin", 70, b"a/x."), ("/z.bin", 50, b"z.bi")]
    assert below(recursive=False) == [("/z.bin", 50, b"z.bi")]
