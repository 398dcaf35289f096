"""AVIF boxes against files made and read by hand here."""

import struct

import pytest

from quern.sources import avif
from quern.sources import containers as C
from quern.sources.sniff import sample_avif

from tests.test_sources import PACKET

SRGB = bytes(128) + struct.pack(">I4sII", 1, b"desc", 144, 25) + b"desc" + bytes(4) + struct.pack(">I", 5) + b"sRGB\0" + bytes(12)
EXIF = b"II*\0\x08\0\0\0" + struct.pack("<HHHII", 1, C.GPS_TAG, 4, 1, 0) + bytes(4)


def build(meta_first=True, version=1, widths=(4, 4, 4, 0), wide_data=False, base=False):
    """Image 1 in two pieces in the data, image 2 in the item data, EXIF 3 between the pieces, XMP 4 before image 2; a profile of sRGB before the size."""
    box, idw = C.build_box, 4 if version == 2 else 2
    data = b"first" + b"\0\0\0\0" + EXIF + b"second"
    idat = b"<x/>" + b"small"

    def infe(n, kind, rest=b""):
        return box("infe", bytes([2, 0, 0, 0]) + struct.pack(">HH", n, 0) + kind + b"\0" + rest)

    def meta(start):
        n = lambda x, w: x.to_bytes(w, "big")
        o, ln, b, ix = widths
        origin = start if base else 0

        def item(number, where, *extents):
            head = n(number, idw) + (n(where, 2) if version else b"") + n(0, 2) + n(origin if not where else 0, b) + n(len(extents), 2)
            return head + b"".join(n(0, ix) + n(at + (start - origin if not where else 0), o) + n(size, ln) for at, size in extents)

        at_exif, at_second = 5, 9 + len(EXIF)
        items = [item(1, 0, (0, 5), (at_second, 6)), item(2, 1, (4, 5)), item(3, 0, (at_exif, 4 + len(EXIF))), item(4, 1, (0, 4))]
        iloc = box("iloc", bytes([version, 0, 0, 0, o << 4 | ln, b << 4 | ix]) + n(4, idw) + b"".join(items))
        iinf = box("iinf", bytes(4) + n(4, 2) + infe(1, b"av01") + infe(2, b"av01") + infe(3, b"Exif") + infe(4, b"mime", b"application/rdf+xml\0\0"))
        refs = [box("cdsc", struct.pack(">HHH", 3, 1, 1)), box("cdsc", struct.pack(">HHH", 4, 1, 1)), box("thmb", struct.pack(">HHH", 2, 1, 1)), box("prem", struct.pack(">HHHH", 1, 2, 4, 2))]
        ipco = box("ipco", box("colr", b"prof" + SRGB) + box("ispe", bytes(12)) + box("irot", b"\1"))
        ipma = box("ipma", bytes(4) + n(3, 4) + b"\0\1\3\1\x82\x83" + b"\0\2\1\2" + b"\0\3\1\1")
        return box("meta", bytes(4) + box("hdlr", bytes(24)) + box("pitm", bytes(4) + n(1, 2)) + iinf + iloc + box("iref", bytes(4) + b"".join(refs)) + box("iprp", ipco + ipma) + box("idat", idat))

    head, mdat = box("ftyp", b"avif\0\0\0\0avif"), (struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) if wide_data else struct.pack(">I4s", 8 + len(data), b"mdat")) + data
    skip = len(mdat) - len(data)
    if meta_first:
        return head + meta(len(head) + len(meta(0)) + skip) + mdat
    return head + mdat + meta(len(head) + skip)


def seen(data):
    """Item ids with their bytes, properties by kind, references, by a walk of its own."""
    boxes = {p.kind: p for p in C.boxes(data)}
    start = boxes["meta"].end - len(boxes["meta"].payload) + 4
    inner = {p.kind: p for p in C.boxes(data, start, boxes["meta"].end)}
    raw = inner["iloc"].payload
    version, at = raw[0], 6
    o, ln, b, ix = raw[4] >> 4, raw[4] & 15, raw[5] >> 4, raw[5] & 15

    def take(width):
        nonlocal at
        at += width
        return int.from_bytes(raw[at - width : at], "big")

    items = {}
    for _ in range(take(4 if version == 2 else 2)):
        number, where = take(4 if version == 2 else 2), take(2) if version else 0
        take(2)
        base, pieces = take(b), []
        for _ in range(take(2)):
            take(ix if version else 0)
            place, size = take(o), take(ln)
            pieces.append((inner["idat"].payload if where else data)[base + place : base + place + size])
        items[number] = pieces
    iref = inner.get("iref")
    refs = [(p.kind, p.payload) for p in C.boxes(iref.payload, 4)] if iref else []
    parts = {p.kind: p for p in C.boxes(inner["iprp"].payload)}
    return items, [p.kind for p in C.boxes(parts["ipco"].payload)], parts["ipma"].payload, refs, inner["iinf"].payload[4:6]


CASES = [{}, {"meta_first": False}, {"version": 2}, {"widths": (8, 4, 8, 0)}, {"widths": (4, 4, 4, 4), "base": True}, {"wide_data": True, "base": True}, {"wide_data": True, "meta_first": False}]


@pytest.mark.parametrize("case", CASES)
def test_strip_keeps_images_and_what_is_said_of_them(case):
    data = build(**case)
    before, after = seen(data), None
    assert before[0][1] == [b"first", b"second"] and before[0][3] == [b"\0\0\0\0" + EXIF]
    out, removed = C.STRIP["avif"](data)
    assert removed == ["exif", "gps", "icc", "xmp"]
    after = seen(out)
    assert after[0] == {1: [b"first", b"second"], 2: [b"small"]} and after[1] == ["ispe", "irot"] and after[4] == b"\0\2"
    assert after[2] == bytes(4) + b"\0\0\0\2" + b"\0\1\2\x81\x82" + b"\0\2\1\1"
    assert after[3] == [("thmb", struct.pack(">HHH", 2, 1, 1)), ("prem", struct.pack(">HHH", 1, 1, 2))]
    assert EXIF not in out and SRGB not in out and [p.kind for p in C.boxes(out)] == [p.kind for p in C.boxes(data)]
    assert sum(p.end - p.start for p in C.boxes(out)) == len(out)
    assert C.STRIP["avif"](out) == (out, [])


@pytest.mark.parametrize("case", CASES)
def test_packets_replace_packets(case):
    data = build(**case)
    assert C.xmp_of(data, "avif") == b"<x/>"
    once = C.with_xmp(data, "avif", PACKET)
    assert C.xmp_of(once, "avif") == PACKET and C.read_rights(once, "avif") == {"creator": ["A", "B"], "credit": "Me"}
    items, kinds, *_, refs, count = seen(once)
    assert {k: items[k] for k in (1, 2)} == {1: [b"first", b"second"], 2: [b"small"]} and items[3] == [b"\0\0\0\0" + EXIF] and count == b"\0\4"
    assert kinds == ["colr", "ispe", "irot"] and ("cdsc", struct.pack(">HHH", 4, 1, 1)) in refs
    assert C.with_xmp(once, "avif", PACKET) == once
    assert C.xmp_of(C.with_xmp(once, "avif", None), "avif") is None


def test_a_packet_comes_and_goes_without_a_trace():
    bare = sample_avif(b"coded")
    assert C.STRIP["avif"](bare) == (bare, [])
    written = C.with_xmp(bare, "avif", PACKET)
    assert C.with_xmp(written, "avif", None) == bare and C.STRIP["avif"](written) == (bare, ["xmp"])
    assert C.xmp_of(bare, "avif") is None and C.read_rights(bare, "avif") == {}


def test_bytes_that_an_image_shares_stay():
    data = build()
    # the packet's item is said to lie where image 1's first piece does
    file = avif.File(data)
    shared = next(i for i in file.table.items if i.id == 1)
    raw = file.written([], tuple(avif.replace(i, construction=0, extents=shared.extents[:1], base=shared.base) if i.id == 4 else i for i in file.table.items))
    assert C.xmp_of(raw, "avif") == b"first"
    assert seen(C.STRIP["avif"](raw)[0])[0][1] == [b"first", b"second"]


def test_damaged_files_are_named_so():
    data = build()
    for cut in range(0, len(data)):
        with pytest.raises(C.Damaged):
            C.STRIP["avif"](data[:cut])
    far = avif.File(data)
    lost = far.written([], tuple(avif.replace(i, extents=((0, 10**6, 4),)) if i.id == 3 else i for i in far.table.items))
    with pytest.raises(C.Damaged):
        C.STRIP["avif"](lost)


def test_a_run_strips_an_avif_and_carries_its_rights(spark, tmp_path):
    from quern import run
    from quern.settings import Settings

    bare, out = sample_avif(b"coded" * 50), str(tmp_path / "o")
    rows = [("/none/a.avif", build()), ("/none/b.avif", C.with_xmp(bare, "avif", PACKET)), ("/none/c.avif", bare[:40])]
    found = {r["path"][6:]: r for r in run.optimise(spark.createDataFrame(rows, "path string, content binary"), Settings(out_dir=out)).collect()}
    assert found["a.avif"]["status"] == "optimised" and found["c.avif"]["error"].startswith("E_DECODE")
    assert seen((tmp_path / "o" / "a.avif").read_bytes())[0][1] == [b"first", b"second"]
    whole = (tmp_path / "o" / "b.avif").read_bytes() if found["b.avif"]["status"] == "optimised" else rows[1][1]
    assert C.read_rights(whole, "avif")["creator"] == ["A", "B"]
