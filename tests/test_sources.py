import os
import struct

import numpy as np
import pytest

from quern import sinks
from quern.sources import containers as C
from quern.sources import files
from quern.streaming import events

PACKET = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/" photoshop:Credit="Me"><dc:creator><rdf:Seq><rdf:li>A</rdf:li><rdf:li>B</rdf:li></rdf:Seq></dc:creator></rdf:Description></rdf:RDF></x:xmpmeta>'


def samples():
    png = C.png_of(np.arange(48, dtype=np.uint8).reshape(4, 4, 3), "note")
    jpeg = C.JPEG_MAGIC + C.build_jpeg_segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + C.build_jpeg_segment(0xFE, b"note") + b"\xff\xda\0\2scan\xff\xd9tail"
    webp = C.build_webp([C.build_riff_chunk("VP8 ", b"odd"), C.build_riff_chunk("EXIF", b"x")])
    return {"png": png, "jpeg": jpeg, "webp": webp}


@pytest.mark.parametrize("kind", ["png", "jpeg", "webp"])
def test_packets_round_trip_and_strip(kind):
    data = samples()[kind]
    written = C.with_xmp(data, kind, PACKET, (4, 4))
    assert C.xmp_of(written, kind) == PACKET
    assert C.read_rights(written, kind) == {"creator": ["A", "B"], "credit": "Me"}
    assert C.xmp_of(C.with_xmp(written, kind, None), kind) is None
    stripped, removed = C.STRIP[kind](written)
    assert removed and C.xmp_of(stripped, kind) is None
    assert C.STRIP[kind](stripped)[0] == stripped


def test_pixels_survive_a_png():
    pixels = np.random.default_rng(1).integers(0, 256, (5, 7, 4), dtype=np.uint8)
    assert np.array_equal(C.pixels_of(C.png_of(pixels)), pixels)


def test_damaged_containers_end_early():
    for data in samples().values():
        for cut in range(0, len(data), 7):
            list(C.png_chunks(data[:cut])), list(C.jpeg_segments(data[:cut])), list(C.riff_chunks(data[:cut])), list(C.boxes(data[:cut]))


def test_boxes_of_all_sizes():
    wide = struct.pack(">I4sQ", 1, b"mdat", 20) + b"abcd"
    data = C.build_box("ftyp", b"avif") + wide + struct.pack(">I4s", 0, b"free") + b"rest"
    assert [(p.kind, p.payload) for p in C.boxes(data)] == [("ftyp", b"avif"), ("mdat", b"abcd"), ("free", b"rest")]


def test_exif_in_both_byte_orders():
    for order, magic in (("<", b"II*\0"), (">", b"MM\0*")):
        exif = magic + struct.pack(order + "IH", 8, 2) + struct.pack(order + "HHI4s", C.COPYRIGHT_TAG, 2, 4, b"me\0\0") + struct.pack(order + "HHII", C.GPS_TAG, 4, 1, 99)
        assert C.has_gps(exif) and C.read_exif_rights(exif) == {"copyright": [{"lang": "x-default", "value": "me"}]}


def test_orientation_alone_stays():
    exif = b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", C.ORIENTATION_TAG, 3, 1, 6, 0) + struct.pack(">HHII", C.GPS_TAG, 4, 1, 99)
    small = C.orientation_block(exif)
    assert C.exif_entries(small) == [(C.ORIENTATION_TAG, 3, b"\6\0")] and C.orientation_block(small) == small and C.orientation_block(b"") is None
    files = {
        "png": samples()["png"][:-12] + C.build_png_chunk("eXIf", exif) + samples()["png"][-12:],
        "jpeg": C.JPEG_MAGIC + C.build_jpeg_segment(0xE1, C.EXIF_JPEG + exif) + samples()["jpeg"][2:],
        "webp": C.build_webp([C.build_riff_chunk("VP8X", b"\x08" + bytes(9)), C.build_riff_chunk("VP8 ", b"x"), C.build_riff_chunk("EXIF", exif)]),
    }
    for kind, data in files.items():
        stripped, removed = C.STRIP[kind](data)
        assert small in stripped and exif not in stripped and removed and C.STRIP[kind](stripped)[0] == stripped


def test_iim_says_its_coding():
    part = lambda r, d, v: bytes([0x1C, r, d]) + struct.pack(">H", len(v)) + v
    assert C.read_iim(part(2, 80, "é".encode("latin1"))) == {"creator": ["é"]}
    assert C.read_iim(part(1, 90, b"\x1b%G") + part(2, 116, "é".encode())) == {"copyright": [{"lang": "x-default", "value": "é"}]}


def test_scans_and_named_files(spark, tmp_path):
    for name in ("a.PNG", "b.txt", ".c.png", "sub/d.webp", "out/e.png"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(samples()["png"])
    root = str(tmp_path)
    found = lambda f: sorted(os.path.relpath(r["path"], root) for r in f.select("path").collect())
    assert found(files.scan_folder(spark, root)) == ["a.PNG"]
    assert found(files.scan_folder(spark, root, True, f"{root}/out")) == ["a.PNG", "sub/d.webp"]
    assert found(files.scan_glob(spark, f"{root}/**/*.{{webp,png}}")) == ["out/e.png", "sub/d.webp"]
    mirrored = files.scan_folder(spark, root, True, f"{root}/out").where("path LIKE '%webp'").first()
    assert mirrored["out_dir"] == f"{root}/out/sub"
    named = files.read_named(spark, [f"{root}/a.PNG", f"{root}/none.png"]).orderBy("idx").collect()
    assert [r["error"] for r in named] == [None, "E_READ"]
    assert files.sniffed(files.scan_folder(spark, root)).first()["format"] == "png"


def test_an_argument_is_a_folder_a_pattern_or_a_name(spark, tmp_path):
    for name in ("a.png", "sub/b.webp", "odd[1].png"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(samples()["png"])
    root = str(tmp_path)
    rows = lambda argument, **more: sorted((os.path.relpath(r["path"], root), r["scanned"], r["error"]) for r in files.expand_argument(spark, argument, **more).collect())
    assert rows(root) == [("a.png", True, None), ("odd[1].png", True, None)]
    assert rows(f"{root}/**/*.webp") == [("sub/b.webp", True, None)]
    assert rows(f"{root}/a.png") == [("a.png", False, None)]
    assert rows(f"{root}/odd[1].png") == [("odd[1].png", False, None)]
    assert rows(f"{root}/*.gif") == [("*.gif", False, "E_READ")] and rows(f"{root}/none/*.png") == [("none/*.png", False, "E_READ")] and rows(f"{root}/b.png") == [("b.png", False, "E_READ")]


def test_staged_writes_are_all_or_nothing(spark, tmp_path):
    good, bad = str(tmp_path / "x" / "a.bin"), str(tmp_path / "file" / "b.bin")
    (tmp_path / "file").write_bytes(b"")
    out = spark.createDataFrame([(1, good, bytearray(b"1")), (2, str(tmp_path / "c.bin"), bytearray(b"2")), (2, bad, bytearray(b"3"))], "file long, path string, content binary")
    rows = {r["file"]: (r["written"], r["error"]) for r in sinks.write_staged(out).collect()}
    assert rows[1] == (1, None) and rows[2][0] == 0 and rows[2][1].startswith("E_WRITE")
    assert (tmp_path / "x" / "a.bin").read_bytes() == b"1" and not (tmp_path / "c.bin").exists()


def test_server_sent_events(spark):
    assert list(sinks.sse_batches(["event: a\nda", "ta: 1\n\ndata: 2\n\n"])) == [("a", "1"), ("message", "2")]
    lines = spark.createDataFrame([("event: a\ndata: 1\ndata: 2\n\n: note\n\ndata: 3",)], "value string")
    assert sorted(map(tuple, events.parse_event_stream(lines).collect())) == [("a", "1\n2"), ("message", "3")]


def test_reducer_over_a_stream(spark, tmp_path):
    rows = [(1, 1, "file-start", 1), (1, 2, "file-done", 2), (1, 3, "settings", 3), (2, 4, "file-start", 4)]
    frame = spark.createDataFrame(rows, "user long, seq long, type string, at long").selectExpr("user", "seq", "type", "timestamp_seconds(at) AS ts")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = events.reduce_states(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("states").collect())) == [(1, "queued", 1), (2, "file-start", 0)]
