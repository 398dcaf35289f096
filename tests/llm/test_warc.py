import hashlib

import zstandard

from quern.llm import warc


def test_records_are_found_by_identifier(tmp_path):
    path, records = str(tmp_path / "a.warc.zst"), {}
    writer = warc.BundleWriter(path, frame_bytes=300)
    for i in range(50):
        body = (f"page {i} " * (i % 7)).encode()
        records[f"urn:{i}"] = warc.build_record("response", f"urn:{i}", "http://x/\r\ny", body, hashlib.sha256(body).hexdigest(), None, i)
        writer.add(f"urn:{i}", records[f"urn:{i}"])
    writer.close()
    reader = warc.BundleReader(path)
    assert len(reader.frames) > 5 and {k: reader.record(k) for k in reversed(records)} == records and dict(reader.records()) == records
    reader.close()
    # any Zstandard reader gives the records; skippable frames are passed over
    with open(path, "rb") as f:
        data = f.read()
    plain, at = b"", 0
    for start, packed, full in warc.BundleReader(path).frames:
        plain += zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=full)
        at = start + packed
    assert plain == b"".join(records.values()) and data[at : at + 4] == warc.INDEX.to_bytes(4, "little")


def test_heads_and_blocks_part():
    record = warc.build_record("revisit", "urn:1", None, b"abc", "00", 4, None)
    head, block = warc.parse_record(record)
    assert block == b"" and head["x-refers-to-page"] == "4" and head["x-payload-length"] == "3" and "x-page-id" not in head
    head, block = warc.parse_record(warc.build_record("response", "urn:1", "u", b"a\r\n\r\nb", "00", None, 3))
    assert block == b"a\r\n\r\nb" and head["warc-target-uri"] == "u"


def test_revisits_name_the_record_they_refer_to(spark, tmp_path):
    """Read with zstandard alone and a reader written here from the standard."""
    html = "h" * 200
    pages = spark.createDataFrame([(4, "http://a/\n4", html), (2, "http://a/2", html), (9, None, html), (5, "http://a/5", "short")], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, str(tmp_path)).collect()
    raw = b""
    for row in manifest:
        reader = warc.BundleReader(f"{tmp_path}/{row['file']}")
        with open(f"{tmp_path}/{row['file']}", "rb") as f:
            data = f.read()
        for start, packed, full in reader.frames:
            raw += zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=full)
    records = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        records.append((fields, rest[:size]))
        raw = rest[size + 4 :]
    by_kind = {k: [r for r in records if r[0]["WARC-Type"] == k] for k in ("warcinfo", "response", "revisit")}
    assert [len(v) for v in by_kind.values()] == [len(manifest), 2, 2] and len({f["WARC-Record-ID"] for f, _ in records}) == len(records)
    target = next(f for f, b in by_kind["response"] if b.endswith(html.encode()))
    assert all(f["WARC-Refers-To"] == target["WARC-Record-ID"] and f["WARC-Refers-To-Target-URI"] == "http://a/2" and b.startswith(b"HTTP/1.1 200") for f, b in by_kind["revisit"])
    assert sum(r["records"] for r in manifest) == 4


def test_edge_rows(spark):
    long, short = "x" * 100, "y" * 99
    rows = [(5, "u", long), (3, "u", long), (3, "u", long), (None, None, long), (1, None, short), (2, "", short), (7, "u", None), (8, "u", ""), (9, "u", "é" * 50), (10, "u", "é" * 50), (None, "u", "z" * 200), (None, "u", "z" * 200), (11, "u", "<p>" * 900_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    kinds = {i: "revisit" if i in (5, 10) else "response" for i, *_ in rows}
    refers = {5: 3, 10: 9}
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), kinds[i], refers.get(i)) for i, _, h in rows if not (i is None and h == long)]
    want.append((None, 100, hashlib.sha256(long.encode()).hexdigest(), "revisit", 3))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
