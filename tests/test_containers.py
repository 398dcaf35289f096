"""Parts of files against walkers written here, and gzip sizes against gzip itself."""

import gzip
import struct
import zlib

from quern.plans.catalogue import QUERIES
from quern.plans.views import table
from quern.sources import sniff


def _walk_png(data):
    at, out = 8, []
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert struct.unpack_from(">I", data, at + 8 + size)[0] == zlib.crc32(kind + body)
        out.append((kind.decode(), at, at + 12 + size, size))
        at += 12 + size
    return out


def _samples(spark, sf_dir, kind):
    from pyspark.sql import functions as F

    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return names, {r["id"]: bytes(r["content"]) for r in sniff.sample_files(names, kind).collect()}


def test_png_chunks_are_those_of_a_walk(spark, sf_dir):
    _, files = _samples(spark, sf_dir, "png")
    want = sorted((i, n, *part) for i, data in files.items() for n, part in enumerate(_walk_png(data)))
    assert sorted(tuple(r[c] for c in ("id", "number", "kind", "start", "end", "bytes")) for r in QUERIES["png_chunks"](spark, sf_dir).collect()) == want


def test_stripped_files_keep_what_is_shown(spark, sf_dir):
    rows = {r["id"]: r for r in QUERIES["strip_files"](spark, sf_dir).collect()}
    names, pngs = _samples(spark, sf_dir, "png")
    named = {r["id"]: r["name"] for r in names.collect()}
    assert set(rows) == set(named)
    for i, name in named.items():
        row, n = rows[i], len(name.encode())
        kind = ("png", "jpeg", "webp")[i % 3]
        assert row["format"] == kind and row["error"] is None and row["rights"] == f'{{"credit": "{name}"}}'
        if kind == "png":
            want = 8 + sum(end - start for k, start, end, _ in _walk_png(pngs[i]) if k in ("IHDR", "IDAT", "IEND"))
        elif kind == "jpeg":  # magic, JFIF, tables, scan with its text and end
            want = 2 + 18 + 69 + 4 + n + 2
        else:  # without XMP and an orientation nothing needs the extended head's flags
            want = row["stripped_bytes"]
            assert want <= 12 + 18 + 8 + n + n % 2 + 18
        assert row["stripped_bytes"] == want


def test_gzip_sizes_are_those_of_gzip(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = QUERIES["gzip_size"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    name = next(c for c in rows[0].asDict() if c != "id")
    assert all(abs(r[name] - len(gzip.compress(texts[r["id"]], 9, mtime=0))) <= 0 for r in rows if name)
