import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import pixels as X
from quern import run
from quern.operators import compare
from quern.settings import Settings
from quern.sources import containers, files, svg


class Halving:
    """A lossy codec for tests: fewer levels at lower quality, in a PNG."""

    name, format, qualities = "levels", "png", (1, 100)

    def encode(self, pixels, quality):
        step = 1 + (100 - quality) // 4
        return containers.png_of((pixels // step * step).astype(np.uint8))

    def decode(self, data):
        return containers.pixels_of(data)


def test_files_are_optimised_and_failures_are_rows(spark, tmp_path):
    r = np.random.default_rng(1)
    noisy = np.clip(np.add.outer(np.arange(40), np.arange(60))[..., None] + r.integers(0, 9, (40, 60, 3)), 0, 255).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(containers.png_of(noisy, "a comment"))
    (tmp_path / "broken.png").write_bytes(containers.PNG_MAGIC + b"nothing")
    (tmp_path / "text.webp").write_bytes(b"no image")
    out = str(tmp_path / "out")
    found = files.scan_folder(spark, str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in run.optimise(found, Settings(mode="same", target=80, out_dir=out), (X.PngCodec(), Halving())).collect()}
    a = rows["a.png"]
    assert a["status"] == "optimised" and a["score"] >= 80 and a["output_bytes"] < a["bytes"] and a["output"] == f"{out}/a.png"
    assert containers.pixels_of(open(a["output"], "rb").read()).shape == noisy.shape
    assert rows["text.webp"]["status"] == "failed" and rows["broken.png"]["error"].startswith("E_DECODE")
    blocked = {r["path"].rsplit("/", 1)[1]: r["error"] for r in run.optimise(found, Settings(), write=False).collect()}
    assert blocked["a.png"] == "E_OUTPUT_IS_INPUT"


def test_pixels():
    p = np.zeros((10, 20, 4), np.uint8)
    p[..., 3], p[0, 0, :3] = 255, 200
    assert X.is_opaque(p) and X.flatten(p, 255)[0, 0, 0] == 200
    p[0, 0, 3] = 128
    assert not X.is_opaque(p) and X.flatten(p, 255)[0, 0].tolist() == [227] * 3 and X.flatten(p, 0)[0, 0].tolist() == [100] * 3
    assert X.fit_to_width(p, 5).shape == (3, 5, 4) and X.fit_to_width(p, 50) is p
    assert np.abs(X.resized(np.full((9, 7, 3), 77, np.uint8), 30, 4).astype(int) - 77).max() == 0
    q = p.copy()
    q[5, 5, 0] = 90
    assert X.score(p, p, X.peak_signal_score) == 100 and 0 < X.score(p, q, X.peak_signal_score) < 100
    assert X.difference_map(p, q)[5, 5].tolist() == [255, 255, 0] and X.difference_map(p, p)[5, 5].tolist() == [0, 0, 0]
    with pytest.raises(ValueError, match="E_TOO_SMALL"):
        X.score(p[:4], q[3:7], X.peak_signal_score)
    with pytest.raises(ValueError, match="MISMATCH"):
        X.score(p, p[:5], X.peak_signal_score)


def test_svg():
    text = '<svg xmlns="http://www.w3.org/2000/svg" xmlns:inkscape="http://www.inkscape.org/namespaces/inkscape" viewBox="0 0 1 1" inkscape:version="1"><!-- a --><!--! kept --><title> T </title><metadata><a/></metadata><inkscape:grid id="g"/><path id="p" d="M0.12345 -0.5"/><use href="#p"/><rect fill="url(#q)" id="q"/></svg>'
    facts = svg.inspect_svg(text)
    assert facts == {"viewBox": "0 0 1 1", "title": "T", "referencedIds": ["p", "q"], "metadata": ["comment", "editor", "metadata"]}
    short = svg.strip_svg(text)
    assert "inkscape" not in short and "<!--!" in short and "<!-- a" not in short and "metadata" not in short and svg.inspect_svg(short)["referencedIds"] == ["p", "q"]
    assert 'd="M.12 -.5"' in svg.rounded_svg(short, 2)
    with pytest.raises(ValueError):
        svg.inspect_svg("<svg")


def test_pairs_refs_and_lists(spark):
    pairs = spark.createDataFrame([(1, 100, 9, 9, 50, 9, 9, False, 81.0), (2, 100, 9, 9, 200, 9, 8, False, 1.0), (3, 0, 4, 4, 5, 4, 4, False, 1.0), (4, 10, 4, 4, 5, 4, 4, True, None), (5, 10, None, None, 5, 4, 4, True, None)], "pair int, a_bytes long, a_width int, a_height int, b_bytes long, b_width int, b_height int, same boolean, score double")
    got = [tuple(r)[1:] for r in compare.compared(pairs).orderBy("pair").collect()]
    assert got == [(None, 81.0, "very-high", 0.5), ("E_DIMENSIONS_MISMATCH", None, None, -1.0), ("E_TOO_SMALL_TO_SCORE", None, None, None), (None, 100.0, "visually-lossless", 0.5), ("E_READ", None, None, 0.5)]
    opened = compare.opened_files(spark.createDataFrame([(3, "/a/x.png"), (1, "/b/y.png"), (7, "/b/y.png")], "idx long, path string"))
    assert sorted((r["idx"], r["ref"]) for r in opened.collect()) == [(1, "file/1/y.png"), (3, "file/2/x.png"), (7, "file/1/y.png")]
    refs = spark.createDataFrame([(0, "file/1/y.png"), (1, "gone")], "idx long, ref string")
    assert [r["error"] for r in compare.resolved(refs, opened.select("ref", "path").distinct()).orderBy("idx").collect()] == [None, "E_READ"]
    message = spark.range(1).select(compare.relabelled(F.lit("at /a/b and /a"), {"/a": "1", "/a/b": "2"}).alias("m"))
    assert message.first()["m"] == "at 2 and 1"
    state = lambda rows: spark.createDataFrame(rows, "ref string, version int, state string")
    assert sorted(map(tuple, compare.upserted(state([("a", 1, "x"), ("b", 5, "x")]), state([("a", 1, "y"), ("b", 4, "y"), ("c", 0, "z")])).collect())) == [("a", 1, "y"), ("b", 5, "x"), ("c", 0, "z")]
    results = spark.createDataFrame([(1, [5, 6]), (2, [])], "file long, outputs array<long>")
    new = spark.createDataFrame([(1, 1, 9)], "file long, pos int, bytes long")
    assert sorted(map(tuple, compare.rewritten(results, new).collect())) == [(1, [5, 9]), (2, [])]
    assert [r["key"] for r in compare.recent(spark.createDataFrame([("a", 1), ("b", 3), ("a", 4), ("c", 2)], "key string, used int"), 2).collect()] == ["a", "b"]
    zoom = spark.range(1).select(compare.fitted_zoom(F.lit(200), F.lit(100), F.lit(100), F.lit(100)).alias("z"), compare.clamped_centre(F.lit(0.0), F.lit(100.0), F.lit(50.0), F.lit(1.0)).alias("c")).first()
    assert (zoom["z"], zoom["c"]) == (0.5, 25.0)


def _noisy(seed=1, shape=(40, 60, 3)):
    r = np.random.default_rng(seed)
    return np.clip(np.add.outer(np.arange(shape[0]), np.arange(shape[1]))[..., None] + r.integers(0, 9, shape), 0, 255).astype(np.uint8)


def _by_name(frame):
    return {r["path"].rsplit("/", 1)[1]: r for r in frame.collect()}


def _codes(row):
    return [w["code"] for w in row["warnings"]]


def test_existing_files_survive_unless_overwriting(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(containers.png_of(_noisy(), "a comment"))
    out = tmp_path / "out"
    out.mkdir()
    (out / "x.png").write_bytes(b"another")
    found = files.scan_folder(spark, str(tmp_path))
    row = _by_name(run.optimise(found, Settings(out_dir=str(out))))["x.png"]
    assert row["status"] == "skipped" and _codes(row) == ["W_OUTPUT_EXISTS"] and row["error"] is None and (out / "x.png").read_bytes() == b"another"
    row = _by_name(run.optimise(found, Settings(out_dir=str(out), overwrite=True)))["x.png"]
    assert row["status"] == "optimised" and len((out / "x.png").read_bytes()) == row["output_bytes"] and sorted(p.name for p in out.iterdir()) == ["x.png"]


def test_in_place_replaces_the_input_alone_when_asked(spark, tmp_path):
    path = tmp_path / "x.png"
    path.write_bytes(containers.png_of(_noisy(), "a comment"))
    found = files.scan_folder(spark, str(tmp_path))
    row = _by_name(run.optimise(found, Settings()))["x.png"]
    assert row["status"] == "failed" and row["error"].startswith("E_OUTPUT_IS_INPUT") and b"a comment" in path.read_bytes()
    row = _by_name(run.optimise(found, Settings(in_place=True)))["x.png"]
    assert row["status"] == "optimised" and b"a comment" not in path.read_bytes()
    again = _by_name(run.optimise(files.scan_folder(spark, str(tmp_path)), Settings(in_place=True)))["x.png"]
    assert again["status"] == "kept-original" and again["output"] is None


def test_the_earlier_input_wins(spark, tmp_path):
    data = containers.png_of(_noisy(), "a comment")
    names = ["b/p.png", "a/p.png", "c/q.png"]
    rows = [(10 - n, str(tmp_path / name), data) for n, name in enumerate(names)]
    given = spark.createDataFrame(rows, "idx long, path string, content binary")
    settings = Settings(out_dir=str(tmp_path / "out"))
    found = {r["path"]: r for r in run.optimise(given, settings, write=False, existing=given.limit(0)).collect()}
    # claims are by folder of the output: the two p.png both go to out/p.png
    assert found[rows[2][1]]["status"] == "optimised"
    by_path = run.optimise(given.drop("idx").union(given.drop("idx")), Settings(in_place=True), write=False).groupBy("path", "status").count().collect()
    assert sorted((r["path"].rsplit("/", 2)[1], r["status"], r["count"]) for r in by_path) == [(d, s, 1) for d in "abc" for s in ("failed", "optimised")]


def test_rights_are_carried_added_or_stripped(spark, tmp_path):
    packet = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator><rdf:Seq><rdf:li>Ann</rdf:li></rdf:Seq></dc:creator></rdf:Description></rdf:RDF></x:xmpmeta>'
    data = containers.with_xmp(containers.png_of(_noisy(), "x" * 3000), "png", packet.encode())
    (tmp_path / "r.png").write_bytes(data)
    found = files.scan_folder(spark, str(tmp_path))

    def result(name, **more):
        row = _by_name(run.optimise(found, Settings(out_dir=str(tmp_path / name), **more)))["r.png"]
        assert row["status"] == "optimised"
        return row, containers.read_rights((tmp_path / name / "r.png").read_bytes(), "png")

    row, own = result("a")
    assert own["creator"] == ["Ann"] and row["carried"] == ["creator"] and _codes(row) == []
    row, both = result("b", rights={"credit": "Me"})
    assert both["creator"] == ["Ann"] and both["credit"] == "Me" and row["carried"] == ["creator", "credit"]
    row, none = result("c", strip_all=True)
    assert none == {} and row["carried"] == [] and _codes(row) == []


def test_added_rights_that_leave_nothing_smaller_are_left_out(spark, tmp_path):
    small = containers.STRIP["png"](containers.png_of(_noisy(), None))[0]
    (tmp_path / "s.png").write_bytes(small)
    row = _by_name(run.optimise(files.scan_folder(spark, str(tmp_path)), Settings(out_dir=str(tmp_path / "o"), rights={"credit": "Me"}, target=100)))["s.png"]
    assert row["status"] == "kept-original" and "W_RIGHTS_NOT_ADDED" in _codes(row)


def test_a_wide_image_is_shrunk_or_kept_with_a_warning(spark, tmp_path):
    (tmp_path / "w.png").write_bytes(containers.png_of(_noisy(shape=(40, 200, 3)), "c"))
    found = files.scan_folder(spark, str(tmp_path))
    row = _by_name(run.optimise(found, Settings(out_dir=str(tmp_path / "o"), max_width=50)))["w.png"]
    assert row["status"] == "optimised" and containers.pixels_of((tmp_path / "o" / "w.png").read_bytes()).shape[:2] == (10, 50) and "W_NO_RIGHTS" in _codes(row)

    class Large(X.PngCodec):
        def encode(self, pixels, quality):
            return super().encode(pixels, quality) + b"\0" * 100_000

    row = _by_name(run.optimise(found, Settings(out_dir=str(tmp_path / "p"), max_width=50), (Large(),)))["w.png"]
    assert row["status"] == "kept-original" and "W_NOT_RESIZED" in _codes(row)


def test_svg_unreadable_and_unknown_files(spark, tmp_path):
    rows = [("/none/a.svg", b"<svg xmlns='http://www.w3.org/2000/svg'><!-- c --><g/></svg>"), ("/none/b.png", None), ("/none/c.txt", b"text"), ("/none/d.avif", b"\0\0\0\x18ftypavif\0\0\0\0avifmif1")]
    found = _by_name(run.optimise(spark.createDataFrame(rows, "path string, content binary"), Settings(mode="webp", out_dir="/none/out"), write=False))
    assert found["a.svg"]["status"] == "optimised" and _codes(found["a.svg"]) == ["W_SVG_SAME_ONLY"]
    assert found["b.png"]["error"].startswith("E_READ") and found["c.txt"]["error"].startswith("E_UNSUPPORTED") and found["d.avif"]["error"].startswith("E_UNSUPPORTED")
    assert run.optimise(spark.createDataFrame([], "path string, content binary"), Settings()).count() == 0


def test_a_failed_rename_leaves_what_was_there(spark, tmp_path):
    from quern import sinks

    (tmp_path / "a").write_bytes(b"old")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "full").write_bytes(b"1")
    outputs = spark.createDataFrame([(1, str(tmp_path / "a"), b"new"), (1, str(tmp_path / "b" / "full" / "c"), b"new")], "file long, path string, content binary")
    row = sinks.write_staged(outputs).first()
    assert row["written"] == 0 and row["error"].startswith("E_WRITE") and (tmp_path / "a").read_bytes() == b"old" and sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]


def test_failures_from_before_and_animations_take_no_work(spark):
    import struct
    import zlib

    from quern.run import optimise
    from quern.sources import containers as C

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    whole = C.png_of(np.zeros((9, 9, 3), np.uint8))
    moving = whole[:33] + chunk(b"acTL", b"\0" * 8) + whole[33:]
    rows = [(1, "/in/a.png", bytearray(whole)), (2, "/in/b.png", bytearray(moving)), (3, "/in/c.png", bytearray(whole))]
    files = spark.createDataFrame(rows, "idx long, path string, content binary")
    failures = spark.createDataFrame([(3, "E_READ: gone"), (9, "E_READ: no such input")], "idx long, error string")
    none = spark.createDataFrame([], "path string")
    got = {r["path"]: (r["status"], (r["error"] or "").split(":")[0]) for r in optimise(files, Settings(mode="same"), write=False, existing=none, failures=failures).collect()}
    assert got["/in/b.png"] == ("failed", "E_ANIMATED") and got["/in/c.png"] == ("failed", "E_READ") and got["/in/a.png"][1] == "" and len(got) == 3
