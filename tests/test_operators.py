import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import paths as P
from quern.functions import text as X
from quern.operators import compare, conflicts, ranges, search, select, totals
from quern.settings import Settings, parse_count, parse_target, parse_url


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_the_smallest_that_passes_is_picked_and_ties_go_to_the_first(spark):
    c = spark.createDataFrame([(1, 0, 50, 80), (1, 1, 40, 75), (1, 2, 40, 90), (1, 3, 10, 60), (2, 0, 50, 60), (2, 1, 60, 65)], "file long, ord int, bytes long, score int")
    assert rows(select.pick(c, ["file"], 70, F.lit(100))) == [(1, 1, 40, 75)]
    assert rows(select.pick(c, ["file"], 70, F.lit(100), True)) == [(1, 1, 40, 75), (2, 1, 60, 65)]
    assert rows(select.pick(c, ["file"], 70, F.lit(40), False)) == []


def test_tiers_come_before_sizes(spark):
    c = spark.createDataFrame([(1, 0, 50, 80)], "file long, ord int, bytes long, score int")
    t = spark.createDataFrame([(1, 0, 60, True), (1, 1, 20, True), (1, 2, None, True)], "file long, tier int, packet int, fits boolean")
    best = select.pick_by_tier(select.carrying(c, t, ["file"]), ["file"], 70, F.lit(100))
    assert [(r["tier"], r["bytes"]) for r in best.collect()] == [(1, 70)]


@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), max_size=8))
@settings(max_examples=15, deadline=None)
def test_chain_keeps_what_is_smaller_than_all_kept(spark, sizes):
    frame = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "file long, ord int, bytes long")
    least, want = None, []
    for s in sizes:
        keep = s is not None and (least is None or s < least)
        least = s if keep else least
        want.append(keep)
    assert [r["kept"] for r in select.kept_by_chain(frame, ["file"], "ord").orderBy("ord").collect()] == want


@pytest.mark.parametrize("seed", range(3))
def test_search_fold_is_the_live_search(spark, seed):
    r = random.Random(seed)
    curve = [r.randint(40, 90) for _ in range(100)]
    _, tried = search.search_qualities(lambda q: (b"x" * q, curve[q]), 30, 95, 70)
    table = F.array(*[F.lit(v) for v in curve])
    path = spark.range(1).select(search.search_path(30, 95, lambda q: F.get(table, q), 70).alias("p")).first()["p"]
    qualities = list(dict.fromkeys(t["quality"] for t in path))
    assert qualities == [t["quality"] for t in tried]


def test_a_conflicting_input_claims_nothing(spark):
    inputs = spark.createDataFrame([(0, "/a/photo.png", "png"), (1, "/a/photo.webp", "webp"), (2, "/a/photo.png", "png"), (3, "/b/photo.png", "png"), (4, "/b/photo.jpg", "jpeg"), (5, "/c/x.txt", None)], "idx long, path string, format string")
    assert rows(conflicts.conflicting(inputs, "webp")) == [(0, "replaces"), (2, "same-file"), (4, "claimed")]


def test_a_block_on_the_input_comes_before_existing_paths(spark):
    outputs = spark.createDataFrame([(1, 0, "/a/x.webp", False, False), (1, 1, "/a/x.png", True, False), (2, 0, "/a/y.png", True, True), (2, 1, "/a/z.png", False, False)], "file long, ord int, path string, is_input boolean, unchanged boolean")
    there = spark.createDataFrame([("/a/x.webp",), ("/a/x.png",), ("/a/y.png",)], "path string")
    assert rows(conflicts.write_plan(outputs, there, False, False)) == [(1, "blocked-input", "/a/x.png", 0), (2, "write", None, 1)]
    assert rows(conflicts.write_plan(outputs, there, True, False))[0] == (1, "blocked-exists", "/a/x.webp", 0)


def test_free_names_pass_over_counts_that_are_taken(spark):
    names = spark.createDataFrame([(0, "d", "a.png"), (1, "d", "a.png"), (2, "d", "a (1).png"), (3, "d", "a.png"), (4, "e", "a.png")], "idx long, folder string, name string")
    assert [r["free_name"] for r in conflicts.free_names(names).orderBy("idx").collect()] == ["a.png", "a (1).png", "a (2).png", "a (3).png", "a.png"]


def test_ranges_that_touch_are_one(spark):
    r = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 10, 11)], "file long, start long, end long")
    assert rows(ranges.merged_ranges(r, ["file"])) == [(1, 0, 7), (1, 9, 12)]
    o = spark.createDataFrame([(1, 7), (1, 8), (1, 20)], "file long, offset long")
    assert rows(ranges.moved_offsets(o, spark.createDataFrame([(1, 0, 7), (1, 9, 12)], "file long, start long, end long"), ["file"])) == sorted([(1, 7, 0), (1, 8, 1), (1, 20, 10)], key=repr)


def test_sizes_are_shown_in_three_digits(spark):
    cases = {0: "0 B", 999: "999 B", 1000: "1.00 kB", 12345: "12.3 kB", 999_499: "999 kB", 999_500: "1.00 MB", 10_000_000: "10.0 MB", 2_500_000_000: "2.50 GB"}
    frame = spark.createDataFrame([(k,) for k in cases], "n long")
    assert {r["n"]: r["t"] for r in frame.select("n", X.format_bytes(F.col("n")).alias("t")).collect()} == cases


def test_paths(spark):
    frame = spark.createDataFrame([("/a/b.JPG",), ("/a/.hidden",), ("/a/c.tar.webp",), (None,)], "p string")
    got = rows(frame.select(P.format_of_extension(F.col("p")), P.stem(F.col("p")), P.output_path(F.col("p"), F.lit("jpeg"))))
    assert got == sorted([("jpeg", "b", "/a/b.JPG"), (None, ".hidden", "/a/.hidden.jpg"), ("webp", "c.tar", "/a/c.tar.jpg"), (None, None, None)], key=repr)


def test_totals_of_no_files(spark):
    none = spark.createDataFrame([], "status string, bytes long, output_bytes array<long>")
    assert totals.run_totals(none).first().asDict() == {"files": 0, "optimised": 0, "kept_original": 0, "skipped": 0, "failed": 0, "input_bytes": 0, "output_bytes": 0, "saving": 0.0}


def test_settings_are_checked():
    assert parse_target("high") == 80 and parse_target("72.5") == 72.5 and parse_count("3") == 3
    for bad in (lambda: parse_target("x"), lambda: parse_target("101"), lambda: parse_count("0"), lambda: parse_url("ftp://a"), lambda: Settings(mode="gif"), lambda: Settings(rights={"creator": " "}), lambda: Settings(strip_all=True, rights={"creator": "a"}), lambda: Settings(max_width=0)):
        with pytest.raises(ValueError):
            bad()
    assert Settings(rights={"creator": " A "}).rights == {"creator": "A"}


def test_whole_texts_are_escaped_and_trimmed(spark, tmp_path):
    from quern.plans.catalogue import QUERIES

    long = "x" * 200
    texts = [long + "<\t&\r\n>" + '"', " \t\n ", "\x02 \x01", long + " \n\t" * 50, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    escaped = {r["doc_id"]: r["escaped"] for r in QUERIES["xml_escape"](spark, str(tmp_path)).collect()}
    assert escaped[0] == '&lt;a href=&quot;' + long + '&lt;&#9;&amp;&#13;&#10;&gt;&quot;&quot;&gt;&amp;'
    trimmed = {r["doc_id"]: r["value"] for r in QUERIES["trim_values"](spark, str(tmp_path)).collect()}
    assert trimmed == {0: texts[0], 1: None, 2: None, 3: long, 4: None}


def test_all_rows_are_ranked_without_one_task(spark):
    frame = spark.range(5000).selectExpr("id AS file", "id * 7919 % 997 AS input_bytes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        got = totals.ranked(frame, F.col("input_bytes").desc(), F.col("file"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(((i, i * 7919 % 997) for i in range(5000)), key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(*r, n) for n, r in enumerate(want)]
    assert got.rdd.getNumPartitions() > 1


def test_many_inputs_of_one_path_stay_out_of_the_fold(spark, monkeypatch):
    """A hot path: one input runs or is decided by others, all repeats are the same file."""
    aggregate = conflicts.F.aggregate
    monkeypatch.setattr(conflicts.F, "aggregate", lambda rows, *a: aggregate(F.when(F.size(rows) <= 3, F.col(rows)).otherwise(F.raise_error(F.lit("a long fold"))), *a))
    inputs = spark.range(3000).selectExpr("id AS idx", "'/a/photo.' || elt(id % 3 + 1, 'png', 'webp', 'jpg') AS path", "elt(id % 3 + 1, 'png', 'webp', 'jpeg') AS format")
    got = rows(conflicts.conflicting(inputs, "webp"))
    assert [r for r in got if r[0] < 3] == [(0, "replaces"), (2, "claimed")]
    assert sum(r[1] == "same-file" for r in got) == 2997 and len(got) == 2999


def test_many_names_get_counts_by_rank(spark):
    names = spark.range(20_000).selectExpr("id AS idx", "'d' AS folder", "'a.png' AS name")
    got = {r["idx"]: r["free_name"] for r in conflicts.free_names(names).collect()}
    assert got == {i: f"a ({i}).png" if i else "a.png" for i in range(20_000)}


def test_refs_are_numbered_by_first_appearance(spark):
    files = spark.createDataFrame([(0, "/b/x.png"), (1, "/a/y.png"), (2, "/b/x.png"), (3, "/a/x.png")], "idx long, path string")
    opened = compare.opened_files(files)
    assert rows(opened) == [(0, "/b/x.png", "file/1/x.png"), (1, "/a/y.png", "file/2/y.png"), (2, "/b/x.png", "file/1/x.png"), (3, "/a/x.png", "file/3/x.png")]
    assert rows(compare.opened_files(files.limit(0))) == []


def test_parent_segments_stop_at_the_root(spark):
    paths = ["/a/../../b", "a/./b//c/..", "/a/b/", "/..a/b..", "", None, "/"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(P.comparable(F.col("p"))).collect()]
    assert got == ["/b", "a/b", "/a/b", "/..a/b..", "", None, "/"]


def test_panes_that_do_not_shrink_are_told_of(spark):
    panes = spark.createDataFrame(
        [(1, "fallback", "PNG fallback", 50, 0.5), (1, "webp", "WebP", 50, 0.5), (1, "avif", "AVIF", 40, 0.6), (2, "fallback", "PNG fallback", 120, -0.2), (2, "webp", "WebP", None, None), (2, "avif", "AVIF", 100, 0.0)],
        "file long, role string, title string, bytes long, saving double",
    )
    got = {(r["file"], r["role"]): (r["kept"], r["note"]) for r in compare.pane_notes(panes).collect()}
    assert got == {(1, "fallback"): (True, None), (1, "webp"): (False, "Not in the suite: no smaller than the PNG fallback"), (1, "avif"): (True, None), (2, "fallback"): (False, None), (2, "webp"): (False, "Not in the suite"), (2, "avif"): (True, None)}


def test_failed_requests_are_made_again(spark):
    asked = spark.createDataFrame([("a", 1, 1, False), ("a", 1, 2, True), ("a", 2, 3, True), ("b", 1, 4, True), ("b", 3, 5, False)], "key string, ts long, seq long, ok boolean")
    assert rows(compare.requests_made(asked).where("made").select("seq")) == [(1,), (2,), (4,)]


def test_outputs_in_view_order(spark):
    frame = spark.createDataFrame([([("fallback", 1), ("same", 5), ("avif", 2), ("webp", 3), ("avif", 4)],), ([],), (None,)], "o array<struct<role:string,n:int>>")
    got = [r[0] and [(x["role"], x["n"]) for x in r[0]] for r in frame.select(compare.in_view_order(F.col("o"))).collect()]
    assert got == [[("same", 5), ("avif", 2), ("avif", 4), ("webp", 3), ("fallback", 1)], [], None]


def test_wrapped_lines_fit(spark):
    texts = ["", "one", "word " * 40 + "end", "x" * 100 + " y", "a  b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.wrapped(F.col("t"))).collect()]
    assert got[:2] == ["  ", "  one"] and got[3] == "  " + "x" * 100 + "\n  y"
    assert all(len(line) <= 80 for line in got[2].split("\n")) and got[2].replace("\n ", "")[2:] == texts[2]


def plain_free_names(names, existing, finder, ignore_case):
    """Names one after the other, as they are asked for."""
    form = str.lower if ignore_case else str
    taken = {(f, form(n)) for f, n in existing}
    out = []
    for folder, name in names:
        stem, dot, ext = name.rpartition(".") if name.rfind(".") > 0 else (name, "", "")
        counted = None if finder else re.match(r"(?s)^(.*) \(([1-9]\d{0,8})\)$", stem)
        base, count = (counted[1], int(counted[2]) + 1) if counted else (stem, 2 if finder else 1)
        free = name
        while (folder, form(free)) in taken:
            free, count = (f"{base} {count}{dot}{ext}" if finder else f"{base} ({count}){dot}{ext}"), count + 1
        taken.add((folder, form(free)))
        out.append(free)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("finder", [False, True])
def test_free_names_are_those_of_one_after_the_other(spark, seed, finder):
    r = random.Random(seed)
    count = lambda: r.choice(["", "", *([f" {r.randrange(2, 5)}", f" {r.randrange(2, 5)} 2"] if finder else [f" ({r.randrange(1, 6)})", " (02)"])])
    some = lambda n: [(r.choice("de"), r.choice(["a", "A", "b.c", ".x", "a (1) (2)"]) + count() + r.choice([".png", ".PNG", ""])) for _ in range(n)]
    names, there = some(150), some(40)
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(names)], "idx long, folder string, name string")
    existing = spark.createDataFrame(there, "folder string, name string")
    give = conflicts.finder_names if finder else conflicts.free_names
    for ignore_case in (False, True):
        got = [x["free_name"] for x in give(frame, existing, ignore_case).orderBy("idx").collect()]
        assert got == plain_free_names(names, there, finder, ignore_case)
    assert [x["free_name"] for x in give(frame, ignore_case=False).orderBy("idx").collect()] == plain_free_names(names, [], finder, False)
    odd = spark.createDataFrame([(0, None, "a"), (1, None, "a"), (2, "d", None)], "idx long, folder string, name string")
    assert [x["free_name"] for x in give(odd).orderBy("idx").collect()] == ["a", "a 2" if finder else "a (1)", None]


def test_a_large_mixed_group_of_names_takes_time_in_proportion(spark):
    names = spark.range(100_000).selectExpr("id AS idx", "'d' AS folder", "concat('a', CASE WHEN id % 3 = 0 THEN concat(' (', id % 7 + 1, ')') ELSE '' END, '.png') AS name")
    began = time.time()
    got = conflicts.free_names(names)
    assert got.select("free_name").distinct().count() == 100_000 and time.time() - began < 60


def test_paths_of_a_table_are_replaced_in_one_pass(spark):
    refs = [("/a/b.png", "file/1"), ("/a/b.png.png", "file/2"), ("/a", "A"), ("file", "no"), ("/a/b.png", "file/0"), ("", "x"), (None, "y")]
    messages = [(1, "x /a/b.png, /a/b.png.png /a/b.pn"), (2, "/a/a//a"), (3, ""), (4, None), (5, "no path"), (1, "file/a/b.png")]
    got = compare.relabelled_by(spark.createDataFrame(messages, "id long, message string"), spark.createDataFrame(refs, "path string, ref string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "x file/0, file/2 A/b.pn"), (2, "AA/A"), (3, ""), (4, None), (5, "no path"), (1, "nofile/0")], key=repr)
    assert compare.relabelled_by(got, spark.createDataFrame([], "path string, ref string")).count() == 6
