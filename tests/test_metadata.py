"""Metadata of files: rows that are damaged, empty or null, and renders in order."""

import pytest

from quern.functions import paths as P
from quern.functions import text as X
from quern.operators import select
from quern.sources import metadata


def test_damaged_and_null_files_are_rows_with_an_error(spark):
    rows = [(1, "png", bytearray(b"\x89PNG\r\n\x1a\n"), "<x/>"), (2, "avif", bytearray(b"no boxes"), "<x/>"), (3, "gif", bytearray(b""), None), (4, "jpeg", None, "<x/>"), (5, "jpeg", bytearray(b"\xff\xd8\xff\xd9"), "x" * 70_000), (6, None, None, None)]
    files = spark.createDataFrame(rows, "id long, format string, content binary, packet string").selectExpr("*", "1 AS error", "2 AS rights")
    written = {r["id"]: r["error"] for r in metadata.with_packets(files).collect()}
    assert written[1] is None and all(written[i].startswith("E_DECODE") for i in (2, 3, 4, 5, 6))
    read = {r["id"]: (r["rights"], r["error"]) for r in metadata.rights_read(files).collect()}
    assert read[1][1] is None and read[1][0]["creator"] is None and read[2][1].startswith("E_DECODE") and read[4][1].startswith("E_DECODE")
    kept = {r["id"]: r["error"] for r in metadata.kept_by_strip(files).collect()}
    assert kept[4].startswith("E_DECODE") and kept[5] is None
    assert metadata.with_packets(files.limit(0)).count() == metadata.rights_read(files.limit(0)).count() == 0


def test_markup_that_cannot_be_read(spark):
    texts = spark.createDataFrame([(1, "<svg/>"), (2, "<svg>"), (3, None), (4, "")], "id long, text string")
    rows = {r["id"]: r for r in metadata.svg_facts(texts).collect()}
    assert rows[1]["error"] is None and rows[1]["referencedIds"] == [] and all(rows[i]["error"].startswith("E_DECODE") for i in (2, 3, 4))


def test_renders_stop_at_the_first_that_does_not_pass(spark):
    rows = [(1, 2, 0, 80.0, 5), (1, 2, 1, None, 5), (1, 3, 0, 95.0, 6), (1, 3, 1, None, 6), (1, 4, 0, 91.0, 7), (1, 4, 1, 90.0, 7), (1, 5, 0, 99.0, 8), (2, 2, 0, None, 1)]
    low = select.lowest_renders(spark.createDataFrame(rows, "file int, decimals int, render int, score double, bytes int"))
    assert {(r["file"], r["decimals"]): r["score"] for r in low.collect()} == {(1, 2): 80, (1, 3): float("-inf"), (1, 4): 90, (1, 5): 99, (2, 2): float("-inf")}
    assert [(r["file"], r["decimals"], r["bytes"]) for r in select.fewest_decimals(low).collect()] == [(1, 4, 7)]


@pytest.mark.parametrize(("optimised", "stripped", "choice"), [(9, 8, "optimised"), (10, 9, "strip"), (None, 9, "strip"), (10, 10, "none"), (None, None, "none")])
def test_an_svg_is_replaced_by_what_is_smaller(spark, optimised, stripped, choice):
    row = spark.createDataFrame([(optimised, stripped, 10)], "a int, b int, c int")
    assert row.select(select.svg_choice(row["a"], row["b"], row["c"])).first()[0] == choice


def test_rights_options(spark):
    rows = spark.createDataFrame([("credit", " me "), ("credit", " "), ("credit", None), ("licensorUrl", "HTTPS://a.b"), ("licensorUrl", "a.b")], "name string, value string")
    assert [r[0] for r in rows.select(X.rights_error(rows["name"], rows["value"])).collect()] == [None, "credit is empty", "credit is empty", None, "licensorUrl is not an http or https address"]


def test_path_lists(spark):
    rows = spark.createDataFrame([(["a", "b"],), ([],), (["a", None],), (None,)], "paths array<string>")
    assert [r[0] for r in rows.select(P.is_path_list(rows["paths"])).collect()] == [True, True, False, False]
