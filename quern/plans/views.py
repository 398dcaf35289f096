"""The star-schema and page tables seen as inputs, candidates, paths, rights and events. All numbers are whole, so that engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern import reachable
from quern.shared import spread

#: Parts, or other rows that are work of their own, that one task makes files of.
_TASK_PARTS = 50_000

LINEITEM = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, dealt by key: a row is work of its own, and a file of millions of rows is but one task's."""
    rows = table(spark, sf_dir, "part")
    return spread(rows, rows.count(), "p_partkey", task_rows=_TASK_PARTS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, dealt by order over as many tasks as its rows ask for: what is sorted, grouped or joined by order stays there."""
    rows = table(spark, sf_dir, "lineitem")
    return spread(rows, rows.count(), "l_orderkey")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, ord, format, role, method, bytes, score) from lineitem; ord numbers an order's lines by all their columns."""
    order = Window.partitionBy("l_orderkey").orderBy(*LINEITEM)
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("file"),
        F.row_number().over(order).alias("ord"),
        F.when(F.col("l_returnflag") == "A", "avif").when(F.col("l_returnflag") == "N", "webp").otherwise("jpeg").alias("format"),
        F.when(F.col("l_returnflag") == "A", "avif").when(F.col("l_returnflag") == "N", "webp").otherwise("fallback").alias("role"),
        F.when(F.col("l_linestatus") == "O", "lossy").otherwise("lossless").alias("method"),
        F.floor("l_extendedprice").cast("long").alias("bytes"),
        (F.lit(100) - F.round(F.col("l_discount") * 100).cast("int") * 5 - F.round(F.col("l_tax") * 100).cast("int") * 2).alias("score"),
    )


CANDIDATES_SQL = """candidates AS (
    SELECT l_orderkey AS file,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INTEGER) AS ord,
        CASE l_returnflag WHEN 'A' THEN 'avif' WHEN 'N' THEN 'webp' ELSE 'jpeg' END AS format,
        CASE l_returnflag WHEN 'A' THEN 'avif' WHEN 'N' THEN 'webp' ELSE 'fallback' END AS role,
        CASE l_linestatus WHEN 'O' THEN 'lossy' ELSE 'lossless' END AS method,
        CAST(floor(l_extendedprice) AS BIGINT) AS bytes,
        CAST(100 - 5 * CAST(round(l_discount * 100) AS INTEGER) - 2 * CAST(round(l_tax * 100) AS INTEGER) AS INTEGER) AS score
    FROM lineitem)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, input_bytes, input_format, width, height) from orders."""
    first = F.substring("o_orderpriority", 1, 1)
    kinds = F.when(first == "1", "png").when(first == "2", "jpeg").when(first == "3", "webp").when(first == "4", "avif").otherwise("svg")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("file"), F.floor(F.col("o_totalprice") / 8).cast("long").alias("input_bytes"), kinds.alias("input_format"),
        (F.col("o_orderkey") * 37 % 20000 + 1).alias("width"), (F.col("o_custkey") * 53 % 12000 + 1).alias("height"),
    )


FILES_SQL = """files AS (
    SELECT o_orderkey AS file, CAST(floor(o_totalprice / 8) AS BIGINT) AS input_bytes,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'png' WHEN '2' THEN 'jpeg' WHEN '3' THEN 'webp' WHEN '4' THEN 'avif' ELSE 'svg' END AS input_format,
        o_orderkey * 37 % 20000 + 1 AS width, o_custkey * 53 % 12000 + 1 AS height
    FROM orders)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, path, format, scanned) from pages: each name stands in three folders and seven extensions, of which one has no known format; every fiftieth path is an earlier one."""
    m = F.col("page_id") - F.when(F.col("page_id") % 50 == 49, 14).otherwise(0)
    ext = F.array(*[F.lit(x) for x in ("png", "JPG", "jpeg", "webp", "avif", "svg", "txt")])
    path = F.concat(F.lit("/in/d"), (F.floor(m / 7) % 3).cast("string"), F.lit("/img"), F.floor(m / 21).cast("string"), F.lit("."), F.get(ext, (m % 7).cast("int")))
    kind = F.when(m % 7 == 0, "png").when((m % 7).isin(1, 2), "jpeg").when(m % 7 == 3, "webp").when(m % 7 == 4, "avif").when(m % 7 == 5, "svg")
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), path.alias("path"), kind.alias("format"), (F.col("page_id") % 3 == 0).alias("scanned"))


PATHS_SQL = """paths AS (
    SELECT page_id AS idx, '/in/d' || (m // 7 % 3) || '/img' || (m // 21) || '.' || (['png', 'JPG', 'jpeg', 'webp', 'avif', 'svg', 'txt'])[m % 7 + 1] AS path,
        (['png', 'jpeg', 'jpeg', 'webp', 'avif', 'svg', NULL])[m % 7 + 1] AS format, page_id % 3 = 0 AS scanned
    FROM (SELECT page_id, page_id - CASE WHEN page_id % 50 = 49 THEN 14 ELSE 0 END AS m FROM pages))"""

#: A path's folder, stem and claimed paths in suite mode.
CLAIMS_SQL = """claims AS (
    SELECT idx, path, format, scanned, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS stem, kinds, list_filter(named, lambda c, i: list_position(named, c) = i) AS claims
    FROM (SELECT *, list_transform(kinds, lambda k: regexp_extract(path, '^(.*)\\.[^.]*$', 1) || '.' || CASE WHEN k = format THEN regexp_extract(path, '\\.([^.]*)$', 1) WHEN k = 'jpeg' THEN 'jpg' ELSE k END) AS named
        FROM (SELECT *, CASE WHEN format IS NULL THEN [] WHEN format = 'svg' THEN ['svg'] ELSE ['avif', 'webp', 'jpeg', 'png'] END AS kinds FROM paths)))"""


def rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, xmp, iim, exif, added): four structs of rights fields from customer, nation and region, with fields missing by the key."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    key = F.col("c_custkey")
    text, texts, marked = "string", "array<string>", "array<struct<lang:string,value:string>>"

    def struct(creator, credit, copyright_, statement, licensor, source):
        fields = (creator, texts), (credit, text), (copyright_, marked), (statement, text), (licensor, texts), (source, text)
        names = ("creator", "credit", "copyright", "webStatement", "licensorUrl", "digitalSourceType")
        return F.struct(*[(F.lit(None) if v is None else v).cast(t).alias(n) for n, (v, t) in zip(names, fields, strict=True)])

    line = lambda lang, value: F.array(F.struct(F.lit(lang).alias("lang"), value.alias("value")))
    url = F.concat(F.lit("https://example.com/"), key.cast("string"))
    xmp = struct(F.when(key % 2 == 0, F.array("c_name")), F.when(key % 5 == 0, F.col("c_mktsegment")), F.when(key % 3 == 0, line("x-default", F.concat(F.lit('<"'), F.col("c_name"), F.lit('"> & co')))), F.when(key % 7 == 0, url), F.when(key % 4 == 1, F.array(url, F.concat(url, F.lit("?a=1&b=2")))), None)
    iim = struct(F.when(key % 3 == 1, F.array(F.upper("c_name"))), F.when(key % 2 == 1, F.col("n_name")), F.when(key % 4 == 0, line("x-default", F.col("n_name"))), None, None, None)
    exif = struct(F.when(key % 5 == 3, F.array("r_name")), None, F.when(key % 2 == 0, line("x-default", F.col("r_name"))), None, None, None)
    added = struct(F.when(key % 6 == 1, F.array(F.lit("Added"))), F.when(key % 11 == 0, F.lit("Added")), None, F.lit("https://example.com/licence"), None, None)
    return c.select(key.alias("file"), xmp.alias("xmp"), iim.alias("iim"), exif.alias("exif"), added.alias("added"))


RIGHTS_SQL = """c AS (
    SELECT c_custkey AS k, c_name, c_mktsegment, n_name, r_name, 'https://example.com/' || c_custkey AS url
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
own AS (SELECT k AS file,
    coalesce(CASE WHEN k % 2 = 0 THEN [c_name] END, CASE WHEN k % 3 = 1 THEN [upper(c_name)] END, CASE WHEN k % 5 = 3 THEN [r_name] END) AS creator,
    coalesce(CASE WHEN k % 5 = 0 THEN c_mktsegment END, CASE WHEN k % 2 = 1 THEN n_name END) AS credit,
    coalesce(CASE WHEN k % 3 = 0 THEN '<"' || c_name || '"> & co' END, CASE WHEN k % 4 = 0 THEN n_name END, CASE WHEN k % 2 = 0 THEN r_name END) AS copyright,
    CASE WHEN k % 7 = 0 THEN url END AS web, CASE WHEN k % 4 = 1 THEN [url, url || '?a=1&b=2'] END AS licensor
    FROM c),
wanted AS (SELECT file, coalesce(creator, CASE WHEN file % 6 = 1 THEN ['Added'] END) AS creator, coalesce(credit, CASE WHEN file % 11 = 0 THEN 'Added' END) AS credit, copyright,
    coalesce(web, 'https://example.com/licence') AS web, licensor FROM own)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, user, type, ts, value) from events: views start a file, signups and purchases finish it, errors fail it, clicks change settings."""
    kind = F.col("event_type")
    types = F.when(kind == "view", "file-start").when(kind == "error", "file-failed").when(kind == "click", "settings").otherwise("file-done")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("user"), types.alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 100).cast("long").alias("value"))


EVENTS_SQL = """ev AS (
    SELECT event_id AS seq, user_id AS user_, CASE event_type WHEN 'view' THEN 'file-start' WHEN 'error' THEN 'file-failed' WHEN 'click' THEN 'settings' ELSE 'file-done' END AS type,
        ts, CAST(floor(value * 100) AS BIGINT) AS value FROM events)"""
