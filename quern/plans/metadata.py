"""Queries over metadata in files: packets written and read back, other carriers, SVG markup, and text of event streams."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import sinks
from quern.functions import text as X
from quern.operators import rights, select
from quern.plans import views as V
from quern.plans.catalogue import _own, _query, _with
from quern.shared import shared_path
from quern.sources import files, metadata, sniff
from quern.streaming import events as E

_KINDS = ("png", "jpeg", "webp", "avif")


@_query(
    _with(V.RIGHTS_SQL)
    + """SELECT file AS id, ['png', 'jpeg', 'webp', 'avif'][file % 4 + 1] AS format, array_to_string(creator, '|') AS creator, credit, CASE WHEN copyright IS NOT NULL THEN 'x-default=' || copyright END AS copyright, web, array_to_string(licensor, '|') AS licensor, CAST(NULL AS VARCHAR) AS error FROM wanted"""
)
def rights_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All wanted rights written to files of four formats in place of the packet there, and read back."""
    wanted = _own(spark, sf_dir).select(F.col("file").alias("id"), rights.xmp_packet(F.col("wanted")).alias("packet"))
    names = wanted.select("id", F.concat(F.lit("image "), "id").alias("name"))
    made = reduce(DataFrame.unionByName, [sniff.sample_files(names.where(F.col("id") % 4 == k), kind) for k, kind in enumerate(_KINDS)])
    written = metadata.with_packets(made.join(wanted, "id"))
    read = metadata.rights_read(written.where("error IS NULL")).withColumn("format", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("id") % 4 + 1).cast("int")))
    lines = F.array_join(F.transform("rights.copyright", lambda c: F.concat(c["lang"], F.lit("="), c["value"])), "|")
    return read.select("id", "format", F.array_join("rights.creator", "|").alias("creator"), "rights.credit", lines.alias("copyright"), F.col("rights.webStatement").alias("web"), F.array_join("rights.licensorUrl", "|").alias("licensor"), "error")


@_query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_name || '|Other' ELSE p_name || '|Second' END AS creator, CASE WHEN p_partkey % 3 > 0 THEN 'Credit ' || p_name END AS credit, 'held by, ' || p_name AS copyright,
    CASE WHEN p_partkey % 2 = 0 THEN 'exif,icc,other' ELSE 'exif,other' END AS removed, CASE WHEN p_partkey % 8 > 0 THEN CAST(p_partkey % 8 + 1 AS INTEGER) END AS orientation, p_partkey % 2 = 1 AS profile FROM part"""
)
def carriers_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights from IIM before EXIF, in both byte orders; a strip leaves the orientation and a profile that is not sRGB, whose parts are out of order."""
    made = metadata.sample_carriers(V.parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).withColumn("format", F.lit("jpeg"))
    read = metadata.rights_read(made).select("id", F.array_join("rights.creator", "|").alias("creator"), "rights.credit", F.get("rights.copyright", F.lit(0))["value"].alias("copyright"))
    return read.join(metadata.kept_by_strip(made).select("id", F.array_join("removed", ",").alias("removed"), "orientation", "profile"), "id")


@_query(
    """SELECT p_partkey AS id, '0 0 ' || p_size || ' 9' AS view_box, p_name AS title, 'a' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ',b' ELSE '' END AS referenced,
    array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'comment' END, CASE WHEN p_partkey % 5 = 0 THEN 'editor' END, CASE WHEN p_partkey % 7 = 0 THEN 'metadata' END], lambda x: x IS NOT NULL), ',') AS metadata,
    CASE WHEN p_partkey % 11 = 0 THEN 'E_DECODE' END AS error FROM part WHERE p_partkey % 11 > 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, 'E_DECODE' FROM part WHERE p_partkey % 11 = 0"""
)
def svg_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of SVGs that are defined and referred to; markup without an end is an error."""
    at, number = F.col("p_partkey"), F.col("p_partkey").cast("string")
    some = lambda n, markup: F.when(at % n == 0, markup).otherwise("")
    parts = [
        F.lit('<svg xmlns="http://www.w3.org/2000/svg" xmlns:i="http://www.inkscape.org/namespaces/inkscape" viewBox="0 0 '), F.col("p_size").cast("string"), F.lit(' 9"'), some(5, ' i:version="1"'), F.lit("><title>"), X.escape_xml(F.col("p_name")), F.lit("</title>"),
        some(3, "<!-- note -->"), some(7, "<metadata>x</metadata>"), F.lit('<g id="a'), number, F.lit('"/><g id="b"/><g id="unused"/><use href="#a'), number, F.lit('"/><use href="#gone"/>'), some(2, '<path fill="url(#b)"/>'), F.when(at % 11 == 0, "").otherwise("</svg>"),
    ]
    facts = metadata.svg_facts(V.parts(spark, sf_dir).select(at.alias("id"), F.concat(*parts).alias("text")))
    return facts.select("id", F.col("viewBox").alias("view_box"), "title", F.array_join("referencedIds", ",").alias("referenced"), F.array_join("metadata", ",").alias("metadata"), F.substring_index("error", ":", 1).alias("error"))


_PLACES = "'/' || CASE WHEN id % 9 = 0 THEN 'out/' ELSE '' END || 'd' || id % 7 || '/' || CASE WHEN id % 10 = 0 THEN '.' ELSE '' END || 'img' || id || '.' || ['png', 'JPG', 'webp', 'avif', 'txt'][CASE WHEN id % 13 = 0 THEN 5 ELSE id % 4 + 1 END]"


@_query(
    f"""SELECT {_PLACES} AS path, ['png', 'jpeg', 'webp', 'avif'][id % 4 + 1] AS format, '/out/d' || id % 7 AS out_dir FROM (SELECT s_suppkey AS id FROM supplier) WHERE id % 9 > 0 AND id % 10 > 0 AND id % 13 > 0"""
)
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, written and found again by extension, in any case; not hidden ones and those of the output folder."""
    root = re.sub("^file:/+", "/", shared_path(spark, "files"))
    names, at = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), F.col("id")
    made = reduce(DataFrame.unionByName, [sniff.sample_files(names.where(at % 4 == k), kind) for k, kind in enumerate(_KINDS)])
    some = lambda n, text: F.when(at % n == 0, text).otherwise("")
    ending = F.when(at % 13 == 0, "txt").otherwise(F.element_at(F.array(F.lit("png"), F.lit("JPG"), F.lit("webp"), F.lit("avif")), (at % 4 + 1).cast("int")))
    path = F.concat(F.lit(f"{root}/"), some(9, "out/"), F.lit("d"), (at % 7).cast("string"), F.lit("/"), some(10, "."), F.lit("img"), at.cast("string"), F.lit("."), ending)
    failed = sinks.write_staged(made.select(at.alias("file"), path.alias("path"), "content")).where("error IS NOT NULL").count()
    if failed:
        raise OSError(f"{failed} files were not written below {root}")
    scanned = files.sniffed(files.scan_folder(spark, root, True, f"{root}/out"))
    below = lambda c: F.substr(F.col(c), F.lit(len(root) + 1))
    return scanned.select(below("path").alias("path"), "format", below("out_dir").alias("out_dir"))


@_query(_with(V.EVENTS_SQL) + 'SELECT type AS event, seq, user_ AS "user", value FROM ev')
def event_stream_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as the text of a stream, and read from it."""
    stream = sinks.server_sent(V.events(spark, sf_dir).select("type", "seq", "user", "value"))
    field = lambda name: F.get_json_object("data", f"$.{name}").cast("long").alias(name)
    return E.parse_event_stream(stream).select("event", field("seq"), field("user"), field("value"))


_OPTION = "['creator', 'credit', 'copyright', 'webStatement', 'licensorUrl', 'digitalSourceType'][c_custkey % 6 + 1]"


@_query(
    f"""SELECT id, name, CASE WHEN trim(value) = '' THEN name || ' is empty' WHEN name IN ('webStatement', 'licensorUrl', 'digitalSourceType') AND NOT regexp_matches(trim(value), '^https?://[^/?#\\s]') THEN name || ' is not an http or https address' END AS error
    FROM (SELECT c_custkey AS id, {_OPTION} AS name, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN ' https://example.com/' || c_custkey ELSE c_name END AS value FROM customer)"""
)
def option_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a rights option, or null."""
    at = F.col("c_custkey")
    names = F.array(*map(F.lit, ("creator", "credit", "copyright", "webStatement", "licensorUrl", "digitalSourceType")))
    value = F.when(at % 5 == 0, "").when(at % 5 == 1, "  ").when(at % 5 == 2, F.concat(F.lit(" https://example.com/"), at)).otherwise(F.col("c_name"))
    named = V.table(spark, sf_dir, "customer").select(at.alias("id"), F.element_at(names, (at % 6 + 1).cast("int")).alias("name"), value.alias("value"))
    return named.select("id", "name", X.rights_error(F.col("name"), F.col("value")).alias("error"))


#: Two renders of each number of decimals, in the order of a file's candidates; one in 13 fails.
_RENDERS = "r AS (SELECT file, CAST((ord - 1) // 2 + 2 AS INTEGER) AS decimals, CAST((ord - 1) % 2 AS INTEGER) AS render, CASE WHEN bytes % 13 > 0 THEN score END AS score, bytes FROM candidates)"
_LOWEST = "low AS (SELECT file, decimals, CASE WHEN bool_or(score IS NULL AND render <= stop) THEN CAST('-inf' AS DOUBLE) ELSE CAST(min(score) FILTER (render <= stop) AS DOUBLE) END AS score, min(bytes) AS bytes FROM (SELECT *, coalesce(min(CASE WHEN score IS NULL OR score < 90 THEN render END) OVER (PARTITION BY file, decimals), 9) AS stop FROM r) GROUP BY file, decimals)"


@_query(
    _with(V.CANDIDATES_SQL, V.FILES_SQL, _RENDERS, _LOWEST)
    + """, passed AS (SELECT file, min(decimals) AS decimals, arg_min(bytes, decimals) AS bytes FROM low WHERE score >= 90 GROUP BY file)
    SELECT file, decimals, CASE WHEN p.bytes < input_bytes THEN 'optimised' WHEN input_bytes * 9 // 10 < input_bytes AND file % 3 > 0 THEN 'strip' ELSE 'none' END AS choice FROM files LEFT JOIN passed p USING (file)"""
)
def svg_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fewest decimals whose renders pass, and whether that, a strip or neither is smaller than the input."""
    c = V.candidates(spark, sf_dir)
    renders = c.select("file", (F.floor((F.col("ord") - 1) / 2) + 2).cast("int").alias("decimals"), ((F.col("ord") - 1) % 2).alias("render"), F.when(F.col("bytes") % 13 > 0, F.col("score")).alias("score"), "bytes")
    passed = select.fewest_decimals(select.lowest_renders(renders))
    inputs = V.files(spark, sf_dir).join(passed, "file", "left")
    strip = F.when(F.col("file") % 3 > 0, F.floor(F.col("input_bytes") * 9 / 10)).otherwise(F.col("input_bytes"))
    return inputs.select("file", "decimals", select.svg_choice(F.col("bytes"), strip, F.col("input_bytes")).alias("choice"))
