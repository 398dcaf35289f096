"""Queries over headers and heads of files. Files are put together byte by byte from columns, apart from what parses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import sinks
from quern.plans import views as V
from quern.plans.catalogue import _query, _with
from quern.shared import local_path, shared_path
from quern.sources import headers, ranges
from quern.sources.files import expand_arguments
from quern.sources.sniff import container_rows, detected_format


def _be(value, width: int) -> Column:
    """A number as hexadecimal digits, the highest byte first."""
    return F.lpad(F.hex(value if isinstance(value, Column) else F.lit(value)), 2 * width, "0")


def _le(value, width: int) -> Column:
    big = _be(value, width)
    return F.concat(*[F.substring(big, 2 * k + 1, 2) for k in range(width - 1, -1, -1)])


def _text(text: str) -> Column:
    return F.lit(text.encode("latin1").hex())


def _when(condition: Column, digits: Column) -> Column:
    return F.when(condition, digits).otherwise("")


def _with_size(body: Column, made) -> Column:
    """made(size in bytes, body): body is a long expression, which stands once, in a row of an array."""
    return F.transform(F.array(body), lambda x: made((F.length(x) / 2).cast("long"), x))[0]


def _chunk(kind: str, body: Column) -> Column:
    """Of a PNG; its checksum is not looked at."""
    return _with_size(body, lambda n, x: F.concat(_be(n, 4), _text(kind), x, F.lit("00000000")))


def _riff(kind: str, body: Column) -> Column:
    return _with_size(body, lambda n, x: F.concat(_text(kind), _le(n, 4), x, _when(n % 2 == 1, F.lit("00"))))


def _box(kind: str, *body: Column) -> Column:
    return _with_size(F.concat(*body), lambda n, x: F.concat(_be(n + 8, 4), _text(kind), x))


def _exif(orientation: Column) -> Column:
    return F.concat(_text("MM\0*"), _be(8, 4), _be(1, 2), _be(0x0112, 2), _be(3, 2), _be(1, 4), _be(orientation, 2), F.lit("0000"), _be(0, 4))


def _contents(n: Column, w: Column, h: Column) -> Column:
    """A file by its number: a PNG, a JPEG, three kinds of WebP, an AVIF, a PNG that is cut short, a GIF; of each kind some with alpha, an orientation, notes, more bits or two frames."""
    by_row = F.floor(n / 8)
    alpha, twice, deep, noted, turn = by_row % 3 == 0, by_row % 11 == 0, by_row % 7 == 0, by_row % 2 == 0, by_row % 9
    colour = F.when(by_row % 5 == 0, 6).otherwise(2)
    ihdr = F.concat(_be(w, 4), _be(h, 4), _be(F.when(deep, 16).otherwise(8), 1), _be(colour, 1), F.lit("000000"))
    head = F.concat(_text("\x89PNG\r\n\x1a\n"), _chunk("IHDR", ihdr))
    extra = F.concat(_when(alpha, _chunk("tRNS", F.lit("000000000000"))), _when(noted, _chunk("tEXt", _text("Title\0a file"))), _when(~noted, _chunk("iTXt", _text("XML:com.adobe.xmp\0\0\0\0\0<x/>"))), _when(turn > 0, _chunk("eXIf", _exif(turn))), _when(twice, _chunk("acTL", F.lit("0000000200000000"))))
    png = F.concat(head, extra, _chunk("IDAT", F.lit("78da")), _chunk("IEND", F.lit("")))

    segment = lambda marker, body: _with_size(body, lambda n, x: F.concat(F.lit(marker), _be(n + 2, 2), x))
    jpeg = F.concat(
        F.lit("ffd8"), segment("ffe0", _text("JFIF\0\x01\x01\0\0\x01\0\x01\0\0")), _when(turn > 0, segment("ffe1", F.concat(_text("Exif\0\0"), _exif(turn)))), _when(noted, segment("fffe", _text("a note"))), _when(alpha, segment("ffed", _text("Photoshop 3.0\0"))),
        F.lit("ffff"), segment("ffc2", F.concat(_be(F.when(deep, 12).otherwise(8), 1), _be(h, 2), _be(w, 2), F.lit("03012200021101031101"))), F.lit("ffda0008010100003f00"), F.lit("ab" * 40), F.lit("ffd9"),
    )

    riff = lambda *chunks: _with_size(F.concat(_text("WEBP"), *chunks), lambda n, x: F.concat(_text("RIFF"), _le(n, 4), x))
    vp8 = _riff("VP8 ", F.concat(F.lit("100000"), F.lit("9d012a"), _le(w, 2), _le(h, 2), F.lit("00" * 7)))
    frames = F.concat(_riff("ANIM", F.lit("00" * 6)), _riff("ANMF", F.lit("00" * 16)), _riff("ANMF", F.lit("00" * 16)))
    flags = F.when(alpha, 0x10).otherwise(0).bitwiseOR(F.when(turn > 0, 0x08).otherwise(0)).bitwiseOR(F.when(twice, 0x02).otherwise(0))
    vp8x = riff(_riff("VP8X", F.concat(_be(flags, 1), F.lit("000000"), _le(w - 1, 3), _le(h - 1, 3))), F.when(twice, frames).otherwise(vp8), _when(turn > 0, _riff("EXIF", _exif(turn))), _when(noted, _riff("XMP ", _text("<x/>"))))
    bits = (w - 1).bitwiseOR(F.shiftleft(h - 1, 14)).bitwiseOR(F.when(alpha, 1 << 28).otherwise(0))
    vp8l = riff(_riff("VP8L", F.concat(F.lit("2f"), _le(bits, 4), F.lit("00" * 6))))

    full = F.lit("00000000")
    item = lambda number: _box("infe", F.lit("02000000"), _be(number, 2), _be(0, 2), _text("av01\0"))
    properties = _box("ipco", _box("ispe", full, _be(w, 4), _be(h, 4)), _box("pixi", full, F.lit("03"), *[_be(F.when(deep, 10).otherwise(8), 1)] * 3), _box("irot", F.lit("01")), _box("auxC", full, _text("urn:mpeg:mpegB:cicp:systems:auxiliary:alpha\0")))
    links = _box("ipma", full, _be(2, 4), _be(1, 2), F.when(turn == 1, F.lit("03018283")).otherwise(F.lit("020182")), _be(2, 2), F.lit("020184"))
    meta = _box("meta", full, _box("pitm", full, _be(1, 2)), _box("iloc", full, F.lit("4400"), _be(0, 2)), _box("iinf", full, _be(2, 2), item(1), item(2)), _when(alpha, _box("iref", full, _box("auxl", _be(2, 2), _be(1, 2), _be(1, 2)))), _box("iprp", properties, links))
    avif = F.concat(_box("ftyp", F.when(twice, _text("avis")).otherwise(_text("avif")), full, _text("mif1miaf")), _box("free", F.lit("00" * 5)), meta, _box("mdat", F.lit("0a0b")))

    out = F.lit("474946383961")
    for k, digits in enumerate((png, jpeg, vp8x, riff(vp8), vp8l, avif, head)):
        out = F.when(n % 8 == k, digits).otherwise(out)
    return F.unhex(out)


_FACTS_SQL = """heads AS (SELECT *, file % 8 AS k, file // 8 AS m, width % 9000 + 1 AS w, height AS h FROM files),
    facts AS (SELECT file, k, m, CASE WHEN k = 7 THEN NULL ELSE ['png', 'jpeg', 'webp', 'webp', 'webp', 'avif', 'png'][k + 1] END AS format,
        CASE WHEN k = 7 THEN 'E_UNSUPPORTED_FORMAT' WHEN k = 6 THEN 'E_DECODE' WHEN k IN (0, 2, 5) AND m % 11 = 0 THEN 'E_ANIMATED' END AS error,
        CASE WHEN k IN (0, 1, 2) AND m % 9 >= 5 OR k = 5 AND m % 9 = 1 THEN h ELSE w END AS width, CASE WHEN k IN (0, 1, 2) AND m % 9 >= 5 OR k = 5 AND m % 9 = 1 THEN w ELSE h END AS height,
        k IN (0, 2, 4, 5) AND m % 3 = 0 OR k = 0 AND m % 5 = 0 AS alpha, CASE WHEN k IN (0, 1, 5) AND m % 7 = 0 THEN 16 ELSE 8 END AS depth,
        CASE WHEN k IN (0, 1, 2) AND m % 9 > 0 THEN CAST(m % 9 AS INTEGER) ELSE 1 END AS orientation,
        array_to_string(list_filter([CASE WHEN k = 1 AND m % 2 = 0 THEN 'comment' END, CASE WHEN k IN (0, 1, 2) AND m % 9 > 0 THEN 'exif' END, CASE WHEN k = 1 AND m % 3 = 0 THEN 'iptc' END, CASE WHEN k = 0 AND m % 2 = 0 THEN 'text' END, CASE WHEN k = 0 AND m % 2 = 1 OR k = 2 AND m % 2 = 0 THEN 'xmp' END], lambda x: x IS NOT NULL), ',') AS kinds,
        CASE WHEN k IN (2, 3) THEN false WHEN k = 4 THEN true END AS lossless FROM heads)"""
_FACT_COLUMNS = ("width", "height", "alpha", "depth", "orientation", "kinds", "lossless")


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.files(spark, sf_dir)
    return f.select("file", _contents(F.col("file"), F.col("width") % 9000 + 1, F.col("height")).alias("content"))


@_query(_with(V.FILES_SQL, _FACTS_SQL) + "SELECT file, format, " + ", ".join(f"CASE WHEN error IS NULL THEN {c} END AS {c}" for c in _FACT_COLUMNS) + ", error FROM facts")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, alpha, depth, orientation, kinds of metadata and animation from the headers of four formats."""
    return headers.summary(headers.inspected_contents(_made(spark, sf_dir))).select("file", "format", *_FACT_COLUMNS, "error")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"))
    n = F.col("file")
    return s.withColumn("content", _contents(n, n * 37 % 9000 + 1, n * 53 % 12000 + 1))


_SUPPLIERS_SQL = "files AS (SELECT s_suppkey AS file, s_suppkey * 37 % 9000 AS width, s_suppkey * 53 % 12000 + 1 AS height FROM supplier)"


def _stored(spark: SparkSession, files: DataFrame, name: str) -> tuple[str, Column]:
    """The folder that files (file, content) were written to, a sub-folder for each tenth, and a file's path in it."""
    root = local_path(shared_path(spark, name))
    path = F.concat(F.lit(f"{root}/d"), (F.col("file") % 10).cast("string"), F.lit("/"), F.col("file").cast("string"), F.lit(".bin"))
    failed = sinks.write_staged(files.select("file", path.alias("path"), "content")).where("error IS NOT NULL").count()
    if failed:
        raise OSError(f"{failed} files were not written below {root}")
    return root, path


@_query(
    _with(_SUPPLIERS_SQL, _FACTS_SQL)
    + "SELECT file, CASE WHEN file % 13 > 0 THEN format END AS format, " + ", ".join(f"CASE WHEN error IS NULL AND file % 13 > 0 THEN {c} END AS {c}" for c in _FACT_COLUMNS) + ", CASE WHEN file % 13 = 0 THEN 'E_READ' ELSE error END AS error FROM facts"
)
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of named files, each followed by 64 KiB that are never read; one in 13 is not there."""
    made = _suppliers(spark, sf_dir)
    padded = made.withColumn("content", F.concat("content", F.unhex(F.repeat(F.lit("00"), 65536))))
    _, path = _stored(spark, padded.where("file % 13 > 0"), "headers")
    named = made.select("file", path.alias("path"))
    return headers.summary(headers.inspected_files(named)).select("file", "format", *_FACT_COLUMNS, "error")


@_query(
    """SELECT s_suppkey AS file, CASE WHEN s_suppkey % 7 > 0 AND s_suppkey % 17 > 0 THEN CAST(octet_length(encode(repeat(s_name, 1 + s_suppkey % 3000))) AS BIGINT) END AS length,
    CASE WHEN s_suppkey % 7 > 0 AND s_suppkey % 17 > 0 THEN md5(repeat(s_name, 1 + s_suppkey % 3000)[:16384]) END AS head, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 17 = 0 THEN 'E_READ' END AS error FROM supplier"""
)
def named_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 KiB of named files, of up to some dozen KiB; files that are not there and folders are rows with an error."""
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.expr("cast(repeat(s_name, cast(1 + s_suppkey % 3000 as int)) as binary)").alias("content"))
    root, path = _stored(spark, s.where("file % 7 > 0 AND file % 17 > 0"), "heads")
    named = s.select("file", F.when(F.col("file") % 17 == 0, F.lit(f"{root}/d1")).otherwise(path).alias("path"))
    return ranges.read_heads(named).select("file", "length", F.md5("head").alias("head"), "error")


@_query(
    _with(_SUPPLIERS_SQL) + "SELECT '/d' || file % 10 || '/' || file || '.bin' AS path, CASE WHEN file % 8 = 7 THEN NULL ELSE ['png', 'jpeg', 'webp', 'webp', 'webp', 'avif', 'png'][file % 8 + 1] END AS format FROM files"
)
def folder_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of all files below a folder, by their heads; tasks list the folders."""
    root, _ = _stored(spark, _suppliers(spark, sf_dir), "folder")
    found = ranges.heads_below(spark, root)
    return found.select(F.substr("path", F.lit(len(root) + 1)).alias("path"), detected_format(F.col("head")).alias("format"))


@_query("SELECT s_suppkey AS file, CASE WHEN s_suppkey % 2 = 0 THEN md5(s_name || ' new') WHEN s_suppkey % 5 = 1 THEN md5(s_name || ' old') END AS content, CASE WHEN s_suppkey % 2 = 1 AND s_suppkey % 5 <> 1 THEN 'E_READ' END AS error, NULL AS first, 'E_WRITE' AS second FROM supplier")
def committed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saves of files over others: that of even numbers takes place, that of odd ones meets a folder in a file's place and changes nothing."""
    s = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_name").alias("name"))
    root = local_path(shared_path(spark, "committed"))
    path = F.concat(F.lit(f"{root}/"), F.col("file").cast("string"), F.lit(".bin"))
    content = lambda word: F.concat("name", F.lit(word)).cast("binary").alias("content")
    before = sinks.write_all(s.where("file % 5 = 1").select(path.alias("path"), content(" old")))
    first = sinks.write_all(s.where("file % 2 = 0").select(path.alias("path"), content(" new")))
    odd = s.where("file % 2 = 1").select(path.alias("path"), content(" odd"))
    folder = spark.createDataFrame([(root, b"")], "path string, content binary")
    second = sinks.write_all(odd.unionByName(folder))
    if before:
        raise OSError(f"files were not written below {root}")
    read = ranges.read_heads(s.select("file", path.alias("path")))
    return read.select("file", F.md5("head").alias("content"), "error", F.lit(first).cast("string").alias("first"), F.lit(second).alias("second"))


@_query(
    _with(V.FILES_SQL, _FACTS_SQL)
    + """, parts AS (SELECT file, list_filter([{'kind': 'IHDR', 'n': 13}, CASE WHEN k = 0 AND m % 3 = 0 THEN {'kind': 'tRNS', 'n': 6} END, CASE WHEN k = 0 AND m % 2 = 0 THEN {'kind': 'tEXt', 'n': 12} END, CASE WHEN k = 0 AND m % 2 = 1 THEN {'kind': 'iTXt', 'n': 26} END,
        CASE WHEN k = 0 AND m % 9 > 0 THEN {'kind': 'eXIf', 'n': 26} END, CASE WHEN k = 0 AND m % 11 = 0 THEN {'kind': 'acTL', 'n': 8} END, CASE WHEN k = 0 THEN {'kind': 'IDAT', 'n': 2} END, CASE WHEN k = 0 THEN {'kind': 'IEND', 'n': 0} END], lambda x: x IS NOT NULL) AS p FROM facts WHERE k IN (0, 6))
    SELECT file AS id, CAST(i - 1 AS INTEGER) AS number, p[i].kind AS kind, CAST(8 + list_sum(list_transform(p[1:i], lambda x: x.n + 12)) - p[i].n - 12 AS BIGINT) AS start, CAST(8 + list_sum(list_transform(p[1:i], lambda x: x.n + 12)) AS BIGINT) AS "end", CAST(p[i].n AS BIGINT) AS bytes
    FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM parts)"""
)
def png_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of PNGs that were put together from columns."""
    made = _made(spark, sf_dir).where("file % 8 IN (0, 6)").withColumnRenamed("file", "id")
    return container_rows(made, "png")


@_query(
    """WITH f AS (SELECT s_suppkey AS id, '/d' || s_suppkey % 4 || '/' || s_suppkey || '.' || ['png', 'WEBP', 'txt'][s_suppkey % 3 + 1] AS path, CAST(octet_length(encode(s_name)) AS BIGINT) AS length FROM supplier)
    SELECT 0 AS argument, path, length, 'o' AS out_dir, true AS scanned, NULL AS error FROM f WHERE id % 4 = 1 AND id % 3 < 2
    UNION ALL SELECT 1, path, length, 'o/d' || id % 4, true, NULL FROM f WHERE id % 4 IN (0, 2) AND id % 3 = 1
    UNION ALL SELECT 2, path, length, 'o', false, NULL FROM f WHERE id = 2 UNION ALL SELECT 3, '/none.png', NULL, 'o', false, 'E_READ' UNION ALL SELECT 4, '/d9/*.png', NULL, 'o', false, 'E_READ'"""
)
def arguments_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder, a pattern, a name and two that nothing answers to, as one list of inputs."""
    root = local_path(shared_path(spark, "arguments"))
    at = F.col("s_suppkey")
    path = F.concat(F.lit(f"{root}/d"), (at % 4).cast("string"), F.lit("/"), at.cast("string"), F.lit("."), F.element_at(F.array(F.lit("png"), F.lit("WEBP"), F.lit("txt")), (at % 3 + 1).cast("int")))
    if sinks.write_all(V.table(spark, sf_dir, "supplier").select(path.alias("path"), F.col("s_name").cast("binary").alias("content"))):
        raise OSError(f"files were not written below {root}")
    arguments = [f"{root}/d1", f"{root}/{{d0,d2}}/*.WEBP", f"{root}/d2/2.txt", f"{root}/none.png", f"{root}/d9/*.png"]
    found = expand_arguments(spark, arguments, out_dir="o")
    return found.select("argument", F.substr("path", F.lit(len(root) + 1)).alias("path"), "length", "out_dir", "scanned", "error")
