"""Files as rows: folders, globs and named paths, read with Spark's binaryFile source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.paths import extension, folder, mirrored, relative_inside
from quern.schemas import EXTENSIONS
from quern.sources.ranges import with_file
from quern.sources.sniff import detected_format


def _plain(path) -> F.Column:
    return F.regexp_replace(path, "^file:/+", "/")


def scan_folder(spark: SparkSession, path: str, recursive: bool = False, out_dir: str | None = None) -> DataFrame:
    """(path, length, content, out_dir, scanned) of a folder's images by extension, in any case, without hidden files and the output folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    kept = files.withColumn("path", _plain(F.col("path"))).where(extension(F.col("path")).isin(*EXTENSIONS))
    below = relative_inside(F.lit(path.rstrip("/")), F.col("path"))
    kept = kept.where(~F.coalesce(below, F.lit("")).rlike("(^|/)\\."))
    if not recursive:
        kept = kept.where(~F.coalesce(below, F.lit("")).contains("/"))
    if out_dir is not None:
        kept = kept.where(~F.startswith(F.col("path"), F.lit(out_dir.rstrip("/") + "/")))
    inner = F.when(below.contains("/"), folder(below)).otherwise("")
    mirror = mirrored(F.lit(out_dir), inner) if out_dir is not None else F.lit(None).cast("string")
    return kept.select("path", "length", "content", mirror.alias("out_dir"), F.lit(True).alias("scanned"))


def glob_base(pattern: str) -> str:
    """The fixed folder before a pattern's first wildcard."""
    return re.split(r"[*?\[{]", pattern, maxsplit=1)[0].rpartition("/")[0]


def glob_regex(pattern: str) -> str:
    """The pattern as a regular expression: ** crosses folders, * and ? do not, {a,b} are alternatives."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return f"^{out}$"


def scan_glob(spark: SparkSession, pattern: str, out_dir: str | None = None) -> DataFrame:
    """Images whose paths match a pattern; sub-folders below its fixed part are mirrored in out_dir."""
    base = glob_base(pattern) or "."
    return scan_folder(spark, base, True, out_dir).where(F.col("path").rlike(glob_regex(pattern)))


def found(spark: SparkSession, path: str) -> str | None:
    """folder or file, or None where nothing is there, by the file system that the path names."""
    if not path:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return None
    return "folder" if system.getFileStatus(at).isDirectory() else "file"


def read_contents(paths: DataFrame) -> DataFrame:
    """paths (path, ...) with length, content and error: whole files, read where the rows are; one that can't be read is a row with E_READ. Other columns stay."""
    paths = paths.drop("length", "content", "error")
    schema = StructType([*paths.schema.fields, *StructType.fromDDL("length long, content binary, error string").fields])
    at = paths.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time, as it may be large
                row = with_file(batch.column(at)[k].as_py(), lambda r: {"length": r.size, "content": r.read(0, r.size)})
                added = [pa.array([row.get(c)], t) for c, t in (("length", pa.int64()), ("content", pa.binary()), ("error", pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *added], names=[*batch.schema.names, "length", "content", "error"])

    return paths.mapInArrow(run, schema)


def read_named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Named paths in order: (idx, path, length, content, error); a file that is not there is a row with E_READ. Nothing is asked of a file on the driver."""
    named = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "idx long, path string")  # a command's arguments
    return read_contents(named.repartition(max(1, min(len(paths), 200)), "idx")).select("idx", "path", "length", "content", "error")


def expand_argument(spark: SparkSession, argument: str, recursive: bool = False, out_dir: str | None = None) -> DataFrame:
    """(path, length, content, out_dir, scanned, error) of one argument: a folder's images, those of a pattern, or the file of that name.

    What is there by its own name is no pattern. A pattern without matches, like a name without a file, is a row with E_READ.
    """
    there = found(spark, argument)
    scanned = None
    if there == "folder":
        scanned = scan_folder(spark, argument, recursive, out_dir)
    elif there is None and re.search(r"[*?\[{]", argument) and found(spark, glob_base(argument) or ".") == "folder":
        scanned = scan_glob(spark, argument, out_dir)
        scanned = None if scanned.select("path").isEmpty() else scanned
    if scanned is not None:
        return scanned.withColumn("error", F.lit(None).cast("string"))
    return read_named(spark, [argument]).select("path", "length", "content", F.lit(out_dir).cast("string").alias("out_dir"), F.lit(False).alias("scanned"), "error")


def expand_arguments(spark: SparkSession, arguments: list[str], recursive: bool = False, out_dir: str | None = None) -> DataFrame:
    """The rows of expand_argument() for several arguments, with argument: the place of the one that gave a row.

    Inputs that several give stay as often; `operators.conflicts.expanded` takes the first of each and puts them in order.
    """
    parts = [expand_argument(spark, a, recursive, out_dir).withColumn("argument", F.lit(k)) for k, a in enumerate(arguments)]  # a command's arguments
    if not parts:
        return expand_argument(spark, "", recursive, out_dir).withColumn("argument", F.lit(0)).limit(0)
    return reduce(DataFrame.unionByName, parts)


def sniffed(files: DataFrame) -> DataFrame:
    """files with format by their bytes and version, a key that changes when they do."""
    out = files.withColumn("format", detected_format(F.col("content")))
    if "modificationTime" in files.columns:
        out = out.withColumn("version", F.concat_ws(":", "path", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string")))
    return out
