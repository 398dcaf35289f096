"""Path columns: formats by extension, output paths and claims."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.schemas import EXTENSION_OF, EXTENSIONS


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./\\\\]+)$", 1))


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), "(?<=.)\\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def format_of_extension(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, kind in EXTENSIONS.items():
        out = F.when(extension(path) == name, kind).otherwise(out)
    return out


def comparable(path: Column, ignore_case: bool = False) -> Column:
    """A path's key: single slashes, no segments of one or two dots, lower case where the file system ignores it. ASCII names need no further normalisation."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    walked = F.reduce(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    root = F.when(path.startswith("/"), "/").otherwise("")
    # few paths have such segments: the others pass without a split
    path = F.when(path.rlike("//|(^|/)\\.{1,2}(/|$)|./$"), F.concat(root, F.array_join(walked, "/"))).otherwise(path)
    return F.lower(path) if ignore_case else path


#: Bytes of names that are composed at once.
_SLICE_BYTES = 2 << 20


def composed(path: Column) -> Column:
    """A path in Unicode's form C, in which file systems that write letters and marks apart compare names; in Arrow batches, as Spark has no function for it.

    Slices of some 2 MB are Python objects at a time, so that a worker holds a batch, whose bytes Spark bounds, and its result.
    Arrow's own function leaves letters and marks apart.
    """

    def composed_slice(names: pa.Array) -> pa.Array:
        return pa.array([n if n is None else unicodedata.normalize("NFC", n) for n in names.to_pylist()], pa.string())

    def run(names: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(names)).as_py() is not False:
            return names
        rows = max(1, len(names) * _SLICE_BYTES // max(1, names.nbytes))
        out = pa.concat_arrays([composed_slice(names.slice(at, rows)) for at in range(0, len(names), rows)])
        pa.default_memory_pool().release_unused()
        return out

    return F.arrow_udf(run, "string")(path)


def comparable_anywhere(path: Column, ignore_case: bool = False) -> Column:
    """comparable() for names of any letters."""
    return comparable(composed(path), ignore_case)


def relative_inside(parent: Column, child: Column) -> Column:
    """The part of child below parent, or null."""
    return F.when(child.startswith(F.concat(parent, F.lit("/"))), F.substr(child, F.length(parent) + 2))


def mirrored(out_dir: Column, below: Column) -> Column:
    return F.when(out_dir.isNotNull(), F.concat_ws("/", out_dir, F.nullif(below, F.lit(""))))


def output_path(path: Column, kind: Column, out_dir: Column | None = None) -> Column:
    """Where an output of format kind goes: beside its input or in out_dir, under the input's own extension if that fits."""
    ends = F.lit(None).cast("string")
    for name, ext in EXTENSION_OF.items():
        ends = F.when(kind == name, ext).otherwise(ends)
    own = F.regexp_extract(path, "\\.([^./\\\\]+)$", 1)
    ends = F.when(format_of_extension(path) == kind, own).otherwise(ends)
    base = folder(path) if out_dir is None else F.coalesce(out_dir, folder(path))
    return F.concat(base, F.lit("/"), stem(path), F.lit("."), ends)


def primary_formats(kind: Column, mode: str) -> Column:
    """The formats that a mode aims for."""
    if mode == "suite":
        raster = F.array(F.lit("avif"), F.lit("webp"))
    elif mode in ("webp", "avif"):
        raster = F.array(F.lit(mode))
    else:
        raster = F.array(kind)
    return F.when(kind == "svg", F.array(F.lit("svg"))).otherwise(raster)


def claimed_formats(kind: Column, mode: str) -> Column:
    """Every format that could be written: those aimed for and what falls back."""
    if mode == "suite":
        back = F.array(F.lit("jpeg"), F.lit("png"), kind)
    else:
        back = F.array(kind)
    return F.array_distinct(F.concat(primary_formats(kind, mode), F.when(kind == "svg", F.array(F.lit("svg"))).otherwise(back)))


def output_claims(path: Column, kind: Column, mode: str, out_dir: Column | None = None) -> Column:
    """Distinct keys of the paths that an input's outputs could take; none for an unknown format."""
    claims = F.array_distinct(F.transform(claimed_formats(kind, mode), lambda f: comparable(output_path(path, f, out_dir))))
    return F.when(kind.isNotNull(), claims).otherwise(F.array().cast("array<string>"))


def is_plain_part(part: Column) -> Column:
    """A part of a path that stays in its folder."""
    return ~(part.isin("", ".", "..") | part.rlike("[/\\\\\\x00]"))


def free_name(name: Column, number: Column) -> Column:
    """The name with a count: "a (1).png" for "a.png"."""
    ext = F.regexp_extract(name, "(?<=.)(\\.[^.]*)$", 1)
    bare = F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")
    return F.concat(bare, F.lit(" ("), number.cast("string"), F.lit(")"), ext)


def is_path_list(paths: Column) -> Column:
    """Whether an array is there and holds no null."""
    return F.coalesce(F.forall(paths, lambda p: p.isNotNull()), F.lit(False))
