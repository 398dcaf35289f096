"""A whole run over files: inspect, plan, strip, resize, encode with the codecs there are, select, plan again and write."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern import sinks
from quern.functions.paths import comparable, output_path, primary_formats
from quern.functions.text import listed
from quern.operators import conflicts, rights, search, select
from quern.operators.geometry import is_scorable, is_downscaled
from quern.pixels import Codec, Metric, PngCodec, fit_to_width, is_opaque, peak_signal_score, score
from quern.schemas import RIGHTS_FIELDS
from quern.settings import Settings
from quern.shared import written
from quern.sources import containers, headers, svg
from quern.sources.ranges import Ranges
from quern.sources.sniff import detected_format

#: A score below which an output's loss is likely to show.
NOTICEABLE_BELOW = 70
#: What a file is when its metadata may stay: one of these is a licence field.
LICENCE_FIELDS = ("creator", "credit", "copyright", "webStatement", "licensorUrl")
_RIGHTS = "struct<creator:array<string>,credit:string,copyright:array<struct<lang:string,value:string>>,webStatement:string,licensorUrl:array<string>,digitalSourceType:string>"
_TIERS = "array<struct<tier:int,fields:array<string>,text:string>>"
_FACTS = f"width int, height int, own {_RIGHTS}, only_rights boolean, keeps_profile boolean, unread string"
_CANDIDATES = "ord int, tier int, format string, method string, quality int, bytes long, score double, role string, carried array<string>, resized boolean, shown_width int, unchanged boolean, content binary, error string"


def _message(error: Exception) -> str:
    text = str(error).splitlines()[0] if str(error) else type(error).__name__
    return text if text.startswith("E_") else f"E_DECODE: {text}"


def _rows(files: DataFrame, columns: Sequence[str], added: str, of) -> DataFrame:
    """files' columns with what `of` makes of each row: zero or more dicts of the added columns."""
    kept = [c for c in columns if c != "content"]
    schema = StructType(files.select(*kept).schema.fields + StructType.fromDDL(added).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a file at a time, as it may be large
                row = batch.slice(at, 1).to_pylist()[0]
                out = [{c: row[c] for c in kept} | made for made in of(row)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.select(*columns).mapInArrow(run, schema)


def inspected(files: DataFrame) -> DataFrame:
    """files (file, format, content) with the size that the header says, rights, and unread: why the file cannot be used. Pixels are not decoded here."""
    empty = dict.fromkeys(("width", "height", "own", "only_rights", "keeps_profile", "unread"))

    def of(row: dict) -> Iterator[dict]:
        kind, data = row["format"], row["content"]
        try:
            if kind == "svg":
                svg.inspect_svg((data or b"").decode())
                yield empty | {"own": {}, "only_rights": False, "keeps_profile": False}
                return
            if kind not in containers.STRIP:
                raise ValueError("E_UNSUPPORTED_FORMAT: no parser for this format")
            if kind == "avif" and (top := list(containers.boxes(data))) and top[-1].end == len(data) and all(p.kind != "meta" for p in top):
                raise ValueError("E_UNSUPPORTED_FORMAT: there are no items in this file")
            head = headers.inspect(Ranges.of(data or b""))
            if head["error"] == "E_ANIMATED":
                raise ValueError("E_ANIMATED: animated images are not supported")
            stripped, removed = containers.STRIP[kind](data)
            own = {k: v for k, v in containers.read_rights(data, kind).items() if k in RIGHTS_FIELDS}
            yield {"width": head.get("width"), "height": head.get("height"), "own": own, "only_rights": removed == ["xmp"], "keeps_profile": b"ICC_PROFILE" in stripped or b"iCCP" in stripped or b"ICCP" in stripped, "unread": None}
        except (ValueError, TypeError, KeyError, IndexError) as e:
            yield empty | {"unread": _message(e)}

    return _rows(files, ["file", "format", "content"], _FACTS, of)


def candidates(files: DataFrame, settings: Settings, codecs: Sequence[Codec] = (PngCodec(),), metric: Metric = peak_signal_score) -> DataFrame:
    """files (file, format, tiers, content) to candidates (source: the file's own format), each with each tier's packet: the lossless strip first, then each codec's choice.

    A file wider than max_width is shrunk to it and has no strip. A file that fails is a row with an error.
    """
    wanted = {"suite": ("avif", "webp", "jpeg", "png")}.get(settings.mode)
    role = lambda f: ("fallback" if f in ("jpeg", "png") else f) if settings.mode == "suite" else settings.mode

    def encodings(kind: str, data: bytes) -> Iterator[tuple]:
        if kind == "svg":
            yield 0, kind, "strip", None, svg.strip_svg(data.decode()).encode(), 100.0, False, None
            return
        reader = next((c for c in codecs if c.format == kind), None)
        pixels = reader.decode(data) if reader else None
        fitted = fit_to_width(pixels, settings.max_width) if reader else None
        resized = reader is not None and fitted is not pixels
        width = fitted.shape[1] if reader else None
        if not resized:
            yield 0, kind, "strip", None, containers.with_xmp(containers.STRIP[kind](data)[0], kind, None), 100.0, False, width
        for n, codec in enumerate(codecs if reader else (), 1):
            if codec.format not in (wanted or ((kind,) if settings.mode == "same" else (settings.mode, kind))) or codec.format == "jpeg" and not is_opaque(fitted):
                continue
            if codec.qualities is None:
                yield n, codec.format, "lossless", None, codec.encode(fitted, None), 100.0, resized, width
            else:
                attempt = lambda q, codec=codec: (d := codec.encode(fitted, q), score(fitted, codec.decode(d), metric))
                best, _ = search.search_qualities(attempt, *codec.qualities, settings.target)
                yield n, codec.format, "lossy", best["quality"], best["data"], best["score"], resized, width

    def of(row: dict) -> Iterator[dict]:
        data, out = row["content"], []
        try:
            for n, kind, method, quality, content, found, resized, width in encodings(row["source"], data):
                for tier in row["tiers"]:
                    whole = content if tier["text"] is None else containers.with_xmp(content, kind, tier["text"].encode())
                    if whole is not None:
                        out.append({"ord": n, "tier": tier["tier"], "format": kind, "method": method, "quality": quality, "bytes": len(whole), "score": float(found), "role": role(kind), "carried": tier["fields"], "resized": resized, "shown_width": width, "unchanged": whole == data, "content": whole, "error": None})
        except (ValueError, TypeError, KeyError, IndexError) as e:
            out = [dict.fromkeys(("ord", "tier", "format", "method", "quality", "bytes", "score", "role", "carried", "resized", "shown_width", "unchanged", "content")) | {"error": _message(e)}]
        yield from out

    return _rows(files.withColumnRenamed("format", "source"), ["file", "source", "tiers", "content"], _CANDIDATES, of)


def _tiers(own: Column, only_rights: Column, settings: Settings) -> Column:
    """array<struct<tier, fields, text>>: the packets that outputs may carry, the fullest first."""
    given = settings.rights
    copyright_ = F.array(F.struct(F.lit("x-default").alias("lang"), F.lit(given.get("copyright")).alias("value"))) if "copyright" in given else F.lit(None)
    value = {f: F.array(F.lit(given[f])) if f in ("creator", "licensorUrl") and f in given else F.lit(given.get(f)) for f in RIGHTS_FIELDS} | {"copyright": copyright_}
    added = F.struct(*[value[f].alias(f) for f in RIGHTS_FIELDS]).cast(_RIGHTS)
    full = rights.merged([own, added])
    text = lambda t: F.when(t["packet"].isNull(), None).when(t["tier"] == 0, rights.xmp_packet(full)).otherwise(rights.xmp_packet(own))
    return F.transform(rights.tiers(own, full, settings.strip_all, only_rights), lambda t: F.struct(t["tier"].alias("tier"), t["fields"].alias("fields"), text(t).alias("text"))).cast(_TIERS)


def _warning(code: str, message: Column | str) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def optimise(files: DataFrame, settings: Settings, codecs: Sequence[Codec] = (PngCodec(),), metric: Metric = peak_signal_score, write: bool = True, existing: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """files (path, content) to (path, status, format, method, bytes, output_bytes, score, output, carried, warnings, error), a row for each output or file without one.

    idx, if files has it, is unique and orders inputs; without it they go by path, and a path's repeats after its first.
    existing (path) lists what is there already; without it tasks look. An output on its input needs in_place (else the file
    failed), one on another existing file needs overwrite (else it is skipped); both are checked before any work for the
    formats aimed for, and again for what was chosen. Null contents are E_READ. failures (idx, error) tells of inputs that
    failed before the run: they take their places in it as failed files, without any work. Empty tables give no rows.
    """
    number = F.col("idx") if "idx" in files.columns else F.concat_ws("\0", F.coalesce("path", F.lit("")), F.lpad(F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64("content"))).cast("string"), 10, "0"))
    each = files.select(number.alias("file"), "path", "content").withColumn("format", F.when(F.col("content").isNotNull(), detected_format(F.col("content"))))
    each = written(each.withColumn("bytes", F.octet_length("content").cast("long")), "run-files")
    out_dir = F.lit(settings.out_dir) if settings.out_dir else None
    there = lambda paths: existing.select("path") if existing is not None else sinks.existing(paths)
    clashes = conflicts.conflicting(each.select(F.col("file").alias("idx"), "path", "format"), settings.mode).select(F.col("idx").alias("file"), F.concat(F.lit("E_OUTPUT_CONFLICT: "), "reason").alias("conflict"))
    facts = written(inspected(each).drop("format"), "run-facts")
    ready = each.drop("content").join(facts, "file").join(clashes, "file", "left").withColumn("unread", F.when(F.col("bytes").isNull(), "E_READ: the file cannot be read").otherwise(F.col("unread")))
    if failures is not None:
        ready = ready.join(failures.groupBy(F.col("idx").alias("file")).agg(F.min("error").alias("before")), "file", "left").withColumn("unread", F.coalesce("before", "unread")).withColumn("conflict", F.when(F.col("before").isNull(), F.col("conflict"))).drop("before")

    is_input = comparable(F.col("path")) == comparable(F.col("own_path"))
    aimed = ready.where("conflict IS NULL AND unread IS NULL").select("file", F.col("path").alias("own_path"), F.posexplode(F.transform(primary_formats(F.col("format"), settings.mode), lambda f: output_path(F.col("path"), f, out_dir))).alias("ord", "path"))
    aimed = aimed.select("file", "ord", "path", is_input.alias("is_input"), F.lit(False).alias("unchanged"))
    early = conflicts.write_plan(aimed, there(aimed), settings.in_place, settings.overwrite).select("file", "action", "blocked_path")
    ready = written(ready.join(early, "file", "left").withColumn("tiers", _tiers(F.col("own"), F.col("only_rights"), settings)), "run-ready")

    open_ = ready.where("action = 'write'").select("file", "tiers", "width", F.col("bytes").alias("input_bytes"))
    made = written(candidates(each.join(open_.select("file", "tiers"), "file"), settings, codecs, metric).drop("tiers"), "run-candidates")
    sized = made.where("error IS NULL").drop("content", "error").join(open_.select("file", "input_bytes"), "file")
    if settings.mode == "suite":
        best = select.select_suite(sized, ["file"], settings.target, F.col("input_bytes"), F.col("resized"))
    else:
        aim = F.col("source") if settings.mode == "same" else F.when(F.col("source") == "svg", "svg").otherwise(F.lit(settings.mode))
        sized = sized.withColumn("is_fallback", F.col("format") != aim)
        best = select.select_single(sized, ["file"], settings.target, F.col("input_bytes"), aim != F.col("source"))
    best = written(best, "run-chosen")

    outputs = best.join(ready.select("file", F.col("path").alias("own_path")), "file").withColumn("path", output_path(F.col("own_path"), F.col("format"), out_dir)).withColumn("is_input", is_input)
    late = conflicts.write_plan(outputs.select("file", "ord", "path", "is_input", "unchanged"), there(outputs), settings.in_place, settings.overwrite)
    late = late.select("file", F.col("action").alias("late_action"), F.col("blocked_path").alias("late_path"))
    # a chosen list of nothing but the input keeps the file as it is
    whole = best.groupBy("file").agg(F.bool_and("unchanged").alias("all_unchanged"), F.min("score").alias("least_score"), F.bool_or("resized").alias("any_resized"), F.bool_or(F.col("method") == "strip").alias("any_strip"), F.flatten(F.collect_set("carried")).alias("any_carried"), F.min(F.size("carried")).alias("least_carried"), F.max("format").alias("chosen_format"))
    was_resized = made.groupBy("file").agg(F.coalesce(F.bool_and("resized"), F.lit(False)).alias("was_resized"), F.max("error").alias("failure"), F.max("shown_width").alias("shown_width"))
    chosen = ready.join(whole, "file", "left").join(late, "file", "left").join(was_resized, "file", "left")
    kept = F.col("all_unchanged").isNull() | F.col("all_unchanged")
    blocked = F.when(F.col("action") != "write", F.col("action")).when(~kept & (F.col("late_action") != "write"), F.col("late_action"))
    where = F.coalesce(F.when(F.col("action") != "write", F.col("blocked_path")), "late_path")
    error = F.coalesce("conflict", "unread", "failure", F.when(blocked == "blocked-input", "E_OUTPUT_IS_INPUT"))
    status = F.when(error.isNotNull(), "failed").when(blocked == "blocked-exists", "skipped").when(kept, "kept-original").otherwise("optimised")

    wanted = F.col("tiers")[0]["fields"]
    carried = F.when(F.col("all_unchanged").isNull(), rights.fields_of(F.col("own"))).otherwise(F.col("any_carried"))
    missing = F.when(F.col("all_unchanged").isNull() | (F.col("least_carried") < F.size(wanted)), F.array_except(wanted, F.when(F.col("least_carried") == 0, F.array().cast("array<string>")).otherwise(carried)))
    raster, warned = F.col("format") != "svg", F.array_compact
    lines = warned(F.array(
        F.when(raster & ~is_scorable(F.col("width"), F.col("height")), _warning("W_TOO_SMALL_TO_SCORE", "the image is too small to be scored, so only lossless outputs were tried")),
        F.when(raster & is_scorable(F.col("width"), F.col("height")) & is_downscaled(F.col("width"), F.col("height")), _warning("W_SCORED_DOWNSCALED", "the image was scored at a smaller size")),
        F.when(~raster & F.lit(settings.mode != "same"), _warning("W_SVG_SAME_ONLY", "an SVG stays an SVG")),
        F.when(raster & F.lit(settings.mode not in ("same", "suite")) & (F.col("chosen_format") != settings.mode), _warning("W_NOT_CONVERTED", "nothing in the format asked for was smaller than the input")),
        F.when(raster & (F.col("least_score") < settings.target), _warning("W_TARGET_NOT_REACHED", F.concat(F.lit("the best score is "), F.format_string("%.1f", "least_score")))),
        F.when(F.col("all_unchanged").isNull() & F.col("was_resized"), _warning("W_NOT_RESIZED", F.concat(F.lit("nothing "), F.col("shown_width").cast("string"), F.lit(" pixels wide was smaller than the input")))),
        F.when(raster & (F.size(missing) > 0), _warning("W_RIGHTS_NOT_ADDED", F.concat(F.lit("left out for size or because the file is kept: "), listed(missing)))),
        F.when(raster & (F.coalesce(F.size(missing), F.lit(0)) <= 0) & F.lit(not settings.strip_all) & ~F.arrays_overlap(wanted, F.array(*map(F.lit, LICENCE_FIELDS))), _warning("W_NO_RIGHTS", "the image names no creator, credit, copyright or licence")),
        F.when(raster & (F.col("least_score") < NOTICEABLE_BELOW), _warning("W_NOTICEABLE", F.concat(F.lit("an output scores "), F.format_string("%.1f", "least_score"), F.lit(", so its loss may show")))),
        F.when(raster & F.col("keeps_profile") & (F.col("all_unchanged").isNull() | F.col("any_strip")), _warning("W_ICC_KEPT", "the colour profile is not sRGB and was kept")),
    ))
    exists = F.array(_warning("W_OUTPUT_EXISTS", F.concat(where, F.lit(" is there already"))))
    none = F.array().cast("array<struct<code:string,message:string>>")
    decided = chosen.select("file", "path", "format", "bytes", status.alias("status"), error.alias("error"), F.when(status == "skipped", exists).when(status == "failed", none).otherwise(lines).alias("warnings"))
    decided = written(decided, "run-decided")

    data = outputs.select("file", "tier", "ord", F.col("format").alias("kind"), "method", F.col("bytes").alias("output_bytes"), "score", "carried", F.col("path").alias("output"), "unchanged", "is_input")
    result = decided.join(data.join(decided.where("status = 'optimised'").select("file"), "file", "left_semi"), "file", "left")
    if write:
        to_write = result.where("status = 'optimised' AND NOT (unchanged AND is_input)").select("file", "tier", "ord", "output")
        done = written(sinks.write_staged(to_write.join(made.select("file", "tier", "ord", "content"), ["file", "tier", "ord"]).select("file", F.col("output").alias("path"), "content")), "run-written")
        result = result.join(done.select("file", F.col("error").alias("unwritten")), "file", "left").withColumn("status", F.when(F.col("unwritten").isNotNull(), "failed").otherwise(F.col("status"))).withColumn("error", F.coalesce("error", "unwritten"))
    return result.select("path", "status", "format", "method", "bytes", "output_bytes", "score", "output", "carried", "warnings", "error")
