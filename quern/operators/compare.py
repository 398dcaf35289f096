"""Pairs of files compared, references resolved, and lists of results brought up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import format_bytes, format_percent, half_up, verdict
from quern.operators.geometry import is_scorable
from quern.operators.totals import ranked
from quern.shared import spread, written
from quern.schemas import ROLES


def compared(pairs: DataFrame) -> DataFrame:
    """pairs (pair, a_bytes, a_width, a_height, b_bytes, b_width, b_height, same, score) with verdict, saving and error.

    What is known stays where a check fails: sizes that differ are E_DIMENSIONS_MISMATCH, pixels that differ but are too few
    to score E_TOO_SMALL_TO_SCORE; identical pixels score 100.
    """
    error = F.when(F.col("a_width").isNull() | F.col("b_width").isNull(), "E_READ").when((F.col("a_width") != F.col("b_width")) | (F.col("a_height") != F.col("b_height")), "E_DIMENSIONS_MISMATCH")
    error = error.when(~F.col("same") & ~is_scorable(F.col("a_width"), F.col("a_height")), "E_TOO_SMALL_TO_SCORE")
    score = F.when(error.isNull(), F.when(F.col("same"), 100.0).otherwise(F.least(F.lit(100.0), F.col("score"))))
    saving = F.when(F.col("a_bytes") > 0, 1 - F.col("b_bytes") / F.col("a_bytes"))
    return pairs.select("pair", error.alias("error"), score.alias("score"), F.when(score.isNotNull(), verdict(score)).alias("verdict"), saving.alias("saving"))


def compare_report(a_bytes: Column, b_bytes: Column, score: Column) -> Column:
    """A line for the score and its verdict and one for the sizes; what is unknown has none."""
    saving = 1 - b_bytes / a_bytes
    change = F.when(saving < 0, F.concat(format_percent(-saving), F.lit(" larger"))).otherwise(F.concat(format_percent(saving), F.lit(" smaller")))
    scored = F.concat(F.lit("Score  "), F.format_string("%.1f", half_up(score, 1)), F.lit(", "), verdict(score))
    return F.concat_ws("\n", F.when(score.isNotNull(), scored), F.concat(F.lit("Size   "), format_bytes(a_bytes), F.lit(" -> "), format_bytes(b_bytes), F.lit(", "), change))


def resolved(refs: DataFrame, opened: DataFrame) -> DataFrame:
    """refs (idx, ref) with the paths of opened (ref, path); refs that are not open are rows with E_READ."""
    return refs.join(opened, "ref", "left").select("idx", "ref", "path", F.when(F.col("path").isNull(), "E_READ").alias("error"))


def opened_files(files: DataFrame) -> DataFrame:
    """files (idx, path) with refs file/<n>/<name>, numbered in order of first appearance; a path that repeats keeps its ref.

    n is the rank of a path's first idx, whatever the number of files.
    """
    numbered = ranked(files.groupBy("path").agg(F.min("idx").alias("first")), F.col("first"), F.col("path"))
    ref = F.concat_ws("/", F.lit("file"), (F.col("rank") + 1).cast("string"), F.substring_index("path", "/", -1))
    # files of short rows look small to the planner, which would send them through the driver
    return files.join(numbered.select("path", ref.alias("ref")).hint("merge"), "path").select("idx", "path", "ref")


def relabelled(message: Column, refs: dict[str, str]) -> Column:
    """A message with paths replaced by their refs, the longest path first."""
    for path in sorted(refs, key=lambda p: (-len(p), p)):
        message = F.replace(message, F.lit(path), F.lit(refs[path]))
    return message


#: Messages whose pieces one task makes.
_TASK_MESSAGES = 50_000


def relabelled_by(messages: DataFrame, refs: DataFrame) -> DataFrame:
    """messages (id, message) with the paths of refs (path, ref) in them replaced by their refs, in one pass: from left to right, at each place the longest path.

    Every piece of a message that begins as some path does and is as long as one meets the table of paths, so that the number
    of paths costs a join alone. Only the paths' lengths and first characters reach the driver; pieces, dozens for each message
    that the planner does not count, are merged with the paths and never broadcast. A path that repeats has its
    smallest ref; empty and null paths are none. Ids may repeat; null messages stay.
    """
    paths = refs.where("path <> ''").groupBy("path").agg(F.min("ref").alias("__ref"))
    facts = paths.agg(F.collect_set(F.length("path")).alias("lengths"), F.collect_set(F.substring("path", 1, 1)).alias("heads")).first()
    if not facts["lengths"]:
        return messages
    each = written(messages.withColumn("__row", F.monotonically_increasing_id()), "messages")  # rows keep their numbers
    each = spread(each, each.count(), "__row", task_rows=_TASK_MESSAGES)
    heads, lengths = (F.array(*[F.lit(x) for x in sorted(facts[c])]) for c in ("heads", "lengths"))
    size = F.length("message")
    begins = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda p: F.array_contains(heads, F.substr("message", p, F.lit(1))))
    pieces = each.select("__row", "message", F.explode(begins).alias("p")).select("__row", "message", "p", F.explode(lengths).alias("n")).where(F.col("p") + F.col("n") <= F.length("message") + 1)
    hits = pieces.select("__row", "p", "n", F.substr("message", F.col("p"), F.col("n")).alias("path")).join(paths.hint("merge"), "path")
    # of each place the longest; no more than a message has characters
    longest = hits.groupBy("__row", "p").agg(F.max_by(F.struct("n", "__ref"), "n").alias("h")).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("p", "h.n", "h.__ref"))).alias("hits"))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, hit: Column) -> Column:
        before = F.substr("message", acc["at"], hit["p"] - acc["at"])
        return F.when(hit["p"] < acc["at"], acc).otherwise(F.struct((hit["p"] + hit["n"]).alias("at"), F.concat(acc["out"], before, hit["__ref"]).alias("out")))

    done = F.aggregate("hits", start, step, lambda acc: F.concat(acc["out"], F.substr("message", acc["at"], F.length("message"))))
    out = each.join(longest.hint("merge"), "__row", "left").withColumn("message", F.when(F.col("hits").isNull(), F.col("message")).otherwise(done))
    return out.select(*[F.col(f"`{c}`") for c in messages.columns])


def upserted(known: DataFrame, new: DataFrame) -> DataFrame:
    """known and new (ref, version, state) with each ref's row of the larger version; new ones win ties."""
    both = known.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    best = both.groupBy("ref").agg(F.max(F.struct("version", "__new", "state")).alias("best"))
    return best.select("ref", F.col("best.version").alias("version"), F.col("best.state").alias("state"))


def rewritten(results: DataFrame, outputs: DataFrame) -> DataFrame:
    """results (file, outputs array) with those of outputs (file, pos, bytes) in place of what stands there."""
    each = results.select("file", F.posexplode_outer("outputs").alias("pos", "old"))
    new = each.join(outputs, ["file", "pos"], "left").select("file", "pos", F.coalesce("bytes", "old").alias("bytes"))
    merged = new.groupBy("file").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "bytes")))).alias("o"))
    return merged.select("file", F.transform("o", lambda x: x["bytes"]).alias("outputs"))


def recent(used: DataFrame, keep: int = 3) -> DataFrame:
    """The `keep` caches (key, used) that were used last."""
    return used.groupBy("key").agg(F.max("used").alias("used")).orderBy(F.col("used").desc(), "key").limit(keep)


def fitted_zoom(width: Column, height: Column, view_width: Column, view_height: Column) -> Column:
    """The zoom at which an image fits its view, also above one."""
    return F.least(view_width / width, view_height / height)


def clamped_centre(centre: Column, size: Column, view: Column, zoom: Column) -> Column:
    """A centre along one axis (0 to size) from which the view shows no empty edge; the middle where all fits."""
    half = view / zoom / 2
    return F.when(size * zoom <= view, size / 2).otherwise(F.greatest(half, F.least(size - half, centre)))


def zoomed_about(centre: Column, point: Column, zoom: Column, new_zoom: Column) -> Column:
    """The centre after a zoom that keeps a point of the image where it is on the screen."""
    return point + (centre - point) * zoom / new_zoom


def capped_width(widths: Column, width: Column) -> Column:
    """The narrowest of a file's outputs where a run made it narrower than the original, else null."""
    narrowest = F.array_min(widths)
    return F.when(narrowest < width, narrowest)


def is_comparable(outputs: Column, width: Column, height: Column) -> Column:
    """Whether a result has outputs and a known size."""
    return (F.coalesce(F.size(outputs), F.lit(0)) > 0) & width.isNotNull() & height.isNotNull()


def in_view_order(outputs: Column) -> Column:
    """Outputs (structs with role) as a viewer shows them: by the order of ROLES, ties as they were; other roles first."""
    numbered = F.transform(outputs, lambda x, i: F.struct(F.array_position(F.array(*[F.lit(r) for r in ROLES]), x["role"]).alias("at"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(numbered), lambda x: x["x"])


def title(role: Column, kind: Column) -> Column:
    """An output's name by its format; a fallback is called so."""
    name = F.when(kind == "webp", "WebP").otherwise(F.upper(kind))
    return F.when(role == "fallback", F.concat(name, F.lit(" fallback"))).otherwise(name)


def pane_notes(panes: DataFrame) -> DataFrame:
    """panes (file, role, title, bytes, saving) with kept and note: what a suite keeps and why it leaves the others out.

    A pane that is empty (null bytes) or larger than its original is not kept. Each other one is if it is smaller than all
    before it, the fallback first; its note names the last kept before it. Panes larger than the original have no note.
    """
    place = F.when(F.col("role") == "fallback", 0).when(F.col("role") == "webp", 1).otherwise(2)
    fits = F.col("bytes").isNotNull() & (F.col("saving") >= 0)
    sized = panes.withColumn("__at", place).withColumn("__bytes", F.when(fits, F.col("bytes")))
    before = Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    least = F.min("__bytes").over(before)
    chained = sized.withColumn("kept", F.coalesce(F.col("__bytes") < least, F.col("__bytes").isNotNull()))
    last = F.last(F.when(F.col("kept"), F.col("title")), ignorenulls=True).over(before)
    told = ~F.col("kept") & (F.col("bytes").isNull() | (F.col("saving") >= 0))
    note = F.when(told, F.concat(F.lit("Not in the suite"), F.coalesce(F.concat(F.lit(": no smaller than the "), last), F.lit(""))))
    return chained.withColumn("note", note).drop("__at", "__bytes")


def refused(output_bytes: Column, input_bytes: Column) -> Column:
    """The error of an output that may not be saved, as it is larger than its original; null if it may."""
    return F.when(output_bytes > input_bytes, "E_LARGER_THAN_ORIGINAL")


def requests_made(requests: DataFrame) -> DataFrame:
    """requests (key, ts, seq, ok) with made: a key is asked for again only while all its requests before have failed."""
    earlier = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("made", F.count_if("ok").over(earlier) == 0)
