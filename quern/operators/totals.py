"""Totals and report rows of a run's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import format_bytes, format_percent
from quern.shared import written


def run_totals(files: DataFrame) -> DataFrame:
    """files (status, bytes, output_bytes array) to one row of counts, bytes of the files that ran, and their saving."""
    ran = F.col("status").isin("optimised", "kept-original")
    least = F.least(F.col("bytes"), F.array_min("output_bytes"))  # least() skips nulls: without outputs the input counts
    count = lambda s: F.count_if(F.col("status") == s)
    sums = files.agg(
        F.count("*").alias("files"), count("optimised").alias("optimised"), count("kept-original").alias("kept_original"), count("skipped").alias("skipped"), count("failed").alias("failed"),
        F.coalesce(F.sum(F.when(ran, F.col("bytes"))), F.lit(0)).alias("input_bytes"), F.coalesce(F.sum(F.when(ran, least)), F.lit(0)).alias("output_bytes"),
    )
    return sums.withColumn("saving", F.when(F.col("input_bytes") == 0, 0.0).otherwise(1 - F.col("output_bytes") / F.col("input_bytes")))


def totals_line(totals: DataFrame) -> DataFrame:
    """One sentence of a row of run_totals()."""
    part = lambda c, label: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {label}")))
    parts = F.concat_ws(", ", part("optimised", "optimised"), part("kept_original", "kept original"), part("skipped", "skipped"), part("failed", "failed"))
    saved = F.when(F.col("input_bytes") == 0, "").otherwise(F.concat(F.lit(" "), format_bytes(F.col("input_bytes")), F.lit(" -> "), format_bytes(F.col("output_bytes")), F.lit(", "), format_percent(F.col("saving")), F.lit(" smaller.")))
    return totals.select(F.concat(F.col("files").cast("string"), F.when(F.col("files") == 1, " file: ").otherwise(" files: "), parts, F.lit("."), saved).alias("line"))


def report_rows(outputs: DataFrame) -> DataFrame:
    """outputs (file, name, ord, …) with the file's name on its first row alone and the width of the name column."""
    order = Window.partitionBy("file").orderBy("ord")
    width = outputs.agg(F.max(F.length("name")).alias("width"))  # one row
    return outputs.withColumn("shown", F.when(F.row_number().over(order) == 1, F.col("name")).otherwise("")).join(F.broadcast(width)).withColumn("cell", F.rpad("shown", F.col("width"), F.lit(" "))).drop("shown")


def report_lines(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with line: the columns as text, two spaces apart, each as wide as its longest value; columns gives "left" or "right" by name. Nulls are empty; blanks at a line's end go."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    widths = rows.agg(*[F.coalesce(F.max(F.length(t)), F.lit(0)).alias(f"__{c}") for c, t in text.items()])  # one row
    pad = {"left": F.rpad, "right": F.lpad}
    cells = [pad[side](text[c], F.col(f"__{c}"), F.lit(" ")) for c, side in columns.items()]
    return rows.join(F.broadcast(widths)).withColumn("line", F.rtrim(F.concat_ws("  ", *cells))).drop(*[f"__{c}" for c in columns])


def without_code(warnings: Column, code: str) -> Column:
    """Warnings (an array of struct(code, message)) but those of one code, which a summary tells of."""
    return F.filter(warnings, lambda w: w["code"] != code)


def notes(warnings: Column, hints: dict[str, str]) -> Column:
    """A line for each warning, after two blanks, with a hint where its code has one; repeats once."""
    hint = lambda w: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in hints.items() for x in pair]), w["code"]), F.lit("")) if hints else F.lit("")
    return F.array_join(F.transform(F.array_distinct(warnings), lambda w: F.concat(F.lit("  "), w["message"], F.when(hint(w) != "", F.concat(F.lit(" ("), hint(w), F.lit(")"))).otherwise(F.lit("")))), "\n")


def warnings_by_code(files: DataFrame) -> DataFrame:
    """files (file, warnings array of struct(code, message)) to (code, files, warnings): repeats within a file count once."""
    each = files.select("file", F.explode(F.array_distinct("warnings")).alias("w"))
    return each.groupBy(F.col("w.code").alias("code")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("warnings"))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank, from 0 on in the order: ranges are sorted and numbered apart, and moved by the counts of those before.

    The numbered ranges are written, as a second reading of the same plan could draw other bounds. Ties stand in any order.
    """
    # an id holds the number of a row's range above its place there
    ranges = written(rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__id", 33).alias("__range")
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.groupBy(part).agg(F.count("*").alias("n")).select("__range", before.alias("__before"))  # a row for each range
    placed = ranges.select("*", part, F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("rank")).join(F.broadcast(offsets), "__range")
    return placed.withColumn("rank", F.col("rank") + F.col("__before")).drop("__range", "__before", "__id")
