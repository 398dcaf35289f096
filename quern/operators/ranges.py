"""Half-open byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.shared import spread


def merged_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end) with ranges that overlap or touch as one: a range starts an island where it is past all before it, one without an end after those of its start."""
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    starts = ranges.withColumn("__new", F.when(F.col("start") <= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    island = starts.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def moved_offsets(offsets: DataFrame, cuts: DataFrame, by: list[str], rows: int | None = None) -> DataFrame:
    """offsets (by, offset) with moved: the offset less all cuts that end at or before it. Cuts without keys are nobody's.

    Both are ordered as one stream and a running sum counts what was cut, in place of a join on a range. rows: about how many
    there are of both, for as many tasks as they ask for.
    """
    ends = cuts.dropna(subset=by).select(*by, F.col("end").alias("at"), (F.col("end") - F.col("start")).alias("cut"), F.lit(False).alias("__asked"))
    stream = ends.unionByName(offsets.select(*by, F.col("offset").alias("at"), F.lit(0).cast("long").alias("cut"), F.lit(True).alias("__asked")))
    if rows is not None:
        stream = spread(stream, rows, *by)
    order = Window.partitionBy(*by).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    return stream.withColumn("gone", F.sum("cut").over(order)).where("__asked").select(*by, F.col("at").alias("offset"), (F.col("at") - F.col("gone")).alias("moved"))
