"""Connected components of a large graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import ensure_checkpoints, looked_up


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = looked_up(both.where("v > u"), least, ["u"], F.hash("v"), "inner", 2 * count)
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    kept = looked_up(down, least, ["u"], F.hash("v"), "inner", count).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs to (node, root): root is the smallest node that a node of any edge can reach.

    Only edges move, never a group: each round groups by node for a minimum, which a hub's edges meet in many tasks. Loops and nulls are ignored; no edges give no rows.
    Each round brings nodes nearer to their root, until none moves.
    """
    ensure_checkpoints(edges.sparkSession)
    now = edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct().checkpoint()
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0]:
        now = _small_star(_large_star(now, before[0]), 2 * before[0]).checkpoint()
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
