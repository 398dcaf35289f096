"""Choosing candidates: the first row of each group, where a task's later rows are left out before a shuffle.

Candidates have file, ord (their place in the list, which breaks ties), bytes and score; other columns go with the pick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(candidates: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group; Spark leaves all but the first of a task's rows out before it shuffles them."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return candidates.withColumn("__no", number).where("__no = 1").drop("__no")


def pick(candidates: DataFrame, by: list[str], target: Column | float, below: Column | None = None, allow_below_target: bool = False) -> DataFrame:
    """Per group the smallest candidate under `below` that reaches the target; else, if allowed, the highest score, then the smallest.

    Groups without a pick give no row.
    """
    target = target if isinstance(target, Column) else F.lit(target)
    fits = F.col("bytes") < below if below is not None else F.lit(True)
    missed = F.coalesce(F.col("score") < target, F.lit(True))
    kept = candidates.where(fits & (F.lit(allow_below_target) | ~missed))
    return _first(kept, by, missed, F.when(missed, -F.col("score")), "bytes", "ord")


def carrying(candidates: DataFrame, tiers: DataFrame, on: list[str]) -> DataFrame:
    """Each candidate with each tier of its group: packet bytes are added, and candidates that cannot hold one are left out.

    tiers has tier (0 first) and packet (bytes, null for none), and `fits` (false where the format cannot hold it) if there.
    """
    joined = candidates.join(tiers, on)
    if "fits" in tiers.columns:
        joined = joined.where(F.col("fits") | F.col("packet").isNull()).drop("fits")
    return joined.withColumn("bytes", F.col("bytes") + F.coalesce("packet", F.lit(0))).drop("packet")


def pick_by_tier(candidates: DataFrame, by: list[str], target: Column | float, below: Column | None = None, allow_below_target: bool = False) -> DataFrame:
    """pick() within the first tier that has one."""
    return _first(pick(candidates, [*by, "tier"], target, below, allow_below_target), by, "tier")


def select_single(candidates: DataFrame, by: list[str], target: Column | float, below: Column, converting: Column) -> DataFrame:
    """One output per group: in each tier the candidates, then the fallbacks, before the next tier.

    candidates has is_fallback; a conversion's own candidates may miss the target, its fallbacks may not, and others have none.
    """
    target = target if isinstance(target, Column) else F.lit(target)
    passing, fallback = F.col("score") >= target, F.col("is_fallback")
    phase = F.when(passing & ~fallback, 0).when(~fallback & converting, 1).when(passing & fallback & converting, 2)
    kept = candidates.where((F.col("bytes") < below) & phase.isNotNull())
    return _first(kept, by, "tier", phase, F.when(phase == 1, -F.col("score")), "bytes", "ord")


def kept_by_chain(sized: DataFrame, by: list[str], order: str, size: str = "bytes") -> DataFrame:
    """sized with `kept`: whether a size is smaller than every earlier kept one. Nulls never are.

    What is kept are the strict minima of the prefixes, so a running minimum over all earlier rows decides.
    """
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(size).over(earlier)
    return sized.withColumn("kept", F.coalesce(F.col(size) < least, F.col(size).isNotNull()))


def select_suite(candidates: DataFrame, by: list[str], target: Column | float, input_bytes: Column, resized: Column) -> DataFrame:
    """Per group the best of each role (fallback, webp, avif), less those that the chain drops.

    All are under the input's size; a fallback of an input that was not resized may equal it.
    """
    bound = input_bytes + F.when((F.col("role") == "fallback") & ~resized, 1).otherwise(0)
    bests = pick_by_tier(candidates, [*by, "role"], target, bound)
    order = F.when(F.col("role") == "fallback", 0).when(F.col("role") == "webp", 1).otherwise(2)
    return kept_by_chain(bests.withColumn("role_ord", order), by, "role_ord").where("kept").drop("kept")


def select_format(candidates: DataFrame, by: list[str], target: Column | float, below: Column) -> DataFrame:
    """pick_by_tier() under the bound, or else under none with misses allowed."""
    strict = pick_by_tier(candidates, by, target, below).withColumn("__r", F.lit(0))
    loose = pick_by_tier(candidates, by, target, None, True).withColumn("__r", F.lit(1))
    return _first(strict.unionByName(loose), by, "__r").drop("__r")


def chosen_attempt(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Per group of attempts (quality, bytes, score, passed): the smallest that passed, then the lowest quality; else the best score, then the smallest."""
    key = F.when(F.col("passed"), F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("k"), "bytes", "quality", "score")).otherwise(F.struct(F.lit(1).alias("p"), (-F.col("score")).cast("double").alias("k"), "bytes", "quality", "score"))
    best = attempts.groupBy(*by).agg(F.min(key).alias("best"))
    return best.select(*by, F.col("best.quality").alias("quality"), F.col("best.bytes").alias("bytes"), F.col("best.score").alias("score"), (F.col("best.p") == 0).alias("reached"))


def lowest_renders(renders: DataFrame, passing: float = 90.0) -> DataFrame:
    """renders (file, decimals, render, score, bytes) to (file, decimals, score, bytes): the lowest score of the renders in order, up to the
    first that does not pass; -inf where that one failed (its score is null).
    """
    failing = F.col("score").isNull() | (F.col("score") < passing)
    # all before the first that does not pass are above it, so that it is the lowest
    first = F.min_by(F.coalesce("score", F.lit(float("-inf"))), F.when(failing, F.col("render")))
    return renders.groupBy("file", "decimals").agg(F.coalesce(first, F.min("score")).cast("double").alias("score"), F.min("bytes").alias("bytes"))


def fewest_decimals(lowest: DataFrame, passing: float = 90.0) -> DataFrame:
    """(file, decimals, score, bytes) to the row of each file with the fewest decimals that passes."""
    return _first(lowest.where(F.col("score") >= passing), ["file"], "decimals")


def svg_choice(optimised: Column, stripped: Column, own: Column) -> Column:
    """optimised if it is smaller than the file, else strip if that is, else none; null sizes are not there."""
    return F.when(optimised < own, "optimised").when(stripped < own, "strip").otherwise("none")
