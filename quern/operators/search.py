"""The quality search: the highest quality, then halving for the lowest that passes, then the one above it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phases of a search, as numbers in the fold's state.
HIGHEST, NARROW, ABOVE, DONE = 0, 1, 2, 3


def search_path(lowest: int, highest: int, score_at: Callable[[Column], Column], target: Column | float) -> Column:
    """array<struct<quality, score, passed>> of the qualities that a search tries in [lowest, highest], in order.

    score_at gives the score of a quality from the row's columns. The fold has as many steps as any search of the range.
    """
    steps = 3 + math.ceil(math.log2(max(2, highest - lowest + 1)))
    target = target if isinstance(target, Column) else F.lit(target)
    state = lambda phase, low, high, tried: F.struct(phase.cast("int").alias("phase"), low.cast("int").alias("low"), high.cast("int").alias("high"), tried.alias("tried"))
    tried_type = "array<struct<quality:int,score:double,passed:boolean>>"

    def step(acc: Column, _: Column) -> Column:
        quality = F.when(acc["phase"] == HIGHEST, F.lit(highest)).when(acc["phase"] == NARROW, F.floor((acc["low"] + acc["high"]) / 2)).otherwise(acc["high"] + 1).cast("int")
        score = score_at(quality).cast("double")
        passed = score >= target
        tried = F.array_append(acc["tried"], F.struct(quality.alias("quality"), score.alias("score"), passed.alias("passed")))
        first = acc["phase"] == HIGHEST
        low = F.when(first, F.lit(lowest)).when(passed, acc["low"]).otherwise(quality + 1)
        high = F.when(first, F.lit(highest)).when(passed, quality).otherwise(acc["high"])
        phase = F.when(acc["phase"] == ABOVE, F.lit(DONE)).when(first & ~passed, F.lit(DONE)).when(low < high, F.lit(NARROW)).when(high < highest, F.lit(ABOVE)).otherwise(F.lit(DONE))
        return F.when(acc["phase"] == DONE, acc).otherwise(state(phase, low, high, tried))

    start = state(F.lit(HIGHEST), F.lit(lowest), F.lit(highest), F.array().cast(tried_type))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["tried"])


def search_qualities(encode: Callable[[int], tuple[bytes, float]], lowest: int, highest: int, target: float) -> tuple[dict, list[dict]]:
    """The same search with a live encoder, for use in mapInPandas: (chosen attempt, attempts in order)."""
    tried: dict[int, dict] = {}

    def passes(quality: int) -> bool:
        if quality not in tried:
            data, score = encode(quality)
            tried[quality] = {"quality": quality, "data": data, "bytes": len(data), "score": score, "passed": score >= target}
        return tried[quality]["passed"]

    low, high = lowest, highest
    if passes(highest):
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if passes(middle) else (middle + 1, high)
        if high < highest:
            passes(high + 1)
    passed = [a for a in tried.values() if a["passed"]]
    best = min(passed, key=lambda a: (a["bytes"], a["quality"])) if passed else min(tried.values(), key=lambda a: (-a["score"], a["bytes"], a["quality"]))
    return best, list(tried.values())
