"""Sizes and pixels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.schemas import DIFF_AMPLIFICATION, DIFF_DIM, LEAST_SCORED_SIDE, MOST_SCORED_PIXELS, MOST_SIDE


def fits_format(width: Column, height: Column, kind: Column) -> Column:
    most = F.lit(None).cast("int")
    for name, side in MOST_SIDE.items():
        most = F.when(kind == name, side).otherwise(most)
    return most.isNull() | ((width <= most) & (height <= most))


def is_scorable(width: Column, height: Column) -> Column:
    return (width >= LEAST_SCORED_SIDE) & (height >= LEAST_SCORED_SIDE)


def is_downscaled(width: Column, height: Column) -> Column:
    return width.cast("long") * height > MOST_SCORED_PIXELS


def source_warning(width: Column, height: Column) -> Column:
    """The code that tells how a source's candidates are scored, if not at full size."""
    return F.when(~is_scorable(width, height), "W_TOO_SMALL_TO_SCORE").when(is_downscaled(width, height), "W_SCORED_DOWNSCALED")


def fitted_height(width: Column, height: Column, cap: Column) -> Column:
    """The height at a width of at most cap, rounded half up, one at least."""
    return F.when(width <= cap, height).otherwise(F.greatest(F.lit(1), F.floor(height * cap / width + 0.5))).cast("long")


def scored_side(side: Column, width: Column, height: Column) -> Column:
    """A side of an image that is scored at MOST_SCORED_PIXELS at most."""
    pixels = width.cast("long") * height
    return F.when(pixels <= MOST_SCORED_PIXELS, side).otherwise(F.greatest(F.lit(LEAST_SCORED_SIDE), F.floor(side * F.sqrt(F.lit(float(MOST_SCORED_PIXELS)) / pixels)))).cast("long")


def render_densities(width: Column, height: Column) -> Column:
    """Scales that a drawing is rendered at: one that makes its smaller side 64 at least, and its double, within MOST_SCORED_PIXELS."""
    most = F.sqrt(F.lit(float(MOST_SCORED_PIXELS)) / (width.cast("double") * height))
    base = F.greatest(F.lit(1.0), F.lit(64.0) / F.least(width, height))
    return F.array_distinct(F.array(F.least(base, most), F.least(base * 2, most)))


def flattened(value: Column, alpha: Column, background: Column) -> Column:
    """A channel over a background, rounded half up."""
    return F.floor((value * alpha + background * (255 - alpha)) / 255 + 0.5).cast("long")


def luma(red: Column, green: Column, blue: Column) -> Column:
    return red * 0.2126 + green * 0.7152 + blue * 0.0722


def heat(difference: Column) -> Column:
    return F.least(F.lit(1.0), difference * DIFF_AMPLIFICATION / 255)


def heat_colour(grey_luma: Column, hot: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a pixel of the difference map."""
    grey = grey_luma * DIFF_DIM * (1 - hot)
    return grey + hot * 255, grey + hot * hot * 255, grey
