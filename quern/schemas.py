"""Names, orders and limits that plans share."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the result contract, in the order that breaks ties and sorts reports.
FORMATS = ("png", "jpeg", "webp", "avif", "svg")
EXTENSIONS = {"avif": "avif", "jpg": "jpeg", "jpeg": "jpeg", "png": "png", "svg": "svg", "webp": "webp"}
EXTENSION_OF = {"avif": "avif", "jpeg": "jpg", "png": "png", "svg": "svg", "webp": "webp"}
ROLES = ("avif", "webp", "fallback")
STATUSES = ("optimised", "kept-original", "skipped", "failed")
RIGHTS_FIELDS = ("creator", "credit", "copyright", "webStatement", "licensorUrl", "digitalSourceType")
TARGETS = {"visually-lossless": 90, "excellent": 85, "high": 80, "web": 70}
VERDICTS = ((90, "visually-lossless"), (85, "excellent"), (80, "very-high"), (70, "high"), (50, "noticeable"))
LOWEST_VERDICT = "obvious"
QUALITIES = {"webp": (30, 95), "avif": (20, 90), "jpeg": (40, 95), "png": (1, 100)}
MOST_SIDE = {"webp": 16383, "avif": 16384, "jpeg": 65500}
LEAST_SCORED_SIDE, MOST_SCORED_PIXELS = 8, 26_000_000
SNIFFED_BYTES = 16 * 1024
DEFAULT_TARGET = 70
SVG_TARGET, SVG_PRECISIONS = 90, (2, 3, 4, 5)
DIFF_AMPLIFICATION, DIFF_DIM = 8, 0.5

WARNING = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType())])
CANDIDATE = T.StructType(
    [
        T.StructField("file", T.LongType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("format", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("score", T.IntegerType()),
    ]
)
EVENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("input", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
