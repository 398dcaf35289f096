"""Formatting and text columns, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.schemas import LOWEST_VERDICT, TARGETS, VERDICTS

# The characters that XML cannot hold, and white space at a value's edges.
NOT_XML = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]"
EDGES = "^[\\s\\x{FEFF}\\x{A0}]+|[\\s\\x{FEFF}\\x{A0}]+$"


def verdict(score: Column) -> Column:
    """The band of a score; each band's lower edge belongs to it."""
    (edge, name), *rest = VERDICTS
    out = F.when(score >= edge, name)
    for edge, name in rest:
        out = out.when(score >= edge, name)
    return out.otherwise(LOWEST_VERDICT)


def rating(name: Column) -> Column:
    return F.when(name == "high", "fair").when(name.isin("noticeable", LOWEST_VERDICT), "bad").otherwise("good")


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounds to digits, halves up, also below zero."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


def format_bytes(size: Column) -> Column:
    """Bytes below 1000, else kB, MB or GB in three significant digits; 999.5 of a unit is one of the next."""
    size = size.cast("double")
    digits = lambda v: F.when(v >= 99.95, F.format_string("%.0f", half_up(v))).when(v >= 9.995, F.format_string("%.1f", half_up(v, 1))).otherwise(F.format_string("%.2f", half_up(v, 2)))
    out = F.when(size < 1000, F.concat(size.cast("long").cast("string"), F.lit(" B")))
    for unit, scale in (("kB", 1e3), ("MB", 1e6)):
        out = out.when(size / scale < 999.5, F.concat(digits(size / scale), F.lit(f" {unit}")))
    return out.otherwise(F.concat(digits(size / 1e9), F.lit(" GB")))


def format_percent(share: Column) -> Column:
    return F.format_string("%.1f%%", half_up(share * 100, 1))


def format_quality(method: Column, quality: Column) -> Column:
    """The method alone, q and the quality for lossy, else both."""
    return F.when(quality.isNull(), method).when(method == "lossy", F.concat(F.lit("q"), quality.cast("string"))).otherwise(F.concat_ws(" ", method, quality.cast("string")))


def counted(count: Column, noun: str) -> Column:
    """A count with its noun."""
    return F.concat_ws(" ", count.cast("string"), F.when(count == 1, noun).otherwise(f"{noun}s"))


def is_web_url(value: Column) -> Column:
    """An absolute http or https address with a host."""
    return F.coalesce(value.rlike("^(?i:https?)://[^/?#\\s]"), F.lit(False))


def rights_error(name: Column, value: Column) -> Column:
    """What is wrong with a rights option, or null; a null value is empty."""
    trimmed = F.regexp_replace(F.coalesce(value, F.lit("")), EDGES, "")
    wants_url = name.isin("webStatement", "licensorUrl", "digitalSourceType")
    return F.when(trimmed == "", F.concat(name, F.lit(" is empty"))).when(wants_url & ~is_web_url(trimmed), F.concat(name, F.lit(" is not an http or https address")))


def parsed_target(value: Column) -> Column:
    """A preset's number, or a number from 0 to 100; null for any other text."""
    out = F.when(value.rlike("^[0-9]+(\\.[0-9]+)?$"), value.try_cast("double"))
    for name, number in TARGETS.items():
        out = F.when(value == name, float(number)).otherwise(out)
    return F.when(out <= 100, out)


def wrapped(text: Column, prefix: str = "  ", width: int = 80) -> Column:
    """Text with a line's words in `width` characters as far as they fit, the prefix first and its width in blanks on later lines."""
    blanks = " " * len(prefix)
    words = F.split(text, " ", -1)
    fits = lambda acc, w: (acc["line"] == "") | (F.length(acc["line"]) + F.length(w) + 1 + len(prefix) <= width)

    def step(acc, w):
        joined = F.struct(acc["done"].alias("done"), F.when(acc["line"] == "", w).otherwise(F.concat_ws(" ", acc["line"], w)).alias("line"))
        broken = F.struct(F.concat(acc["done"], acc["line"], F.lit(f"\n{blanks}")).alias("done"), w.alias("line"))
        return F.when(fits(acc, w), joined).otherwise(broken)

    start = F.struct(F.lit(prefix).alias("done"), F.get(words, F.lit(0)).alias("line"))
    return F.aggregate(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), start, step, lambda acc: F.concat(acc["done"], acc["line"]))


def painted(text: Column, rate: Column) -> Column:
    """Text in a terminal's colour for a rating: green, yellow or red."""
    code = F.when(rate == "good", "32").when(rate == "fair", "33").otherwise("31")
    return F.concat(F.lit("\x1b["), code, F.lit("m"), text, F.lit("\x1b[39m"))


def listed(items: Column) -> Column:
    """Items as "a, b and c"; null for none."""
    n = F.size(items)
    return F.when(n == 1, F.get(items, F.lit(0))).when(n > 1, F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(items, n - 1)))


def trimmed(value: Column) -> Column:
    """The value without characters that XML cannot hold and without white space at its edges; empty is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(value, NOT_XML, ""), EDGES, ""), F.lit(""))


def escape_xml(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def without_comments(markup: Column) -> Column:
    """Markup without comments other than conditional ones that start with <!--!."""
    return F.regexp_replace(markup, "(?s)<!--[^!].*?-->", "")
