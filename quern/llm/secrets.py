"""Secret scans with DataFrame functions alone: patterns, and the Shannon entropy of a sliding window.

A candidate is a maximal run of a character class. A fold over its characters keeps the counts of the window's characters;
each step changes the counts of the one that enters and the one that leaves, and with them the sum of c*log2(c) from which
the entropy follows. Nothing is shuffled and no row leaves its task.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the base kinds, in the order of kinds. The last two match maximal runs, so a least length within the pattern drops what is shorter.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Characters that the value of an assignment has at least.
VALUE_LENGTH = 6


@dataclass(frozen=True)
class EntropyClass:
    """Runs of `members` (a regex class) with a window of `window` characters of `bits` bits of entropy or more."""

    kind: str
    members: str
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return f"(?<!{self.members}){self.members}{{{self.window},}}"


_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    EntropyClass("entropy_hex", "[0-9A-Fa-f]", _DIGITS + "abcdefABCDEF", 20, 3.03),
    EntropyClass("entropy_base64", "[A-Za-z0-9+/_=-]", _DIGITS + _UPPER + _UPPER.lower() + "+/_=-", 20, 3.87),
)
#: A run that matches one of these is no secret by its entropy: no digit or no letter, words and numbers between separators, identifiers, placeholders, the alphabet in order.
ALLOWED = (
    "^[^0-9]*$",
    "^[^A-Za-z]*$",
    "^[/_=+-]*([a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]{1,8})([/_=+-]+([a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]{1,8}))*[/_=+-]*$",
    "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "(?i)example|sample|dummy|placeholder|changeme|your[_-]?(key|token|secret)|x{6,}|(0123456789|abcdefghij|1234567890)",
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _starts(pieces: Column, found: Column) -> Column:
    """Where each match starts, by the lengths of what stands before it."""
    step = lambda acc, i: F.struct(
        (acc["at"] + F.length(F.get(pieces, i)) + F.length(F.get(found, i))).alias("at"),
        F.array_append(acc["starts"], acc["at"] + F.length(F.get(pieces, i))).alias("starts"),
    )
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), first, step, lambda acc: acc["starts"])).otherwise(F.array().cast("array<int>"))


def _spans(kind: int, found: str, starts: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.struct(F.get(starts, i).alias("start"), F.lit(kind).alias("kind"), (F.get(starts, i) + F.length(F.get(found, i))).alias("end")))


def _entropy_range(run: Column, of: EntropyClass) -> Column:
    """(first, last): the start of the first window with enough entropy and the end of the last, from 0; null without one."""
    w, size = of.window, len(of.alphabet)
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 1)])
    most = w * (math.log2(w) - of.bits)  # entropy >= bits as a bound of the sum of c*log2(c)
    codes = F.transform(F.split(run, ""), lambda ch: F.position(ch, F.lit(of.alphabet)) - 1)

    def step(acc: Column, at: Column) -> Column:
        comes, goes, i = at["comes"], at["goes"], at["i"]
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == comes, 1).otherwise(0) - F.when(k == goes, 1).otherwise(0))
        more = F.get(term, F.get(acc["counts"], comes) + 1) - F.get(term, F.get(acc["counts"], comes))
        less = F.when(goes >= 0, F.get(term, F.get(acc["counts"], goes) - 1) - F.get(term, F.get(acc["counts"], goes))).otherwise(0.0)
        total = F.when(comes == goes, acc["total"]).otherwise(acc["total"] + more + less)
        hit = (i >= w - 1) & (total <= most)
        return F.struct(
            counts.alias("counts"),
            total.alias("total"),
            F.when(hit & (acc["first"] < 0), i - (w - 1)).otherwise(acc["first"]).alias("first"),
            F.when(hit, i + 1).otherwise(acc["last"]).alias("last"),
        )

    moves = F.transform(codes, lambda code, i: F.struct(code.alias("comes"), F.lit(-1).alias("goes"), i.alias("i")))
    # the code that leaves is that of `w` places before
    gone = F.concat(F.array_repeat(F.lit(-1), w), codes)
    moves = F.zip_with(moves, gone, lambda m, g: F.struct(m["comes"].alias("comes"), g.alias("goes"), m["i"].alias("i")))
    moves = F.filter(moves, lambda m: m["comes"].isNotNull())
    first = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.aggregate(moves, first, step, lambda acc: F.when(acc["first"] >= 0, F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))


def _suspect_range(of: EntropyClass) -> Callable[[Column], Column]:
    """The range of a run, null where the allow-list has it."""
    return lambda run: F.when(~functools.reduce(lambda a, b: a | b, [run.rlike(a) for a in ALLOWED]), _entropy_range(run, of))


def _moved(kind: int) -> Callable[[Column, Column], Column]:
    return lambda r, at: F.when(r.isNotNull(), F.struct((at + r["first"]).alias("start"), F.lit(kind).alias("kind"), (at + r["last"]).alias("end")))


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans, found): a row for each row of docs; other columns are ignored.

    found holds (start, kind, end), sorted, with ends exclusive and in code points; spans and base_sha256 are made of it.
    Spans of entropy that touch a base span are left out, as the secret is reported there. Null and empty texts have none;
    repeated rows and null ids give rows of their own.
    """
    df = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | {c.kind: c.pattern for c in CLASSES}
    strings = F.array().cast("array<string>")
    for name, pattern in patterns.items():
        # most texts match nothing: they are read once a pattern and not taken apart
        has = F.col("text").rlike(pattern)
        df = df.withColumn(f"{name}_found", F.when(has, F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).otherwise(strings))
    for name, pattern in patterns.items():
        any_ = F.size(f"{name}_found") > 0
        df = df.withColumn(f"{name}_starts", F.when(any_, _starts(F.split("text", pattern, -1), F.col(f"{name}_found"))).otherwise(F.array().cast("array<int>")))
    for k, name in enumerate(KINDS):
        any_ = F.size(f"{name}_found") > 0
        spans = _spans(k, f"{name}_found", f"{name}_starts")
        if name == "assign":
            values = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))
            spans = F.filter(spans, lambda s, i: F.length(F.get(F.col("assign_values"), i)) >= VALUE_LENGTH)
            df = df.withColumn("assign_values", F.when(any_, values).otherwise(strings))
        if name.startswith("entropy"):
            of = next(c for c in CLASSES if c.kind == name)
            ranges = F.transform(F.col(f"{name}_found"), _suspect_range(of))
            df = df.withColumn(f"{name}_ranges", F.when(any_, ranges).otherwise(F.array().cast("array<struct<first:int,last:int>>")))
            spans = F.array_compact(F.zip_with(F.col(f"{name}_ranges"), F.col(f"{name}_starts"), _moved(k)))
        df = df.withColumn(f"{name}_spans", F.when(any_, spans.cast(_SPAN)).otherwise(_none()))
    base = F.concat(*[F.col(f"{k}_spans") for k in KINDS[:3]])
    df = df.withColumn("base", F.array_sort(base))
    more, found = F.concat(*[F.col(f"{k}_spans") for k in KINDS[3:]]), F.col("base")
    apart = F.filter(more, lambda e: ~F.exists(F.col("base"), lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    # what both classes find is reported once, by the narrower one
    df = df.withColumn("apart", F.array_sort(apart))
    only = F.filter("apart", lambda e: (e["kind"] == 3) | ~F.exists(F.col("apart"), lambda b: (b["kind"] == 3) & (b["start"] < e["end"]) & (e["start"] < b["end"])))
    df = df.withColumn("entropy", only)
    found = F.array_sort(F.concat("base", "entropy"))
    count = lambda name: F.size(f"{name}_spans").cast("long")
    df = df.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.size("entropy").cast("long").alias("n_entropy"), _text_of(F.col("base")).alias("base"), found.alias("found"))
    return df.select("doc_id", "n_assign", "n_access", "n_hex", "n_entropy", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), _text_of(F.col("found")).alias("spans"), "found")


def _sql_entropy(of: EntropyClass, k: int) -> str:
    allowed = " OR ".join(f"regexp_matches(run, '{a}')" for a in ALLOWED)
    return f"""
        SELECT id, pos + min(i) AS start, {k} AS kind, pos + max(i) + {of.window} AS "end" FROM (
            SELECT id, pos, run, i FROM (
                SELECT id, unnest(range(len(runs))) AS n, list_sum(list_transform(pieces[1:n + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(runs[1:n], lambda x: length(x))), 0) AS pos, runs[n + 1] AS run
                FROM (SELECT id, regexp_extract_all(text, '{of.members}{{{of.window},}}') AS runs, string_split_regex(text, '{of.members}{{{of.window},}}') AS pieces FROM d)
            ), unnest(range(length(run) - {of.window - 1})) AS t(i)
            WHERE NOT ({allowed}) AND list_aggregate(string_split(substr(run, i + 1, {of.window}), ''), 'entropy') >= {of.bits})
        GROUP BY id, pos, run"""


def _sql_base(kind: int, pattern: str, keep: str = "true") -> str:
    quoted = pattern.replace("'", "''")
    return f"""
        SELECT id, CAST(pos AS BIGINT) AS start, {kind} AS kind, CAST(pos + length(run) AS BIGINT) AS "end" FROM (
            SELECT id, unnest(range(len(runs))) AS n, list_sum(list_transform(pieces[1:n + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(runs[1:n], lambda x: length(x))), 0) AS pos, runs[n + 1] AS run, vals[n + 1] AS val
            FROM (SELECT id, regexp_extract_all(text, '{quoted}') AS runs, regexp_extract_all(text, '{quoted}', {2 if kind == 0 else 0}) AS vals, string_split_regex(text, '{quoted}') AS pieces FROM d))
        WHERE {keep}"""


def oracle_sql() -> str:
    """The rows of the query in DuckDB SQL: every window's entropy on its own."""
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    joined = "coalesce(string_agg({k}[kind + 1] || ':' || start || ':' || \"end\", ',' ORDER BY start, kind), '')".format(k=kinds)
    base = " UNION ALL ".join([_sql_base(0, ASSIGN, f"length(val) >= {VALUE_LENGTH}"), _sql_base(1, ACCESS), _sql_base(2, HEX)])
    more = " UNION ALL ".join(_sql_entropy(c, 3 + i) for i, c in enumerate(CLASSES))
    touches = 'b.id = e.id AND b.start < e."end" AND e.start < b."end"'
    return f"""
        WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
        base AS ({base}), more AS ({more}),
        apart AS (SELECT e.* FROM more e WHERE NOT EXISTS (SELECT 1 FROM base b WHERE {touches})),
        only_ AS (SELECT e.* FROM apart e WHERE kind = 3 OR NOT EXISTS (SELECT 1 FROM apart b WHERE b.kind = 3 AND {touches})),
        every AS (SELECT * FROM base UNION ALL SELECT * FROM only_),
        b AS (SELECT id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, {joined} AS s FROM base GROUP BY id),
        a AS (SELECT id, count(*) FILTER (kind > 2) AS n3, {joined} AS s FROM every GROUP BY id)
        SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, coalesce(n3, 0) AS n_entropy,
               sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans
        FROM d LEFT JOIN b USING (id) LEFT JOIN a USING (id)"""
