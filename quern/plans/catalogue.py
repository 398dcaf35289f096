"""Named queries over the supplied tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import paths as P
from quern.functions import text as X
from quern.operators import compare, conflicts, geometry, ranges, rights, search, select, totals
from quern.plans import views as V
from quern.schemas import DEFAULT_TARGET, QUALITIES, RIGHTS_FIELDS
from quern.sources import sniff
from quern.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _with(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "


_VERDICT = "CASE WHEN {0} >= 90 THEN 'visually-lossless' WHEN {0} >= 85 THEN 'excellent' WHEN {0} >= 80 THEN 'very-high' WHEN {0} >= 70 THEN 'high' WHEN {0} >= 50 THEN 'noticeable' ELSE 'obvious' END"


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.candidates(spark, sf_dir).join(V.files(spark, sf_dir), "file")


@_query(
    _with(V.CANDIDATES_SQL, V.FILES_SQL)
    + f"""SELECT file, bytes, score, format, {_VERDICT.format("score")} AS verdict, input_bytes, 1 - bytes / input_bytes AS saving
    FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY bytes, ord) AS no FROM candidates JOIN files USING (file) WHERE bytes < input_bytes AND score >= 70) WHERE no = 1"""
)
def pick_smallest_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = select.pick(_bounded(spark, sf_dir), ["file"], DEFAULT_TARGET, F.col("input_bytes"))
    return best.select("file", "bytes", "score", "format", X.verdict(F.col("score")).alias("verdict"), "input_bytes", (1 - F.col("bytes") / F.col("input_bytes")).alias("saving"))


@_query(
    _with(V.CANDIDATES_SQL, V.FILES_SQL)
    + """SELECT file, bytes, score, CASE WHEN score < 85 THEN 'W_TARGET_NOT_REACHED' END AS warning FROM (
        SELECT *, row_number() OVER (PARTITION BY file ORDER BY score < 85, CASE WHEN score < 85 THEN -score ELSE 0 END, bytes, ord) AS no FROM candidates JOIN files USING (file) WHERE bytes < input_bytes) WHERE no = 1"""
)
def pick_allow_below_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = select.pick(_bounded(spark, sf_dir), ["file"], 85, F.col("input_bytes"), allow_below_target=True)
    return best.select("file", "bytes", "score", F.when(F.col("score") < 85, "W_TARGET_NOT_REACHED").alias("warning"))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tiers per file: a large packet, a small one and none; a seventh of files cannot hold the large one."""
    f = V.files(spark, sf_dir)
    each = f.select("file", F.explode(F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(p).cast("int").alias("packet"), ((F.col("file") % 7 != 0) | F.lit(n > 0)).alias("fits")) for n, p in ((0, 4000), (1, 900), (2, None))])).alias("t"))
    return each.select("file", "t.*")


_TIERS = """tiers AS (SELECT file, tier, packet FROM (SELECT file, unnest([0, 1, 2]) AS tier, unnest([4000, 900, 0]) AS packet FROM files) WHERE NOT (tier = 0 AND file % 7 = 0)),
tiered AS (SELECT candidates.* EXCLUDE (bytes), tier, bytes + packet AS bytes, input_bytes, input_format FROM candidates JOIN tiers USING (file) JOIN files USING (file))"""


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    # candidates meet their file once; the three tiers are a constant list and multiply rows in place
    return select.carrying(_bounded(spark, sf_dir), _tiers(spark, sf_dir), ["file"])


@_query(
    _with(V.CANDIDATES_SQL, V.FILES_SQL, _TIERS)
    + "SELECT file, tier, bytes, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY tier, bytes, ord) AS no FROM tiered WHERE bytes < input_bytes AND score >= 70) WHERE no = 1"
)
def pick_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.pick_by_tier(_tiered(spark, sf_dir), ["file"], DEFAULT_TARGET, F.col("input_bytes")).select("file", "tier", "bytes", "score", "ord")


@_query(
    _with(V.CANDIDATES_SQL, V.FILES_SQL, _TIERS)
    + """SELECT file, tier, bytes, score, format, is_fallback FROM (
        SELECT *, row_number() OVER (PARTITION BY file ORDER BY tier, phase, CASE WHEN phase = 1 THEN -score ELSE 0 END, bytes, ord) AS no FROM (
            SELECT *, format = 'jpeg' AS is_fallback, CASE WHEN format <> 'jpeg' AND score >= 80 THEN 0 WHEN format <> 'jpeg' AND input_format <> 'webp' THEN 1 WHEN format = 'jpeg' AND score >= 80 AND input_format <> 'webp' THEN 2 END AS phase
            FROM tiered WHERE bytes < input_bytes) WHERE phase IS NOT NULL) WHERE no = 1"""
)
def select_single_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiered(spark, sf_dir).withColumn("is_fallback", F.col("format") == "jpeg")
    best = select.select_single(rows, ["file"], 80, F.col("input_bytes"), F.col("input_format") != "webp")
    return best.select("file", "tier", "bytes", "score", "format", "is_fallback")


@_query(
    _with(V.CANDIDATES_SQL, V.FILES_SQL, _TIERS)
    + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, role ORDER BY tier, bytes, ord) AS no FROM tiered
        WHERE score >= 70 AND bytes < input_bytes + CASE WHEN role = 'fallback' AND file % 2 = 0 THEN 1 ELSE 0 END) WHERE no = 1),
    chain AS (SELECT *, list_position(['fallback', 'webp', 'avif'], role) AS r FROM best)
    SELECT file, role, tier, bytes, score FROM (SELECT *, min(bytes) OVER (PARTITION BY file ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM chain) WHERE before IS NULL OR bytes < before"""
)
def select_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = select.select_suite(_tiered(spark, sf_dir), ["file"], DEFAULT_TARGET, F.col("input_bytes"), F.col("file") % 2 != 0)
    return best.select("file", "role", "tier", "bytes", "score")


@_query(
    _with(V.CANDIDATES_SQL, V.FILES_SQL, _TIERS)
    + """SELECT file, tier, bytes, score FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY loose, tier, miss, CASE WHEN miss = 1 THEN -score ELSE 0 END, bytes, ord) AS no FROM (
        SELECT *, 0 AS loose, 0 AS miss FROM tiered WHERE format = 'webp' AND score >= 80 AND bytes < input_bytes
        UNION ALL SELECT *, 1, CASE WHEN score >= 80 THEN 0 ELSE 1 END FROM tiered WHERE format = 'webp')) WHERE no = 1"""
)
def select_one_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    webp = _tiered(spark, sf_dir).where("format = 'webp'")
    return select.select_format(webp, ["file"], 80, F.col("input_bytes")).select("file", "tier", "bytes", "score")


@_query(
    _with(V.CANDIDATES_SQL)
    + "SELECT file, ord, bytes, coalesce(bytes < min(bytes) OVER (PARTITION BY file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), bytes IS NOT NULL) AS kept FROM (SELECT file, ord, CASE WHEN score >= 60 THEN bytes END AS bytes FROM candidates)"
)
def suite_chain_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = V.candidates(spark, sf_dir).select("file", "ord", F.when(F.col("score") >= 60, F.col("bytes")).alias("bytes"))
    return select.kept_by_chain(sized, ["file"], "ord")


def _curve(quality):
    """A rising curve with noise, from whole numbers alone."""
    return F.floor(F.lit(20) + F.col("p_size") + quality * 7 / 10 + (F.col("p_partkey") * 31 + quality * 17) % 9)


_LOW, _HIGH = QUALITIES["webp"]
_CURVE = "CAST(floor(20 + p_size + q * 7 / 10 + (p_partkey * 31 + q * 17) % 9) AS INTEGER)"
_SEARCH = f"""WITH RECURSIVE s AS (
        SELECT p_partkey, p_size, 1 AS n, 0 AS phase, {_LOW} AS low, {_HIGH} AS high, {_HIGH} AS q FROM part
        UNION ALL
        SELECT p_partkey, p_size, n + 1, phase, low, high, CASE WHEN phase = 1 THEN (low + high) // 2 ELSE high + 1 END AS q FROM (
            SELECT p_partkey, p_size, n, low, high, CASE WHEN done THEN 3 WHEN low < high THEN 1 WHEN high < {_HIGH} THEN 2 ELSE 3 END AS phase FROM (
                SELECT p_partkey, p_size, n, phase = 2 OR (phase = 0 AND NOT passed) AS done,
                    CASE WHEN phase = 0 OR passed THEN low ELSE q + 1 END AS low, CASE WHEN phase = 1 AND passed THEN q ELSE high END AS high
                FROM (SELECT *, {_CURVE} >= 70 AS passed FROM s)))
        WHERE phase < 3),
    tried AS (SELECT p_partkey, n, q AS quality, CAST({_CURVE} AS DOUBLE) AS score, {_CURVE} >= 70 AS passed FROM s) """


#: A target that some parts' curves never reach.
_HARD = 95


def _tried(spark: SparkSession, sf_dir: str, target: float = DEFAULT_TARGET) -> DataFrame:
    part = V.parts(spark, sf_dir).select("p_partkey", "p_size")
    path = search.search_path(_LOW, _HIGH, _curve, target)
    return part.select("p_partkey", F.posexplode(path).alias("n", "t")).select("p_partkey", (F.col("n") + 1).alias("n"), "t.*")


@_query(_SEARCH + "SELECT p_partkey, n, quality, score, passed FROM tried")
def search_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tried(spark, sf_dir)


_BYTES = "CAST(1000 + p_partkey % 97 * 10 + quality * 13 + (quality * 7) % 5 * 40 AS BIGINT)"


@_query(
    _SEARCH
    + f"""SELECT p_partkey, quality, bytes, score, passed AS reached FROM (SELECT *, {_BYTES} AS bytes,
        row_number() OVER (PARTITION BY p_partkey ORDER BY passed DESC, CASE WHEN passed THEN 0 ELSE -score END, {_BYTES}, quality) AS no FROM (SELECT DISTINCT p_partkey, quality, score, passed FROM tried)) WHERE no = 1"""
)
def search_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.lit(1000) + F.col("p_partkey") % 97 * 10 + F.col("quality") * 13 + (F.col("quality") * 7) % 5 * 40).cast("long")
    return select.chosen_attempt(_tried(spark, sf_dir).withColumn("bytes", size), ["p_partkey"])


@_query(_SEARCH.replace(f">= {DEFAULT_TARGET}", f">= {_HARD}") + "SELECT p_partkey, max(score) AS best FROM tried GROUP BY p_partkey HAVING NOT bool_or(passed)")
def search_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tried(spark, sf_dir, _HARD).groupBy("p_partkey").agg(F.max("score").alias("best"), F.bool_or("passed").alias("any")).where(~F.col("any")).drop("any")


@_query(_with(V.CANDIDATES_SQL) + "SELECT file, format, score, min(bytes) AS bytes, count(*) AS uses FROM candidates GROUP BY file, format, score")
def attempt_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes of one encoder and quality are made once, however often they are asked for."""
    return V.candidates(spark, sf_dir).groupBy("file", "format", "score").agg(F.min("bytes").alias("bytes"), F.count("*").alias("uses"))


# Which encoders a format tries, in order, and what each needs of its source.
ENCODERS = (
    ("png", 0, "png lossless", "always"),
    ("png", 1, "png palette", "scorable"),
    ("jpeg", 0, "jpeg", "scorable"),
    ("avif", 0, "avif", "scorable"),
    ("webp", 0, "webp", "lossy"),
    ("webp", 1, "webp lossless", "exact"),
    ("webp", 2, "webp near-lossless", "near"),
)
_ENCODERS = "encoders(format, ord, encoder, needs) AS (VALUES " + ", ".join(str(e) for e in ENCODERS) + ")"


@_query(
    _with(V.FILES_SQL, _ENCODERS)
    + """SELECT file, format, CAST(ord AS INTEGER) AS ord, encoder FROM (SELECT *, width >= 8 AND height >= 8 AS scorable, input_format = 'webp' AND file % 2 = 0 AS lossless_webp FROM files), encoders
        WHERE input_format <> 'svg' AND (format = 'png' OR (width <= CASE format WHEN 'webp' THEN 16383 WHEN 'avif' THEN 16384 ELSE 65500 END AND height <= CASE format WHEN 'webp' THEN 16383 WHEN 'avif' THEN 16384 ELSE 65500 END))
        AND CASE needs WHEN 'always' THEN true WHEN 'scorable' THEN scorable WHEN 'lossy' THEN scorable AND NOT lossless_webp
            WHEN 'exact' THEN lossless_webp OR NOT scorable OR input_format = 'png' ELSE scorable AND input_format = 'png' END"""
)
def encoder_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.files(spark, sf_dir).where("input_format <> 'svg'").withColumn("scorable", geometry.is_scorable(F.col("width"), F.col("height")))
    f = f.withColumn("lossless_webp", (F.col("input_format") == "webp") & (F.col("file") % 2 == 0))
    # seven constant rows multiply in place, without a join
    each = f.withColumn("e", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("format", "ord", "encoder", "needs"), e, strict=True)]) for e in ENCODERS]))).select("*", "e.*").drop("e")
    png = F.col("input_format") == "png"
    meets = F.when(F.col("needs") == "always", F.lit(True)).when(F.col("needs") == "scorable", F.col("scorable")).when(F.col("needs") == "lossy", F.col("scorable") & ~F.col("lossless_webp"))
    meets = meets.when(F.col("needs") == "exact", F.col("lossless_webp") | ~F.col("scorable") | png).otherwise(F.col("scorable") & png)
    return each.where(meets & geometry.fits_format(F.col("width"), F.col("height"), F.col("format"))).select("file", "format", "ord", "encoder")


@_query(_with(V.CANDIDATES_SQL) + f"SELECT verdict, CASE WHEN verdict = 'high' THEN 'fair' WHEN verdict IN ('noticeable', 'obvious') THEN 'bad' ELSE 'good' END AS rating, count(*) AS n FROM (SELECT {_VERDICT.format('score')} AS verdict FROM candidates) GROUP BY 1, 2")
def verdict_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = V.candidates(spark, sf_dir).select(X.verdict(F.col("score")).alias("verdict"))
    return banded.groupBy("verdict", X.rating(F.col("verdict")).alias("rating")).agg(F.count("*").alias("n"))


_RESULTS = """results AS (
    SELECT file, input_bytes, CASE WHEN file % 19 = 0 THEN 'failed' WHEN file % 17 = 0 THEN 'skipped' WHEN outs IS NULL THEN 'kept-original' ELSE 'optimised' END AS status, CASE WHEN file % 19 <> 0 AND file % 17 <> 0 THEN outs END AS outs
    FROM files LEFT JOIN (SELECT file, list(bytes ORDER BY bytes) AS outs FROM (SELECT file, role, min(bytes) AS bytes FROM candidates JOIN files USING (file) WHERE score >= 70 AND bytes < input_bytes GROUP BY file, role) GROUP BY file) USING (file))"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, bytes, status, output_bytes): each file with the sizes of its outputs, one a role."""
    best = _bounded(spark, sf_dir).where((F.col("score") >= DEFAULT_TARGET) & (F.col("bytes") < F.col("input_bytes"))).groupBy("file", "role").agg(F.min("bytes").alias("bytes"))
    outs = best.groupBy("file").agg(F.array_sort(F.collect_list("bytes")).alias("outs"))  # three at most
    each = V.files(spark, sf_dir).join(outs, "file", "left")
    status = F.when(F.col("file") % 19 == 0, "failed").when(F.col("file") % 17 == 0, "skipped").when(F.col("outs").isNull(), "kept-original").otherwise("optimised")
    ran = (F.col("file") % 19 != 0) & (F.col("file") % 17 != 0)
    return each.select("file", F.col("input_bytes").alias("bytes"), status.alias("status"), F.when(ran, F.col("outs")).alias("output_bytes"))


_TOTALS = """totals AS (SELECT count(*) AS files, count(*) FILTER (status = 'optimised') AS optimised, count(*) FILTER (status = 'kept-original') AS kept_original, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
    CAST(coalesce(sum(input_bytes) FILTER (status IN ('optimised', 'kept-original')), 0) AS BIGINT) AS input_bytes,
    CAST(coalesce(sum(least(input_bytes, coalesce(list_min(outs), input_bytes))) FILTER (status IN ('optimised', 'kept-original')), 0) AS BIGINT) AS output_bytes FROM results)"""


@_query(_with(V.CANDIDATES_SQL, V.FILES_SQL, _RESULTS, _TOTALS) + "SELECT *, CASE WHEN input_bytes = 0 THEN 0.0 ELSE 1 - output_bytes / input_bytes END AS saving FROM totals")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.run_totals(_results(spark, sf_dir))


@_query(_with(V.CANDIDATES_SQL, V.FILES_SQL, _RESULTS) + "SELECT status, count(*) AS files, CAST(sum(input_bytes) AS BIGINT) AS bytes FROM results GROUP BY status")
def totals_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).groupBy("status").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


_MB = "printf('%.{1}f', floor({0} / 1e6 * 1e{1} + 0.5) / 1e{1})"
_SIZE = """CASE WHEN {0} < 1000 THEN {0} || ' B'
    WHEN {0} / 1e3 < 999.5 THEN CASE WHEN {0} / 1e3 >= 99.95 THEN printf('%.0f', floor({0} / 1e3 + 0.5)) WHEN {0} / 1e3 >= 9.995 THEN printf('%.1f', floor({0} / 1e3 * 10 + 0.5) / 10) ELSE printf('%.2f', floor({0} / 1e3 * 100 + 0.5) / 100) END || ' kB'
    WHEN {0} / 1e6 < 999.5 THEN CASE WHEN {0} / 1e6 >= 99.95 THEN printf('%.0f', floor({0} / 1e6 + 0.5)) WHEN {0} / 1e6 >= 9.995 THEN printf('%.1f', floor({0} / 1e6 * 10 + 0.5) / 10) ELSE printf('%.2f', floor({0} / 1e6 * 100 + 0.5) / 100) END || ' MB'
    ELSE CASE WHEN {0} / 1e9 >= 99.95 THEN printf('%.0f', floor({0} / 1e9 + 0.5)) WHEN {0} / 1e9 >= 9.995 THEN printf('%.1f', floor({0} / 1e9 * 10 + 0.5) / 10) ELSE printf('%.2f', floor({0} / 1e9 * 100 + 0.5) / 100) END || ' GB' END"""


@_query(
    _with(V.CANDIDATES_SQL, V.FILES_SQL, _RESULTS, _TOTALS)
    + f"""SELECT files || CASE WHEN files = 1 THEN ' file: ' ELSE ' files: ' END || concat_ws(', ', CASE WHEN optimised > 0 THEN optimised || ' optimised' END, CASE WHEN kept_original > 0 THEN kept_original || ' kept original' END, CASE WHEN skipped > 0 THEN skipped || ' skipped' END, CASE WHEN failed > 0 THEN failed || ' failed' END)
    || '.' || CASE WHEN input_bytes = 0 THEN '' ELSE ' ' || {_SIZE.format("input_bytes")} || ' -> ' || {_SIZE.format("output_bytes")} || ', ' || printf('%.1f', floor((1 - output_bytes / input_bytes) * 100 * 10 + 0.5) / 10) || '% smaller.' END AS line FROM totals"""
)
def totals_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.totals_line(totals.run_totals(_results(spark, sf_dir)))


@_query(_with(V.CANDIDATES_SQL, V.FILES_SQL, _RESULTS) + "SELECT file, status, coalesce(list_bool_and([x = input_bytes for x in outs]), true) AS unchanged, coalesce(len(outs), 0) AS outputs FROM results")
def unchanged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every output of a file is as large as its input; true without any."""
    same = F.coalesce(F.forall("output_bytes", lambda x: x == F.col("bytes")), F.lit(True))
    return _results(spark, sf_dir).select("file", "status", same.alias("unchanged"), F.greatest(F.size(F.coalesce("output_bytes", F.array().cast("array<bigint>"))), F.lit(0)).cast("long").alias("outputs"))


@_query(_with(V.CANDIDATES_SQL, V.FILES_SQL, _RESULTS) + """SELECT file, '{"file":' || file || ',"status":"' || status || '","bytes":' || input_bytes || CASE WHEN len(outs) > 0 THEN ',"outputs":[' || array_to_string(outs, ',') || ']' ELSE '' END || '}' AS document FROM results""")
def file_results_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document per file, without the fields it lacks."""
    doc = F.struct("file", "status", "bytes", F.when(F.size("output_bytes") > 0, F.col("output_bytes")).alias("outputs"))
    return _results(spark, sf_dir).select("file", F.to_json(doc).alias("document"))


# --- paths -----------------------------------------------------------------------------------------------------------


@_query(_with(V.PATHS_SQL) + "SELECT idx, path, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'jpg' THEN 'jpeg' WHEN 'txt' THEN NULL ELSE lower(regexp_extract(path, '\\.([^./]+)$', 1)) END AS format FROM paths")
def format_of_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.paths(spark, sf_dir).select("idx", "path", P.format_of_extension(F.col("path")).alias("format"))


@_query(
    _with(V.PATHS_SQL)
    + "SELECT idx, kind, CASE WHEN idx % 2 = 0 THEN '/out' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END || '/' || regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') || '.' || CASE WHEN kind = format THEN regexp_extract(path, '\\.([^.]*)$', 1) WHEN kind = 'jpeg' THEN 'jpg' ELSE kind END AS output FROM (SELECT *, unnest(['webp', 'avif', 'jpeg']) AS kind FROM paths WHERE format IS NOT NULL)"
)
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = V.paths(spark, sf_dir).where("format IS NOT NULL").withColumn("kind", F.explode(F.array(F.lit("webp"), F.lit("avif"), F.lit("jpeg"))))
    out = F.when(F.col("idx") % 2 == 0, F.lit("/out"))
    return each.select("idx", "kind", P.output_path(F.col("path"), F.col("kind"), out).alias("output"))


@_query(_with(V.PATHS_SQL) + "SELECT idx, '/out' || CASE WHEN below = '' THEN '' ELSE '/' || below END AS folder FROM (SELECT idx, regexp_extract(path, '^/in/?(.*)/[^/]*$', 1) AS below FROM paths)")
def mirror_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    below = P.relative_inside(F.lit("/in"), P.folder(F.col("path")))
    return V.paths(spark, sf_dir).select("idx", P.mirrored(F.lit("/out"), below).alias("folder"))


@_query(_with(V.PATHS_SQL, V.CLAIMS_SQL) + "SELECT idx, unnest(claims) AS claim FROM claims")
def output_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.paths(spark, sf_dir).select("idx", F.explode(P.output_claims(F.col("path"), F.col("format"), "suite")).alias("claim"))


@_query(
    _with(V.PATHS_SQL, V.CLAIMS_SQL)
    + """SELECT idx, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx) AS no FROM paths p WHERE NOT scanned OR NOT EXISTS (SELECT 1 FROM (SELECT path AS own, unnest(claims) AS claim FROM claims) c WHERE claim = p.path AND claim <> own)) WHERE no = 1"""
)
def expand_without_earlier_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.expanded(V.paths(spark, sf_dir), "suite").select("idx", "path")


#: A folder and stem has inputs that grow with the pages.
_DENSE_SQL = V.PATHS_SQL.replace("m // 21", "m % 4")


def _dense_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = V.paths(spark, sf_dir)
    m = F.col("idx") - F.when(F.col("idx") % 50 == 49, 14).otherwise(0)
    return paths.withColumn("path", F.concat(P.folder(F.col("path")), F.lit("/img"), (m % 4).cast("string"), F.lit("."), F.substring_index("path", ".", -1)))


@_query(
    _with(V.PATHS_SQL, V.CLAIMS_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, grouped AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY idx) AS no, min(idx) OVER (PARTITION BY path) AS first, list(path) OVER (PARTITION BY dir, stem) AS inputs FROM claims),
    walk AS (
        SELECT dir, stem, CAST(0 AS BIGINT) AS no, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS VARCHAR) AS reason, CAST([] AS VARCHAR[]) AS taken FROM grouped GROUP BY dir, stem
        UNION ALL
        SELECT dir, stem, no, idx, reason, CASE WHEN reason IS NULL THEN list_distinct(list_concat(taken, claims)) ELSE taken END FROM (
            SELECT g.dir, g.stem, g.no, g.idx, w.taken, g.claims, CASE WHEN first < g.idx THEN 'same-file' ELSE
                list_filter(list_transform(g.claims, lambda c: CASE WHEN list_contains(w.taken, c) THEN 'claimed' WHEN c <> g.path AND list_contains(g.inputs, c) THEN 'replaces' END), lambda x: x IS NOT NULL)[1] END AS reason
            FROM walk w JOIN grouped g ON g.dir = w.dir AND g.stem = w.stem AND g.no = w.no + 1))
    SELECT idx, reason FROM walk WHERE reason IS NOT NULL"""
)
def conflicts_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as they are: of each folder and stem a file in seven formats, and some paths twice."""
    return conflicts.conflicting(V.paths(spark, sf_dir), "suite")


@_query(ORACLE_SQL["conflicts_greedy"].replace(V.PATHS_SQL, _DENSE_SQL))
def conflicts_of_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dozen folders and stems, which all inputs share."""
    return conflicts.conflicting(_dense_paths(spark, sf_dir), "suite")


@_query(
    _with(V.PATHS_SQL, V.CLAIMS_SQL)
    + """, outputs AS (SELECT idx AS file, generate_subscripts(claims, 1) - 1 AS ord, unnest(claims) AS out, path, idx % 5 = 0 AS same FROM claims),
    there AS (SELECT DISTINCT path FROM paths WHERE idx % 2 = 0),
    each AS (SELECT o.*, t.path IS NOT NULL AS there, o.out = o.path AS is_input FROM outputs o LEFT JOIN there t ON o.out = t.path),
    plan AS (SELECT file, min_by(out, ord) FILTER (there AND is_input AND NOT same) AS a, min_by(out, ord) FILTER (there AND NOT is_input) AS b, count(*) FILTER (NOT (there AND is_input AND same)) AS n FROM each GROUP BY file)
    SELECT file, CASE WHEN a IS NOT NULL THEN 'blocked-input' WHEN b IS NOT NULL THEN 'blocked-exists' ELSE 'write' END AS action, coalesce(a, b) AS blocked_path, CASE WHEN a IS NULL AND b IS NULL THEN n ELSE 0 END AS writes FROM plan"""
)
def write_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.paths(spark, sf_dir)
    outputs = p.select(F.col("idx").alias("file"), F.col("path").alias("own"), F.posexplode(P.output_claims(F.col("path"), F.col("format"), "suite")).alias("ord", "path"))
    outputs = outputs.withColumn("is_input", F.col("path") == F.col("own")).withColumn("unchanged", F.col("file") % 5 == 0)
    return conflicts.write_plan(outputs, p.where("idx % 2 = 0").select("path"), in_place=False, overwrite=False)


_NAMES_SQL = """n AS (SELECT l_orderkey * 10 + l_linenumber AS idx, '/d' || l_suppkey % 3 AS folder, 'img' || l_partkey % 200 AS base, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity % 4 ELSE 0 END AS count, CASE WHEN l_tax > 0.04 THEN '.png' ELSE '.jpg' END AS ext FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
    there AS (SELECT DISTINCT '/d' || l_suppkey % 3 AS folder, 'img' || l_partkey % 200 AS base, CAST(l_quantity % 9 AS BIGINT) AS count, CASE WHEN l_tax > 0.04 THEN '.png' ELSE '.jpg' END AS ext FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"""


@_query(
    _with(V.PATHS_SQL)
    + """SELECT idx, folder, base || CASE WHEN no > 0 THEN ' (' || no || ')' ELSE '' END || '.' || ext AS free_name FROM (
        SELECT *, row_number() OVER (PARTITION BY folder, base, ext ORDER BY idx) - 1 AS no FROM (
            SELECT idx, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS base, split_part(path, '.', -1) AS ext FROM paths))"""
)
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole names within a folder, each with the next free count."""
    p = V.paths(spark, sf_dir).select("idx", P.folder(F.col("path")).alias("folder"), F.substring_index("path", "/", -1).alias("name"))
    return conflicts.free_names(p)


@_query(
    _with(_NAMES_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY folder, base, ext ORDER BY idx) AS no FROM n),
    walk AS (SELECT folder, base, ext, CAST(0 AS BIGINT) AS no, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS BIGINT) AS given, coalesce(t.taken, []) AS taken FROM (SELECT DISTINCT folder, base, ext FROM n) LEFT JOIN (SELECT folder, base, ext, list(count) AS taken FROM there GROUP BY ALL) t USING (folder, base, ext)
        UNION ALL SELECT folder, base, ext, no, idx, given, list_append(taken, given) FROM (
            SELECT o.folder, o.base, o.ext, o.no, o.idx, w.taken, list_filter(range(CAST(o.count AS BIGINT), CAST(o.count AS BIGINT) + len(w.taken) + 1), lambda c: NOT list_contains(w.taken, c))[1] AS given
            FROM walk w JOIN o ON o.folder = w.folder AND o.base = w.base AND o.ext = w.ext AND o.no = w.no + 1))
    SELECT idx, folder, base || CASE WHEN given > 0 THEN ' (' || given || ')' ELSE '' END || ext AS free_name FROM walk WHERE idx IS NOT NULL"""
)
def free_names_in_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that ask for several counts of a base, beside those that are in their folders already."""
    lines = V.table(spark, sf_dir, "lineitem")
    counted = lambda count: F.concat(F.lit("img"), (F.col("l_partkey") % 200).cast("string"), F.when(count > 0, F.concat(F.lit(" ("), count.cast("long").cast("string"), F.lit(")"))).otherwise(F.lit("")), F.when(F.col("l_tax") > 0.04, ".png").otherwise(".jpg"))
    folder = F.concat(F.lit("/d"), (F.col("l_suppkey") % 3).cast("string")).alias("folder")
    before = lambda day: F.col("l_shipdate") < F.lit(day).cast("timestamp_ntz")
    wanted = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") % 4).otherwise(0)
    names = lines.where(before("1998-01-01")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), folder, counted(wanted).alias("name"))
    there = lines.where(~before("1998-01-01")).select(folder, counted(F.col("l_quantity") % 9).alias("name"))
    return conflicts.free_names(names, there)


# --- rights ----------------------------------------------------------------------------------------------------------


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.rights(spark, sf_dir)
    own = rights.merged([F.col("xmp"), F.col("iim"), F.col("exif")])
    return r.select("file", own.alias("own"), "added").withColumn("wanted", rights.merged([F.col("own"), F.col("added")]))


@_query(_with(V.RIGHTS_SQL) + "SELECT file, creator[1] AS creator, credit, copyright, web, licensor[1] AS licensor FROM own")
def rights_first_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("own")
    first = lambda c: F.get(c, F.lit(0))
    return _own(spark, sf_dir).select("file", first(o["creator"]).alias("creator"), o["credit"].alias("credit"), first(o["copyright"])["value"].alias("copyright"), o["webStatement"].alias("web"), first(o["licensorUrl"]).alias("licensor"))


_FIELDS = "list_filter([CASE WHEN {0}.creator IS NOT NULL THEN 'creator' END, CASE WHEN {0}.credit IS NOT NULL THEN 'credit' END, CASE WHEN {0}.copyright IS NOT NULL THEN 'copyright' END, CASE WHEN {0}.web IS NOT NULL THEN 'webStatement' END, CASE WHEN {0}.licensor IS NOT NULL THEN 'licensorUrl' END], lambda x: x IS NOT NULL)"


@_query(_with(V.RIGHTS_SQL) + f"SELECT file, array_to_string(list_filter({_FIELDS.format('wanted')}, lambda f: NOT list_contains({_FIELDS.format('own')}, f)), ',') AS added FROM wanted JOIN own USING (file)")
def rights_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).select("file", F.array_join(rights.added_fields(F.col("own"), F.col("wanted")), ",").alias("added"))


@_query(
    _with(V.RIGHTS_SQL)
    + f"""SELECT file, CASE WHEN n = 1 THEN m[1] ELSE array_to_string(m[1:n - 1], ', ') || ' and ' || m[n] END AS missing FROM (
        SELECT file, list_filter({_FIELDS.format("wanted")}, lambda f: NOT list_contains({_FIELDS.format("own")}, f)) AS m, len(m) AS n FROM wanted JOIN own USING (file)) WHERE n > 0"""
)
def rights_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a kept file lacks of the wanted fields, as a phrase."""
    outs = _own(spark, sf_dir).select("file", rights.fields_of(F.col("wanted")).alias("wanted"), rights.fields_of(F.col("own")).alias("carried"))
    return rights.missing_fields(outs).select("file", X.listed(F.col("missing")).alias("missing"))


_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_N = rights.NAMESPACE
_PACKET = f"""'{rights.PACKET[0]}<rdf:Description rdf:about=""'
    || CASE WHEN {{0}}.creator IS NOT NULL OR {{0}}.copyright IS NOT NULL THEN ' xmlns:dc="{_N["dc"]}"' ELSE '' END || CASE WHEN {{0}}.credit IS NOT NULL THEN ' xmlns:photoshop="{_N["photoshop"]}"' ELSE '' END
    || CASE WHEN {{0}}.web IS NOT NULL THEN ' xmlns:xmpRights="{_N["xmpRights"]}"' ELSE '' END || CASE WHEN {{0}}.licensor IS NOT NULL THEN ' xmlns:plus="{_N["plus"]}"' ELSE '' END
    || CASE WHEN {{0}}.credit IS NOT NULL THEN ' photoshop:Credit="' || {_ESC.format("{0}.credit")} || '"' ELSE '' END || CASE WHEN {{0}}.web IS NOT NULL THEN ' xmpRights:WebStatement="' || {_ESC.format("{0}.web")} || '"' ELSE '' END
    || CASE WHEN {{0}}.creator IS NULL AND {{0}}.copyright IS NULL AND {{0}}.licensor IS NULL THEN '/>' ELSE '>'
    || CASE WHEN {{0}}.creator IS NOT NULL THEN '<dc:creator><rdf:Seq>' || array_to_string(list_transform({{0}}.creator, lambda v: '<rdf:li>' || {_ESC.format("v")} || '</rdf:li>'), '') || '</rdf:Seq></dc:creator>' ELSE '' END
    || CASE WHEN {{0}}.copyright IS NOT NULL THEN '<dc:rights><rdf:Alt><rdf:li xml:lang="x-default">' || {_ESC.format("{0}.copyright")} || '</rdf:li></rdf:Alt></dc:rights>' ELSE '' END
    || CASE WHEN {{0}}.licensor IS NOT NULL THEN '<plus:Licensor><rdf:Bag>' || array_to_string(list_transform({{0}}.licensor, lambda v: '<rdf:li rdf:parseType="Resource"><plus:LicensorURL>' || {_ESC.format("v")} || '</plus:LicensorURL></rdf:li>'), '') || '</rdf:Bag></plus:Licensor>' ELSE '' END || '</rdf:Description>' END || '{rights.PACKET[1]}'"""


@_query(_with(V.RIGHTS_SQL) + f"SELECT file, {_PACKET.format('wanted')} AS packet FROM wanted")
def xmp_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).select("file", rights.xmp_packet(F.col("wanted")).alias("packet"))


_HAS = f"len({_FIELDS.format('own')}) > 0 AND len({_FIELDS.format('wanted')}) > len({_FIELDS.format('own')})"


@_query(
    _with(V.RIGHTS_SQL)
    + f"""SELECT file, CAST(t AS INTEGER) AS tier, CASE t WHEN 0 THEN octet_length(encode({_PACKET.format("wanted")})) WHEN two THEN NULL ELSE octet_length(encode({_PACKET.format("own")})) END AS packet
    FROM (SELECT *, CASE WHEN {_HAS} THEN 2 ELSE 1 END AS two, unnest(CASE WHEN {_HAS} THEN CASE WHEN file % 9 = 0 THEN [0, 1] ELSE [0, 1, 2] END ELSE CASE WHEN file % 9 = 0 THEN [0] ELSE [0, 1] END END) AS t FROM own JOIN wanted USING (file))
    JOIN own USING (file) JOIN wanted USING (file)"""
)
def rights_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = rights.tiers(F.col("own"), F.col("wanted"), False, F.col("file") % 9 == 0)
    return _own(spark, sf_dir).select("file", F.explode(tiers).alias("t")).select("file", "t.tier", F.col("t.packet").cast("long").alias("packet"))


@_query("SELECT doc_id, replace(replace(replace(" + _ESC.format("'<a href=\"' || text || '\">&'") + ", chr(9), '&#9;'), chr(10), '&#10;'), chr(13), '&#13;') AS escaped FROM documents")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, line ends and tabs among them."""
    return V.table(spark, sf_dir, "documents").select("doc_id", X.escape_xml(F.concat(F.lit('<a href="'), "text", F.lit('">&'))).alias("escaped"))


@_query("SELECT doc_id, nullif(regexp_replace(regexp_replace(chr(10) || '  ' || text || chr(1) || ' ', '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS value FROM documents")
def trim_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of every document, padded."""
    return V.table(spark, sf_dir, "documents").select("doc_id", X.trimmed(F.concat(F.lit("\n  "), "text", F.lit("\x01 "))).alias("value"))


# --- bytes, ranges and pixels ----------------------------------------------------------------------------------------


@_query(
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'avif' WHEN 4 THEN 'avif' WHEN 5 THEN 'svg' WHEN 6 THEN NULL END AS format, page_id % 8 = 4 AS is_sequence FROM pages"""
)
def sniff_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of byte rows: a header by the page's number, then the page; the last kinds are no image."""
    heads = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"RIFF\x10\x00\x00\x00WEBP", b"\x00\x00\x00\x18ftypmif1\x00\x00\x00\x00avifmiaf", b"\x00\x00\x00\x1cftypmif1\x00\x00\x00\x00avisavifmiaf", '﻿<?xml version="1.0"?>\n<!-- a --><!DOCTYPE svg>\n<svg xmlns="x">'.encode(), b"RIFF\x10\x00\x00\x00WAVE", b""]
    head = F.get(F.array(*[F.lit(h) for h in heads]), (F.col("page_id") % 8).cast("int"))
    each = V.table(spark, sf_dir, "pages").select("page_id", F.concat(head, F.encode("html", "UTF-8")).alias("content"))
    return each.select("page_id", sniff.detected_format(F.col("content")).alias("format"), sniff.is_avif_sequence(F.col("content")).alias("is_sequence"))


@_query("SELECT page_id, regexp_replace(html, '<!--[^!].*?-->', '', 'gs') AS markup FROM pages")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "pages").select("page_id", X.without_comments(F.col("html")).alias("markup"))


_RANGES = "ranges AS (SELECT l_orderkey AS file, CAST(l_linenumber * 1000 + l_partkey % 700 AS BIGINT) AS start, CAST(l_linenumber * 1000 + l_partkey % 700 + l_quantity * 12 AS BIGINT) AS \"end\" FROM lineitem)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 700).cast("long")
    return V.lines(spark, sf_dir).select(F.col("l_orderkey").alias("file"), start.alias("start"), F.rint(start + F.col("l_quantity") * 12).cast("long").alias("end"))  # SQL's cast rounds, halves to even


_MERGED = """merged AS (SELECT file, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY file ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM ranges)) GROUP BY file, island)"""


@_query(_with(_RANGES, _MERGED) + "SELECT * FROM merged")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.merged_ranges(_ranges(spark, sf_dir), ["file"])


@_query(_with(_RANGES, _MERGED) + """SELECT file, o.offset_ AS "offset", o.offset_ - CAST(coalesce(sum(m."end" - m.start), 0) AS BIGINT) AS moved FROM (SELECT DISTINCT file, start + 37 AS offset_ FROM ranges) o LEFT JOIN merged m USING (file) WHERE true AND (m."end" <= o.offset_ OR m.file IS NULL OR true) GROUP BY file, offset_""".replace('sum(m."end" - m.start)', 'sum(CASE WHEN m."end" <= o.offset_ THEN m."end" - m.start END)').replace("WHERE true AND (m.\"end\" <= o.offset_ OR m.file IS NULL OR true) ", ""))
def offset_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir)
    offsets = r.select("file", (F.col("start") + 37).alias("offset")).distinct()
    rows = 2 * V.table(spark, sf_dir, "lineitem").count()
    return ranges.moved_offsets(offsets, ranges.merged_ranges(r, ["file"]), ["file"], rows)


@_query("SELECT l_orderkey AS file, l_linenumber AS pixel, CAST(floor((v * a + 255 * (255 - a)) / 255 + 0.5) AS BIGINT) AS on_white, CAST(floor(v * a / 255 + 0.5) AS BIGINT) AS on_black FROM (SELECT *, l_partkey % 256 AS v, l_suppkey * 7 % 256 AS a FROM lineitem)")
def flatten_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, a = F.col("l_partkey") % 256, F.col("l_suppkey") * 7 % 256
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("pixel"), geometry.flattened(v, a, F.lit(255)).alias("on_white"), geometry.flattened(v, a, F.lit(0)).alias("on_black"))


@_query("SELECT file, pixel, CAST(floor(g + 255 * h + 0.5) AS BIGINT) AS red, CAST(floor(g + 255 * h * h + 0.5) AS BIGINT) AS green, CAST(floor(g + 0.5) AS BIGINT) AS blue FROM (SELECT *, (r * 0.2126::DOUBLE + r2 * 0.7152::DOUBLE + 9 * 0.0722::DOUBLE) * 0.5::DOUBLE * (1 - h) AS g FROM (SELECT l_orderkey AS file, l_linenumber AS pixel, l_partkey % 256 AS r, l_suppkey % 256 AS r2, least(1.0::DOUBLE, (l_partkey % 64) * 8 / 255) AS h FROM lineitem))")
def diff_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = geometry.heat(F.col("l_partkey") % 64)
    colours = geometry.heat_colour(geometry.luma(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.lit(9)), hot)
    whole = [F.floor(c + 0.5).cast("long").alias(n) for c, n in zip(colours, ("red", "green", "blue"), strict=True)]
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("pixel"), *whole)


@_query(_with(V.CANDIDATES_SQL) + "SELECT file, format, least(100, min(score)) AS score FROM candidates GROUP BY file, format")
def score_min_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.candidates(spark, sf_dir).groupBy("file", "format").agg(F.least(F.lit(100), F.min("score")).alias("score"))


@_query(_with(V.FILES_SQL) + "SELECT file, least(width, 1600) AS width, CASE WHEN width <= 1600 THEN height ELSE CAST(greatest(1, floor(height * 1600 / width + 0.5)) AS BIGINT) END AS height FROM files")
def resize_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).select("file", F.least("width", F.lit(1600)).alias("width"), geometry.fitted_height(F.col("width"), F.col("height"), F.lit(1600)).alias("height"))


@_query(_with(V.FILES_SQL) + "SELECT file, CASE WHEN width * height <= 26000000 THEN width ELSE CAST(greatest(8, floor(width * sqrt(26000000.0::DOUBLE / (width * height)))) AS BIGINT) END AS width, CASE WHEN width * height <= 26000000 THEN height ELSE CAST(greatest(8, floor(height * sqrt(26000000.0::DOUBLE / (width * height)))) AS BIGINT) END AS height FROM files")
def downscale_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return V.files(spark, sf_dir).select("file", geometry.scored_side(w, w, h).alias("width"), geometry.scored_side(h, w, h).alias("height"))


@_query(_with(V.FILES_SQL) + "SELECT file, len(list_distinct([floor(least(base, most) * 1000), floor(least(base * 2, most) * 1000)])) AS densities, CAST(floor(least(base, most) * 1000) AS BIGINT) AS first FROM (SELECT file, greatest(1.0::DOUBLE, 64.0::DOUBLE / least(width, height)) AS base, sqrt(26000000.0::DOUBLE / (CAST(width AS DOUBLE) * height)) AS most FROM files)")
def render_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geometry.render_densities(F.col("width"), F.col("height"))
    whole = F.array_distinct(F.transform(d, lambda x: F.floor(x * 1000)))
    return V.files(spark, sf_dir).select("file", F.size(whole).cast("long").alias("densities"), F.get(whole, F.lit(0)).cast("long").alias("first"))


@_query()
def gzip_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sniff.gzip_sizes(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content")))


@_query()
def png_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of PNG files made of parts' names, as rows."""
    return sniff.container_rows(sniff.sample_files(V.parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "png"), "png")


_NAMED = "named AS (SELECT p_partkey AS id, octet_length(encode(p_name)) AS n FROM part)"
#: Bytes of a sample's packet besides its name.
_PACKET_BYTES = len(sniff.sample_packet(b""))


@_query(
    _with(_NAMED, f"s AS (SELECT id, unnest([0, 1, 2, 3]) AS number, unnest(['E0', 'E1', 'FE', 'DB']) AS kind, unnest([14, {29 + _PACKET_BYTES} + n, n, 65]) AS bytes FROM named)")
    + """SELECT id, number, kind, start, start + 4 + bytes AS "end", bytes FROM (SELECT *, CAST(2 + coalesce(sum(bytes + 4) OVER (PARTITION BY id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)"""
)
def jpeg_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sniff.container_rows(sniff.sample_files(V.parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "jpeg"), "jpeg")


@_query(
    _with(_NAMED, f"s AS (SELECT id, unnest([0, 1, 2, 3]) AS number, unnest(['VP8X', 'VP8 ', 'EXIF', 'XMP ']) AS kind, unnest([10, n, 10, {_PACKET_BYTES} + n]) AS bytes FROM named)")
    + """SELECT id, number, kind, start, start + 8 + bytes + bytes % 2 AS "end", bytes FROM (SELECT *, CAST(12 + coalesce(sum(8 + bytes + bytes % 2) OVER (PARTITION BY id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)"""
)
def riff_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sniff.container_rows(sniff.sample_files(V.parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "webp"), "webp")


@_query()
def strip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata removed from PNG, JPEG and WebP files, and the rights read from what was there."""
    parts = V.parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    kinds = [sniff.stripped_files(sniff.sample_files(parts.where(F.col("id") % 3 == k), kind)) for k, kind in enumerate(("png", "jpeg", "webp"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


#: What a strip takes from a sample besides the packet and the name in it, by format: heads of the parts, and parts that hold the name or nothing.
_CUTS = f"""CASE id % 4 WHEN 0 THEN 34 + {_PACKET_BYTES} + n + 20 + n WHEN 1 THEN 33 + {_PACKET_BYTES} + n + 4 + n
    WHEN 2 THEN 18 + 8 + {_PACKET_BYTES} + n + ({_PACKET_BYTES} + n) % 2 ELSE 42 + 26 + 14 + {_PACKET_BYTES} + n END"""


@_query(
    _with("named AS (SELECT p_partkey AS id, p_name AS name, octet_length(encode(p_name)) AS n FROM part)")
    + f"""SELECT id, ['png', 'jpeg', 'webp', 'avif'][id % 4 + 1] AS format, ['iTXt,tEXt', 'comment,xmp', 'EXIF,XMP', 'xmp'][id % 4 + 1] AS removed, name AS credit, CAST({_CUTS} AS BIGINT) AS cut, CAST(NULL AS VARCHAR) AS error FROM named"""
)
def metadata_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strip takes from files of all four containers, and the credit that was read there."""
    parts = V.parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    kinds = [sniff.stripped_files(sniff.sample_files(parts.where(F.col("id") % 4 == k), kind)) for k, kind in enumerate(("png", "jpeg", "webp", "avif"))]
    each = reduce(DataFrame.unionByName, kinds)
    return each.select("id", "format", "removed", F.get_json_object("rights", "$.credit").alias("credit"), (F.col("bytes") - F.col("stripped_bytes")).alias("cut"), "error")


@_query(
    _with(_NAMED, f"s AS (SELECT id, unnest([0, 1, 2]) AS number, unnest(['ftyp', 'meta', 'mdat']) AS kind, unnest([16, {len(sniff.sample_avif(b'')) - 24 - 8 - 8 + 82}, {_PACKET_BYTES} + 2 * n]) AS bytes FROM named)")
    + """SELECT id, number, kind, start, start + 8 + bytes AS "end", bytes FROM (SELECT *, CAST(coalesce(sum(bytes + 8) OVER (PARTITION BY id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)"""
)
def avif_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of AVIF files that got a packet: the item table has grown by one item, the data by the packet."""
    return sniff.container_rows(sniff.sample_files(V.parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "avif"), "avif")


# --- text, reports and warnings --------------------------------------------------------------------------------------


@_query(_with(V.FILES_SQL) + f"SELECT file, {_SIZE.format('size')} AS text FROM (SELECT file, input_bytes * (CASE file % 4 WHEN 0 THEN 1 WHEN 1 THEN 997 WHEN 2 THEN 100003 ELSE 0 END) + file % 1200 AS size FROM files)")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.when(F.col("file") % 4 == 0, 1).when(F.col("file") % 4 == 1, 997).when(F.col("file") % 4 == 2, 100003).otherwise(0)
    return V.files(spark, sf_dir).select("file", X.format_bytes(F.col("input_bytes") * times + F.col("file") % 1200).alias("text"))


@_query(_with(V.CANDIDATES_SQL) + "SELECT file, ord, printf('%.1f', floor(score / 100 * 100 * 10 + 0.5) / 10) || '%' AS percent, CASE WHEN method = 'lossy' THEN 'q' || score ELSE method || ' ' || score END AS quality FROM candidates")
def format_percent_and_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.candidates(spark, sf_dir).select("file", "ord", X.format_percent(F.col("score") / 100).alias("percent"), X.format_quality(F.col("method"), F.col("score")).alias("quality"))


@_query(_with(V.CANDIDATES_SQL) + "SELECT file, ord, bytes, rpad(CASE WHEN row_number() OVER (PARTITION BY file ORDER BY ord) = 1 THEN 'file-' || file ELSE '' END, (SELECT max(length('file-' || file)) FROM candidates)::INTEGER, ' ') AS cell, (SELECT max(length('file-' || file)) FROM candidates)::INTEGER AS width FROM candidates")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.candidates(spark, sf_dir).select("file", "ord", "bytes", F.concat(F.lit("file-"), F.col("file").cast("string")).alias("name"))
    return totals.report_rows(rows).select("file", "ord", "bytes", "cell", "width")


# Codes with the setting that helps.
HINTS = {"E_OUTPUT_IS_INPUT": "set out_dir, or in_place", "W_OUTPUT_EXISTS": "set overwrite", "W_NO_RIGHTS": "give rights, or set strip_all"}
_WARN = "warned AS (SELECT l_orderkey AS file, (['W_NO_RIGHTS', 'W_NOTICEABLE', 'W_OUTPUT_EXISTS', 'W_ICC_KEPT'])[l_suppkey % 4 + 1] AS code, 'line ' || l_linenumber AS message FROM lineitem)"


def _warned(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get(F.array(*[F.lit(c) for c in ("W_NO_RIGHTS", "W_NOTICEABLE", "W_OUTPUT_EXISTS", "W_ICC_KEPT")]), (F.col("l_suppkey") % 4).cast("int"))
    return V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.struct(code.alias("code"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("message")).alias("w"))


@_query(_with(_WARN) + "SELECT code, count(DISTINCT file) AS files, count(*) AS warnings FROM (SELECT DISTINCT file, code, message FROM warned) GROUP BY code")
def warnings_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _warned(spark, sf_dir).groupBy("file").agg(F.collect_set("w").alias("warnings"))
    return totals.warnings_by_code(files)


@_query(_with(_WARN) + "SELECT DISTINCT file, message || CASE code WHEN 'W_OUTPUT_EXISTS' THEN ' (" + HINTS["W_OUTPUT_EXISTS"] + ")' WHEN 'W_NO_RIGHTS' THEN ' (" + HINTS["W_NO_RIGHTS"] + ")' ELSE '' END AS text FROM warned")
def warnings_with_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.lit(None).cast("string")
    for code, text in HINTS.items():
        hint = F.when(F.col("w.code") == code, F.lit(f" ({text})")).otherwise(hint)
    return _warned(spark, sf_dir).select("file", F.concat("w.message", F.coalesce(hint, F.lit(""))).alias("text")).distinct()


_SHOWN = "code <> 'W_NO_RIGHTS'"


@_query(_with(_WARN) + f"""SELECT file, string_agg('  ' || message || CASE code WHEN 'W_OUTPUT_EXISTS' THEN ' ({HINTS["W_OUTPUT_EXISTS"]})' ELSE '' END, chr(10) ORDER BY code, message) FILTER ({_SHOWN}) AS notes FROM (SELECT DISTINCT file, code, message FROM warned) GROUP BY file""")
def notes_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes below each file of a report, without the code that its last line counts."""
    files = _warned(spark, sf_dir).groupBy("file").agg(F.array_sort(F.collect_set("w")).alias("warnings"))  # a file's warnings
    return files.select("file", F.nullif(totals.notes(totals.without_code(F.col("warnings"), "W_NO_RIGHTS"), HINTS), F.lit("")).alias("notes"))


@_query(_with(V.FILES_SQL) + ", w AS (SELECT max(length(input_format)) AS a, max(length(file)) AS b, max(length(width)) AS c FROM (SELECT CAST(file AS VARCHAR) AS file, input_format, CAST(width AS VARCHAR) AS width FROM files)) SELECT file, rtrim(rpad(input_format, CAST(a AS INTEGER), ' ') || '  ' || lpad(CAST(file AS VARCHAR), CAST(b AS INTEGER), ' ') || '  ' || CASE WHEN file % 7 = 0 THEN '' ELSE CAST(width AS VARCHAR) END) AS line FROM files, w")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a table, one column to the left, one to the right, one that is empty at times."""
    rows = V.files(spark, sf_dir).select("file", "input_format", F.when(F.col("file") % 7 != 0, F.col("width")).alias("shown"))
    return totals.report_lines(rows, {"input_format": "left", "file": "right", "shown": "left"}).select("file", "line")


@_query(_with(V.CANDIDATES_SQL, V.FILES_SQL) + "SELECT file, CASE WHEN min(w) < any_value(width) THEN min(w) END AS capped FROM (SELECT file, width, least(width, 4000 + bytes % 9000) AS w FROM candidates JOIN files USING (file)) GROUP BY file")
def capped_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width that a file's outputs were capped at."""
    w = V.candidates(spark, sf_dir).join(V.files(spark, sf_dir), "file").select("file", "width", F.least("width", 4000 + F.col("bytes") % 9000).alias("w"))
    outputs = w.groupBy("file", "width").agg(F.collect_list("w").alias("widths"))  # an order's lines, seven at most
    return outputs.select("file", compare.capped_width(F.col("widths"), F.col("width")).alias("capped"))


@_query(_with(_WARN) + "SELECT count(*) FILTER (n) AS without_rights, count(*) AS files FROM (SELECT file, bool_or(code = 'W_NO_RIGHTS') AS n FROM warned GROUP BY file)")
def no_rights_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _warned(spark, sf_dir).groupBy("file").agg(F.bool_or(F.col("w.code") == "W_NO_RIGHTS").alias("n"))
    return each.agg(F.count_if("n").alias("without_rights"), F.count("*").alias("files"))


# --- events ----------------------------------------------------------------------------------------------------------


@_query(_with(V.EVENTS_SQL) + 'SELECT user_ AS "user", seq, type, row_number() OVER (PARTITION BY user_ ORDER BY ts, seq) AS position FROM ev')
def events_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ordered(V.events(spark, sf_dir))


@_query(_with(V.EVENTS_SQL) + "SELECT user_ AS \"user\", seq, CAST(count(*) FILTER (type IN ('file-done', 'file-failed')) OVER w AS BIGINT) AS done, CAST(count(*) FILTER (type = 'file-start') OVER w AS BIGINT) AS started FROM ev WINDOW w AS (PARTITION BY user_ ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)")
def events_running_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.running_done(V.events(spark, sf_dir))


@_query(_with(V.EVENTS_SQL) + """SELECT user_ AS "user", arg_max(type, (ts, seq)) FILTER (type <> 'settings') AS state, count(*) FILTER (type = 'settings') AS version FROM ev GROUP BY user_""")
def events_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest_state(V.events(spark, sf_dir))


@_query(_with(V.EVENTS_SQL) + """SELECT user_ AS "user", seq, value FROM (SELECT *, count(*) FILTER (type = 'settings') OVER (PARTITION BY user_ ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS version, count(*) FILTER (type = 'settings') OVER (PARTITION BY user_) AS last FROM ev) WHERE version = last AND type = 'file-done'""")
def events_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest_wins(V.events(spark, sf_dir))


@_query(_with(V.EVENTS_SQL) + """SELECT user_ AS "user", session, count(*) AS events, arg_max(value, (ts, seq)) AS value FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_ ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_ ORDER BY ts, seq) > INTERVAL 6 HOUR, true) AS gap FROM ev)) GROUP BY user_, session""")
def events_debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.debounced(V.events(spark, sf_dir), "6 hours")


@_query(_with(V.EVENTS_SQL) + "SELECT CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS day, type, count(*) AS n FROM ev GROUP BY 1, 2")
def events_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by a stream over the events file, run until nothing is left."""
    return E.stream_daily_counts(spark, sf_dir)


# --- plain plans of the star schema ----------------------------------------------------------------------------------


@_query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def setting_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by setting, as of a bench of encoders."""
    rows = V.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.count("*").alias("n"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@_query(_with(V.FILES_SQL) + "SELECT file, input_format, CAST((row_number() OVER (ORDER BY input_bytes DESC, file) - 1) % 8 AS INTEGER) AS shard FROM files")
def shards_largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inputs, the largest first, dealt to eight shards in turn."""
    ranked = totals.ranked(V.files(spark, sf_dir).select("file", "input_format", "input_bytes"), F.col("input_bytes").desc(), F.col("file"))
    return ranked.select("file", "input_format", (F.col("rank") % 8).cast("int").alias("shard"))


assert set(RIGHTS_FIELDS) == set(rights.PREFIX)

from quern.plans import headers, metadata, sessions, streams  # noqa: E402, F401 (they add their queries)
