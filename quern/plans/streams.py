"""Stateful streams over the events table, run in parts, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans import views as V
from quern.plans.catalogue import _query, _with
from quern.streaming import stateful as S

_HOUR = 3_600_000_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.events(spark, sf_dir).withColumnRenamed("user", "key").withColumn("at", S.micros())


def _in_time(events: DataFrame) -> list[DataFrame]:
    """The first half of the month and the second."""
    return [events.where(F.dayofmonth("ts") <= 15), events.where(F.dayofmonth("ts") > 15)]


def _shuffled(events: DataFrame, *by: Column | str) -> list[DataFrame]:
    """Two parts of no order at all."""
    half = F.pmod(F.xxhash64(*by), F.lit(2))
    return [events.where(half == k) for k in (0, 1)]


_AT = _with(V.EVENTS_SQL) + ", e AS (SELECT *, user_ AS key, epoch_us(ts) AS t FROM ev), horizon AS (SELECT max(t) // 1000 * 1000 AS h FROM e)"
_REST, _TAKES = 6 * _HOUR, 20 * _HOUR


@_query(
    _AT.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", c AS (SELECT key, t, seq, value % 3 AS value, lead(t) OVER (PARTITION BY key ORDER BY t, seq) AS next FROM e),
    per AS (SELECT key, list({{'t': t, 'value': value}} ORDER BY t, seq) AS changes, list({{'t': t + {_REST}, 'value': value}} ORDER BY t, seq) FILTER (next IS NULL OR next > t + {_REST}) AS rests FROM c GROUP BY key),
    asks AS (SELECT key, rests[1].t AS asked_at, rests[1].value AS value FROM per UNION ALL
        SELECT key, asked.t, asked.value FROM (SELECT key, CASE WHEN moved.value <> value THEN {{'t': back, 'value': moved.value}} ELSE list_filter(rests, lambda r: r.t >= back)[1] END AS asked
            FROM (SELECT *, asked_at + {_TAKES} AS back, list_filter(changes, lambda c: c.t <= asked_at + {_TAKES})[-1] AS moved FROM asks JOIN per USING (key))) WHERE asked IS NOT NULL)
    SELECT key, asked_at, value FROM asks, horizon WHERE asked_at < h"""
)
def stream_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a slider: six hours of rest, one under way for twenty, another at once where the value has moved; up to the last event."""
    moves = _events(spark, sf_dir).select("key", "ts", "at", "seq", (F.col("value") % 3).alias("value"))
    ran = S.run_in_parts(spark, _in_time(moves), lambda s: S.stateful(S.timed(s), S.Debounced(_REST, _TAKES), timed=True), S.Debounced.schema, "debounced")
    return ran.drop("batch")


_SETTLE = 12 * _HOUR


@_query(
    _AT
    + f""", s AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT key, t, seq, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS version, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t, seq) < {_SETTLE} THEN 0 ELSE 1 END AS opens FROM e WHERE type = 'settings')),
    ends AS (SELECT key, min((t, seq)) AS first, max(t) + {_SETTLE} AS settled, max(version) AS version FROM s GROUP BY key, session),
    r AS (SELECT e.key, e.seq, e.value, e.t, max_by((settled, version), first) AS last FROM e LEFT JOIN ends ON ends.key = e.key AND ends.first < (e.t, e.seq) WHERE e.type = 'file-done' GROUP BY ALL)
    SELECT key, seq, value, version, released_at FROM (SELECT key, seq, value, coalesce(last[2], 0) AS version, CASE WHEN t < last[1] THEN last[1] ELSE t END AS released_at FROM r), horizon WHERE released_at <= h OR released_at = (SELECT max(t) FROM e)"""
)
def stream_results_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished files, held while settings change and for twelve hours after; up to the last event."""
    kinds = F.when(F.col("type") == "settings", "settings").when(F.col("type") == "file-done", "result")
    rows = _events(spark, sf_dir).withColumn("kind", kinds)
    seen = rows.where("kind IS NOT NULL").select("key", "ts", "at", "seq", "kind", "value")
    # events that are neither still move the time on: the latest of each part does
    late = F.dayofmonth("ts") > 15
    latest = rows.where("kind IS NULL").groupBy(late.alias("late")).agg(F.max("ts").alias("ts"))
    seen = seen.unionByName(latest.select(F.lit(-1).cast("long").alias("key"), "ts", S.micros().alias("at"), F.lit(-1).cast("long").alias("seq"), F.lit("none").alias("kind"), F.lit(0).cast("long").alias("value")))
    ran = S.run_in_parts(spark, _in_time(seen), lambda s: S.stateful(S.timed(s), S.Held(_SETTLE), timed=True), S.Held.schema, "held")
    return ran.where("key >= 0").drop("batch")


@_query(
    _with(V.EVENTS_SQL)
    + """, n AS (SELECT user_ AS key, type, row_number() OVER (PARTITION BY user_ ORDER BY ts, seq) - 1 AS index, count(*) OVER (PARTITION BY user_) AS events FROM ev),
    kept AS (SELECT * FROM n WHERE key % 5 <> 0 OR index < events // 2)
    SELECT key, index + 1 AS position, type, index FROM kept UNION ALL SELECT key, 0, 'run-start', NULL FROM n WHERE index = 0 UNION ALL SELECT key, events + 1, 'run-done', NULL FROM n WHERE index = 0 AND key % 5 <> 0"""
)
def stream_runs_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of runs, some of them sent twice, put in order between run-start and run-done; a fifth of the runs is aborted half-way."""
    w = Window.partitionBy("key")
    n = _events(spark, sf_dir).select("key", "type", (F.row_number().over(w.orderBy("ts", "seq")) - 1).cast("long").alias("index"), F.count("*").over(w).alias("events"))
    aborts = (F.col("key") % 5 == 0) & (F.col("index") >= F.expr("events div 2"))
    sent = n.select("key", F.when(aborts & (F.col("index") == F.expr("events div 2")), "run-abort").otherwise(F.col("type")).alias("type"), "index", "events").withColumn("copy", F.lit(0))
    again = sent.where("index % 10 = 3").withColumn("copy", F.lit(1))
    starts = n.where("index = 0").select("key", F.lit("run-start").alias("type"), F.lit(-1).cast("long").alias("index"), "events", F.lit(0).alias("copy"))
    rows = sent.unionByName(again).unionByName(starts)
    return S.run_in_parts(spark, _shuffled(rows, "key", "index", "copy"), lambda s: S.stateful(s, S.InOrder()), S.InOrder.schema, "ordered").drop("batch")


#: An event's action: views add or start; files that end finish, save or are replaced; errors fail; changes of settings queue again or write rights.
_ACTION_SQL = """CASE type WHEN 'file-start' THEN CASE WHEN seq % 3 = 0 THEN 'add' ELSE 'start' END WHEN 'file-failed' THEN CASE seq % 4 WHEN 0 THEN 'save-fail' WHEN 1 THEN 'save-drop' ELSE 'fail' END
    WHEN 'settings' THEN CASE seq % 5 WHEN 0 THEN 'requeue' WHEN 1 THEN 'save-start' ELSE 'rights' END ELSE CASE seq % 6 WHEN 0 THEN 'replaced' WHEN 1 THEN 'save-done' WHEN 2 THEN 'save-start' ELSE 'finish' END END"""


@_query(
    _with(V.EVENTS_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", a AS (SELECT user_ AS key, {_ACTION_SQL} AS action, seq % 3 AS pane, value - 2000 AS value, row_number() OVER (PARTITION BY user_ ORDER BY ts, seq) AS no FROM ev),
    walk AS (SELECT key, 0 AS no, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS bytes, CAST(NULL AS BIGINT) AS result, CAST(NULL AS BOOLEAN) AS error, CAST(NULL AS BOOLEAN) AS replaced, CAST(NULL AS BIGINT) AS rewrites FROM a GROUP BY key
        UNION ALL SELECT key, a.no,
            CASE WHEN fresh OR status IS NOT NULL AND action = 'requeue' THEN 'queued' WHEN status IS NULL THEN NULL WHEN action = 'start' THEN 'processing' WHEN action = 'finish' THEN CASE WHEN value < 0 THEN 'failed' ELSE 'done' END WHEN action = 'fail' AND status IN ('queued', 'processing') THEN 'failed' ELSE status END,
            CASE WHEN fresh THEN value ELSE bytes END,
            CASE WHEN fresh OR action = 'requeue' OR status IS NULL THEN NULL WHEN action = 'finish' THEN value WHEN action = 'rights' THEN result + value ELSE result END,
            CASE WHEN fresh THEN false WHEN status IS NULL THEN NULL WHEN action = 'requeue' THEN false WHEN action = 'finish' THEN value < 0 WHEN action = 'fail' AND status IN ('queued', 'processing') THEN true ELSE error END,
            CASE WHEN fresh THEN false WHEN status IS NULL THEN NULL WHEN action = 'requeue' THEN false WHEN action = 'replaced' THEN true ELSE replaced END,
            CASE WHEN fresh THEN 0 WHEN status IS NULL THEN NULL WHEN action = 'requeue' THEN 0 WHEN action = 'rights' AND result IS NOT NULL THEN rewrites + 1 ELSE rewrites END
        FROM (SELECT w.*, a.action, a.value, a.no AS next_no, a.action = 'add' AND (w.status IS NULL OR w.replaced) AS fresh FROM walk w JOIN a ON a.key = w.key AND a.no = w.no + 1) AS a(key, before, status, bytes, result, error, replaced, rewrites, action, value, no, fresh)),
    last AS (SELECT key, status, bytes, result, error, replaced, rewrites FROM walk QUALIFY row_number() OVER (PARTITION BY key ORDER BY no DESC) = 1),
    saves AS (SELECT key, string_agg(pane || ':' || CASE action WHEN 'save-start' THEN 'saving' WHEN 'save-done' THEN 'saved' ELSE 'failed' END, ',' ORDER BY pane) AS saves FROM (
        SELECT key, pane, max_by(action, no) AS action FROM a WHERE action LIKE 'save-%' GROUP BY key, pane) WHERE action <> 'save-drop' GROUP BY key)
    SELECT last.*, coalesce(saves, '') AS saves FROM last LEFT JOIN saves USING (key)"""
)
def stream_images_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened images and the saves of their panes after all actions."""
    rows = _events(spark, sf_dir).select("key", "ts", "at", "seq", F.expr(_ACTION_SQL).alias("action"), (F.col("seq") % 3).alias("pane"), (F.col("value") - 2000).alias("value"))
    ran = S.run_in_parts(spark, _in_time(rows), lambda s: S.stateful(s, S.Images()), S.Images.schema, "images")
    return ran.groupBy("key").agg(F.max_by(F.struct(*[c for c in ran.columns if c not in ("key", "batch")]), "batch").alias("s")).select("key", "s.*")


@_query(_with(V.EVENTS_SQL) + "SELECT user_ AS key, row_number() OVER (PARTITION BY user_ ORDER BY ts, seq) - 1 AS place, type AS event, CAST(seq AS VARCHAR) || chr(10) || value AS data FROM ev")
def stream_blocks_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's events as text in pieces of 23 characters, out of order, some of them sent twice, put together and parsed."""
    end = F.when(F.col("seq") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    block = F.concat(F.lit(": note"), end, F.lit("event: "), "type", end, F.lit("data: "), F.col("seq").cast("string"), end, F.lit("data:"), F.col("value").cast("string"), end, end)
    # a run's events, one text each
    runs = _events(spark, sf_dir).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq", block.alias("block")))), lambda x: x["block"]), "").alias("text"))
    pieces = runs.select("key", F.posexplode(F.expr("transform(sequence(0, (length(text) - 1) div 23), i -> substring(text, i * 23 + 1, 23))")).alias("number", "text")).withColumn("number", F.col("number").cast("long"))
    sent = pieces.withColumn("copy", F.lit(0)).unionByName(pieces.where("number % 7 = 2").withColumn("copy", F.lit(1)))
    return S.run_in_parts(spark, _shuffled(sent, "key", "number", "copy"), lambda s: S.stateful(s, S.Blocks()), S.Blocks.schema, "blocks").drop("batch")


_UNDER_WAY, _KEPT = 10 * _HOUR, 72 * _HOUR


@_query(
    _AT.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", r AS (SELECT key, t, seq, t + CASE WHEN type = 'file-failed' THEN {_UNDER_WAY} ELSE {_KEPT} END AS ends, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS no FROM e),
    made AS (SELECT key, no, seq, ends FROM r WHERE no = 1 UNION ALL SELECT key, n.no, n.seq, n.ends FROM (SELECT made.key, min_by(r, r.no) AS n FROM made JOIN r ON r.key = made.key AND r.no > made.no AND r.t >= made.ends GROUP BY made.key))
    SELECT r.key, r.seq, m.no = r.no AS made, m.seq AS served_by FROM r ASOF JOIN made m ON r.key = m.key AND r.no >= m.no"""
)
def stream_requests_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that are made and those that another one serves: ten hours under way, 72 kept, failed ones forgotten."""
    rows = _events(spark, sf_dir).select("key", "ts", "at", "seq", (F.col("type") != "file-failed").alias("ok"))
    return S.run_in_parts(spark, _in_time(rows), lambda s: S.stateful(S.timed(s), S.Remembered(_UNDER_WAY, _KEPT), timed=True), S.Remembered.schema, "requests").drop("batch")
