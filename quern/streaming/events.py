"""A run's events: order, progress, the last state of each key, and streams of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.shared import shared_path

_ORDER = ("ts", "seq")
_FINISHED = ("file-done", "file-failed")


def _by_user(rows: bool = False):
    w = Window.partitionBy("user").orderBy(*_ORDER)
    return w.rowsBetween(Window.unboundedPreceding, 0) if rows else w


def ordered(events: DataFrame) -> DataFrame:
    """Each key's events with their places in time."""
    return events.select("user", "seq", "type", F.row_number().over(_by_user()).cast("long").alias("position"))


def running_done(events: DataFrame) -> DataFrame:
    """After each event how many files of its key have started and finished."""
    count = lambda cond: F.count_if(cond).over(_by_user(True))
    return events.select("user", "seq", count(F.col("type").isin(*_FINISHED)).alias("done"), count(F.col("type") == "file-start").alias("started"))


def latest_state(events: DataFrame) -> DataFrame:
    """Per key the type of its last file event and how often its settings changed."""
    key = F.when(F.col("type") != "settings", F.struct(*_ORDER))
    return events.groupBy("user").agg(F.max_by("type", key).alias("state"), F.count_if(F.col("type") == "settings").alias("version"))


def latest_wins(events: DataFrame) -> DataFrame:
    """Finished files that came after their key's last change of settings; earlier ones are superseded."""
    changed = F.max(F.when(F.col("type") == "settings", F.struct(*_ORDER))).over(Window.partitionBy("user"))
    late = changed.isNull() | (F.struct(*_ORDER) > changed)
    return events.withColumn("late", late).where(F.col("late") & (F.col("type") == "file-done")).select("user", "seq", "value")


def debounced(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a key's events with pauses of `gap` at most: their number and the last one's value."""
    pause = F.col("ts") - F.lag("ts").over(_by_user())
    starts = F.coalesce(pause > F.expr(f"INTERVAL {gap}"), F.lit(True))
    numbered = events.withColumn("starts", starts).withColumn("session", F.count_if("starts").over(_by_user(True)))
    return numbered.groupBy("user", "session").agg(F.count("*").alias("events"), F.max_by("value", F.struct(*_ORDER)).alias("value"))


def image_states(events: DataFrame) -> DataFrame:
    """What reduce_states() has after all events, as a batch: (user, state, version). Without a file event a key is queued; a
    change of settings after the last one queues a finished file again."""
    is_file = F.col("type") != "settings"
    last = F.max_by("type", F.when(is_file, F.struct(*_ORDER)))
    file_at, changed_at = F.max(F.when(is_file, F.struct(*_ORDER))), F.max(F.when(~is_file, F.struct(*_ORDER)))
    sums = events.groupBy("user").agg(last.alias("last"), file_at.alias("file_at"), changed_at.alias("changed_at"), F.count_if(~is_file).alias("version"))
    again = F.col("last").isNull() | ((F.col("last") == "file-done") & (F.col("changed_at") > F.col("file_at")))
    return sums.select("user", F.when(again, "queued").otherwise(F.col("last")).alias("state"), "version")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event files of a folder as a stream, with a time that watermarks accept."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, type, n) by a windowed stream with a watermark, over all files there are; the sink is a table that outlives it."""
    base, name = shared_path(spark, "stream"), F.col("event_type")
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    kind = F.when(name == "view", "file-start").when(name == "error", "file-failed").when(name == "click", "settings").otherwise("file-done")
    counts = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), kind.alias("type")).agg(F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "type", "n").write.mode("overwrite").parquet(f"{base}/out/{number}")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    schema = "day string, type string, n long"
    parts = [spark.read.schema(schema).parquet(f"{base}/out/{n}") for n in range(last, -1, -1)][:1]
    return parts[0]


def reduce_states(stream: DataFrame) -> DataFrame:
    """A stateful reducer over a stream of (user, seq, type, ts): after each batch a key's state and version. A change of settings re-queues a finished file."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, version = state.get if state.exists else ("queued", 0)
        for rows in batches:
            for kind in rows.sort_values(["ts", "seq"])["type"]:
                if kind == "settings":
                    version, status = version + 1, "queued" if status == "file-done" else status
                else:
                    status = kind
        state.update((status, version))
        yield pd.DataFrame({"user": [key[0]], "state": [status], "version": [version]})

    return stream.groupBy("user").applyInPandasWithState(step, "user long, state string, version long", "state string, version long", "update", "NoTimeout")


def parse_event_stream(lines: DataFrame) -> DataFrame:
    """Text of server-sent events (value: a block, or blocks with blank lines between them) to (event, data): fields of a block are joined, comments left out."""
    block = F.explode(F.split(F.regexp_replace("value", "\\r\\n?", "\n"), "\n\n+")).alias("block")
    rows = F.split("block", "\n")
    field = lambda name: F.array_join(F.transform(F.filter(rows, lambda r: r.startswith(f"{name}:")), lambda r: F.regexp_replace(r, f"^{name}: ?", "")), "\n")
    parsed = lines.select(block).select(F.nullif(field("event"), F.lit("")).alias("event"), field("data").alias("data"))
    return parsed.where("data <> ''").select(F.coalesce("event", F.lit("message")).alias("event"), "data")
