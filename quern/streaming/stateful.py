"""Streams with state of their own: debounced requests, held results, ordered runs, reduced images, reassembled text and remembered requests.

Each is a processor for transformWithState over a stream keyed by one column. Times within are microseconds of the
events, so that what comes out depends on the events and not on how batches cut them; timers follow the watermark. A
batch's rows of a key are put in order first. What a key keeps is bounded by what is open for it, as each docstring says.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern import reachable
from quern.shared import shared_path
from quern.sinks import batch_writer

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NEVER = -1


def _ordered(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator:
    return pd.concat(list(batches)).sort_values(list(by)).itertuples(index=False)


_DTYPES = {"long": "Int64", "boolean": "boolean", "string": object}


def _frame(schema: str, rows: Sequence[tuple]) -> pd.DataFrame:
    """Rows of a schema of longs, booleans and strings."""
    fields = [f.split() for f in schema.split(", ")]
    return pd.DataFrame({name: pd.Series([r[k] for r in rows], dtype=_DTYPES[kind]) for k, (name, kind) in enumerate(fields)})


class _Timed(StatefulProcessor):
    """One timer a key, at the earliest time at which something is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _due(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at != _NEVER:
            self.handle.registerTimer(-(-at // 1000))


class Debounced(_Timed):
    """Changes (at, seq, value) of a key to requests (key, asked_at, value): one once a change has rested for `rest`, one in flight at a time.

    A request takes `takes`. If the value has moved when it comes back, the new one is asked for at once; rests that end
    meanwhile ask for nothing. At equal times changes come first, then what comes back, then rests. Kept: four numbers.
    """

    schema = "key long, asked_at long, value long"

    def __init__(self, rest: int, takes: int):
        self.rest, self.takes = rest, takes

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pane = handle.getValueState("pane", "wanted long, rests_at long, asked long, back_at long")

    def _until(self, s: list[int], until: int, out: list[tuple]) -> None:
        """s: [wanted, rests_at, asked, back_at]."""
        while True:
            _, rests, asked, back = s
            if back != _NEVER and back <= until and (rests == _NEVER or back <= rests):
                s[3] = _NEVER
                if s[0] == asked:
                    continue
                at = back
            elif rests != _NEVER and rests <= until:
                s[1] = _NEVER
                if back != _NEVER:
                    continue
                at = rests
            else:
                return
            s[2], s[3] = s[0], at + self.takes
            out.append((at, s[0]))

    def _save(self, s: list[int]) -> None:
        self.pane.update(tuple(s))
        self._due(min([t for t in (s[1], s[3]) if t != _NEVER], default=_NEVER))

    def _rows(self, key, out: list[tuple]) -> Iterator[pd.DataFrame]:
        yield _frame(self.schema, [(key[0], *r) for r in out])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = list(self.pane.get()) if self.pane.exists() else [0, _NEVER, 0, _NEVER], []
        for r in _ordered(rows, ("at", "seq")):
            self._until(s, int(r.at) - 1, out)
            s[0], s[1] = int(r.value), int(r.at) + self.rest
        self._save(s)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = list(self.pane.get()), []
        self._until(s, timerValues.getCurrentWatermarkInMs() * 1000 - 1, out)  # a timer that is set now may have passed, too
        self._save(s)
        yield from self._rows(key, out)


class Held(_Timed):
    """Events (at, seq, kind: settings or result, value) of a key to its results (key, seq, value, version, released_at).

    A change of settings opens a time of `settle`, which a change within it begins anew. Results that come meanwhile are
    held and released at its end with the version then, that is the number of changes; others go at once. None is lost.
    Kept: two numbers and the results held.
    """

    schema = "key long, seq long, value long, version long, released_at long"

    def __init__(self, settle: int):
        self.settle = settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.settings = handle.getValueState("settings", "version long, settles_at long")
        self.waiting = handle.getListState("waiting", "seq long, value long")

    def _release(self, s: list[int], until: int, out: list[tuple]) -> None:
        if s[1] != _NEVER and s[1] <= until:
            out += [(int(seq), int(value), s[0], s[1]) for seq, value in self.waiting.get()]
            self.waiting.clear()
            s[1] = _NEVER

    def _rows(self, key, s: list[int], out: list[tuple]) -> Iterator[pd.DataFrame]:
        self.settings.update(tuple(s))
        self._due(s[1])
        yield _frame(self.schema, [(key[0], *r) for r in out])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out, waiting, opened = list(self.settings.get()) if self.settings.exists() else [0, _NEVER], [], [], False
        for r in _ordered(rows, ("at", "seq")):
            if s[1] != _NEVER and s[1] <= int(r.at):
                at = s[1]
                if not opened:  # what earlier batches left
                    self._release(s, int(r.at), out)
                out += [(seq, value, s[0], at) for seq, value in waiting]
                s[1], waiting, opened = _NEVER, [], True
            if r.kind == "settings":
                s = [s[0] + 1, int(r.at) + self.settle]
            elif s[1] == _NEVER:
                out.append((int(r.seq), int(r.value), s[0], int(r.at)))
            else:
                waiting.append((int(r.seq), int(r.value)))
        if waiting:
            self.waiting.appendList(waiting)
        yield from self._rows(key, s, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = list(self.settings.get()), []
        self._release(s, timerValues.getCurrentWatermarkInMs() * 1000, out)
        yield from self._rows(key, s, out)


#: Numbers of one row of what is ahead.
_CHUNK = 256


class _Ahead:
    """Texts ahead of their turn, by number: a row of state holds those of _CHUNK numbers, which are read and written together."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.state = handle.getMapState("ahead", "chunk long", "texts string")

    def _read(self, chunk: int) -> dict[int, str]:
        if not self.state.containsKey((chunk,)):
            return {}
        return {int(n): text for n, text in json.loads(self.state.getValue((chunk,))[0]).items()}

    def add(self, new: dict[int, str]) -> None:
        """A batch's texts; they replace those of their numbers."""
        self.held: dict[int, dict[int, str]] = {}
        self.read: set[int] = set()
        for number, text in new.items():
            self.held.setdefault(number // _CHUNK, {})[number] = text

    def take(self, turn: int) -> Iterator[tuple[int, str]]:
        """(number, text) from turn on without a gap, as far as asked for."""
        while True:
            chunk = turn // _CHUNK
            if chunk not in self.read:
                self.held[chunk] = self._read(chunk) | self.held.get(chunk, {})
                self.read.add(chunk)
            if turn not in self.held[chunk]:
                return
            yield turn, self.held[chunk].pop(turn)
            turn += 1

    def clear(self) -> None:
        self.state.clear()

    def keep(self) -> None:
        """What was not taken waits on."""
        for chunk, texts in self.held.items():
            merged = texts if chunk in self.read else self._read(chunk) | texts
            if merged:
                self.state.updateValue((chunk,), (json.dumps(merged),))
            elif chunk in self.read and self.state.containsKey((chunk,)):
                self.state.removeKey((chunk,))


class InOrder(StatefulProcessor):
    """A run's events (type, index, files), in any order and repeated, to (key, position, type, index): run-start, the events by index without a gap, run-done.

    The event run-start says how many files events there are; nothing goes before it. run-abort ends a run: nothing goes
    after it, and such a run has no run-done. Kept: what has come ahead of its turn.
    """

    schema = "key long, position long, type string, index long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "next long, events long, over boolean")
        self.ahead = _Ahead(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turn, events, over = self.run.get() if self.run.exists() else (_NEVER, _NEVER, False)
        new, out = {}, []
        for r in _ordered(rows, ("index",)):
            if r.type == "run-start":
                events = int(r.events)
            elif int(r.index) >= max(turn, 0):
                new[int(r.index)] = r.type
        self.ahead.add(new)
        if events != _NEVER and not over:
            if turn == _NEVER:
                out.append((0, "run-start", None))
                turn = 0
            for index, kind in self.ahead.take(turn):
                over = kind == "run-abort"
                if over:
                    break
                out.append((index + 1, kind, index))
                turn = index + 1
            if not over and turn == events:
                out.append((turn + 1, "run-done", None))
                over = True
        if over:
            self.ahead.clear()
        else:
            self.ahead.keep()
        self.run.update((turn, events, over))
        yield _frame(self.schema, [(key[0], *r) for r in out])


class Images(StatefulProcessor):
    """Actions (at, seq, action, pane, value) on an opened image to its state after each batch: (key, status, bytes, result, error, replaced, rewrites, saves).

    add opens it (again, if its original was replaced); start, finish (value: the result; below zero: it failed) and fail
    (only what has not ended) move its status; requeue queues it anew without its result; rights writes the result's
    outputs again, by `value`; replaced says that a save took the original's place. save-start, save-done, save-fail and
    save-drop are a pane's: saving, saved, failed, or none. Actions on an image that is not open change nothing. Kept: one
    row, and one for each pane with a save.
    """

    schema = "key long, status string, bytes long, result long, error boolean, replaced boolean, rewrites long, saves string"
    _SAVES = {"save-start": "saving", "save-done": "saved", "save-fail": "failed"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.image = handle.getValueState("image", "status string, bytes long, result long, error boolean, replaced boolean, rewrites long")
        self.saves = handle.getMapState("saves", "pane long", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        image = dict(zip(("status", "bytes", "result", "error", "replaced", "rewrites"), self.image.get(), strict=True)) if self.image.exists() else None
        saves = {p: s for (p,), (s,) in self.saves.iterator()}
        before = dict(saves)
        for r in _ordered(rows, ("at", "seq")):
            fresh = {"status": "queued", "result": None, "error": False, "replaced": False, "rewrites": 0}
            if r.action == "add":
                image = fresh | {"bytes": int(r.value)} if image is None or image["replaced"] else image
            elif r.action in self._SAVES:
                saves[int(r.pane)] = self._SAVES[r.action]
            elif r.action == "save-drop":
                saves.pop(int(r.pane), None)
            elif image is None:
                continue
            elif r.action == "replaced":
                image["replaced"] = True
            elif r.action == "requeue":
                image = fresh | {"bytes": image["bytes"]}
            elif r.action == "start":
                image["status"] = "processing"
            elif r.action == "finish":
                image |= {"status": "failed" if r.value < 0 else "done", "result": int(r.value), "error": bool(r.value < 0)}
            elif r.action == "fail" and image["status"] in ("queued", "processing"):
                image |= {"status": "failed", "error": True}
            elif r.action == "rights" and image["result"] is not None:
                image |= {"result": image["result"] + int(r.value), "rewrites": image["rewrites"] + 1}
        if image is not None:
            self.image.update(tuple(image[c] for c in ("status", "bytes", "result", "error", "replaced", "rewrites")))
        for pane in before.keys() - saves.keys():
            self.saves.removeKey((pane,))
        for pane, state in saves.items():
            if before.get(pane) != state:
                self.saves.updateValue((pane,), (state,))
        fields = ("status", "bytes", "result", "error", "replaced", "rewrites")
        yield _frame(self.schema, [(key[0], *((image or {}).get(c) for c in fields), ",".join(f"{p}:{s}" for p, s in sorted(saves.items())))])


class Blocks(StatefulProcessor):
    """Pieces (number, text) of a server-sent stream, cut anywhere and in any order, to its events (key, place, event, data).

    Pieces are put together by number; a block goes once the blank line after it is there. Fields of a block are joined;
    comments and blocks without data give nothing. Repeated pieces are passed over. Kept: the block that has begun, and pieces ahead of their turn.
    """

    schema = "key long, place long, event string, data string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.text = handle.getValueState("text", "next long, place long, held string")
        self.ahead = _Ahead(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turn, place, held = self.text.get() if self.text.exists() else (0, 0, "")
        new, out = {int(r.number): r.text for r in _ordered(rows, ("number",)) if int(r.number) >= turn}, []
        self.ahead.add(new)
        pieces = [held]
        for number, piece in self.ahead.take(turn):
            pieces.append(piece)
            turn = number + 1
        held = "".join(pieces).replace("\r\n", "\n")
        *blocks, held = held.split("\n\n")
        for block in blocks:
            lines = [line.partition(":")[::2] for line in block.split("\n")]
            data = "\n".join(v.removeprefix(" ") for f, v in lines if f == "data")
            if data:
                out.append((place, next((v.removeprefix(" ") for f, v in reversed(lines) if f == "event"), "message"), data))
                place += 1
        self.ahead.keep()
        self.text.update((turn, place, held))
        yield _frame(self.schema, [(key[0], *r) for r in out])


class Remembered(_Timed):
    """Requests (at, seq, ok) of a key to (key, seq, made, served_by): those made, and those that another one serves.

    While a request is under way, for `takes`, and after it has succeeded, until `keeps` after it was made, the same key's
    requests are served by it. One that fails is forgotten when it comes back. Kept: two numbers, until they end.
    """

    schema = "key long, seq long, made boolean, served_by long"

    def __init__(self, takes: int, keeps: int):
        self.takes, self.keeps = takes, keeps

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.memo = handle.getValueState("memo", "seq long, ends_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, ends = self.memo.get() if self.memo.exists() else (_NEVER, _NEVER)
        out = []
        for r in _ordered(rows, ("at", "seq")):
            made = int(r.at) >= ends
            if made:
                seq, ends = int(r.seq), int(r.at) + (self.keeps if r.ok else self.takes)
            out.append((key[0], int(r.seq), made, seq))
        self.memo.update((seq, ends))
        self._due(ends)
        yield _frame(self.schema, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.memo.clear()
        yield _frame(self.schema, [])


def stateful(stream: DataFrame, processor: StatefulProcessor, key: str = "key", timed: bool = False) -> DataFrame:
    """The stream's rows of each key through a processor; timed: with a watermark that its timers follow."""
    mode = "EventTime" if timed else "None"
    return stream.groupBy(key).transformWithStateInPandas(processor, processor.schema, "Update", mode)


def run_in_parts(spark: SparkSession, parts: Sequence[DataFrame], query: Callable[[DataFrame], DataFrame], schema: str, name: str) -> DataFrame:
    """What a query over a stream gives, run until nothing is left after each of the parts of its input: its rows with batch long.

    Every run goes on where the one before stopped, from its checkpoint. Batches are written below the shared folder by
    their number, so that one that runs again takes its own place.
    """
    reachable(spark)
    base, before = shared_path(spark, name), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{base}/in")
            stream = query(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
            run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(batch_writer(f"{base}/out")).start()
            run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(f"{schema}, batch long").parquet(f"{base}/out")


def timed(stream: DataFrame) -> DataFrame:
    """A stream with a column ts whose watermark is the latest ts of the batches before."""
    return stream.withWatermark("ts", "0 seconds")


def micros(ts: str = "ts") -> F.Column:
    return F.unix_micros(F.col(ts))
