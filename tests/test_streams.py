from pyspark.sql import functions as F

from quern import sinks
from quern.streaming import stateful as S


def ran(spark, parts, columns, query, processor):
    frames = [spark.createDataFrame(p, columns) for p in parts]
    frames = [f.withColumn("ts", F.timestamp_micros("at")) if "at" in f.columns else f for f in frames]
    return S.run_in_parts(spark, frames, query, processor.schema, "test").orderBy("batch")


def rows(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


def test_a_slider_asks_once_it_rests_and_again_when_it_has_moved(spark):
    p, s = S.Debounced(100, 1000), 1_000_000
    # two moves at once rest together; the third comes while the first is under way; the last is of another key and moves time on
    first = [(1, 10 * s, 1, 5), (1, 10 * s + 50, 2, 6), (1, 10 * s + 700, 3, 7)]
    later = [(1, 20 * s, 4, 8), (1, 20 * s + 500, 5, 9), (1, 20 * s + 600, 6, 8), (2, 40 * s, 7, 1)]
    query = lambda stream: S.stateful(S.timed(stream), S.Debounced(100, 1000), timed=True)
    got = ran(spark, [first, later], "key long, at long, seq long, value long", query, p)
    assert sorted(rows(got, "key", "asked_at", "value")) == [(1, 10 * s + 150, 6), (1, 10 * s + 1150, 7), (1, 20 * s + 100, 8)]


def test_results_wait_while_settings_change(spark):
    s = 1_000_000
    parts = [[(1, 10 * s, 1, "result", 1), (1, 11 * s, 2, "settings", 0), (1, 12 * s, 3, "result", 2)], [(1, 15 * s, 4, "settings", 0), (1, 24 * s, 5, "result", 3), (1, 25 * s, 6, "result", 4), (2, 60 * s, 7, "result", 9)]]
    query = lambda stream: S.stateful(S.timed(stream), S.Held(10 * s), timed=True)
    got = ran(spark, parts, "key long, at long, seq long, kind string, value long", query, S.Held(1))
    assert sorted(rows(got, "seq", "version", "released_at")) == [(1, 0, 10 * s), (3, 2, 25 * s), (5, 2, 25 * s), (6, 2, 25 * s), (7, 0, 60 * s)]


def test_runs_come_in_order_whatever_the_batches(spark):
    events = [(1, "e", i, 6) for i in range(6)]
    parts = [[events[4], events[1], events[1]], [(1, "run-start", -1, 6), events[0]], [events[5], events[3], events[0]], [events[2], events[2]]]
    query = lambda stream: S.stateful(stream, S.InOrder())
    got = ran(spark, parts, "key long, type string, index long, events long", query, S.InOrder())
    assert rows(got, "batch", "position") == [(1, 0), (1, 1), (1, 2), (3, 3), (3, 4), (3, 5), (3, 6), (3, 7)]
    assert [t for (t,) in rows(got, "type")] == ["run-start", *"eeeeee", "run-done"]
    aborted = [[(2, "run-start", -1, 9), (2, "e", 2, 9), (2, "run-abort", 1, 9)], [(2, "e", 0, 9), (2, "e", 3, 9)]]
    got = ran(spark, aborted, "key long, type string, index long, events long", query, S.InOrder())
    assert rows(got, "position", "type") == [(0, "run-start"), (1, "e")]


def test_images_take_all_actions(spark):
    act = lambda seq, action, value=0, pane=0, key=1: (key, seq, seq, action, pane, value)
    parts = [
        [act(1, "start"), act(2, "add", 100), act(3, "add", 200), act(4, "start"), act(5, "save-start", pane=1)],
        [act(6, "finish", 40), act(7, "fail"), act(8, "rights", 5), act(9, "save-done", pane=1), act(10, "save-start", pane=2)],
        [act(11, "replaced"), act(12, "save-fail", pane=2), act(13, "save-drop", pane=1)],
        [act(14, "add", 300), act(15, "finish", -1)],
        [act(16, "requeue"), act(17, "fail"), act(18, "rights", 9)],
    ]
    query = lambda stream: S.stateful(stream, S.Images())
    got = ran(spark, parts, "key long, at long, seq long, action string, pane long, value long", query, S.Images())
    assert rows(got, "status", "bytes", "result", "error", "replaced", "rewrites", "saves") == [
        ("processing", 100, None, False, False, 0, "1:saving"),
        ("done", 100, 45, False, False, 1, "1:saved,2:saving"),
        ("done", 100, 45, False, True, 1, "2:failed"),
        ("failed", 300, -1, True, False, 0, "2:failed"),
        ("failed", 300, None, True, False, 0, "2:failed"),
    ]


def test_blocks_are_put_together_from_any_pieces(spark):
    text = "event: a\r\ndata: 1\r\ndata:2\r\n\r\n: note\n\ndata: 3\n\ndata: cut"
    pieces = [(1, n, text[n * 3 : n * 3 + 3]) for n in range(-(-len(text) // 3))]
    query = lambda stream: S.stateful(stream, S.Blocks())
    got = ran(spark, [pieces[::2], pieces[1::2] + pieces[:4]], "key long, number long, text string", query, S.Blocks())
    assert rows(got, "place", "event", "data") == [(0, "a", "1\n2"), (1, "message", "3")]


def test_requests_are_shared_and_failures_forgotten(spark):
    s = 1_000_000
    parts = [[(1, 100 * s, 1, False), (1, 105 * s, 2, True), (1, 110 * s, 3, True)], [(1, 115 * s, 4, True), (1, 210 * s - 1, 5, True), (1, 210 * s, 6, True)]]
    query = lambda stream: S.stateful(S.timed(stream), S.Remembered(10 * s, 100 * s), timed=True)
    got = ran(spark, parts, "key long, at long, seq long, ok boolean", query, S.Remembered(1, 1))
    assert sorted(rows(got, "seq", "made", "served_by")) == [(1, True, 1), (2, False, 1), (3, True, 3), (4, False, 3), (5, False, 3), (6, True, 6)]


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    write = sinks.batch_writer(str(tmp_path / "out"))
    for number, values in ((0, [1, 2]), (1, [3]), (1, [3]), (0, [1, 2])):
        write(spark.createDataFrame([(v,) for v in values], "v long"), number)
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")), "v", "batch")) == [(1, 0), (2, 0), (3, 1)]
