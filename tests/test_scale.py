"""How plans deal rows over tasks: what must not grow in one task or reach the driver."""

import pyarrow as pa
from pyspark.sql import functions as F

from quern.operators import compare
from quern.shared import TASK_ROWS, spread


def plan_of(frame, capsys):
    frame.explain()
    return capsys.readouterr().out


def test_pieces_of_messages_are_never_broadcast(spark, capsys):
    messages = spark.createDataFrame([(1, "cannot read /in/a.png"), (2, None)], "id long, message string")
    got = compare.relabelled_by(messages, spark.createDataFrame([("/in/a.png", "file/1/a.png")], "path string, ref string"))
    assert "BroadcastExchange" not in plan_of(got, capsys)
    assert sorted(got.collect()) == [(1, "cannot read file/1/a.png"), (2, None)]


def test_rows_that_are_work_of_their_own_are_dealt_over_all_cores(spark, sf_dir):
    from quern.plans import views as V
    from quern.plans.catalogue import QUERIES

    cores = spark.sparkContext.defaultParallelism
    for name in ("avif_boxes", "metadata_cut", "carriers_read", "search_choice"):
        # a small file of parts was one task's, whatever its rows cost
        frame = QUERIES[name](spark, sf_dir)
        parts = frame.groupBy(F.spark_partition_id()).count().count()
        assert parts >= cores, name
    assert V.parts(spark, sf_dir).count() == V.table(spark, sf_dir, "part").count()


def test_tasks_grow_with_the_rows(spark):
    rows = spark.range(100)
    assert spread(rows, 20_000_000, "id").rdd.getNumPartitions() == 20_000_000 // TASK_ROWS
    assert spread(rows, 100, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_names_are_composed_in_small_slices(spark, monkeypatch):
    from quern.functions import paths

    # the largest slice of a batch that was made into Python objects
    seen = []
    monkeypatch.setattr(paths.F, "arrow_udf", lambda run, _: lambda names: run(names))
    normalize = paths.unicodedata.normalize
    monkeypatch.setattr(paths, "pa", type("Arrow", (), {**vars(paths.pa), "array": staticmethod(lambda rows, kind: (seen.append(len(rows)), pa.array(rows, kind))[1])}))
    names = pa.array(["e\u0301" * 100_000, None, "a"] * 20)
    assert paths.composed(names).to_pylist() == [n if n is None else normalize("NFC", n) for n in names.to_pylist()]
    assert sum(seen) == 60 and max(seen) < 60


def test_lines_of_an_order_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    from quern.plans import views as V
    from quern.plans.catalogue import QUERIES

    few, counted = lambda name: QUERIES[name](spark, sf_dir).rdd.getNumPartitions(), V.table(spark, sf_dir, "lineitem").count()
    for f in (V.spread,):
        monkeypatch.setattr(V, "spread", lambda df, rows, *by, **_: f(df, rows, *by, task_rows=counted // 20))
    for name in ("merge_ranges", "pane_notes", "viewer_outputs"):
        assert few(name) >= 20, name


def test_a_base_s_names_meet_no_window_over_them_all(spark, capsys):
    from quern.operators import conflicts

    names = spark.createDataFrame([(2, None, "a.png"), (1, None, "a.png"), (3, "", "a.png"), (4, "/d", None)], "idx long, folder string, name string")
    got = conflicts.free_names(names)
    # maxima over a whole stretch are taken over counts, which are grouped first
    plan = plan_of(got, capsys)
    assert all("idx" not in line for line in plan.splitlines() if "Window" in line and "max(" in line)
    assert sorted(got.collect(), key=lambda r: r.idx) == [(1, None, "a.png"), (2, None, "a (1).png"), (3, "", "a.png"), (4, "/d", None)]
