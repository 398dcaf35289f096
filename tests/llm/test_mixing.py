import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing


def test_targets_stop_at_three_times_the_source():
    assert mixing.capped_targets([100, 10, 10], [1, 2, 3]) == pytest.approx([60, 30, 30])
    assert mixing.capped_targets([10, 10, 10], [1, 2, 3]) == pytest.approx([5, 10, 15])
    assert mixing.capped_targets([0, 0], [1, 2]) == [0, 0] and mixing.capped_targets([], []) == []
    assert sum(mixing.capped_targets([7, 900, 3, 55], [1, 2, 3, 1])) == pytest.approx(965)


def test_pairs_keep_their_mass():
    r = np.random.default_rng(1)
    size = np.sort(r.integers(1, 500, 300).astype(float))[::-1]
    up, mass = mixing.pivot(size, size * 0.37, r.random(300), np.zeros(300, bool))
    assert mass.sum() == pytest.approx(size.sum() * 0.37) and (up == -1).sum() <= 1 and (mass[up == 1] == pytest.approx(size[up == 1])) and not mass[up == 0].round(5).any()
    keep = np.arange(300) % 30 == 0
    up, _ = mixing.pivot(size, size * 0.37, r.random(300), keep)
    assert (up[keep] == -1).all() and (up[~keep] == -1).sum() <= 1


def test_targets_are_those_of_plain_rounds():
    def plain(sizes, weights, cap=3.0):
        total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), {i for i in range(len(sizes)) if sizes[i] > 0}
        while open_:
            weight = sum(weights[i] for i in open_)
            over = {i for i in open_ if total * weights[i] / weight > cap * sizes[i]}
            if not over:
                return [total * weights[i] / weight if i in open_ else out[i] for i in range(len(sizes))]
            for i in over:
                out[i] = cap * sizes[i]
            total -= sum(out[i] for i in over)
            open_ -= over
        return out

    r = np.random.default_rng(8)
    for _ in range(200):
        n = int(r.integers(1, 30))
        sizes, weights = np.floor(10 ** r.uniform(0, 5, n)).tolist(), [1.0 + i % 3 for i in range(n)]
        assert mixing.capped_targets(sizes, weights) == pytest.approx(plain(sizes, weights))
    many = np.floor(10 ** r.uniform(0, 5, 200_000)).tolist()
    assert sum(mixing.capped_targets(many, [1.0 + i % 3 for i in range(len(many))])) == pytest.approx(sum(many))


def test_what_is_drawn_at_last_is_small():
    r = np.random.default_rng(3)
    for share in (0.3, 0.4, 0.7):
        for _ in range(20):
            size = np.sort(np.append(r.integers(1, 60, 200), (900, 700)).astype(float))[::-1]
            up = mixing.settle(size, size * share, r.random(202))
            assert set(up.tolist()) <= {0, 1} and abs((up * size).sum() - size.sum() * share) <= 60
    assert mixing.settle(np.array([0.0, 0.0]), np.zeros(2), r.random(2)).tolist() == [0, 0]


def test_rounding_is_fair():
    r = np.random.default_rng(2)
    for size, mass in ((np.full(4, 10.0), np.full(4, 3.0)), (np.array([30.0, 20.0, 19.0, 18.0]), np.array([9.0, 15.0, 1.0, 6.0])), (np.array([900.0, 20.0, 19.0, 1.0]), np.array([500.0, 3.0, 4.0, 0.5]))):
        ups = np.array([mixing.settle(size, mass, r.random(4)) for _ in range(6000)])
        assert np.abs(ups.mean(axis=0) - mass / size).max() < 0.025
        pairs = np.array([(u == 1) + 0.0 + (u < 0) * m / size for u, m in (mixing.pivot(size, mass, r.random(4), np.zeros(4, bool)) for _ in range(6000))])
        assert np.abs(pairs.mean(axis=0) - mass / size).max() < 0.025


def test_a_source_is_fair_over_its_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    monkeypatch.setattr(mixing, "OPEN_ROWS", 2)
    docs = spark.createDataFrame([(i, "a" if i < 60 else "b", "w " * (1 + i % 17)) for i in range(80)], "doc_id long, source string, text string")
    ups, sums = np.zeros(80), []
    for seed in range(25):
        got = sorted(mixing.mixed(docs, seed=seed).collect(), key=lambda x: x["doc_id"])
        ups += [x["copies"] for x in got]
        sums.append([sum(x["taken"] for x in got if x["source"] == s) for s in "ab"])
    rates = [x["target"] / x["source_size"] for x in got]
    targets = [next(x["target"] for x in got if x["source"] == s) for s in "ab"]
    # each document as often as its source asks for, within four standard errors of its sum over runs; no run far from its target
    assert np.abs(ups / 25 - rates).max() < 4 * 0.5 / 5 and abs((ups / 25 - rates).mean()) < 0.05
    assert np.abs(np.array(sums) - targets).max() <= 17


def test_sources_come_near_their_targets_over_many_leaves(spark):
    hot = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.expr("repeat('w ', cast(1 + id % 50 as int))").alias("text"))
    cold = spark.range(9000, 9300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.expr("repeat('w ', cast(1 + id % 90 as int))").alias("text"))
    docs = hot.union(cold)
    first, again = (sorted(map(tuple, mixing.mixed(docs).collect())) for _ in range(2))
    assert first == again and len(first) == 9300
    by: dict = {}
    for _, source, size, source_size, target, copies, taken in first:
        assert copies in (int(target / source_size), int(target / source_size) + 1) and taken == copies * size <= 3 * size
        got = by.setdefault(source, [0, target])
        got[0] += taken
    assert len(by) == 4 and all(abs(taken - target) <= 90 for taken, target in by.values())
    assert sum(target for _, target in by.values()) == pytest.approx(sum(r[2] for r in first))


def test_edge_rows(edges, empty):
    rows = mixing.mixed(edges).collect()
    assert len(rows) == edges.count() and all(r["taken"] == r["copies"] * r["size"] for r in rows)
    assert mixing.mixed(empty).count() == 0 and mixing.remixed(empty).count() == 0
    edges = edges.withColumn("copies", F.lit(7)).withColumn("taken", F.lit("x")).withColumn("target", F.lit(None).cast("int"))
    assert mixing.remixed(edges.where("doc_id = 5")).columns == edges.columns
    remixed = mixing.remixed(edges)
    assert remixed.columns == edges.columns and remixed.count() == sum(r["copies"] for r in rows)


def test_rows_are_repeated_as_planned(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = {r["doc_id"]: r["copies"] for r in mixing.mixed(docs).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixing.remixed(docs).groupBy("doc_id").count().collect()} == plan
