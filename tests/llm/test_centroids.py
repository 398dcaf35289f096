import hashlib
import math

import numpy as np
import pytest

from quern.llm import centroids as C
from quern.llm.queries import ORACLE_SQL, QUERIES


def plain(rows, count, rounds):
    """rows (id, integers) by measuring every vector against every centroid, in plain integers."""
    order = sorted((r for r in rows), key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    now = [list(r[1]) for r in order[:count]]
    for k in range(rounds + 1):
        near = []
        for _, v in rows:
            near.append(min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), i) for i, c in enumerate(now)))
        if k < rounds:
            for i in range(len(now)):
                own = [v for (_, v), (_, a) in zip(rows, near, strict=True) if a == i]
                if own:
                    now[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = sum(d for d, _ in near)
    within = [sum(d for d, a in near if a == i) for i in range(len(now))]
    return sorted(((r[0], a, d, within[a], total, hashlib.sha256(",".join(map(str, now[a])).encode()).hexdigest()) for r, (d, a) in zip(rows, near, strict=True)), key=repr)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_query_gives_the_rows_of_its_sql(spark, sf_dir, same_as_duckdb):
    same_as_duckdb(QUERIES["op13_centroids"](spark, sf_dir), ORACLE_SQL["op13_centroids"])


@pytest.mark.parametrize("seed", range(3))
def test_rows_are_those_of_plain_integers(spark, seed):
    r = np.random.default_rng(seed)
    # few values, so that many distances tie and centroids meet
    rows = [(i, (r.integers(-2, 3, 4) / (256 if seed else 64)).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    assert got(C.clustered(frame, centroids=9, rounds=4, width=4)) == plain(whole, 9, 4)


def test_search_measures_less_and_is_the_same():
    r = np.random.default_rng(5)
    v = (r.normal(size=(3000, 8)) * 20 + r.integers(0, 30, (3000, 1)) * 90).astype(np.int64)
    now = C.Centroids(v[:30])
    state = now.first(v)[:3]
    for _ in range(5):
        rows = np.array([v[state[0] == k].sum(axis=0) // max(1, (state[0] == k).sum()) for k in range(30)])
        rows = np.where(np.isin(np.arange(30), state[0])[:, None], rows, now.rows)
        now = C.Centroids(rows, now.rows)
        state = now.again(v, *state)[:3]
        d = C.squared(v, rows)
        assert (state[0] == d.argmin(axis=1)).all()
        assert (state[1] * state[1] >= d.min(axis=1) - 1e-3).all() and (state[2] <= np.sqrt(np.sort(d, axis=1)[:, 1]) + 1e-6).all()
        assert now.measured < 0.5 * d.size


def test_large_integers_are_exact():
    v = np.array([[1 << 26, -(1 << 26)], [3, 4], [(1 << 26) - 1, 5]], np.int64)
    assert C.squared(v, v).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in v] for x in v]


def test_edge_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, [0.5, 1.0], 1), (2, None, 2), (3, [nan, 1.0], 3), (4, [None, 1.0], 4), (5, [inf, 0.0], 5), (6, [1.0], 6), (7, [1.0, 2.0, 3.0], 7), (8, [], 8), (None, [0.25, -0.001], 9), (9, [0.5, 1.0], 1), (9, [0.5, 1.0], 1), (9, [-3.0, 0.0], 2), (10, [1e308, -1e308], 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").withColumnRenamed("cluster", "distance")
    held = lambda x: max(-C.LIMIT, min(C.LIMIT, math.floor(256 * x) if math.isfinite(256 * x) else C.LIMIT * (1 if x > 0 else -1)))
    whole = [(i, [held(x) for x in v]) for i, v, _ in rows if v is not None and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v)]
    for count in (1, 3, 40):
        assert got(C.clustered(frame, centroids=count, rounds=2, width=2)) == plain(whole, count, 2)
    assert C.clustered(frame.limit(0)).count() == 0 and C.clustered(frame.limit(0)).columns == C.clustered(frame, width=2).columns
