import math

import numpy as np
import pytest

from quern.llm import neighbours as N


def plain(vectors, asked, count):
    out = {}
    for q, x in asked:
        scored = sorted((-float(np.cumsum(np.array(x) * np.array(y))[-1]), v) for v, y in vectors if v != q and len(y) == len(x))
        out[q] = [(v, -s) for s, v in scored[:count]]
    return out


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=8) * r.uniform(0.2, 3)).astype(np.float32).tolist()) for i in range(600)]
    return rows + [(1000 + i, rows[7][1]) for i in range(40)]


def test_factor_one_is_exact_with_ties_to_the_smaller_id(spark, vectors):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked = [v for v in vectors if v[0] % 20 == 0]
    assert found(N.searched(frame)) == plain(vectors, asked, 20)


@pytest.mark.parametrize("width", [16, 24])
def test_of_any_number_of_ties_the_smallest_ids_come(spark, width):
    r = np.random.default_rng(width)
    rows = [(int(i), x) for i, x in zip(r.permutation(3000), r.choice([-1.0, 1.0], (3000, width)).tolist(), strict=True)]
    rows += [(i, rows[i % 7][1]) for i in range(3000, 3040)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(N.searched(frame)) == plain(rows, [v for v in rows if v[0] % 20 == 0], 20)


def test_ids_that_repeat_in_the_queries_rank_together(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 9.0]), (3, [0.25, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in N.searched(frame, count=3).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 0.5), (20, 2, 1, 0.5), (20, 3, 1, 0.5)]


def test_a_larger_factor_visits_less_and_finds_less(spark):
    r = np.random.default_rng(4)
    points = np.array([r.normal(size=4) + (i % 9) * 4 for i in range(3000)])
    tree, queries = N.Tree(points, 32), points[::50]
    best = np.argsort(-(queries @ points.T), axis=1)[:, :10]
    recall, visited = [], []
    for factor in (1.0, 1.1, 1.25, 1.5, 4.0):
        rows, _ = tree.search(queries, 10, factor)
        recall.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(rows.tolist(), best.tolist(), strict=True)]))
        visited.append(tree.visited / len(queries))
    assert recall[0] == 1.0 and recall[1] >= 0.9
    assert all(a >= b for a, b in zip(recall, recall[1:], strict=False)) and all(a >= b for a, b in zip(visited, visited[1:], strict=False))
    # the exact search of vectors in groups leaves most leaves out
    assert visited[0] < 0.5 * tree.leaves


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [math.nan, 1.0]), (4, [None, 1.0]), (5, [math.inf, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.5, 0.5]), (None, [1.0, 1.0]), (20, [-1.0, 0.0]), (40, [])]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, rank int")
    assert found(N.searched(frame)) == {0: [(7, 0.5), (20, -1.0)], 20: [(7, -0.5), (0, -1.0)]}
    assert N.searched(frame.limit(0)).count() == 0
