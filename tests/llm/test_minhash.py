import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import minhash as M
from quern.llm.queries import ORACLE_SQL, QUERIES


def plain_set(text, k=3):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain(rows, percent=85, k=3):
    """rows (id, text) by comparing every two sets."""
    sets, parent = [plain_set(t, k) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    found = [least[root(i)] for i in range(len(rows))]
    return sorted(((r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, found, strict=True)), key=repr)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_query_gives_the_rows_of_its_sql(spark, sf_dir, same_as_duckdb):
    same_as_duckdb(QUERIES["op11_minhash"](spark, sf_dir), ORACLE_SQL["op11_minhash"])


def test_sizes_are_those_of_plain_sets():
    texts = ["", " \n", "One", "one two", "One two three", "a b c a b c a b", "a " * 50, "É é x\x0by\x1cz w v"]
    sets = M.shingle_sets(pa.array(texts, pa.large_string()))
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    assert sets[2].tolist() == M.shingle_sets(pa.array(["oNE\t"], pa.large_string()))[0].tolist() and not set(sets[2].tolist()) & set(sets[3].tolist())


@pytest.mark.parametrize(("values", "errors"), [(48, 17), (12, 5), (7, 3), (10, 0)])
def test_pigeonhole_loses_no_pair_under_the_distance(values, errors):
    r = np.random.default_rng(values)
    for _ in range(300):
        a = r.integers(0, 1 << 16, values, dtype=np.uint16)
        b = a.copy()
        at = r.permutation(values)[: r.integers(0, errors + 1)]
        b[at] ^= np.uint16(1)
        x, y = M.keys_of(np.stack([a, b]), errors)
        assert (x == y).any()


def test_chance_to_lose_a_link_is_bounded():
    assert M.errors_allowed() == 17 and M.least_size() == 6 and M.errors_allowed(80) > 17
    r = np.random.default_rng(1)
    far = []
    for _ in range(400):
        u = r.integers(0, 1 << 62, 400, dtype=np.uint64)
        a, b = M.signatures([np.sort(u[:370]), np.sort(u[30:])])
        far.append(int((a != b).sum()))
    assert max(far) <= 17 and abs(np.mean(far) - 48 * 0.15) < 0.5


@pytest.mark.parametrize("seed", range(2))
def test_groups_of_copies_are_those_of_every_pair(spark, seed, monkeypatch):
    monkeypatch.setattr(M, "HOT_ROWS", 20)
    monkeypatch.setattr(M, "BLOCK_ROWS", 8)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 700)
    r, rows = random.Random(seed), []
    for group, size in enumerate((90, 40, 12, 1, 1, 1)):
        base = [f"w{r.randrange(400)}" for _ in range(80)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(9)):  # of all likenesses about that of a link
                w[r.randrange(80)] = f"x{r.randrange(5000)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert got(M.near_duplicates(frame)) == want and len({w[2] for w in want}) > 10
    assert got(M.near_duplicates(frame, percent=80, shingle=5)) == plain(rows, 80, 5)


def test_edge_rows(edges, empty):
    rows = [tuple(x) for x in edges.select("doc_id", "text").collect()]
    frame = edges.withColumnRenamed("score", "component_id").withColumnRenamed("source", "signature")
    assert got(M.near_duplicates(frame)) == plain(rows)
    assert M.near_duplicates(empty).count() == 0
