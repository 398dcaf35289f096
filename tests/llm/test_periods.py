import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quern.llm import periods as P
from quern.llm.queries import QUERIES


def plain_runs(w):
    """All runs of a list of words, by trying every period."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            i = j
            if length < max(6, 4 * q):
                continue
            if any(all(w[k] == w[k + d] for k in range(start, start + length - d)) for d in range(1, q)):
                continue
            out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *four, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_those_of_every_period(seed):
    r = random.Random(seed)
    for _ in range(250):
        w = []
        while len(w) < r.randrange(1, 90):
            root = [r.randrange(r.choice((1, 2, 3, 9))) for _ in range(r.randrange(1, 7))]
            w += root * r.randrange(1, 9) + root[: r.randrange(3)]
        codes = np.array(w, np.int64)
        want = plain_runs(w)
        assert sorted(P.Stretch(codes).runs(), key=lambda x: (x[0], x[2])) == want
        cut = r.randrange(len(w) + 1)
        assert P.text_runs(codes, np.array([0, cut, cut, len(w)])) == [plain_runs(w[:cut]), [], plain_runs(w[cut:])]


def test_lyndon_words_are_the_longest():
    r = random.Random(9)
    for _ in range(200):
        w = [r.randrange(3) for _ in range(r.randrange(1, 40))]
        s = P.Stretch(np.array(w, np.int64))
        for reverse in (False, True):
            x = [-a for a in w] if reverse else w
            is_lyndon = lambda u: all(u < u[k:] for k in range(1, len(u)))
            assert s.lyndon_ends(reverse) == [max(e for e in range(i + 1, len(x) + 1) if is_lyndon(x[i:e])) for i in range(len(x))]


def test_hashes_that_collide_do_no_harm(monkeypatch):
    monkeypatch.setattr(P, "_PRIME", 3)
    monkeypatch.setattr(P, "_NEAR", 0)
    r = random.Random(4)
    for _ in range(60):
        w = [r.randrange(2) for _ in range(r.randrange(1, 60))]
        assert sorted(P.Stretch(np.array(w, np.int64)).runs(), key=lambda x: (x[0], x[2])) == plain_runs(w)


def test_long_loops_take_time_in_proportion():
    for root in ([1], [1, 2], list(range(50)), [1] * 30 + [2]):
        w = (root * 400_000)[:200_000]
        assert (0, len(w), len(root)) in P.text_runs(np.array(w, np.int64), np.array([0, len(w)]))[0]


def test_query_is_that_of_plain_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    small = [d for d in docs if len((d["text"] or "").split()) < 2500]
    got = {r[0]: r for r in rows(QUERIES["op12_periodic_runs"](spark, sf_dir))}
    assert len(got) == len(docs) and all(got[d["doc_id"]] == plain_row(*d) for d in small)
    assert sum(r[1] for r in got.values()) > 0


def test_edge_rows(spark, edges, empty):
    frame = edges.withColumnRenamed("score", "runs")
    got = rows(P.digests(P.scanned(frame, order=P.looped)))
    want = sorted([plain_row(r["doc_id"], r["text"]) for r in edges.select("doc_id", "text").collect() if r["doc_id"] != 5], key=repr)
    assert [r for r in got if r[0] != 5] == want and next(r for r in got if r[0] == 5)[:6] == (5, 1, 0, 40_000, 2, 20_000_000)
    assert P.scanned(empty).count() == 0
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0]
    docs = spark.createDataFrame([(k, " ".join(f"w{i % 11}" for i in range(7 * k % 90))) for k in ids], "doc_id long, text string")
    assert rows(P.digests(P.scanned(docs, order=P.looped))) == sorted([plain_row(*d) for d in docs.collect()], key=repr)
    text = spark.createDataFrame([(1, "a\tb c  d d d d d d e")], "doc_id long, text string")
    assert P.scanned(text).select("n_words", "runs", "collapsed").first() == (10, [(3, 6, 1)], "a b c d e")
