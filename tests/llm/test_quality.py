import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import quality


def test_scores_are_sparse_dot_products():
    texts = pa.array(["", "a b b", "A!! b, c", "é é 1 1"], pa.large_string())
    offsets, places = quality.features(texts, 1 << 10)
    weights = np.random.default_rng(1).normal(size=1 << 10).astype(np.float32)
    want = [1 / (1 + np.exp(-(0.5 + quality.SCALE * (weights[places[a:b]].astype(float).mean() if b > a else 0)))) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert np.allclose(quality.scores(texts, weights, 0.5), want)
    assert len(offsets) == 5 and offsets[1] == 0


def test_held_out_labels_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.scored(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where(quality.held_out("doc_id")).toPandas()
    assert len(out) > 60 and (out.predicted == out.quality).mean() >= 0.95
    assert out.predicted[out.quality == 1].mean() >= 0.97


def test_rows_that_are_held_out_are_not_learnt_from(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    texts, marks = quality.sample(docs, labels, 100)
    ids = sorted(int(t.split()[1]) for t in texts)
    assert ids == [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert all(int(t.split()[1]) % 2 == m for t, m in zip(texts, marks, strict=True))
    assert len(quality.sample(docs, labels, 7)[0]) == 7


def test_edge_rows(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (7, 1), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    frame = edges  # its column score gives way
    out = quality.scored(frame, labels)
    assert out.columns == [*frame.columns[:-1], "score", "predicted"] and out.count() == edges.count() and out.where("score BETWEEN 0 AND 1").count() == edges.count()
    assert quality.scored(empty, labels).count() == 0
    assert {r["score"] for r in quality.scored(frame, labels.limit(0)).collect()} == {0.5}
    assert quality.kept(edges, labels).columns == edges.columns


def test_training_is_that_of_plain_steps():
    """Weight by weight, one n-gram at a time, as the learner is defined."""
    r = np.random.default_rng(6)
    texts = [" ".join(r.choice(list("abcdefgh"), r.integers(0, 12))) for _ in range(60)] + ["", None]
    labels = [int("a" in (t or "")) for t in texts]
    size = 1 << 8
    z, n = {}, {}
    share = {v: len(labels) / (2 * max(1, labels.count(v))) for v in (0, 1)}

    def weight(k):
        a = z.get(k, 0.0)
        return 0.0 if abs(a) <= quality.L1 else -(a - np.sign(a) * quality.L1) / ((quality.BETA + np.sqrt(n.get(k, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for text, label in zip(texts, labels, strict=True):
            _, places = quality.features(pa.array([text or ""], pa.large_string()), size)
            x = {size: 1.0} | {int(k): quality.SCALE * float((places == k).sum()) / len(places) for k in set(places.tolist())}
            now = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-min(35, max(-35, sum(now[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g = share[label] * (p - label) * v
                step = (np.sqrt(n.get(k, 0.0) + g * g) - np.sqrt(n.get(k, 0.0))) / quality.ALPHA
                z[k] = z.get(k, 0.0) + g - step * now[k]
                n[k] = n.get(k, 0.0) + g * g
    weights, bias = quality.train(texts, labels, size, passes=3)
    assert np.allclose(weights, [weight(k) for k in range(size)], atol=1e-5) and abs(bias - weight(size)) < 1e-6


def test_edge_rows_score_as_their_texts_do(spark, edges):
    texts = [t for t, in edges.select("text").collect()]
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 1), (5, 0), (-6, 0)], "doc_id long, quality int")
    model = quality.train(*quality.sample(edges, labels))
    want = {t: float(quality.scores(pa.array([t or ""], pa.large_string()), *model)[0]) for t in texts}
    got = quality.scored(edges, labels).select("text", "score", "predicted").collect()
    assert all(abs(r["score"] - want[r["text"]]) < 1e-9 and r["predicted"] == (want[r["text"]] >= 0.7) for r in got)
    assert want[""] == want[None] == want[" \t\n "]
