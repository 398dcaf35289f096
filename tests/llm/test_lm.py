import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import lm
from quern.llm._shared import split_words


def test_chunks_predict_each_id_once():
    sizes = np.array([1, 0, 15, 16, 17, 200])
    ids = np.arange(sizes.sum())
    inputs, first, place = lm.chunks(sizes, ids)
    assert len(set(place.tolist())) == len(ids) and first.sum() == 5
    begins = np.cumsum(sizes) - sizes
    want = [lm.BEGIN if i in set(begins[sizes > 0].tolist()) else i - 1 for i in range(len(ids))]
    assert inputs.ravel()[place].tolist() == want
    assert sorted(i for _, _, a, b in lm.batches_of(first, place, 3) for i in range(a, b)) == ids.tolist()


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(1)
    sizes, ids = np.array([40, 3, 90, 1]), r.integers(0, 300, 134)
    found = lm.fit(sizes, ids)
    # weights of any size, as training on little text hardly moves them
    return lm.Model({k: v + r.normal(size=v.shape).astype(np.float32) * 0.3 * (v > -lm.MOST) for k, v in found.p.items()}, found.tree)


def test_probabilities_of_all_next_ids_sum_to_one(model):
    for before in ([], [5, 7], list(range(40))):
        n = len(before) + 1
        ids = np.array([x for i in range(lm.OUT_IDS) for x in (*before, i)])
        logs = model.score(np.full(lm.OUT_IDS, n), ids).reshape(-1, n)[:, -1].astype(float)
        assert (10**logs).sum() == pytest.approx(1.0, abs=1e-3)


def plain_logs(model, ids):
    """One id after the other, from the formulas."""
    p, out = {k: v.astype(float) for k, v in model.p.items()}, []
    before = [lm.BEGIN, *ids.tolist()]
    for t, target in enumerate(ids.tolist()):
        start = max(0, t // lm.STEP * lm.STEP - lm.STEP)
        x = p["e"][before[start : t + 1]]
        place, shift = t % lm.STEP, lm.STEP if t < lm.STEP else 0
        w = np.exp([x[-1] @ p["q"] @ (x[i] @ p["k"]) + p["r"][place, shift + i] for i in range(len(x))])
        h = x[-1] + (w / w.sum()) @ (x @ p["v"])
        log = 0.0
        for level in range(len(model.tree.node)):
            n, k = model.tree.node[level, target], model.tree.child[level, target]
            if n < 0:
                break
            s = h @ p["u"][n] + p["c"][n]
            log += s[k] - np.log(np.exp(s).sum())
        out.append(log / np.log(10))
    return out


def test_scores_are_those_of_a_plain_forward_pass(model):
    r = np.random.default_rng(2)
    for n in (1, 5, 16, 17, 70):
        ids = r.integers(0, 400, n)
        assert np.allclose(model.score(np.array([n]), ids), plain_logs(model, ids), atol=1e-3)


def test_attention_is_causal(model):
    ids = np.arange(50)
    whole = model.score(np.array([50]), ids)
    changed = ids.copy()
    changed[30] = 299
    assert np.allclose(whole[:30], model.score(np.array([50]), changed)[:30], atol=1e-5)
    assert abs(whole[31] - model.score(np.array([50]), changed)[31]) > 1e-6


def test_every_id_sees_half_a_window_before_it(model):
    ids = np.arange(64)
    whole = model.score(np.array([64]), ids)
    for at in (32, 40, 63):
        changed = ids.copy()
        changed[at - lm.STEP] = 299
        assert abs(whole[at] - model.score(np.array([64]), changed)[at]) > 1e-7


def test_texts_are_scored_apart(model):
    a, b = np.arange(45), np.arange(100, 170)
    both = model.score(np.array([45, 0, 70]), np.concatenate([a, b]))
    assert np.allclose(both, np.concatenate([model.score(np.array([45]), a), model.score(np.array([70]), b)]), atol=1e-5)


def test_gradients_are_those_of_differences(model, monkeypatch):
    r = np.random.default_rng(3)
    sizes = np.array([20, 45])
    ids = r.integers(0, 60, 65)
    moved = {}
    monkeypatch.setattr(lm.Trainer, "_move", lambda self, name, grad, at=slice(None): moved.update({name: (grad, at)}))
    trainer = lm.Trainer(model.p, model.tree, 1)
    trainer.add(sizes, ids)
    loss = lambda p: -sum(sum(plain_logs(lm.Model(p, model.tree), part)) for part in (ids[:20], ids[20:])) * np.log(10) / (lm.FIT_ROWS * lm.STEP)
    for name, (grad, at) in moved.items():
        full = np.zeros(model.p[name].shape)
        full[at] = grad
        for where in np.argsort(-np.abs(full), axis=None)[:2]:
            up, down = ({k: v.astype(float) for k, v in model.p.items()} for _ in range(2))
            up[name].ravel()[where] += 1e-4
            down[name].ravel()[where] -= 1e-4
            assert full.ravel()[where] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=0.02)


def test_an_untrained_model_gives_shares_of_counts():
    counts = np.zeros(lm.OUT_IDS, np.int64)
    counts[[7, 9]] = 10**6, 3 * 10**6
    p, tree = lm.begin(counts)
    logs = lm.Model(p, tree).score(np.array([2]), np.array([7, 9]))
    assert 10 ** logs.astype(float) == pytest.approx([0.25, 0.75], rel=0.01)


def test_packing_is_undone(model):
    same = lm.unpacked(lm.packed(model.p), model.p)
    assert all(np.allclose(same[k], model.p[k]) for k in model.p)


def plain(rows):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    docs = [(i, re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower)) + ["\n"], i is not None and zlib.crc32(str(i).encode()) % 7 == 2) for i, t in rows]
    counts = Counter(w for _, words, held in docs if not held for w in words)
    total, distinct = sum(counts.values()), len(counts)
    return [(i, held, len(words), sum(counts[w] > 0 for w in words), total, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)) for i, words, held in docs]


def check(frame):
    want = sorted(plain([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]), key=repr)
    rows = lm.scored(frame).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert all(r["score"] is not None and math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def test_base_is_that_of_plain_counts(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_edge_rows(edges, empty):
    check(edges)
    assert lm.scored(empty).count() == 0


def test_rare_words_are_joined(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 50)
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_all_training_documents_fit_the_layer(spark):
    """What stands in few of many documents is learnt too, and a score is the sum over a text's ids."""
    rows = [(i, "plain words stand here in a row") for i in range(3000)] + [(5000 + i, "zebra quartz violin zebra quartz violin " * 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = lm.byte_bpe_path()
    each = docs.selectExpr("doc_id", "text", "false AS held_out")
    counts = lm.materialised(lm.word_counts(docs), "word-counts")
    texts = lm.materialised(lm.encoded(each, lm._frequent(counts, lm.FREQUENT), path), "ids")
    model = lm.trained(texts)
    encoder = lm.tokenizer(path, 1000)

    def ids_of(text):
        offsets, words = split_words(pa.array([text], pa.large_string()))
        return lm._ids(encoder, offsets, words.dictionary_encode())[1].astype(np.int64)

    first, after = ids_of("quartz"), ids_of("zebra quartz")
    at = np.flatnonzero(after == first[0])[0]
    assert model.score(np.array([len(after)]), after)[at] > model.score(np.array([len(first)]), first)[0]
    found = {r["doc_id"]: r["score"] for r in lm.with_scores(texts.select("doc_id", "ids"), model).collect()}
    ids = ids_of(rows[0][1])
    assert len(found) == 3300 and found[0] == pytest.approx(float(model.score(np.array([len(ids)]), ids).sum()), rel=1e-5)


def test_moves_of_tasks_are_averaged_by_what_they_saw():
    r = np.random.default_rng(2)
    sizes, ids = np.array([40, 30]), r.integers(0, 300, 70)
    start, tree = lm.begin(np.bincount(ids, minlength=lm.OUT_IDS))
    trainer = lm.Trainer(start, tree, 5)
    trainer.add(sizes, ids)
    key, weight, moves = trainer.moved()
    # two tasks alike give what one gives
    same = lm.averaged(start, key, 2 * weight, 2 * moves)
    assert all(np.allclose(same[k], trainer.p[k], atol=1e-4) for k in same)
    assert not np.allclose(same["u"], start["u"])


def test_a_level_is_one_batch_of_all_its_nodes(model, monkeypatch):
    """Scores of a level's nodes are worked on together, not node by node, and come out as they do for each id alone."""
    sizes, ids = np.array([60]), np.random.default_rng(4).integers(0, 400, 60)
    calls, plain_exp = [], np.exp
    monkeypatch.setattr(lm.np, "exp", lambda *a, **k: calls.append(1) or plain_exp(*a, **k))
    found = model.score(sizes, ids)
    monkeypatch.undo()
    # one for each level and one for the attention of the only batch
    assert len(calls) == (model.tree.node[:, ids] >= 0).any(axis=1).sum() + 1
    assert np.allclose(found, plain_logs(model, ids), atol=1e-3)
    there = [t.tolist() for t, *_ in model.tree.levels(ids[np.argsort(model.tree.rank[ids], kind="stable")])]
    assert [len(t) for t in there] == [n for n in (model.tree.node[:, ids] >= 0).sum(axis=1).tolist() if n]


def test_a_chunk_takes_five_products(model, monkeypatch):
    """The matrices of queries and keys are one, met ids get their changes by one product: two forwards and three backwards, whatever the parameters."""
    calls, plain_matmul = [], np.matmul
    monkeypatch.setattr(lm.np, "matmul", lambda a, b, **k: calls.append(np.ndim(b)) or plain_matmul(a, b, **k))
    trainer = lm.Trainer(model.p, model.tree, 1)
    trainer.add(np.array([60, 5]), np.random.default_rng(6).integers(0, 400, 65))
    assert trainer.t == 1 and calls.count(3) == 5
    calls.clear()
    model.score(np.array([60]), np.arange(60))
    assert calls.count(3) == 2
