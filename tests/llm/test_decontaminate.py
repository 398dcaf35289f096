import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate as D


def plain_tiling(item, text, least):
    free_item, free_text, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_item[i + n] and free_text[j + n]:
                    n += 1
                if n >= least and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return tiles
        n, i, j = -best[0], best[1], best[2]
        free_item[i : i + n] = free_text[j : j + n] = [False] * n
        tiles.append((i, j, n))


@pytest.mark.parametrize("seed", range(60))
def test_tiles_are_those_of_plain_tiling(seed):
    r = random.Random(seed)
    a, b = (np.array([r.randint(1, 2 + seed % 2) for _ in range(r.randint(0, n))], np.uint64) for n in (30, 40))
    for least in (2, 5):
        assert D.greedy_tiles(a, b, least=least) == plain_tiling(a.tolist(), b.tolist(), least)


def test_rolling_hashes_tell_runs_apart():
    tokens = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    h = D.rolling(tokens, 3)
    assert len(h) == 5 and h[0] == h[3] and len(set(h.tolist())) == 4 and len(D.rolling(tokens[:2], 3)) == 0


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def flags(spark, texts, items, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    return {r["doc_id"]: (r["leaked_items"], r["best_item"]) for r in D.flagged(docs, bench, **more).collect()}


def test_whole_reordered_and_recased_passages_are_found(spark):
    texts = [f"before {ITEM} after", "seven eight nine ten eleven twelve, then: ONE two three four FIVE six!", "one two three four", "one two three nine four five six", None, "", ITEM + " " + "filler " * 5000]
    assert flags(spark, texts, [ITEM, "short item", None, ITEM]) == {0: (2, 0), 1: (2, 0), 2: (0, None), 3: (0, None), 4: (0, None), 5: (0, None), 6: (2, 0)}


def test_items_that_repeat_count_each_and_are_tiled_once(spark):
    texts, items = [ITEM, "nothing", ITEM], [ITEM, ITEM, "x " * 40, ITEM]
    assert flags(spark, texts, items) == {0: (3, 0), 1: (0, None), 2: (3, 0)}


def test_memory_stays_linear_in_repetitive_texts():
    import tracemalloc

    item, text = np.ones(1000, np.uint64), np.ones(200_000, np.uint64)
    tracemalloc.start()
    assert D.greedy_tiles(item, text) == [(0, 0, 1000)]
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_repetitive_texts_are_flagged(spark):
    assert flags(spark, ["same " * 20_000, "same other " * 50], ["same " * 1000, "same other " * 30]) == {0: (1, 0), 1: (1, 1)}


def brute(texts, items, coverage):
    words = lambda t: D.word_tokens(pa.array([t or ""], pa.large_string()))[1]
    out = {}
    for n, text in enumerate(texts):
        shares = [(sum(k for *_, k in plain_tiling(i.tolist(), words(text).tolist(), D.SEED_WORDS)) / max(1, len(i)), m) for m, i in enumerate(map(words, items))]
        hits = [(-s, m) for s, m in shares if s >= coverage and s > 0]
        out[n] = (len(hits), min(hits)[1] if hits else None)
    return out


def test_flags_are_those_of_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [" ".join(r.choices(vocabulary, k=r.randint(5, 30))) for _ in range(8)]
    texts = []
    for _ in range(40):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 10)))]
        for _ in range(r.randint(0, 2)):
            item = r.choice(items).split()
            a = r.randint(0, len(item) - 1)
            parts += [" ".join(item[a : a + r.randint(1, 30)]), " ".join(r.choices(vocabulary, k=4))]
        r.shuffle(parts)
        texts.append(" ".join(parts))
    assert flags(spark, texts, items) == brute(texts, items, D.COVERAGE)


def test_edge_rows(spark, edges, empty):
    bench = spark.createDataFrame([(1, "plain words stand here in a row"), (None, None)], "item_id long, text string")
    out = D.flagged(edges, bench)
    assert out.columns[:5] == edges.columns and out.count() == edges.count() and out.where("leaked_items > 0").count() == 3
    assert D.flagged(empty, bench).count() == 0 and D.flagged(edges, bench.limit(0)).where("leaked_items > 0").count() == 0
    assert D.decontaminated(edges, bench).count() == edges.count() - 3
    clash = edges.withColumnRenamed("score", "Coverage").withColumn("copies", F.lit(1)).withColumn("component_id", F.lit(2))
    assert D.flagged(clash, bench).columns == [*edges.columns[:4], "copies", "component_id", "leaked_items", "best_item", "coverage"]
    assert D.decontaminated(clash, bench).columns == clash.columns


def test_seeds_that_all_share_make_no_pairs_of_all(spark):
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    shared = words("common", 6)
    items = [(i, f"{shared} {words(f'item{i}x', 20)}") for i in range(30)]
    texts = [(f"{shared} {words(f'text{t}x', 40)}" if t % 10 else f"{items[t // 10][1]} {words(f'text{t}x', 9)}") for t in range(100)]
    texts += [words("item5x", 20), " ".join(items[6][1].split()[20:] + ["z"] + items[6][1].split()[:20]), shared]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda c: D._key(F.col(c))
    seeds = D._seeds(bench.select(key("text").alias("item"), "text"))
    found = D._doc_seeds(docs.select(key("text").alias("doc"), "text"), D._filter(seeds)).distinct()
    pairs = D._candidates(found, seeds, D.COVERAGE)
    plain = found.join(seeds, "seed").groupBy("doc", "item").agg(F.sum("places").alias("places"), F.max("words").alias("words")).where(F.col("places") * D.SEED_WORDS >= F.col("words") * D.COVERAGE).select("doc", "item")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, plain.collect())) and pairs.count() < 50
    got = {r["doc_id"]: r["best_item"] for r in D.flagged(docs, bench).where("leaked_items > 0").collect()}
    assert got == {**{10 * k: k for k in range(10)}, 100: 5, 101: 6}
