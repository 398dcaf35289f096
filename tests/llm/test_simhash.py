import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import graph, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups: dict = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprints_are_those_of_plain_counts():
    texts = ["", " \n", "One", "one two", "one two three", "a b c d e f g", "a a a a a a a", "É é x\x0by\x1cz", "w " * 700]
    got = simhash.text_fingerprints(pa.array(texts, pa.large_string()))
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


def test_spark_hashes_agree(spark):
    assert spark.sql("SELECT xxhash64('one two three')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("one two three", 42) == plain_fingerprint("one two three")


@pytest.mark.parametrize("seed", range(3))
def test_tiles_lose_no_link(spark, seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = [int(b) for b in base]
    for _ in range(300):
        x = fps[r.integers(len(fps))]
        for k in r.integers(0, 64, r.integers(0, 5)):
            x ^= 1 << int(k)
        fps.append(x)
    fps = sorted(set(fps) | {0, (1 << 64) - 1, 7})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {row["node"]: row["root"] for row in graph.components(simhash.links(frame, tile_rows=8)).collect()}
    index = {s: i for i, s in enumerate(signed)}
    want = plain_components(list(range(len(fps))), fps)
    got = [roots.get(s, s) for s in signed]
    assert [[want[index[a]] == want[index[b]] for b in signed[:60]] for a in signed[:60]] == [[x == y for y in got[:60]] for x in got[:60]]
    assert len(set(got)) == len(set(want))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(1000, i) for i in range(200, 300)] + [(5, 5), (None, 3), (7, 6)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {got[i] for i in range(91)} == {0} and {got[i] for i in (1000, *range(200, 300))} == {200} and len(got) == 192
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_is_that_of_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = {r["doc_id"]: (f, c) for r, f, c in zip(rows, fps, plain_components([r["doc_id"] for r in rows], fps), strict=True)}
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == sorted({c for _, c in want.values()})


def test_edge_rows(edges, empty):
    rows = edges.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = sorted(zip([r["doc_id"] for r in rows], plain_components([r["doc_id"] for r in rows], fps), strict=True), key=repr)
    assert sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(edges).collect()), key=repr) == want
    edges = edges.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("n", F.lit("x"))
    kept = simhash.deduplicated(edges)
    assert kept.columns == edges.columns and kept.where("doc_id IS NULL").count() == 2 and kept.where("doc_id = 7").count() == 0 and kept.where("doc_id = 1").count() == 2  # two texts that are not alike
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


def test_an_id_on_two_unrelated_texts_leads_both_groups(spark):
    a, b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (1, a)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicated(docs).collect())) == [(1, a), (1, b)]


def test_tiles_of_many_parts_lose_no_link(spark):
    fps = [(1 << (i % 16)) | (1 << (16 + i // 16 % 16)) for i in range(256)]
    frame = spark.createDataFrame([(x,) for x in fps], "fp long").distinct()
    found = graph.components(simhash.links(frame, radius=2, tile_rows=20)).collect()
    assert len(found) == 256 and len({r["root"] for r in found}) == 1


def five_word_sets(rows):
    out = {}
    for doc_id, text in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ") if x]
        out[doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_are_found_and_others_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    sets = five_word_sets(docs.select("doc_id", "text").collect())
    found = {r["doc_id"]: r["component_id"] for r in simhash.copies_grouped(docs).collect()}
    ids = sorted(sets)
    pairs = [(alike(sets[a], sets[b]), a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] & sets[b]]
    near = [found[a] == found[b] for share, a, b in pairs if share >= 0.8]
    assert len(near) > 50 and np.mean(near) >= 0.9
    # a document that is alike to no other by half stays by itself
    close = {x for share, a, b in pairs if share >= 0.5 for x in (a, b)}
    assert all(found[x] == x and list(found.values()).count(x) == 1 for x in ids if x not in close and sets[x])
    assert sorted(r["doc_id"] for r in simhash.without_copies(docs).collect()) == sorted({c for c in found.values()})


@pytest.mark.parametrize("edits", [1, 3, 5])
def test_copies_with_some_words_changed_are_one_group(spark, edits):
    r, rows = np.random.default_rng(edits), []
    for k in range(40):
        words = [f"w{x}" for x in r.integers(0, 5000, 300)]
        rows.append((2 * k, " ".join(words)))
        for at in r.integers(0, 300, edits):
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    sets = five_word_sets(rows)
    found = {x["doc_id"]: x["component_id"] for x in simhash.copies_grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [found[2 * k] == found[2 * k + 1] for k in range(40) if alike(sets[2 * k], sets[2 * k + 1]) >= 0.8]
    assert len(near) == 40 and np.mean(near) >= 0.9 and len(set(found.values())) <= 44 and all(c // 2 == d // 2 for d, c in found.items())


def test_many_blocks_and_edge_rows_of_copies(spark, edges, empty, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base[: k % 199], f"x{k}", *base[k % 199 + 1 :]])) for k in range(60)] + [(100 + k, " ".join(f"y{k}_{i}" for i in range(200))) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wide = simhash.copies_grouped(frame)
    assert {r["component_id"] for r in wide.collect() if r["doc_id"] < 100} == {0} and wide.where("doc_id >= 100 AND doc_id = component_id").count() == 20
    edges = edges.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("size", F.lit("x"))
    kept = simhash.without_copies(edges)
    assert kept.columns == edges.columns and kept.where("doc_id IS NULL").count() == 2
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [-6, 1, 1, 2, 5]
    assert simhash.without_copies(empty).count() == 0
