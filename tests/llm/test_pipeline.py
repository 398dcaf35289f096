import re
from collections import Counter

import corpus_pipeline as pipeline
from quern.llm import decontaminate, mixing, quality, rans, simhash


def test_each_stage_takes_effect_on_its_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        assert name == "token_files" or docs.columns == columns
    ids = lambda f: sorted(r["doc_id"] for r in f.select("doc_id").collect())
    before, after = seen["quality"]
    assert ids(after) == ids(quality.scored(before, labels).where("predicted = 1")) and after.join(labels, "doc_id").where("quality = 1").count() == before.join(labels, "doc_id").where("quality = 1").count()
    before, after = seen["near_duplicates"]
    assert ids(after) == sorted({r["component_id"] for r in simhash.copies_grouped(before).collect()})
    before, after = seen["decontamination"]
    assert ids(after) == ids(decontaminate.flagged(before, bench).where("leaked_items = 0")) and decontaminate.flagged(after, bench).where("leaked_items > 0").count() == 0
    before, after = seen["mixing"]
    assert ids(after) == sorted(r["doc_id"] for r in mixing.mixed(before).collect() for _ in range(r["copies"]))
    before, after = seen["token_files"]
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, rans.token_round_trip(before).collect()))
    assert sorted(map(tuple, pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, after.collect()))


def test_rows_without_ids_and_texts_pass(spark, sf_dir, edges):
    docs = edges.select("doc_id", "text", "source", "score")
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "token_files":
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    docs.collect()


def plain_words(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({k: " " for k in range(9, 14)}).split(" ") if w]


def test_stages_hold_against_plain_checks(spark, tmp_path):
    """No stage's own functions are used here: pairs of sets, windows of words, sums by source and the tokenizer itself are."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.01"
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        seen[name] = docs, (docs := spark.read.parquet(str(tmp_path / name)))
    rows = {n: [f.collect() for f in pair] for n, pair in seen.items()}

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows["quality"][1]}
    good, bad = ([d for d, q in labels.items() if q == v] for v in (1, 0))
    assert sum(d in kept for d in good) >= 0.97 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)

    before, after = rows["near_duplicates"]
    sets = {r["doc_id"]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := plain_words(r["text"])) else set() for r in before}
    kept, ids = {r["doc_id"] for r in after}, sorted(sets)
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k] if sets[a] & sets[b]}
    close = [p for p, s in share.items() if s >= 0.8]
    assert len(close) > 20 and sum(not (a in kept and b in kept) for a, b in close) >= 0.9 * len(close)
    touched = {x for p, s in share.items() if s >= 0.5 for x in p}
    assert {d for d in ids if d not in touched and sets[d]} <= kept

    before, after = rows["decontamination"]
    kept = {r["doc_id"] for r in after}
    tokens = lambda text: tuple(re.findall(r"[^\W_]+", (text or "").lower()))
    runs = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)}
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items = [t for t in items if len(t) >= 5]
    fives = set().union(*(runs(t, 5) for t in items))
    for r in before:
        t = tokens(r["text"])
        if any(len(item) <= len(t) and item in runs(t, len(item)) for item in items):
            assert r["doc_id"] not in kept
        elif not runs(t, 5) & fives:
            assert r["doc_id"] in kept

    before, after = rows["mixing"]
    size, of, copies = {r["doc_id"]: len(plain_words(r["text"])) for r in before}, {r["doc_id"]: r["source"] for r in before}, Counter(r["doc_id"] for r in after)
    total, sources = Counter(), sorted({s for s in of.values() if s is not None}) + [None] * (None in of.values())
    for d, n in size.items():
        total[of[d]] += n
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    target, open_, left = {}, {s for s in sources if total[s]}, sum(total.values())
    while open_ and (over := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * total[s]}):
        target |= {s: 3 * total[s] for s in over}
        open_, left = open_ - over, left - sum(3 * total[s] for s in over)
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = Counter()
    for d, n in copies.items():
        assert n <= 3
        taken[of[d]] += n * size[d]
    assert all(abs(taken[s] - target[s]) <= max(size[d] for d in size if of[d] == s) for s in target)

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(rows["token_files"][0], key=lambda r: r["doc_id"]):
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows["token_files"][1]) == want
