import gc
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quern.llm import rans, tokenise
from quern.llm.tokenise import BatchTokenizer, Kept, _lists, byte_bpe_path


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, rans.LANES * rans.STEPS, rans.LANES * rans.STEPS + 7, 600_000])
def test_ids_survive_coding(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.4, n), 65_535).astype(np.uint16)
    head, parts = rans.encode(ids)
    assert np.array_equal(rans.decode(head, b"".join(parts)), ids)
    if n > 300_000:
        assert sum(map(len, parts)) < 2 * n


def test_damage_is_noticed(tmp_path):
    ids = np.random.default_rng(1).integers(0, 999, 70_000).astype(np.uint16)
    path = str(tmp_path / "a.rans")
    rans.write_file(path, [3, None, 7], np.array([70_000, 0, 0]), ids)
    doc_ids, sizes, read = rans.read_file(path)
    assert doc_ids == [3, None, 7] and sizes.tolist() == [70_000, 0, 0] and np.array_equal(read, ids)
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        rans.read_file(path)


def test_parts_give_the_ids_of_whole_texts():
    tokenizer = BatchTokenizer(byte_bpe_path())
    assert tokenizer.by_parts
    r = np.random.default_rng(5)
    signs = [" ", "  ", "a", "Bc", "'s", "\n", "\t", "1", "é", ".", "!!", "<|endoftext|>", "漢", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "😀", "n't"]
    texts = ["".join(r.choice(signs, r.integers(0, 14))) for _ in range(4000)]
    sizes, ids = tokenizer.encode(pa.array(texts, pa.large_string()))
    plain = [e.ids for e in Tokenizer.from_file(byte_bpe_path()).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(p) for p in plain] and ids.tolist() == [i for p in plain for i in p]


def test_kept_parts_take_few_bytes():
    tokenizer = BatchTokenizer(byte_bpe_path())
    gc.collect()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    for start in range(0, 100_000, 20_000):
        tokenizer.encode(pa.array([f"a w{i}" for i in range(start, start + 20_000)], pa.large_string()))
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 60 * 100_000


def test_kept_parts_with_one_hash_are_told_apart():
    kept = Kept()
    parts = pa.array(["a", "b", "", "c"], pa.large_string())
    kept.add(parts, np.array([7, 7, 3, 9]), _lists(np.array([1, 2, 0, 1]), np.array([5, 6, 6, 8], np.uint16)))
    found = kept.find(pa.array(["b", "a", "c", "d", ""], pa.large_string()), np.array([7, 7, 9, 9, 3])).tolist()
    # of a and b one is found, the other is encoded anew
    assert found[:2] in ([-1, 0], [1, -1]) and found[2:] == [3, -1, 2]
    assert kept.lists.take(pa.array([found[2]])).to_pylist() == [[8]]


def test_workers_can_give_up_tokenizers():
    path = byte_bpe_path()
    first = tokenise.tokenizer(path, 7)
    assert tokenise.tokenizer(path, 7) is first
    tokenise.forget()
    assert not tokenise._LOADED and tokenise.tokenizer(path, 7) is not first


def want(rows):
    tokenizer, start, out = Tokenizer.from_file(byte_bpe_path()), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(map(tuple, rans.token_round_trip(docs).collect())) == want(rows)


def test_edge_rows(edges, empty):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    got = sorted(map(tuple, rans.token_round_trip(edges).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert sorted((g[2], g[3]) for g in got) == sorted(w[2:] for w in want(rows))
    assert [g[1] for g in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert rans.token_round_trip(empty).count() == 0
