"""Token-id files: range asymmetric numeral coding with a static table that all blocks of a file share.

Ids go in turn to LANES states; a lane's state gives up 32 bits when it would overflow. A block has STEPS ids a lane and is
coded by itself; every CHECK_STEPS a checkpoint holds the states and the place in the block's words, so that a file's
checkpoints can be decoded next to each other. Each block has a checksum of its words and one of its ids.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm._shared import AtomicFile, attempt_name, make_folder, materialised, open_fs, shared_path, text_slices
from quern.llm.tokenise import byte_bpe_path, tokenizer

LANES, STEPS, CHECK_STEPS, BITS = 512, 512, 256, 20
_LOW = 1 << 31
MAGIC = b"QRANS01\n"
#: Ids of a file, about, and the id after each document.
FILE_IDS, END = 4 << 20, 0


def table_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur and their shares of 2^BITS, none zero."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols].astype(np.int64)
    shares = counts * ((1 << BITS) - len(symbols)) // max(1, int(counts.sum())) + 1
    if len(symbols):
        shares[np.argmax(shares)] += (1 << BITS) - int(shares.sum())
    return symbols.astype(np.uint16), shares.astype(np.uint64)


def _encode_rows(codes: np.ndarray, shares: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """codes (blocks, steps, lanes) to states and word places at each checkpoint, words by block in the order they are read, words of each block."""
    blocks, steps, lanes = codes.shape
    state = np.full((blocks, lanes), _LOW, np.uint64)
    words, owners, states, seen = [None] * steps, [None] * steps, [], []
    total = np.zeros(blocks, np.int64)
    bits, limit = np.uint64(BITS), np.uint64((_LOW >> BITS) << 32)
    for t in range(steps - 1, -1, -1):
        code = codes[:, t, :]
        share = shares[code]
        over = state >= limit * share
        words[t] = (state[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        owners[t] = np.nonzero(over)[0].astype(np.uint16)
        total += over.sum(axis=1)
        state = np.where(over, state >> np.uint64(32), state)
        whole, rest = np.divmod(state, share)
        state = (whole << bits) + rest + starts[code]
        if t % CHECK_STEPS == 0:
            states.append(state)
            seen.append(total.copy())
    owners, words = np.concatenate(owners), np.concatenate(words)
    # words that come after a checkpoint were written before it
    places = total[None, :] - np.array(seen[::-1])
    return np.array(states[::-1]).transpose(1, 0, 2), places.T, words[np.argsort(owners, kind="stable")], total


def _decode_rows(states: np.ndarray, places: np.ndarray, words: np.ndarray, steps: int, lookup: np.ndarray, shares: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Codes (rows, steps, lanes) from checkpoints' states (rows, lanes) and places in words (rows)."""
    out = np.empty((len(states), steps, states.shape[1]), np.uint16)
    state, place = states.copy(), places.astype(np.int64).copy()
    bits, mask, low = np.uint64(BITS), np.uint64((1 << BITS) - 1), np.uint64(_LOW)
    for t in range(steps):
        slot = state & mask
        code = lookup[slot]
        out[:, t, :] = code
        state = shares[code] * (state >> bits) + slot - starts[code]
        under = state < low
        at = np.cumsum(under, axis=1)
        need = at[:, -1].copy()
        at += place[:, None] - 1
        state[under] = (state[under] << np.uint64(32)) | words[at[under]]
        place += need
    return out


def encode(ids: np.ndarray) -> tuple[dict, list[bytes]]:
    """uint16 ids to (description, parts of the file's body)."""
    symbols, shares = table_of(ids)
    starts = np.concatenate([[0], np.cumsum(shares)[:-1]]).astype(np.uint64) if len(shares) else shares
    code_of = np.zeros(1 << 16, np.uint16)
    code_of[symbols] = np.arange(len(symbols), dtype=np.uint16)
    block, parts, blocks = LANES * STEPS, [], []
    whole = len(ids) // block
    groups = [(ids[: whole * block], whole, STEPS)] if whole else []
    if rest := len(ids) - whole * block:
        steps = -(-rest // LANES)
        filler = symbols[np.argmax(shares)]
        groups.append((np.concatenate([ids[whole * block :], np.full(steps * LANES - rest, filler, np.uint16)]), 1, steps))
    done = 0
    for some, count, steps in groups:
        states, places, words, totals = _encode_rows(code_of[some].reshape(count, steps, LANES), shares, starts)
        at = np.concatenate([[0], np.cumsum(totals)])
        for k in range(count):
            own = words[at[k] : at[k + 1]].tobytes()
            true = ids[done : done + steps * LANES]
            done += len(true)
            blocks.append({"ids": len(true), "steps": steps, "words": int(totals[k]), "places": places[k].tolist(), "crc": zlib.crc32(own), "ids_crc": zlib.crc32(true.tobytes())})
            parts += [states[k].astype("<u8").tobytes(), own]
    return {"lanes": LANES, "bits": BITS, "check_steps": CHECK_STEPS, "symbols": len(symbols), "blocks": blocks}, [symbols.astype("<u2").tobytes(), shares.astype("<u4").tobytes(), *parts]


def decode(head: dict, body: bytes) -> np.ndarray:
    """The ids of encode(); raises ValueError where a checksum differs."""
    n, lanes, steps_between = head["symbols"], head["lanes"], head["check_steps"]
    symbols = np.frombuffer(body, "<u2", n)
    shares = np.frombuffer(body, "<u4", n, 2 * n).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(shares)[:-1]]).astype(np.uint64) if n else shares
    lookup = np.repeat(np.arange(n, dtype=np.uint16), shares.astype(np.int64))
    at, words_at, words, rows = 6 * n, 0, [], []
    for b, block in enumerate(head["blocks"]):
        count = len(block["places"])
        states = np.frombuffer(body, "<u8", count * lanes, at).reshape(count, lanes)
        at += states.nbytes
        own = body[at : at + 4 * block["words"]]
        if zlib.crc32(own) != block["crc"]:
            raise ValueError(f"block {b} is damaged")
        at += len(own)
        words.append(np.frombuffer(own, "<u4"))
        for k, place in enumerate(block["places"]):
            rows.append((min(steps_between, block["steps"] - k * steps_between), b, k, states[k], words_at + place))
        words_at += block["words"]
    # one word more, as a place may be the end
    words = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
    pieces: dict[tuple[int, int], np.ndarray] = {}
    for steps in {r[0] for r in rows}:
        same = [r for r in rows if r[0] == steps]
        codes = _decode_rows(np.array([r[3] for r in same], np.uint64), np.array([r[4] for r in same]), words, steps, lookup, shares, starts)
        pieces |= {(r[1], r[2]): codes[i].ravel() for i, r in enumerate(same)}
    out = []
    for b, block in enumerate(head["blocks"]):
        ids = symbols[np.concatenate([pieces[b, k] for k in range(len(block["places"]))])][: block["ids"]]
        if zlib.crc32(ids.tobytes()) != block["ids_crc"]:
            raise ValueError(f"ids of block {b} differ")
        out.append(ids)
    return np.concatenate([np.zeros(0, np.uint16), *out])


def write_file(uri: str, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> int:
    """One file: magic, body, the documents' ids and numbers of token ids, a description in JSON, its length."""
    head, parts = encode(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + sizes.astype("<i8").tobytes() + known.tobytes(), 1)
    head |= {"documents": len(doc_ids), "index": len(index), "index_crc": zlib.crc32(index)}
    text = json.dumps(head, separators=(",", ":")).encode()
    out = AtomicFile(uri)
    for part in (MAGIC, *parts, index, text, struct.pack("<Q", len(text))):
        out.write(part)
    out.close()
    return out.size


def read_file(uri: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents' ids, their numbers of token ids and all token ids of a file."""
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        data = f.read()
    (length,) = struct.unpack("<Q", data[-8:])
    head = json.loads(data[-8 - length : -8])
    index = data[-8 - length - head["index"] : -8 - length]
    if data[:8] != MAGIC or zlib.crc32(index) != head["index_crc"]:
        raise ValueError(f"{uri} is damaged")
    n, index = head["documents"], zlib.decompress(index)
    ids, sizes, known = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<i8", n, 8 * n), np.frombuffer(index, np.uint8, n, 16 * n)
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], sizes, decode(head, data[8:])


def write_tokens(docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Write the token ids of docs below folder in ascending order of id; returns the manifest (file, part, number, documents, ids, bytes).

    Each text (null: empty) is encoded whole, without special tokens added, and END follows it. Rows without an id come
    first; rows that share an id are in an order that depends on their texts. Other columns are ignored; an empty table
    writes no files. path: the tokenizer's file; all workers have it.
    """
    make_folder(folder)
    path = path or byte_bpe_path()
    spark = docs.sparkSession
    dealt = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, rows = TaskContext.get().partitionId(), tokenizer(path), []
        doc_ids, sizes, ids, held = [], [], [], 0

        def done() -> None:
            name = attempt_name("tokens", f"-{len(rows):05d}.rans")
            size = write_file(f"{folder}/{name}", doc_ids, np.concatenate(sizes), np.concatenate(ids))
            rows.append((name, part, len(rows), len(doc_ids), held, size))

        for batch in batches:
            for some, texts in text_slices(batch, "text"):
                count, flat = encoder.encode(texts)
                with_end = np.full(len(flat) + len(count), END, np.uint16)
                with_end[np.arange(len(flat)) + np.repeat(np.arange(len(count)), count)] = flat
                doc_ids += some.column(0).to_pylist()
                sizes.append(count + 1)
                ids.append(with_end)
                held += len(with_end)
                if held >= FILE_IDS:
                    done()
                    doc_ids, sizes, ids, held = [], [], [], 0
        if doc_ids:
            done()
        names = ("file", "part", "number", "documents", "ids", "bytes")
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k else pa.string()) for k in range(6)], names=names)

    return materialised(dealt.mapInArrow(run, "file string, part long, number long, documents long, ids long, bytes long"), "tokens-manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files: start counts the ids of all documents before it."""
    # a row for each file of millions of ids, so that this window's one task stays small
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, sizes, ids = read_file(f"{folder}/{file}")
                ends = np.cumsum(sizes)
                raw, at = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], ends])).tolist()
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = max(1, min(2000, manifest.count()))
    return files.repartition(parts, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame) -> DataFrame:
    """Write docs' token ids into files in the shared folder and return what read_tokens finds there."""
    folder = shared_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder))
