"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A token is a run of letters, of digits or of other signs, in lower case; a run that repeats the one before it counts as a
repeat mark, and letters that stand in capitals alone give a mark too. A text's features are the shares of its n-grams among
all of them, so that a score is a sparse dot product of counts and weights over the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import text_slices
from quern.llm.decontaminate import hashed_values

#: Weights; words of the longest n-gram; labelled rows that a model learns from, at most; passes over them; threshold of label 1.
SIZE, NGRAM, TRAIN_ROWS, PASSES, THRESHOLD = 1 << 18, 2, 4000, 2, 0.7
#: Rate, smoothing and both penalties of the learner; features are shares times SCALE.
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.001, 0.1, 20.0
_MIX, _MARK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
REPEAT, CAPITALS = np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)


def features(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's n-grams and the place of each among `size` weights."""
    # a blank on both sides of each run of signs makes it a token
    spaced = pc.replace_substring_regex(texts, "([^\\p{L}\\p{N}\\s]+)", " \\1 ")
    lists = pc.ascii_split_whitespace(spaced)
    offsets, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    offsets = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets - offsets[0]]
    coded = words.filter(full).dictionary_encode()
    lower = pc.utf8_lower(coded.dictionary)
    loud = pc.and_(pc.utf8_is_upper(coded.dictionary), pc.greater(pc.utf8_length(coded.dictionary), 1)).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    token = hashed_values(lower)[codes] if len(codes) else np.zeros(0, np.uint64)
    first = np.zeros(len(token) + 1, bool)
    first[offsets[:-1]] = True
    same = np.concatenate([[False], token[1:] == token[:-1]]) & ~first[: len(token)] if len(token) else np.zeros(0, bool)
    token = np.where(same, REPEAT, token)
    pair = np.concatenate([np.zeros(1, np.uint64), token[:-1] * _MIX]) ^ token if len(token) else token
    pair = np.where(first[: len(token)], token * _MARK, pair * _MARK)
    shout = np.where(loud[codes], CAPITALS, token) if len(token) else token
    grams = np.stack([token, pair, shout], axis=1)
    return 3 * offsets, ((grams * _MIX) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64).ravel()


def train(texts: list[str | None], labels: list[int], size: int = SIZE, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias of a model that follows the regularised leader, one text at a time, in the order given. Labels count equally as classes."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    positive = max(1, sum(labels))
    weight_of = {1: len(labels) / (2 * positive), 0: len(labels) / (2 * max(1, len(labels) - positive))}
    rows = []
    for start in range(0, len(texts), 64):
        offsets, places = features(pa.array([t or "" for t in texts[start : start + 64]], pa.large_string()), size)
        counted = [np.unique(places[a:b].astype(np.int32), return_counts=True) for a, b in zip(offsets, offsets[1:], strict=False)]
        rows += [(at, count.astype(np.int32)) for at, count in counted]
    solve = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(passes):
        for (at, count), label in zip(rows, labels, strict=True):
            at = np.append(at, size)
            x = np.append(count * (SCALE / max(1, count.sum())), 1.0)
            w = solve(z[at], n[at])
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = weight_of[label] * (p - label) * x
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = solve(z, n)
    return w[:size].astype(np.float32), float(w[size])


def scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1 for each text of a large_string array without nulls."""
    offsets, places = features(texts, len(weights))
    count = np.diff(offsets)
    sums = np.concatenate([[0.0], np.cumsum(weights[places], dtype=np.float64)])
    mean = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(1, count)
    return 1.0 / (1.0 + np.exp(-np.clip(SCALE * mean + bias, -35, 35)))


def held_out(id_column: str, parts: int = 4, part: int = 2) -> F.Column:
    """Whether crc32 of the id as text leaves `part` when divided by `parts`; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> tuple[list[str | None], list[int]]:
    """Texts and labels of at most `rows` labelled documents that are not held out, those of the smallest hashes of their ids.

    This sample is the only thing gathered; its bound is `rows` texts. Labels other than 0 and 1 are left out; ids with both are too.
    """
    marked = labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    marked = marked.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").where(~held_out("id"))
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(rows).select("id", "label")
    found = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    found = found.orderBy(F.xxhash64("id", F.lit(1)), "id", "text").limit(rows).select("text", "label").toArrow()
    return found.column("text").to_pylist(), found.column("label").to_pylist()


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", prefix: str = "") -> DataFrame:
    """docs with columns score double and predicted int (names after `prefix`): the probability of label 1, and whether it is THRESHOLD or more.

    The model learns from sample(). Null and empty texts have no n-grams and score as the bias alone. Without labels every
    score is a half. Columns of docs with these names give way to them; other columns, their order and their nulls stay.
    """
    names = [prefix + "score", prefix + "predicted"]
    docs = docs.drop(*names)
    model = docs.sparkSession.sparkContext.broadcast(train(*sample(docs, labels, rows, id_column, text_column, label_column)))  # SIZE weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, text_column):
                found = scores(texts, *model.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=[*part.schema.names, *names])

    schema = docs.select("*", F.lit(0.0).alias(names[0]), F.lit(0).alias(names[1])).schema
    return docs.mapInArrow(run, schema)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects, with their own columns."""
    found = scored(docs, labels, prefix="__quern_")
    return found.where("__quern_predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
