"""Runs of repeated words: maximal periodic stretches, found by Lyndon words.

A stack that is scanned from right to left gives the longest Lyndon word at each place, under an order of the words and
under its reverse. Each run has a place where one of the two is as long as its period, so each place's word is extended to
both sides as far as words repeat at its length. Suffixes are compared and words extended by rolling hashes and binary
search, and what the hashes say is checked on the words themselves.

Of a run that repeats at least REPEATS = 4 times, with LEAST = 6 words or more, every three words in a row stand in the text
three times or more. Stretches of such threes are looked for first, and only they are scanned; no run crosses their ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import split_words, text_slices

#: A run's least number of words, and of periods.
LEAST, REPEATS = 6, 4
#: Words that are compared one by one before hashes are.
_NEAR = 12
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E61


class Stretch:
    """Words of a text as numbers, with the lengths of common extensions."""

    def __init__(self, codes: np.ndarray):
        self.words, self.n = codes.tolist(), len(codes)
        self.raw = codes.astype(np.int32).tobytes()
        self.hashes: list[int] | None = None

    def _hash(self) -> None:
        h, self.hashes, self.powers = 0, [0], [1]
        for w in self.words:
            h = (h * _BASE + w + 1) % _PRIME
            self.hashes.append(h)
            self.powers.append(self.powers[-1] * _BASE % _PRIME)

    def _search(self, i: int, j: int, most: int, step: int) -> int:
        """The largest length up to `most` at which the words from i and j on (step 1), or up to them (step -1), are equal."""
        if self.hashes is None:
            self._hash()
        h, p, low, high = self.hashes, self.powers, 0, most
        while low < high:
            l = (low + high + 1) // 2  # noqa: E741
            a, b = (i, j) if step > 0 else (i - l + 1, j - l + 1)
            if (h[a + l] - h[a] * p[l] - h[b + l] + h[b] * p[l]) % _PRIME == 0:
                low = l
            else:
                high = l - 1
        a, b = (i, j) if step > 0 else (i - low + 1, j - low + 1)
        if self.raw[4 * a : 4 * (a + low)] == self.raw[4 * b : 4 * (b + low)]:
            # hashes of equal words are equal, so that none longer is equal
            return low
        w, low = self.words, 0
        while low < most and w[i + step * low] == w[j + step * low]:
            low += 1
        return low

    def ahead(self, i: int, j: int, most: int) -> int:
        """How many words from i on are those from j on."""
        w = self.words
        for k in range(min(most, _NEAR)):
            if w[i + k] != w[j + k]:
                return k
        return most if most <= _NEAR else self._search(i, j, most, 1)

    def behind(self, i: int, j: int, most: int) -> int:
        """How many words up to i are those up to j."""
        w = self.words
        for k in range(min(most, _NEAR)):
            if w[i - k] != w[j - k]:
                return k
        return most if most <= _NEAR else self._search(i, j, most, -1)

    def lyndon_ends(self, reverse: bool) -> list[int]:
        """For each place the end of the longest Lyndon word that begins there."""
        n, ahead = self.n, self.ahead
        w = [-x for x in self.words] if reverse else self.words
        ends = [n] * n
        for i in range(n - 1, -1, -1):
            a, j = w[i], i + 1
            while j < n:
                b = w[j]
                if a > b:
                    break
                if a == b:
                    # the words i..j and j..e: the smaller one first makes a longer Lyndon word
                    e = ends[j]
                    most = min(j - i, e - j)
                    k = ahead(i, j, most)
                    if w[i + k] > w[j + k] if k < most else j - i >= e - j:
                        break
                j = ends[j]
            ends[i] = j
        return ends

    def runs(self) -> set[tuple[int, int, int]]:
        """(start, length, period) of all runs of REPEATS periods and LEAST words or more."""
        w, n, found = self.words, self.n, set()
        for reverse in (False, True):
            ends, seen = self.lyndon_ends(reverse), {}
            for i in range(n - 1, -1, -1):
                e = ends[i]
                p = e - i
                if p * REPEATS > n or not (e < n and w[e] == w[i] or i and w[i - 1] == w[e - 1]):
                    continue
                start, stop = seen.get(p, (n, n))
                if start <= i and e <= stop:
                    continue
                start = i - self.behind(i - 1, e - 1, i) if i else 0
                stop = e + self.ahead(i, e, n - e)
                seen[p] = start, stop
                if stop - start >= max(LEAST, REPEATS * p):
                    found.add((start, stop - start, p))
        return found


def stretches(codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Where runs can be: stretches of LEAST words or more, all threes of which stand three times or more in their text."""
    n = len(codes)
    if n < LEAST:
        return []
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - 2]
    mix = np.uint64(0x9E3779B97F4A7C15)
    key = text.astype(np.uint64)
    for k in range(3):  # equal keys of unlike threes leave more to scan, no less
        key = (key + codes[k : n - 2 + k].astype(np.uint64) + np.uint64(1)) * mix
        key ^= key >> np.uint64(29)
    inside = np.arange(n - 2) + 3 <= offsets[text + 1]
    at = np.flatnonzero(inside)
    _, which, count = np.unique(key[at], return_inverse=True, return_counts=True)
    often = np.zeros(n, bool)
    often[at] = count[which.ravel()] >= 3
    edge = np.flatnonzero(np.diff(np.concatenate([[0], often.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    # of neighbouring texts none shares a stretch, as threes do not cross their ends
    return [(a, b + 2) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b + 2 - a >= LEAST]


def text_runs(codes: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period), by start and then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    for a, b in stretches(codes, offsets):
        k = int(np.searchsorted(offsets, a, side="right")) - 1
        _, small = np.unique(codes[a:b], return_inverse=True)
        out[k] += [(start + a - int(offsets[k]), length, period) for start, length, period in Stretch(small.ravel()).runs()]
    return [sorted(r, key=lambda x: (x[0], x[2])) if r else r for r in out]


#: What puts a text's words in another order before they are scanned: (its id, its number of words) to word numbers, or None.
Order = Callable[[int | None, int], np.ndarray | None]


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: Order | None = None) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): a row for each row of docs.

    Words are maximal stretches outside space and 0x09-0x0D, numbered from 0. A run is a stretch with smallest period q, of
    LEAST words and REPEATS * q or more, that no word next to it extends; collapsed has the words that no run has after its
    first q words, joined by one space. Null, empty and wordless texts have no words and no runs. Repeated rows and null ids
    give a row each; an empty table gives none; other columns are ignored. Texts are scanned whole, one slice after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                offsets, words = split_words(texts, lower=False)
                if order is not None:
                    take, ids = np.arange(len(words)), part.column(0).to_pylist()
                    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                        if (new := order(ids[k], b - a)) is not None:
                            take[a:b] = a + new
                    words = words.take(pa.array(take))
                codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
                found = text_runs(codes, offsets)
                keep = np.ones(len(words), bool)
                for k, runs in enumerate(found):
                    for start, length, period in runs:
                        keep[offsets[k] + start + period : offsets[k] + start + length] = False
                kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), words.filter(pa.array(keep)).cast(pa.string())), " ")
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), lists, joined], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema)


def looped(doc_id: int | None, n: int) -> np.ndarray | None:
    """Lets the end of every tenth text, by its id's hash, go round: its words from some place on repeat the first few of them."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % period
    return at


def digests(found: DataFrame) -> DataFrame:
    """scanned() as numbers and hashes: (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), the four of the longest run (then the first, then the shortest period)."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    best = found.withColumn("__longest", longest)
    length = -F.col("__longest.less")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("__longest.start").alias("start"), length.alias("length"), F.col("__longest.period").alias("period"),
        F.expr("(1000 * -__longest.less) div __longest.period").alias("exponent_milli"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
