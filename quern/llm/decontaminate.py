"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds, hashes of runs of SEED_WORDS words. A filter of fixed size, made of
all items' seeds, leaves most documents' seeds out before the join. A pair whose shared seeds could cover enough of the item
is tiled: the longest match whose words are unmarked in both texts is found by Karp-Rabin hashes of running lengths, becomes
a tile and marks them, again and again. An item counts as leaked when its tiles cover enough of its words, in whatever order
they stand in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._shared import looked_up, materialised, string_parts, text_slices

#: Words of a seed and of the shortest tile; share of an item's words that tiles must cover.
SEED_WORDS, COVERAGE = 5, 0.5
#: Bits of the filter of all items' seeds are 2 to the power of this, 8 MB, however large the benchmark is.
FILTER_BITS = 26
_BASE = np.uint64(0x9E3779B97F4A7C15)


def hashed_values(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings without nulls."""
    raw, ends = string_parts(strings)
    digest, ends = xxhash.xxh64_intdigest, ends.tolist()
    return np.fromiter((digest(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)), np.uint64, len(ends) - 1)


def word_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's words and 64-bit hashes of all words: runs of letters and digits in lower case. Each distinct word is hashed once."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), "[^\\p{L}\\p{N}]+")
    offsets, words = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(full)])[offsets - offsets[0]]
    coded = words.filter(pa.array(full)).dictionary_encode()
    known = hashed_values(coded.dictionary)
    return offsets, known[coded.indices.to_numpy()] if len(known) else np.empty(0, np.uint64)


def rolling(tokens: np.ndarray, length: int = SEED_WORDS) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all runs of `length` tokens."""
    count = max(0, len(tokens) - length + 1)
    out = np.zeros(count, np.uint64)
    for k in range(length if count else 0):
        out = out * _BASE + tokens[k : k + count]
    return out


def _running(tokens: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes, from which those of windows of any length follow."""
    out = np.zeros(len(tokens) + 1, np.uint64)
    # the sum of token * base^-place, so that a cumulative sum gives all of them at once
    powers = _powers(len(tokens), pow(int(_BASE), -1, 1 << 64))
    np.cumsum(tokens * powers, out=out[1:])
    return out


def _powers(count: int, base: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _windows(running: np.ndarray, blocked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows of a length without a blocked token; blocked counts those of each prefix."""
    start = np.flatnonzero(blocked[length:] == blocked[: len(blocked) - length])
    return start, (running[start + length] - running[start]) * _powers(len(running), int(_BASE))[start]


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of the tiles in the order they are marked.

    Each time the longest match of unmarked tokens is taken, of equal ones the first in item, then in text; matches of fewer
    than `least` tokens are none. Memory is linear in the tokens, however often they repeat: the longest length is found by
    halving, and a length's windows are looked up, never paired.
    """
    # tokens of the text that no seed covers can't be under a tile
    here, there = rolling(item, least), rolling(text, least)
    covered = np.zeros(len(text) + 1, np.int64)
    hit = np.flatnonzero(np.isin(there, here))
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + least, -1)
    used = np.cumsum(covered[:-1]) > 0
    kept = np.flatnonzero(used | np.concatenate([[False], used[:-1]])) if len(text) else np.zeros(0, np.int64)
    tokens, free_text, free_item = text[kept], used[kept].copy(), np.ones(len(item), bool)
    run_item, run_text, tiles, high = _running(item), _running(tokens), [], min(len(item), len(tokens))
    count = lambda free: np.concatenate([[0], np.cumsum(~free)])

    def shared(length: int) -> bool:
        a, b = (_windows(r, count(f), length)[1] for r, f in ((run_item, free_item), (run_text, free_text)))
        return bool(np.isin(a, b).any())

    while high >= least:
        low, most = least - 1, high
        while low < most:
            middle = (low + most + 1) // 2
            low, most = (middle, most) if shared(middle) else (low, middle - 1)
        if low < least:
            break
        (at_item, hash_item), (at_text, hash_text) = _windows(run_item, count(free_item), low), _windows(run_text, count(free_text), low)
        order = np.argsort(hash_text, kind="stable")
        at_text, hash_text = at_text[order], hash_text[order]
        first, last = (np.searchsorted(hash_text, hash_item, side=s) for s in ("left", "right"))
        next_of: dict[int, int] = {}  # of windows with a hash, the first that was not found taken yet
        for i, a, b in zip(at_item[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist(), strict=True):
            if not free_item[i : i + low].all():
                continue
            k = next_of.get(a, a)
            while k < b:
                j = int(at_text[k])
                if free_text[j : j + low].all() and np.array_equal(item[i : i + low], tokens[j : j + low]):
                    free_item[i : i + low] = free_text[j : j + low] = False
                    tiles.append((i, int(kept[j]), low))
                    break
                k += 1
            next_of[a] = k
        high = low - 1
    return tiles


def _key(text: F.Column) -> F.Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))


_KEY = "struct<a:bigint,b:bigint>"


def _seeds(items: DataFrame) -> DataFrame:
    """items (item, text) to (item, seed, places, words): how often each seed stands in each item, and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                offsets, tokens = word_tokens(texts)
                found = [np.unique(rolling(tokens[a:b]), return_counts=True) for a, b in zip(offsets, offsets[1:], strict=False)]
                row = np.repeat(np.arange(len(found)), [len(s) for s, _ in found])
                seeds, places = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(seeds.view(np.int64)), pa.array(places.astype(np.int64)), pa.array(np.diff(offsets)[row])], names=["item", "seed", "places", "words"])

    return items.select("item", "text").mapInArrow(run, f"item {_KEY}, seed long, places long, words long")


def _filter(seeds: DataFrame) -> np.ndarray:
    """A bit for each of the first FILTER_BITS bits of a seed; a row of 16 bytes for each 64 of them reaches the driver at most, 16 MB in all."""
    bits = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    rows = seeds.select(F.shiftrightunsigned(bits, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _doc_seeds(docs: DataFrame, filtered: np.ndarray) -> DataFrame:
    """docs (doc, text) to (doc, seed): each text's distinct seeds that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(filtered)  # 8 MB, whatever the benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.view(np.uint64)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                offsets, tokens = word_tokens(texts)
                seeds = rolling(tokens)
                bit = seeds >> np.uint64(64 - FILTER_BITS)
                at = np.flatnonzero((words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
                row = np.searchsorted(offsets, at, side="right") - 1
                inside = at + SEED_WORDS <= offsets[row + 1]
                at, row = at[inside], row[inside]
                order = np.lexsort((seeds[at], row))
                at, row = at[order], row[order]
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (seeds[at[1:]] != seeds[at[:-1]])
                if new.any():
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[new])), pa.array(seeds[at[new]].view(np.int64))], names=["doc", "seed"])

    return docs.select("doc", "text").mapInArrow(run, f"doc {_KEY}, seed long")


def _tiled(pairs: DataFrame) -> DataFrame:
    """pairs (doc, item, text, item_text) to (doc, item, share): the part of the item's words that tiles cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = []
            for n in range(batch.num_rows):  # a pair at a time, as its texts may be long
                part = batch.slice(n, 1)
                offsets, tokens = word_tokens(pa.concat_arrays([part.column(3).cast(pa.large_string()), part.column(2).cast(pa.large_string())]))
                item, text = tokens[: offsets[1]], tokens[offsets[1] :]
                share.append(sum(length for *_, length in greedy_tiles(item, text)) / max(1, len(item)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], names=["doc", "item", "share"])

    return pairs.select("doc", "item", "text", "item_text").mapInArrow(run, f"doc {_KEY}, item {_KEY}, share double")


def _candidates(found: DataFrame, seeds: DataFrame, coverage: float) -> DataFrame:
    """(doc, item) of texts whose seeds (doc, seed) cover enough of an item's (item, seed, places, words) that tiles, which lie within seeds, could.

    An item's most frequent seeds, as many as do not cover enough by themselves, can't make a pair alone. So texts and items
    meet over its other seeds, and the frequent ones are counted for the pairs that come of that: a seed that many texts and
    many items share never makes a pair of each.
    """
    frequent = found.groupBy("seed").agg(F.count("*").alias("many"))
    enough = F.col("words") * F.lit(float(coverage))
    # an item's seeds, as many as its words at most
    hottest = Window.partitionBy("item").orderBy(F.col("many").desc(), "seed").rowsBetween(Window.unboundedPreceding, 0)
    ranked = seeds.join(frequent, "seed").withColumn("hot", F.sum("places").over(hottest) * SEED_WORDS < enough)
    ranked = materialised(ranked.select("item", "seed", "places", "words", "hot"), "ranked-seeds")
    met = found.join(ranked.where("NOT hot"), "seed").groupBy("doc", "item").agg(F.sum("places").alias("places"), F.max("words").alias("words"))
    hot = ranked.where("hot")
    most = hot.groupBy("item").agg(F.sum("places").alias("most"))
    met = materialised(met.join(most, "item", "left").withColumn("most", F.coalesce("most", F.lit(0))).where((F.col("places") + F.col("most")) * SEED_WORDS >= enough), "met")
    more = met.where("most > 0").select("doc", "item").join(hot.select("item", "seed", F.col("places").alias("hot_places")), "item").join(found, ["doc", "seed"]).groupBy("doc", "item").agg(F.sum("hot_places").alias("hot_places"))
    return met.join(more, ["doc", "item"], "left").where((F.col("places") + F.coalesce("hot_places", F.lit(0))) * SEED_WORDS >= enough).select("doc", "item")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """docs (doc, text) and benchmark (id, text) to (doc, leaked, best, share): a row for each distinct text that leaks an item."""
    # items with the same text are tiled once
    items = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.count("*").alias("n"), F.min("id").alias("best")).withColumn("item", _key(F.col("text")))
    items = materialised(items, "items")
    seeds = materialised(_seeds(items), "item-seeds")
    # repeated texts meet before the join
    found = materialised(_doc_seeds(docs, _filter(seeds)).distinct(), "text-seeds")
    pairs = materialised(_candidates(found, seeds, coverage), "pairs")
    texts = docs.join(pairs.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.first("text").alias("text"))
    tiled = _tiled(pairs.join(texts, "doc").join(items.select("item", F.col("text").alias("item_text")), "item")).where(F.col("share") >= coverage)
    rank = F.struct(-F.col("share"), F.col("best").isNull().alias("unnamed"), "best")
    flags = tiled.join(items.select("item", "n", "best"), "item").groupBy("doc").agg(F.sum("n").alias("leaked"), F.min(rank).alias("first"), F.max("share").alias("share"))
    return flags.select("doc", "leaked", F.col("first.best").alias("best"), "share")


def flagged(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", coverage: float = COVERAGE, item_id: str = "item_id", item_text: str = "text", prefix: str = "") -> DataFrame:
    """docs with columns leaked_items long, best_item long and coverage double (names after `prefix`).

    leaked_items counts the benchmark rows whose tiles reach `coverage`; best_item is the id of the most covered (then the
    smallest id) and coverage its share, null and 0 without one. Null and empty texts leak nothing; items of fewer than
    SEED_WORDS words cannot be found. Columns of docs with these names give way to them; other columns, their order and their
    nulls stay.
    """
    names = [prefix + n for n in ("leaked_items", "best_item", "coverage")]
    docs = docs.drop(*names)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    found = materialised(leaks(docs.select(_key(text).alias("doc"), text.alias("text")), benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")), coverage), "leaks")
    found = found.toDF(*[f"__quern_{c}" for c in ("text", "leaked", "best", "share")])
    out = looked_up(docs.withColumn("__quern_text", _key(text)), found, ["__quern_text"], F.spark_partition_id())
    zero = F.coalesce("__quern_share", F.lit(0.0))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("__quern_leaked", F.lit(0)).cast("long").alias(names[0]), F.col("__quern_best").alias(names[1]), zero.alias(names[2]))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """docs without the rows that leak an item, with their own columns."""
    found = flagged(docs, benchmark, text_column, coverage, prefix="__quern_")
    return found.where("__quern_leaked_items = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
