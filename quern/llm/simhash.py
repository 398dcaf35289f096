"""SimHash near-duplicates: 64-bit fingerprints, compared exactly tile by tile.

A tile holds fingerprints whose four 16-bit slices have the same population counts. Each slice's counts differ by no more
than its bits do, so tiles whose counts differ by more than the radius in sum hold no link and are skipped; the rest are
compared with exclusive-or and bit counts in numpy. Equal fingerprints stand in once.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import looked_up, materialised, split_words, string_parts, text_slices
from quern.llm.graph import components
from quern.llm.minhash import shingle_sets

#: Words of a shingle, differing bits of a link, seed of a shingle's hash.
SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints that one row of a tile holds at most, about.
TILE_ROWS = 4096
#: Near copies: words of a shingle, fingerprints of 64 bits, differing bits of the first one and of all, and least share of the smaller set's size.
COPY_SHINGLE, WIDE, COPY_NEAR, COPY_RADIUS, COPY_PERCENT = 5, 8, 15, 92, 80
_LANES = np.uint64(0x0101010101010101)


def bit_majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of `counts` hashes each, the bits that are set in over half of the run; an empty run gives zero."""
    full = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint64)
    if not len(full):
        return out
    n = counts[full]
    # byte lanes hold sums of up to 255 hashes
    pieces = -(-n // 255)
    starts = np.cumsum(n) - n
    piece_at = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(piece_at, pieces))
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        lanes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), piece_at, axis=0)
        over = (2 * lanes > n[:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(over).view(np.uint64).ravel() << np.uint64(k)
    return out


def text_fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned fingerprints of a large_string array without nulls."""
    offsets, words = split_words(texts)
    per = np.diff(offsets)
    if not len(words):
        return np.zeros(len(per), np.uint64)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.cast(pa.string()))
    raw, _ = string_parts(pc.binary_join(lists, " "))
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(per)), per)
    rank = np.cumsum(per > 0) - 1  # of texts with words: each is joined without a blank at its end
    begin = np.cumsum(size + 1) - (size + 1) - rank[doc]
    end = begin + size
    count = np.where(per >= shingle, per - shingle + 1, (per > 0).astype(np.int64))
    first = np.repeat(offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    last = first + np.repeat(np.minimum(per, shingle), count) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], seed) for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
    return bit_majorities(hashes, count)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, fp long): a row for each row of docs; null and wordless texts have fingerprint zero. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_fingerprints(texts).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all the links a[i]-b[i] join, fewer than there are ends."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return a[kept], b[kept]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two arrays of fingerprints, compared in blocks of about `rows` pairs."""
    left, right = [], []
    step = max(1, rows // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        if len(x):
            x, y = a[i + x], b[y]
            x, y = x[x != y], y[x != y]
            if len(x) > len(a) + len(b):
                x, y = forest(x.view(np.int64), y.view(np.int64))
            left.append(x.view(np.int64))
            right.append(y.view(np.int64))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(np.concatenate(left), np.concatenate(right))


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of slice counts between a tile and those to compare it with; of two opposite ones, one."""
    zero = (0, 0, 0, 0)
    return [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= zero]


def links(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """fps (fp long, distinct) to (u, v): links that join all fingerprints within the radius, directly or over others."""
    counts = [F.expr(f"bit_count(shiftrightunsigned(fp, {16 * k}) & 65535L)").cast("int") for k in range(4)]
    keyed = fps.select("fp", F.struct(*[c.alias(f"s{k}") for k, c in enumerate(counts)]).alias("tile"))
    # 17^4 tiles at most, so the counts have a size bound of 2 MB and may be broadcast; their parts are one for TILE_ROWS fingerprints more
    sizes = materialised(keyed.groupBy("tile").agg(F.count("*").alias("n")), "tiles")
    parts = F.ceil(F.col("n") / tile_rows)
    blocks = keyed.join(F.broadcast(sizes), "tile").groupBy("tile", F.pmod(F.xxhash64("fp", F.lit(7)), parts).alias("part")).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    blocks = materialised(blocks, "blocks")
    near = F.array(*[F.struct(*[(F.col("tile")[f"s{k}"] + F.lit(x)).alias(f"s{k}") for k, x in enumerate(d)]) for d in _offsets(radius)])
    # each pair of parts has a key of its own on the right, so that no two of them must meet in one task
    other = sizes.select(F.col("tile").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part_b"))
    left = blocks.select("tile", F.col("part").alias("part_a"), F.col("fps").alias("a"), F.explode(near).alias("other")).join(F.broadcast(other), "other")
    left = left.where("tile <> other OR part_a <= part_b")
    right = blocks.select(F.col("tile").alias("other"), F.col("part").alias("part_b"), F.col("fps").alias("b"))
    pairs = left.join(right, ["other", "part_b"]).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            sides = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column(0), batch.column(1))]
            (ao, av), (bo, bv) = sides
            for i in range(batch.num_rows):
                found.append(tile_links(av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]], radius))
            u, v = (np.concatenate([x[k] for x in found]) for k in (0, 1)) if found else (np.empty(0, np.int64),) * 2
            u, v = forest(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def grouped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """near_duplicates() with root long, the fingerprint that stands for the component, whatever ids its rows have."""
    each = materialised(fingerprints(docs, id_column, text_column), "fingerprints")
    fps = materialised(each.groupBy("fp").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")), "distinct")
    roots = components(links(fps.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    linked = fps.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("lead").alias("component_id"))
    # a fingerprint of one row without links needs no lookup
    known = linked.join(least, "root").select("fp", "root", "component_id").union(fps.where("n > 1").join(roots, "fp", "left_anti").select("fp", "fp", F.col("lead").alias("component_id")))
    known = materialised(known, "known")
    found = F.col("root").isNotNull()
    # a frequent fingerprint, as that of texts without words, is met in many tasks
    each = looked_up(each, known, ["fp"], F.hash("doc_id"))
    return each.select("doc_id", "fp", F.when(found, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp long, component_id): a row for each row of docs.

    component_id is the smallest doc_id that can be reached over links of `radius` differing bits or fewer. Null ids keep their
    rows; a component of such alone has a null id. Repeated rows and ids give a row each. An empty table gives no rows.
    """
    return grouped(docs, id_column, text_column, radius).drop("root")


def _majorities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WIDE fingerprints for each set of shingle hashes."""
    counts = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    rows = []
    for k in range(WIDE):
        x = (flat ^ (flat >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        rows.append(bit_majorities(x ^ (x >> np.uint64(29)), counts))
    return np.stack(rows, axis=1)


def _set_names(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)


def wide_tile_links(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], near: int, radius: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks (fp, size, WIDE columns of fingerprints)."""
    (ia, na, *fa), (ib, nb, *fb) = a, b
    names, inverse = np.unique(np.concatenate([ia, ib]), return_inverse=True)
    at_a, at_b, label = inverse[: len(ia)], inverse[len(ia) :], np.arange(len(names))
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(ib)))
    for i in range(0, len(ia), step):
        x, y = np.nonzero(np.bitwise_count(fa[0][i : i + step, None] ^ fb[0][None, :]) <= near)
        x += i
        open_ = label[at_a[x]] != label[at_b[y]]
        x, y = x[open_], y[open_]
        apart = sum(np.bitwise_count(fa[k][x] ^ fb[k][y]).astype(np.int64) for k in range(WIDE))
        linked = (apart <= radius) & (100 * np.minimum(na[x], nb[y]) >= percent * np.maximum(na[x], nb[y]))
        x, y = at_a[x[linked]], at_b[y[linked]]
        if len(x):
            # what is joined already is told by labels, so that few links of a large group are walked
            ends = np.unique(np.stack([label[x], label[y]], axis=1), axis=0)
            u, v = forest(ends[:, 0], ends[:, 1])
            left.append(names[u])
            right.append(names[v])
            parent = np.arange(len(names))
            for p, q in zip(u.tolist(), v.tolist(), strict=True):
                while parent[p] != p:
                    p = parent[p]
                while parent[q] != q:
                    q = parent[q]
                parent[max(p, q)] = min(p, q)
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            label = parent[label]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def wide_links(fps: DataFrame, near: int, radius: int, percent: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """fps (fp, size, w0, ...) to (u, v): links that join all sets within the radius and alike in size.

    A tile holds sets of like sizes and like population counts of w0; tiles that are too far apart in either are skipped.
    """
    band = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / np.log(100 / percent)).cast("int")
    count = F.floor(F.bit_count("w0") / (near + 1)).cast("int")
    keyed = fps.withColumn("tile", F.struct(band.alias("band"), count.alias("count")))
    sizes = materialised(keyed.groupBy("tile").agg(F.count("*").alias("n")), "tiles")  # some bands of sizes times some of counts
    parts = F.ceil(F.col("n") / tile_rows)
    member = F.struct("fp", "size", *[f"w{k}" for k in range(WIDE)])
    blocks = materialised(keyed.join(F.broadcast(sizes), "tile").groupBy("tile", F.pmod(F.xxhash64("fp", F.lit(7)), parts).alias("part")).agg(F.collect_list(member).alias("rows")), "blocks")
    offsets = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    others = F.array(*[F.struct((F.col("tile.band") + d).alias("band"), (F.col("tile.count") + c).alias("count")) for d, c in offsets])
    other = sizes.select(F.col("tile").alias("other"), F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part_b"))
    left = blocks.select("tile", F.col("part").alias("part_a"), F.col("rows").alias("a"), F.explode(others).alias("other")).join(F.broadcast(other), "other").where("tile <> other OR part_a <= part_b")
    pairs = left.join(blocks.select(F.col("tile").alias("other"), F.col("part").alias("part_b"), F.col("rows").alias("b")), ["other", "part_b"]).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(k).slice(i, 1).flatten() for k in (0, 1))
                a, b = ([s.field(0).to_numpy(), s.field(1).to_numpy(), *(s.field(2 + k).to_numpy().view(np.uint64) for k in range(WIDE))] for s in (a, b))
                u, v = wide_tile_links(a, b, near, radius, percent)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def copies_grouped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = COPY_SHINGLE, near: int = COPY_NEAR, radius: int = COPY_RADIUS, percent: int = COPY_PERCENT) -> DataFrame:
    """grouped() for near copies: sets of 5-word shingles that are alike by 0.8 or more, told by WIDE fingerprints of 64 bits.

    fp names a text's set. Two sets that are alike by just 0.8 differ in 0.15 of all bits on average; radius leaves room for
    chance, near is the same for the first fingerprint, which alone is compared with all others of its tiles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                sets = shingle_sets(texts, shingle)
                wide = _majorities(sets).view(np.int64)
                columns = [part.column(0), pa.array(_set_names(sets)), pa.array([len(x) for x in sets], pa.int64()), *[pa.array(np.ascontiguousarray(wide[:, k])) for k in range(WIDE)]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "size", *[f"w{k}" for k in range(WIDE)]])

    names = [f"w{k}" for k in range(WIDE)]
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    each = materialised(texts.mapInArrow(run, "doc_id long, fp long, size long, " + ", ".join(f"{n} long" for n in names)), "copies")
    fps = materialised(each.groupBy("fp").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", *names)]), "distinct")
    roots = materialised(components(wide_links(fps.select("fp", "size", *names), near, radius, percent)).select(F.col("node").alias("fp"), "root"), "roots")
    linked = fps.select("fp", "lead").join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("lead").alias("component_id"))
    known = linked.join(least, "root").select("fp", "root", "component_id").union(fps.where("n > 1").join(roots, "fp", "left_anti").select("fp", "fp", F.col("lead").alias("component_id")))
    known = materialised(known, "known")
    each = looked_up(each.select("doc_id", "fp"), known, ["fp"], F.hash("doc_id"))
    return each.select("doc_id", "fp", F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("root", "fp").alias("root"))


def _first_of_groups(docs: DataFrame, found: DataFrame, marks: Callable[[pa.Array], np.ndarray], id_column: str, text_column: str) -> DataFrame:
    """docs with the row of the smallest id of each group of found (doc_id, fp, component_id, root); marks gives the fp of texts.

    Of rows that repeat that id in the group one stays; rows without an id stay.
    """
    found = materialised(found.where("doc_id IS NOT NULL"), "near-duplicates")
    repeated = materialised(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__quern_id")), "repeated")
    key = F.col(id_column).cast("long")
    # ids that go are fewer than those that stay: one join moves the texts, or none if they can be broadcast
    gone = materialised(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__quern_id")).union(repeated).distinct(), "gone")
    kept = docs.join(gone, key == F.col("__quern_id"), "left_anti")
    if repeated.isEmpty():
        return kept
    # an id with several texts is decided by id and fingerprint
    same = docs.join(repeated, key == F.col("__quern_id"), "left_semi")

    def with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, text_column):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks(texts))], names=[*part.schema.names, "__quern_fp"])

    same = same.mapInArrow(with_fingerprint, same.select("*", F.lit(0).cast("long").alias("__quern_fp")).schema)
    leads = found.where("doc_id = component_id").select(F.col("doc_id").alias("__quern_id"), F.col("fp").alias("__quern_lead"), F.col("root").alias("__quern_root")).distinct()
    again = same.join(leads, (key == F.col("__quern_id")) & (F.col("__quern_fp") == F.col("__quern_lead"))).dropDuplicates([id_column, "__quern_root"])
    again = again.select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(again)


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of near_duplicates(), that of the smallest id; rows without an id stay."""
    return _first_of_groups(docs, grouped(docs, id_column, text_column, radius), lambda texts: text_fingerprints(texts).view(np.int64), id_column, text_column)


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = COPY_PERCENT) -> DataFrame:
    """docs with one row of each group of copies_grouped(), that of the smallest id.

    Texts without words are one group. Rows without an id stay, as do both of two texts that share an id and are not alike; an
    empty table gives an empty one; other columns, whatever their names, stay as they are.
    """
    return _first_of_groups(docs, copies_grouped(docs, id_column, text_column, percent=percent), lambda texts: _set_names(shingle_sets(texts, COPY_SHINGLE)), id_column, text_column)
