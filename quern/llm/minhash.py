"""MinHash near-duplicates by a multi-index Hamming join.

A text's set of word shingles has a signature of VALUES minimal hashes, of each of which BITS bits are kept. Sets that are
alike by `percent` differ in few values: in more than errors_allowed() of them with a chance of MISS at most. Signatures
are cut into so many chunks that, of two with no more differing values than that, one chunk differs in one value at most.
So each chunk is looked up once for each of its values left out, which finds all such pairs; they are then confirmed on the
whole sets.

Pairs of a large group are never listed all. The members of a key meet its least and its greatest one first, confirmed links
join them to components, and only members of different components are compared further. Of those, a set that has too many
shingles which no other open set has is linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._shared import looked_up, materialised, split_words, text_slices
from quern.llm.decontaminate import hashed_values
from quern.llm.graph import components

#: Words of a shingle; likeness of a link, as 100 times intersection over union.
SHINGLE, PERCENT = 3, 85
#: Values of a signature and bits of each; the chance, at most, that a pair just alike enough differs in more values than are allowed.
VALUES, BITS, MISS = 48, 16, 1.2e-4
#: A key with more members is looked up apart; members of a key in one block; shingles of a group in one.
HOT_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 4096, 2048, 1 << 18
#: Bits of the filter of sets that are asked for are 2 to the power of this, 8 MB, however many they are.
FILTER_BITS = 26
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def errors_allowed(percent: int = PERCENT, values: int = VALUES, miss: float = MISS) -> int:
    """The fewest differing values that sets of this likeness exceed with a chance of `miss` at most."""
    p = 1 - percent / 100
    tail = 1.0
    for k in range(values + 1):
        tail -= comb(values, k) * p**k * (1 - p) ** (values - k)
        if tail <= miss:
            return k
    return values


def least_size(percent: int = PERCENT) -> int:
    """Sets of fewer shingles are alike only if they are equal."""
    return next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 40


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27)) ^ (x << np.uint64(31))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The set of shingles of each text of a large_string array without nulls, as sorted 64-bit hashes.

    Words are those outside space and 0x09-0x0D, A-Z in lower case; a text with fewer than `shingle` words is one shingle, one without words none.
    """
    offsets, words = split_words(texts)
    coded = words.dictionary_encode()
    tokens = hashed_values(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    rolled = np.zeros(max(0, len(tokens) - shingle + 1), np.uint64)
    for k in range(shingle):
        rolled = _mixed(rolled + tokens[k : k + len(rolled)] * _STEP + np.uint64(k + 1))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(rolled[a : b - shingle + 1]))
        else:
            whole = np.zeros(min(1, b - a), np.uint64)
            for k in range(b - a):
                whole = _mixed(whole + tokens[a + k : a + k + 1] * _STEP + np.uint64(k + 1))
            out.append(whole)
    return out


def signatures(sets: list[np.ndarray], values: int = VALUES) -> np.ndarray:
    """A row of `values` 16-bit numbers for each set; of an empty one, zeros."""
    out = np.zeros((len(sets), values), np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[k] for k in full])
    starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in full])[:-1]])
    odd = np.random.default_rng(11).integers(0, 1 << 63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    hashed = np.empty_like(flat)
    for k in range(values):
        np.multiply(flat ^ (flat >> np.uint64(32)), odd[k], out=hashed)
        out[full, k] = (_mixed(np.minimum.reduceat(hashed, starts)) >> np.uint64(64 - BITS)).astype(np.uint16)
    return out


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def _names(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that stand for each set, as two numbers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)


def prints(texts: DataFrame, shingle: int = SHINGLE, values: int = VALUES) -> DataFrame:
    """(doc_id, n, a, b, signature): for each row of texts (doc_id, text) the size, the name and the signature of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, strings in text_slices(batch, "text"):
                sets = shingle_sets(strings, shingle)
                names, rows = _names(sets), signatures(sets, values)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(np.ascontiguousarray(names[:, k])) for k in (0, 1)], pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "n", "a", "b", "signature"])

    return texts.mapInArrow(run, "doc_id long, n long, a long, b long, signature binary")


def _rows(column: pa.Array, values: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, values)


def chunked(values: int, errors: int) -> list[np.ndarray]:
    """Places of a signature in chunks, of which one differs in one place at most if the whole does in `errors` at most."""
    return np.array_split(np.arange(values), errors // 2 + 1)


def keys_of(rows: np.ndarray, errors: int) -> np.ndarray:
    """For each signature a key for each place: that of its chunk without it."""
    out = np.empty(rows.shape, np.uint64)
    wide = rows.astype(np.uint64) + np.uint64(1)
    for c, places in enumerate(chunked(rows.shape[1], errors)):
        for left_out in places.tolist():
            key = np.full(len(rows), c * 1000 + left_out + 1, np.uint64) * _STEP
            for place in places.tolist():
                if place != left_out:
                    key = _mixed(key + wide[:, place] * _STEP)
            out[:, left_out] = key
    return out


def _keys(classes: DataFrame, percent: int, values: int) -> DataFrame:
    """(key, node) of the classes that can be linked with another."""
    errors = errors_allowed(percent, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                found = keys_of(_rows(part.column(1), values), errors)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), values)))], names=["key", "node"])

    return classes.where(F.col("n") >= least_size(percent)).select("node", "signature").mapInArrow(run, "key long, node long")


def _members(classes: DataFrame, percent: int, values: int) -> DataFrame:
    """(key, node, low, high, many): the members of each key that has several, with its least and greatest one and their number."""
    keys = _keys(classes, percent, values)
    groups = materialised(keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("many")).where("many > 1"), "keys")
    found = keys.join(groups.where(F.col("many") <= HOT_ROWS), "key")
    hot = groups.where(F.col("many") > HOT_ROWS)
    # a key with a large part of all rows is looked up in many tasks; such keys are few
    if (n := hot.count()) > 0:
        found = found.unionByName(looked_up(keys, hot, ["key"], F.hash("node"), "inner", n))
    return materialised(found, "members")


def _close(pairs: DataFrame, classes: DataFrame, percent: int, values: int) -> DataFrame:
    """Of pairs (u, v) those whose signatures and sizes don't rule a link out."""
    errors = errors_allowed(percent, values)
    side = lambda name: classes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("signature").alias(f"s_{name}"))
    sized = pairs.join(side("u"), "u").join(side("v"), "v").where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_rows(batch.column(2), values) != _rows(batch.column(3), values)).sum(axis=1) <= errors
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(near)) for k in (0, 1)], names=["u", "v"])

    return sized.select("u", "v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def _asked(nodes: DataFrame) -> np.ndarray:
    """A bit for each of the last FILTER_BITS bits of a set's name and its first document's id; a row for each 64 reaches the driver at most."""
    bit = F.col("a").bitwiseXOR(F.coalesce("lead", F.lit(0))).bitwiseAND((1 << FILTER_BITS) - 1)
    rows = nodes.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast((a ^ coalesce(lead, 0)) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _sets(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles binary) of nodes (node, a, b, lead): their sets, made again from the texts."""
    asked = texts.sparkSession.sparkContext.broadcast(_asked(nodes))  # 8 MB, whatever their number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = asked.value.view(np.uint64)
        for batch in batches:
            for part, strings in text_slices(batch, "text"):
                sets = shingle_sets(strings, shingle)
                names = _names(sets)
                bit = (names[:, 0] ^ part.column(0).fill_null(0).to_numpy()) & ((1 << FILTER_BITS) - 1)
                at = np.flatnonzero((words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
                columns = [part.column(0).take(pa.array(at)), *[pa.array(np.ascontiguousarray(names[at, k])) for k in (0, 1)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[k].tobytes() for k in at.tolist()], pa.binary())], names=["doc_id", "a", "b", "shingles"])

    made = texts.mapInArrow(run, "doc_id long, a long, b long, shingles binary")
    same = (made["a"] == nodes["a"]) & (made["b"] == nodes["b"]) & made["doc_id"].eqNullSafe(nodes["lead"])
    # an id that repeats may give a set more than once
    return made.join(nodes, same).select("node", "shingles").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v) those whose whole sets are alike."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"s_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["u", "v"])

    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "s_u", "s_v").mapInArrow(run, "u long, v long")


def _met(blocks: DataFrame, by: str) -> DataFrame:
    """blocks (by, part, parts, x) to (x, y): each two parts of a group, y null where a part meets itself."""
    alone = blocks.select("x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y"))
    large = blocks.where("parts > 1")
    if large.isEmpty():
        return alone
    left = large.where(F.col("part") + 1 < F.col("parts")).select(by, "x", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"))
    return alone.unionByName(left.join(large.select(by, "part", F.col("x").alias("y")), [by, "part"]).select("x", "y"))


def _sides(batch: pa.RecordBatch, row: int, values: int) -> tuple[list, list | None]:
    """The blocks x and y (None: x itself) of a row: nodes, roots, sizes, signatures, and sets if they are there."""

    def side(column: pa.Array) -> list:
        s = column.flatten()
        return [*(s.field(k).to_numpy() for k in range(3)), _rows(s.field(3), values), *([s.field(4)] if s.type.num_fields > 4 else [])]

    x, y = (batch.column(c).slice(row, 1) for c in (0, 1))
    return side(x), None if y.null_count else side(y)


def _crossing(x: list, y: list | None, percent: int, errors: int) -> np.ndarray:
    """Nodes of two blocks (y None: of one) that are close, by size and signature, to one of another component."""
    (na, ra, sa, va), (nb, rb, sb, vb) = x, y or x
    found = [np.empty(0, np.int64)]
    step = max(1, (1 << 20) // max(1, len(nb)))
    for i in range(0, len(na), step):
        p, q = np.nonzero((ra[i : i + step, None] != rb[None, :]) & (100 * np.minimum(sa[i : i + step, None], sb[None, :]) >= percent * np.maximum(sa[i : i + step, None], sb[None, :])))
        for k in range(0, len(p), 1 << 18):
            near = (va[i + p[k : k + (1 << 18)]] != vb[q[k : k + (1 << 18)]]).sum(axis=1) <= errors
            found += [np.unique(na[i + p[k : k + (1 << 18)][near]]), np.unique(nb[q[k : k + (1 << 18)][near]])]
    return np.unique(np.concatenate(found))


def _close_nodes(rows: DataFrame, percent: int, values: int) -> DataFrame:
    """Of rows (key, node, root, n, signature, many) the nodes (u) that have a close one of another component under a key."""
    errors, parts = errors_allowed(percent, values), F.ceil(F.col("many") / BLOCK_ROWS)
    blocks = rows.groupBy("key", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("part")).agg(F.collect_list(F.struct("node", "root", "n", "signature")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(_crossing(*_sides(batch, k, values), percent, errors))], names=["u"])

    return _met(materialised(blocks, "blocks"), "key").mapInArrow(run, "u long").distinct()


def exact_links(x: list, y: list | None, percent: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes of two blocks (y None: of one) that join all that are alike; of components that are joined already no more.

    A set is compared with all of the other block at once: its shingles are marked, and marks are counted for each set.
    """
    (na, ra, sa, va, xa), (nb, rb, sb, vb, xb) = x, y or x
    roots, label = np.unique(np.concatenate([ra, rb]), return_inverse=True)
    at_a, at_b, label = label[: len(ra)], label[len(ra) :], np.arange(len(roots))
    flat = lambda sets: np.frombuffer(b"".join(sets.to_pylist()), np.uint64)
    _, codes = np.unique(np.concatenate([flat(xa), flat(xb)]), return_inverse=True)
    codes_a, codes_b = codes[: sa.sum()], codes[sa.sum() :]
    starts_a, starts_b = np.cumsum(sa) - sa, np.cumsum(sb) - sb
    mark, left, right = np.zeros(len(codes) and codes.max() + 1, bool), [], []
    for i in range(len(na)):
        open_ = np.flatnonzero((label[at_a[i]] != label[at_b]) & (100 * np.minimum(sa[i], sb) >= percent * np.maximum(sa[i], sb)))
        open_ = open_[(va[i] != vb[open_]).sum(axis=1) <= errors]
        if not len(open_):
            continue
        own = codes_a[starts_a[i] : starts_a[i] + sa[i]]
        mark[own] = True
        common = np.add.reduceat(mark[codes_b], starts_b, dtype=np.int64)[open_]
        mark[own] = False
        for j in open_[100 * common >= percent * (sa[i] + sb[open_] - common)].tolist():
            p, q = label[at_a[i]], label[at_b[j]]
            if p != q:
                left.append(na[i])
                right.append(nb[j])
                label[label == max(p, q)] = min(p, q)
    return np.array(left, np.int64), np.array(right, np.int64)


def _group_links(rows: DataFrame, sizes: DataFrame, percent: int, values: int) -> DataFrame:
    """Links (u, v) within groups of rows (group, node, root, n, signature, shingles); sizes (group, parts): what they are cut into."""
    errors = errors_allowed(percent, values)
    member = F.struct("node", "root", "n", "signature", "shingles")
    blocks = rows.join(sizes, "group").groupBy("group", "parts", F.pmod(F.xxhash64("node"), "parts").alias("part")).agg(F.collect_list(member).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                u, v = exact_links(*_sides(batch, k, values), percent, errors)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    return _met(materialised(blocks, "groups"), "group").mapInArrow(run, "u long, v long")


def _supported(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of nodes (u) those that have enough shingles that another one's set has, too."""
    of = sets.join(nodes.select(F.col("u").alias("node")), "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), batch.column(0)[k].as_py())), pa.array(s)], names=["node", "shingle"])

    each = of.mapInArrow(run, "node long, shingle long")
    alone = each.groupBy("shingle").agg(F.min("node").alias("node"), F.count("*").alias("many")).where("many = 1").groupBy("node").agg(F.count("*").alias("alone"))
    sized = of.select("node", F.floor(F.octet_length("shingles") / 8).alias("n"))
    kept = sized.join(alone, "node", "left").where(100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n"))
    return kept.select("node")


def links(texts: DataFrame, classes: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, values: int = VALUES) -> DataFrame:
    """(u, v): links that join all the classes (node, a, b, n, lead, signature) that links of this likeness join."""
    members = _members(classes, percent, values)
    ends = F.explode(F.array(F.struct(F.col("low").alias("u"), F.col("node").alias("v")), F.struct(F.col("node").alias("u"), F.col("high").alias("v"))))
    stars = members.select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct()
    stars = materialised(_close(stars, classes, percent, values), "stars")
    of = lambda nodes: classes.join(nodes, "node", "left_semi").select("node", "a", "b", "lead")
    asked = stars.select(F.col("u").alias("node")).union(stars.select("v")).distinct()
    sets = materialised(_sets(texts, materialised(of(asked), "asked"), shingle), "sets")
    first = materialised(_confirmed(stars, sets, percent), "links")
    roots = materialised(components(first), "roots")
    # what is left: keys of three members or more that hold different components
    rooted = members.where("many > 2").join(roots, "node", "left").select("key", "node", "many", F.coalesce("root", "node").alias("root"))
    rooted = materialised(rooted, "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    open_ = materialised(rooted.join(mixed, "key", "left_semi"), "open")
    facts = classes.select("node", "n", "signature")
    nodes = materialised(_close_nodes(open_.join(facts, "node"), percent, values), "open-nodes")
    if nodes.isEmpty():
        return first
    sets = materialised(_sets(texts, materialised(of(nodes.select(F.col("u").alias("node"))), "asked"), shingle), "sets")
    alive = materialised(_supported(nodes, sets, percent), "alive")
    # nodes that share an open key, directly or over others, are a group; its sets meet part by part
    shared = open_.join(alive, "node", "left_semi").select("key", "node", "root")
    least = shared.groupBy("key").agg(F.min("node").alias("least"))
    groups = components(shared.join(least, "key").select(F.col("least").alias("u"), F.col("node").alias("v")).where("u <> v").distinct())
    rows = sets.join(groups.select("node", F.col("root").alias("group")), "node").join(facts, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = materialised(rows.select("group", "node", "root", "n", "signature", "shingles"), "group-rows")
    sizes = rows.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    return first.unionByName(_group_links(rows, sizes, percent, values))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, values: int = VALUES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): a row for each row of docs.

    n_shingles is the size of the text's set of shingles. Sets link where 100 times their intersection is `percent` times
    their union or more; component_id is the smallest doc_id that can be reached over links, itself included. Null, empty and
    wordless texts have no shingles and are linked with nothing, not even each other. Null ids keep their rows; a component of
    such alone has a null id. Repeated rows and ids give a row each. An empty table gives no rows; other columns are ignored.
    """
    texts = _texts(docs, id_column, text_column)
    each = materialised(prints(texts, shingle, values), "prints")
    classes = each.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = materialised(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(links(texts, classes, percent, shingle, values))
    linked = classes.join(roots, "node").select("a", "b", "lead", "root")
    least = linked.groupBy("root").agg(F.min("lead").alias("component_id"))
    single = classes.where("copies > 1").join(roots, "node", "left_anti").select("a", "b", F.col("lead").alias("component_id"))
    known = materialised(linked.join(least, "root").select("a", "b", "component_id").unionByName(single).withColumn("found", F.lit(True)), "known")
    out = looked_up(each.drop("signature"), known, ["a", "b"], F.hash("doc_id"))
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def oracle_sql(percent: int = PERCENT) -> str:
    """The rows of near_duplicates() over `documents`, with sets of 3 words joined on every shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        each AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS x FROM s),
        links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM each AS a JOIN each AS b ON a.x = b.x AND a.doc_id <> b.doc_id
            AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        reach AS (SELECT DISTINCT u AS doc_id, u AS r FROM links UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON reach.r = links.u),
        least_of AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM s LEFT JOIN least_of USING (doc_id)"""
