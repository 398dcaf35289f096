"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies. Its whole part is taken; the fraction, as a mass of
words, is rounded in pairs: mass moves from one of the two to the other, in a direction drawn so that neither gains on
average, until one is integral, and the other meets the next. Leaves of a source are rounded on their own, and the documents
they leave open are combined through a tree. At its root the largest are settled first, against all smaller ones together, so
that the one document that is drawn at last is small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._shared import materialised, unit_hash

#: Weights of the sources in order, repeating; most copies of a document; documents of a leaf, about; children of a node.
WEIGHTS, MOST_COPIES, LEAF_ROWS, FAN_IN = (1.0, 2.0, 3.0), 3.0, 2048, 64
#: Documents of all sizes that a leaf leaves open for the nodes above it, besides the one that is left over.
OPEN_ROWS = 16
_EXACT = 1e-6
WORD = "[^\\x20\\x09-\\x0D]+"


def capped_targets(sizes: list[float], weights: list[float], cap: float = MOST_COPIES) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap times its size; the excess of those is shared by weight among the rest.

    What a unit of weight gets only rises as sources stop at their caps, so that they do so in order of size by weight: one pass over them, sorted.
    """
    out, total = [0.0] * len(sizes), float(sum(sizes))
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: cap * sizes[i] / weights[i])
    weight = sum(weights[i] for i in order)
    for at, i in enumerate(order):
        if total * weights[i] / weight <= cap * sizes[i]:
            for j in order[at:]:
                out[j] = total * weights[j] / weight
            break
        out[i] = cap * sizes[i]
        total -= out[i]
        weight -= weights[i]
    return out


def source_targets(sized: DataFrame) -> DataFrame:
    """sized (source, size) to (source, source_size, leaves, target), a row a source, in order of code points with null last.

    Sources are few (a row each reaches one task); their number is the only thing gathered.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]
        targets = capped_targets([r["source_size"] for r in rows], weights)
        columns = [pa.array([r["source"] for r in rows], pa.string()), pa.array([r["source_size"] for r in rows], pa.int64()), pa.array([-(-r["rows"] // LEAF_ROWS) for r in rows], pa.int64()), pa.array(targets, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["source", "source_size", "leaves", "target"])

    return totals.repartition(1).mapInArrow(run, "source string, source_size long, leaves long, target double")


def pivot(size: np.ndarray, mass: np.ndarray, chance: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Round masses (0 to size, in order of falling size) in pairs: (1, 0 or -1 for open, masses).

    One document that is not kept open at most is left over. The masses' sum stays, and each stays on average.
    """
    up, mass, left = np.full(len(size), -1, np.int8), mass.astype(float).copy(), -1

    def integral(i: int) -> bool:
        if mass[i] <= _EXACT or mass[i] >= size[i] - _EXACT:
            up[i] = size[i] > 0 and mass[i] >= size[i] - _EXACT
            return True
        return False

    for j in np.flatnonzero(~keep).tolist():
        if integral(j):
            continue
        if left < 0:
            left = j
            continue
        gain, loss = min(size[left] - mass[left], mass[j]), min(mass[left], size[j] - mass[j])
        move = gain if chance[j] < loss / (gain + loss) else -loss
        mass[left] += move
        mass[j] -= move
        done = integral(j)
        if integral(left):
            left = -1 if done else j
    return up, mass


def settle(size: np.ndarray, mass: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Round all masses (of documents in order of falling size) to 1 or 0, the largest first, each on average as it is.

    A document is paired with all smaller open ones together: mass moves between it and them, shared out by what each can
    give and take, in a direction drawn so that none gains on average, until it is integral. So what is open at last is small,
    and only that one document's draw moves the sum.
    """
    mass, left = mass.astype(float).copy(), np.random.default_rng(np.frombuffer(chance.tobytes(), np.uint32))
    for i in range(len(size)):
        while _EXACT < mass[i] < size[i] - _EXACT:
            rest, full = mass[i + 1 :], size[i + 1 :]
            room = np.minimum(rest, full - rest)
            room[room <= _EXACT] = 0
            all_of = room.sum()
            if all_of <= _EXACT:
                mass[i] = size[i] if left.random() < mass[i] / size[i] else 0.0
                break
            up, down = min(size[i] - mass[i], all_of), min(mass[i], all_of)
            move = up if left.random() < down / (up + down) else -down
            mass[i] += move
            rest -= room * (move / all_of)
    return ((size > 0) & (mass >= size - _EXACT)).astype(np.int8)


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken): a row for each row of docs; other columns are ignored.

    size counts words (null: 0). Documents without words get the whole copies of their source alone, and a source without
    words gets no copies. Repeated rows and null ids are documents of their own. An empty table gives no rows. Random numbers
    depend on id, size and seed, so that reruns agree (rows that repeat those are interchangeable).
    """
    sized = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialised(sized, "sized")
    targets = materialised(source_targets(sized), "targets")
    targets = targets.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").select("doc_id", "source", "size", "source_size", "target", "leaves", rate.alias("rate"), unit_hash("doc_id", "size", seed=seed).alias("chance"))
    # a source's rows are dealt to leaves by hash, so that no source meets in one task
    nodes = joined.withColumn("node", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1)), F.greatest("leaves", F.lit(1)))).withColumn("whole", F.floor("rate"))
    nodes = nodes.select("doc_id", "source", "size", "source_size", "target", "leaves", "whole", ((F.col("rate") - F.col("whole")) * F.col("size")).alias("mass"), "chance", "node")
    schema = ", ".join(f"{n} {t}" for n, t in nodes.dtypes) + ", up tinyint"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        size = table.column("size").to_numpy().astype(np.float64)
        chance, mass = table.column("chance").to_numpy(), table.column("mass").to_numpy()
        order = np.lexsort((table.column("doc_id").fill_null(-1).to_numpy(), chance, -size))
        s, m, u, root = size[order], mass[order], chance[order], table.column("leaves")[0].as_py() <= 1
        keep = np.zeros(len(s), bool)
        keep[np.linspace(0, len(s) - 1, min(OPEN_ROWS, len(s))).astype(int)] = True
        up, after = pivot(s, m, u, keep) if not root else (settle(s, m, u), m)
        out, masses = np.empty_like(up), np.empty_like(after)
        out[order], masses[order] = up, after
        return table.set_column(table.schema.get_field_index("mass"), "mass", pa.array(masses)).append_column("up", pa.array(out))

    done = []
    deepest = targets.agg(F.max("leaves")).first()[0] or 0
    while True:
        rounded = materialised(nodes.groupBy("source", "node").applyInArrow(run, schema), "rounded")
        done.append(rounded.where("up >= 0"))
        if deepest <= 1:
            break
        deepest = -(-deepest // FAN_IN)
        nodes = rounded.where("up < 0").drop("up").withColumn("leaves", F.ceil(F.col("leaves") / FAN_IN)).withColumn("node", F.floor(F.col("node") / FAN_IN))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("up")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def remixed(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs with each row as often as mixed() takes it. Rows that share an id and a size share out their copies; rows without an id go by it too."""
    plan = materialised(mixed(docs, id_column).select(F.col("doc_id").alias("__quern_id"), F.col("source").alias("__quern_source"), F.col("size").alias("__quern_of"), F.col("copies").alias("__quern_copies")), "plan")
    key, columns = F.col(id_column).cast("long"), [F.col(f"`{c}`") for c in docs.columns]
    repeat = F.explode(F.array_repeat(F.lit(0), F.col("__quern_copies").cast("int"))).alias("__quern_copy")
    if plan.groupBy("__quern_id").agg(F.count("*").alias("n")).where("n > 1 OR __quern_id IS NULL").isEmpty():
        # texts move once, by their ids; the plan grows with them and is never broadcast
        return docs.join(plan.where("__quern_copies > 0").select("__quern_id", "__quern_copies").hint("merge"), key == F.col("__quern_id")).select(*columns, repeat).drop("__quern_copy")
    sized = docs.withColumn("__quern_size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
    # rows that share id, source and size are numbered on both sides, in an order that a second reading gives again
    number = lambda order, *by: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    plan = plan.withColumn("__quern_no", number("__quern_copies", "__quern_id", "__quern_source", "__quern_of"))
    sized = sized.withColumn("__quern_row", number(F.xxhash64("text"), key, "source", "__quern_size"))
    match = key.eqNullSafe(F.col("__quern_id")) & F.col("source").eqNullSafe(F.col("__quern_source")) & (F.col("__quern_size") == F.col("__quern_of")) & (F.col("__quern_row") == F.col("__quern_no"))
    return sized.join(plan.where("__quern_copies > 0"), match).select(*columns, repeat).drop("__quern_copy")
