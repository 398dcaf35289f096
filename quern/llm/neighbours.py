"""Nearest neighbours by vantage-point trees, one per shard.

The inner product is no metric, so vectors get one more component that brings them all to the length of the longest: then
the largest inner product is the smallest distance, to which the triangle inequality applies. A tree splits its vectors at
the median distance from a vantage point; a side is skipped when the query's distance to the split exceeds its twentieth
best distance so far divided by `factor`: at one nothing is lost, above one more is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._shared import materialised

#: Neighbours of a query; queries have ids divisible by EVERY; pruning factor (one: exact).
NEIGHBOURS, EVERY, FACTOR = 20, 20, 1.0
#: Vectors of a shard and queries of a block, about, and vectors of a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 4096, 2048, 64
#: Points among which a vantage point is chosen, and those by which it is judged.
TRIED, JUDGES = 8, 256
#: Queries that are measured anew at a time, and what rounding of a squared distance is held to be, as a share of its terms.
MEASURED_ROWS, ROUNDING = 256, 1e-11


class Tree:
    """A vantage-point tree over distinct vectors."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.points = np.hstack([vectors, np.sqrt(np.maximum(self.top - norms, 0.0))[:, None]])
        self.leaf_rows, self.leaves, self.visited = leaf_rows, 0, 0
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf_rows:
            self.leaves += 1
            return rows
        # of a few points the one that sees others at the most different distances; the farthest from the mean is one of them
        far = rows[np.argmax(((self.points[rows] - self.points[rows].mean(axis=0)) ** 2).sum(axis=1))]
        tried, judges = (rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)] for n in (TRIED, JUDGES))
        tried = np.append(tried, far)
        spread = [np.sqrt(((self.points[judges] - self.points[t]) ** 2).sum(axis=1)).std() for t in tried.tolist()]
        vantage = int(tried[int(np.argmax(spread))])
        distance = np.sqrt(((self.points[rows] - self.points[vantage]) ** 2).sum(axis=1))
        order = np.argsort(distance, kind="stable")
        half = len(rows) // 2
        near, far = rows[order[:half]], rows[order[half:]]
        low, high = distance[order[half - 1]], distance[order[half]]
        return vantage, float(low), float(high), self._build(near), self._build(far)

    def search(self, queries: np.ndarray, count: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the `count` nearest points of each query (-1: none) and their squared distances, in no order; all queries go down together.

        visited is then the number of leaves that queries were compared with, summed over queries.
        """
        self.visited = 0
        points = np.hstack([queries, np.zeros((len(queries), 1))])
        norms = np.einsum("ij,ij->i", points, points)
        best, found = np.full((len(queries), count), np.inf), np.full((len(queries), count), -1)
        worst = np.full(len(queries), np.inf)

        def visit(node, active: np.ndarray) -> None:
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                if not len(node):
                    return
                self.visited += len(active)
                leaf = self.points[node]
                distance = norms[active, None] + self.top - 2.0 * (points[active] @ leaf.T)
                improves = (distance < worst[active, None]).any(axis=1)
                active, distance = active[improves], distance[improves]
                if not len(active):
                    return
                joined = np.hstack([best[active], distance])
                rows = np.hstack([found[active], np.broadcast_to(node, distance.shape)])
                pick = np.argpartition(joined, count - 1, axis=1)[:, :count]
                best[active] = np.take_along_axis(joined, pick, axis=1)
                found[active] = np.take_along_axis(rows, pick, axis=1)
                worst[active] = best[active].max(axis=1)
                return
            vantage, low, high, near, far = node
            distance = np.sqrt(np.maximum(norms[active] + self.top - 2.0 * (points[active] @ self.points[vantage]), 0.0))
            # rounding may not skip what is as near
            reach = lambda rows: np.sqrt(np.maximum(worst[rows], 0.0)) / factor + 1e-7
            inside = distance <= (low + high) / 2
            a, b = active[inside], active[~inside]
            da, db = distance[inside], distance[~inside]
            visit(near, a)
            visit(far, a[high - da <= reach(a)])
            visit(far, b)
            visit(near, b[db - low <= reach(b)])

        visit(self.root, np.arange(len(queries)))
        return found, best

    def within(self, queries: np.ndarray, bound: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all points no farther from a query than the square root of its bound, however many there are."""
        points = np.hstack([queries, np.zeros((len(queries), 1))])
        norms = np.einsum("ij,ij->i", points, points)
        bound = bound + ROUNDING * (norms + self.top)
        reach = np.sqrt(np.maximum(bound, 0.0)) / factor + 1e-7
        asked, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def visit(node, active: np.ndarray) -> None:
            if not len(active) or not len(node):
                return
            if isinstance(node, np.ndarray):
                distance = norms[active, None] + self.top - 2.0 * (points[active] @ self.points[node].T)
                q, r = np.nonzero(distance <= bound[active, None])
                asked.append(active[q])
                rows.append(node[r])
                return
            vantage, low, high, near, far = node
            distance = np.sqrt(np.maximum(norms[active] + self.top - 2.0 * (points[active] @ self.points[vantage]), 0.0))
            inside = distance <= (low + high) / 2
            visit(near, active[inside | (distance - low <= reach[active])])
            visit(far, active[~inside | (high - distance <= reach[active])])

        visit(self.root, np.arange(len(queries)))
        return np.concatenate(asked), np.concatenate(rows)


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id long, vector array<double>, width) of the rows whose vector is neither null nor zero and whose components are all finite."""
    df = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0.0)
    return df.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(sound).withColumn("width", F.size("vector"))


def _packed(df: DataFrame, rows: int, salt: int) -> DataFrame:
    """Rows of about `rows` vectors of equal width: (width, part, ids binary, data binary)."""
    counts = df.groupBy("width").agg(F.ceil(F.count("*") / rows).alias("parts"))  # a row per width

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("vec_id").to_numpy(), np.int64)
        flat = np.concatenate([c.values.slice(c.offsets[0].as_py(), c.offsets[-1].as_py() - c.offsets[0].as_py()).to_numpy() for c in table.column("vector").chunks])
        order = np.lexsort((*np.flipud(flat.reshape(len(ids), -1).T[:4]), ids))
        data = flat.reshape(len(ids), -1)[order]
        return pa.table({"width": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})

    dealt = df.join(F.broadcast(counts), "width").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(salt)), "parts"))
    return dealt.select("width", "part", "vec_id", "vector").groupBy("width", "part").applyInArrow(run, "width int, part long, ids binary, data binary")


def _nearest(tree: Tree, distinct: np.ndarray, ids: np.ndarray, starts: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, count: int, factor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries' ids, vec_ids, scores) of each query's `count` nearest of a shard, on the original vectors; ties to the smaller id.

    The ids of distinct vector r are ids[starts[r] : starts[r + 1]], rising. The search gives the distance of the last that
    can count, one more as a query's own id is none; then all vectors as near as that are measured, so that of any number
    that tie the smallest ids are found.
    """
    sizes = np.minimum(np.diff(starts), count + 1)
    for k in range(0, len(queries), MEASURED_ROWS):
        asked, own = queries[k : k + MEASURED_ROWS], query_ids[k : k + MEASURED_ROWS]
        _, best = tree.search(asked, min(len(distinct), count + 1), factor)
        q, r = tree.within(asked, best.max(axis=1), factor)
        # summed from the first component to the last wherever a vector stands, so that equal ones tie
        step = max(1, (1 << 22) // max(1, distinct.shape[1]))
        measured = [np.cumsum(distinct[r[i : i + step]] * asked[q[i : i + step]], axis=1)[:, -1] for i in range(0, len(r), step)]
        scores = np.repeat(np.concatenate([np.empty(0), *measured]), sizes[r])
        at = np.repeat(starts[r] - (np.cumsum(sizes[r]) - sizes[r]), sizes[r]) + np.arange(sizes[r].sum())
        q, found = np.repeat(q, sizes[r]), ids[at]
        other = found != own[q]
        q, found, scores = q[other], found[other], scores[other]
        order = np.lexsort((found, -scores, q))
        q, found, scores = q[order], found[order], scores[order]
        first = np.searchsorted(q, np.arange(len(asked)))
        kept = np.arange(len(q)) - first[q] < count
        yield own[q[kept]], found[kept], scores[kept]


def nearest(vectors: DataFrame, queries: DataFrame, count: int = NEIGHBOURS, factor: float = FACTOR, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the `count` rows of vectors with the largest inner products.

    Every vector is indexed, in shards by hash of its id; the queries meet each shard in blocks. A query's own id is no
    candidate. Vectors that usable() leaves out take no part, nor do vectors of other widths than the query's; a query with
    fewer candidates gets them all. Equal vectors stand in a tree once. Ties go to the smaller id; ids that repeat in queries
    with other vectors rank together. Empty tables give no rows; other columns are ignored.
    """
    shards = materialised(_packed(usable(vectors, id_column, vector_column), SHARD_ROWS, 3), "shards").withColumnRenamed("ids", "shard_ids").withColumnRenamed("data", "shard_data").withColumnRenamed("part", "shard")
    blocks = materialised(_packed(usable(queries, id_column, vector_column), BLOCK_ROWS, 5), "blocks")
    # each block is sent to each shard of its width; a shard is a key of its own, so that shards spread over tasks
    keys = shards.groupBy("width").agg(F.max("shard").alias("most"))
    sent = blocks.join(F.broadcast(keys), "width").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), "most"))).drop("most")
    tasks = max(1, min(2000, shards.count()))
    pairs = shards.repartition(tasks, "width", "shard").join(sent.repartition(tasks, "width", "shard"), ["width", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            out = ([], [], [])
            for row in batch.to_pylist():
                if last != (row["width"], row["shard"]):
                    ids = np.frombuffer(row["shard_ids"], np.int64)
                    data = np.frombuffer(row["shard_data"], np.float64).reshape(len(ids), -1)
                    distinct, inverse = np.unique(data, axis=0, return_inverse=True)
                    order = np.lexsort((ids, inverse.ravel()))
                    starts = np.concatenate([[0], np.cumsum(np.bincount(inverse.ravel()))])
                    held, last = (Tree(distinct), distinct, ids[order], starts), (row["width"], row["shard"])
                query_ids = np.frombuffer(row["ids"], np.int64)
                asked = np.frombuffer(row["data"], np.float64).reshape(len(query_ids), -1)
                for columns in _nearest(*held, query_ids, asked, count, factor):
                    for c, column in zip(out, columns, strict=True):
                        c.append(column)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    found = pairs.select("width", "shard", "shard_ids", "shard_data", "ids", "data").mapInArrow(run, "query_id long, vec_id long, score double")
    # the best of each task are picked before the shuffle
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def searched(vectors: DataFrame, every: int = EVERY, count: int = NEIGHBOURS, factor: float = FACTOR, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """nearest() for the rows whose id is divisible by `every`."""
    return nearest(vectors, vectors.where(F.col(id_column) % every == 0), count, factor, id_column, vector_column)
