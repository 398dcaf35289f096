"""Centroid clustering of integer vectors, exact, by the exponion search.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of that to any other one; both follow
the centroids' moves. Where they don't settle the question, the distance to its own centroid becomes exact, and if that is
no help only centroids in a ball around its own are measured: those within twice the distance and that between the
centroid and its nearest other one. Lists of the other centroids sorted by distance tell which those are. The radius is
inclusive, so that ties are seen; they go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._shared import discard, materialised_at

#: Components of a vector, steps of a unit, centroids, rounds, and the prefix of an id whose hash orders the first centroids.
WIDTH, STEPS, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, "2:"
#: Integers are held to this size, so that squared distances fit in a long.
LIMIT = 1 << 26
#: Sizes up to which products of floats are exact.
_FLOATS = 1 << 20
#: What bounds may be off by, as a share; they are sums of some roots.
_SLACK = 1e-9


def lattice(vectors: DataFrame, width: int = WIDTH, steps: int = STEPS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id long, v array<int>): floor(steps * x) of the vectors with `width` components, none of them null or non-finite. Integers beyond LIMIT count as LIMIT."""
    df = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.floor(F.least(F.greatest(x * F.lit(float(steps)), F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int")
    return df.where(F.col("x").isNotNull() & (F.size("x") == width)).where(sound).select("vec_id", F.transform("x", held).alias("v"))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two int64 arrays."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= _FLOATS:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(axis=1) for row in c], axis=1)


class Centroids:
    """Centroids with the lists that the search needs."""

    def __init__(self, rows: np.ndarray, before: np.ndarray | None = None):
        self.rows = rows
        between = np.sqrt(squared(rows, rows).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        others = between + np.where(np.eye(len(rows), dtype=bool), np.inf, 0.0)
        self.nearest_other = others.min(axis=1, initial=np.inf)
        self.moved = np.zeros(len(rows)) if before is None else np.sqrt(((rows - before) ** 2).sum(axis=1).astype(np.float64))
        by = np.argsort(self.moved)
        self.most_moved = np.full(len(rows), self.moved[by[-1]])
        if len(rows) > 1:
            self.most_moved[by[-1]] = self.moved[by[-2]]
        self.measured = 0

    def _measure(self, v: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector the nearest of the centroids `numbers` (rising), its squared distance, and the next distance."""
        self.measured += len(v) * len(numbers)
        d = squared(v, self.rows[numbers])
        best = d.argmin(axis=1)
        at = np.arange(len(v))
        least = d[at, best]
        if len(numbers) == 1:
            return numbers[best], least, np.full(len(v), np.inf)
        d[at, best] = np.iinfo(np.int64).max
        return numbers[best], least, np.sqrt(d.min(axis=1).astype(np.float64))

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number, upper bound, lower bound, squared distance) of vectors of which nothing is known yet."""
        number, d, low = self._measure(v, np.arange(len(self.rows)))
        return number, np.sqrt(d.astype(np.float64)), low, d

    def again(self, v: np.ndarray, number: np.ndarray, high: np.ndarray, low: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same from the bounds of the round before. The squared distance is that of the vectors that were measured, else -1; exact: of all."""
        number, high, low = number.copy(), high + self.moved[number], low - self.most_moved[number]
        d = np.full(len(v), -1, np.int64)
        open_ = np.arange(len(v)) if exact else np.flatnonzero(high * (1 + _SLACK) + _SLACK >= low)
        d[open_] = self._own(v, number, open_)
        high[open_] = np.sqrt(d[open_].astype(np.float64))
        open_ = open_[high[open_] * (1 + _SLACK) + _SLACK >= low[open_]]
        radius = (2 * high[open_] + self.nearest_other[number[open_]]) * (1 + _SLACK) + _SLACK
        own = number[open_].copy()
        for a in np.unique(own).tolist():
            at = open_[own == a]
            many = np.searchsorted(self.sorted[a], radius[own == a], side="right")
            for n in np.unique(many).tolist():
                rows = at[many == n]
                number[rows], d[rows], low[rows] = self._measure(v[rows], np.sort(self.order[a, :n]))
                high[rows] = np.sqrt(d[rows].astype(np.float64))
        return number, high, low, d

    def _own(self, v: np.ndarray, number: np.ndarray, rows: np.ndarray) -> np.ndarray:
        self.measured += len(rows)
        out = np.empty(len(rows), np.int64)
        for k in range(0, len(rows), 4096):
            at = rows[k : k + 4096]
            out[k : k + 4096] = ((v[at] - self.rows[number[at]]) ** 2).sum(axis=1)
        return out


_STATE = "vec_id long, v array<int>, number int, high double, low double, distance long"


def _assigned(state: DataFrame, centroids: Centroids, first: bool, last: bool) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(centroids)  # a row for each centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            if first:
                number, high, low, d = shared.value.first(v)
            else:
                number, high, low, d = shared.value.again(v, *(batch.column(k).to_numpy() for k in (2, 3, 4)), exact=last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number.astype(np.int32)), pa.array(high), pa.array(low), pa.array(d)], names=["vec_id", "v", "number", "high", "low", "distance"])

    return state.mapInArrow(run, _STATE)


def _means(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Floors of the componentwise means of each centroid's vectors; centroids without any stay. Tasks add up their own vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(before), np.zeros(len(before), np.int64)
        for batch in batches:
            if batch.num_rows:
                v, number = batch.column(0).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1), batch.column(1).to_numpy()
                order = np.argsort(number, kind="stable")
                found, starts = np.unique(number[order], return_index=True)
                sums[found] += np.add.reduceat(v[order], starts, axis=0)
                counts += np.bincount(number, minlength=len(before))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found]), pa.array(sums[found].tolist(), pa.list_(pa.int64()))], names=["number", "n", "sums"])

    parts = state.select("v", "number").mapInArrow(run, "number int, n long, sums array<long>")
    totals = parts.groupBy("number").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(before.shape[1])]).alias("sums")).collect()  # a row for each centroid
    out = before.copy()
    for r in totals:
        out[r["number"]] = np.array(r["sums"], np.int64) // r["n"]
    return out


def _seeds(kept: DataFrame, count: int, width: int) -> np.ndarray:
    rows = kept.orderBy(F.sha2(F.concat(F.lit(SEED), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(count).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), width)


def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, steps: int = STEPS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, cluster int, distance, cluster_inertia, inertia, centroid_sha256): a row for each vector that lattice() keeps.

    The first centroids are the kept vectors whose ids have the smallest hashes (null ids last; equal ids by their
    components), as many as there are if they are fewer. Repeated rows count as often as they are there; equal centroids
    leave the later ones empty, which stay where they are. Null and odd vectors take no part, other columns are ignored, and
    an empty table gives no rows. Only centroids, and sums of each, reach the driver.
    """
    spark: SparkSession = vectors.sparkSession
    kept, path = materialised_at(lattice(vectors, width, steps, id_column, vector_column), "lattice")
    seeds = _seeds(kept, centroids, width)
    if not len(seeds):
        discard(spark, path)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now, state = Centroids(seeds), kept
    for k in range(rounds + 1):
        state, written = materialised_at(_assigned(state, now, k == 0, k == rounds), "assigned")
        discard(spark, path)  # a round's table stands in for the one before
        path = written
        if k < rounds:
            now = Centroids(_means(state, now.rows), now.rows)
    inertia = {r["number"]: r["inertia"] for r in state.groupBy("number").agg(F.sum("distance").alias("inertia")).collect()}  # a row for each centroid
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in now.rows.tolist()]
    facts = spark.createDataFrame([(k, n, sum(inertia.values()), digest[k]) for k, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", F.col("number").alias("cluster"), "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, steps: int = STEPS) -> str:
    """The rows of clustered() over `embeddings`, measured against all centroids."""
    hashed = f"sha256('{SEED}' || vec_id)"
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({steps} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {hashed}) - 1 AS k, v AS c FROM kept ORDER BY {hashed} LIMIT {centroids})",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS no FROM (
            SELECT vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{r})) WHERE no = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
                SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY k, i) GROUP BY k) USING (k))""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""
