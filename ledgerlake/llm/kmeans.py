"""Centroid clustering with ns-bounds: exact k-means on integer vectors that skips most distances.

Every vector keeps, for each centroid, the distance of the last evaluation and the round of that evaluation. The
centroids of all rounds are kept too. Before a round, a bound is loosened by the norm of the centroid's *total*
displacement since the evaluation, ``|c(now) - c(then)|``, which is never more than the sum of its per-round drifts
and often far less. A vector whose bounds show that no other centroid can be as near stays where it is without a
distance; the others are held against exactly those centroids that the bounds leave open, in integers, so results
(ties included: the smaller number) are those of a full scan.

Rounds run on Spark: the vectors are written once, each round's bounds and clusters once (older ones are deleted), and
new centroids come from partial sums per task and cluster, so a cluster with most of the rows is no larger a task than
any other. The driver holds the history: rounds x centroids x components.

Rows without exactly ``dim`` components, or with a null or non-finite one, are left out, as are null vectors. Scaled
components are clipped at +-2^27 (unscaled: two million, for a scale of 64), so squared distances fit a long. A row
without a number is clustered but never a first centroid. Repeated rows count as often as they occur. With fewer rows
than centroids, every row is a first centroid. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import delete_folder, new_folder, scratch, written

LARGEST = 1 << 27
# Relative width of the rounding errors that a bound may have.
SLACK = 1e-12


def integer_vectors(rows: DataFrame, key: str, vector: str, dim: int, scale: float) -> DataFrame:
    """key, x (array<long>): floor(scale * component) of the rows whose vector is whole."""
    v = F.col(vector)
    whole = (F.size(v) == dim) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))),
                                                         F.lit(float(-LARGEST)))).cast("long"))
    return rows.where(F.coalesce(whole, F.lit(False))).select(F.col(key).cast("long").alias("key"), scaled.alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """The k numbered vectors with the smallest sha256 of ``seed:key``, in the order of their hashes."""
    named = vectors.where("key is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256))
    return np.array([r.x for r in named.orderBy("h", "x").limit(k).select("x").collect()], np.int64)


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), dim)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel()))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("nd,nd->n", d, d)


@dataclass
class Bounds:
    """Of a batch of vectors: distance to each centroid at its last evaluation, and the round of that."""

    last: np.ndarray    # n x k
    when: np.ndarray    # n x k
    cluster: np.ndarray

    def assign(self, x: np.ndarray, history: np.ndarray) -> int:
        """Move to the centroids of the newest round; returns how many distances were evaluated.

        ``cluster`` becomes the nearest centroid. A bound is ``last`` with ``moved``, the norm of the total displacement.
        """
        now, k = len(history) - 1, history.shape[1]
        rows, centres = np.arange(len(x)), history[now]
        moved = np.sqrt(((history - centres) ** 2).sum(2, dtype=np.float64))
        far = moved[self.when, np.arange(k)]
        lower = self.last - far - SLACK * (self.last + far)
        own = (self.last + far + SLACK * (self.last + far))[rows, self.cluster]
        lower[rows, self.cluster] = np.inf
        open_ = np.flatnonzero(lower.min(1) <= own) if k > 1 else rows[:0]
        if not len(open_):
            return 0
        # Tighten the own distance, then evaluate what the bounds still leave open.
        y, a = x[open_], self.cluster[open_]
        best = squared(y, centres[a])
        self._evaluated(open_, a, best, now)
        tries = (lower[open_] <= (np.sqrt(best) * (1 + SLACK))[:, None])
        evaluated = len(open_)
        for j in np.flatnonzero(tries.any(0)):
            at = np.flatnonzero(tries[:, j])
            d = squared(y[at], centres[j])
            self._evaluated(open_[at], j, d, now)
            evaluated += len(at)
            nearer = (d < best[at]) | ((d == best[at]) & (j < a[at]))
            best[at[nearer]], a[at[nearer]] = d[nearer], j
        self.cluster[open_] = a
        return evaluated

    def _evaluated(self, rows, j, d: np.ndarray, now: int) -> None:
        self.last[rows, j], self.when[rows, j] = np.sqrt(d.astype(np.float64)), now


def full_scan(x: np.ndarray, centres: np.ndarray) -> Bounds:
    d = np.stack([squared(x, c) for c in centres], 1)
    return Bounds(np.sqrt(d.astype(np.float64)), np.zeros(d.shape, np.int32), d.argmin(1).astype(np.int32))


_STATE = "key long, x array<long>, cluster int, last array<double>, at array<int>, evaluated long"


def _first_round(vectors: DataFrame, history: np.ndarray) -> DataFrame:
    dim, k = history.shape[2], history.shape[1]

    def scan(batches):
        for b in batches:
            found = full_scan(_matrix(b.column("x"), dim, np.int64), history[0])
            yield _state(b, found, np.full(b.num_rows, k))

    return vectors.mapInArrow(scan, _STATE)


def _state(b: pa.RecordBatch, s: Bounds, evaluated: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("key"), b.column("x"), pa.array(s.cluster, pa.int32()), _lists(s.last),
                                       _lists(s.when), pa.array(evaluated, pa.int64())],
                                      ["key", "x", "cluster", "last", "at", "evaluated"])


def _next_round(state: DataFrame, history: np.ndarray) -> DataFrame:
    dim, k = history.shape[2], history.shape[1]

    def move(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = Bounds(_matrix(b.column("last"), k, np.float64).copy(), _matrix(b.column("at"), k, np.int32).copy(),
                       b.column("cluster").to_numpy().copy())
            evaluated = np.zeros(b.num_rows, np.int64)
            evaluated[0] = s.assign(_matrix(b.column("x"), dim, np.int64), history)  # a sum over the batch
            yield _state(b, s, evaluated)

    return state.mapInArrow(move, _STATE)


def _moved_centroids(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Componentwise floor of each cluster's mean; empty clusters stay. Exact: partial sums in longs, totals in decimals."""
    k, dim = centres.shape

    def partial(batches):
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            np.add.at(sums, b.column("cluster").to_numpy(), _matrix(b.column("x"), dim, np.int64))
            counts += np.bincount(b.column("cluster").to_numpy(), minlength=k)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(counts), _lists(sums)],
                                             ["cluster", "n", "sums"])

    parts = state.select("cluster", "x").mapInArrow(partial, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[
        F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dim)]).alias("sums"))
    out = centres.copy()
    for r in total.collect():
        if r.n:
            out[r.cluster] = [int(s) // r.n for s in r.sums]
    return out


def cluster(vectors: DataFrame, starts: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray, list[int]]:
    """k-means over ``vectors`` (key, x) from ``starts`` (k x dim).

    Returns (key, cluster, distance) after ``rounds`` rounds and a last assignment, the history of centroids (rounds + 1,
    k, dim), and how many distances each assignment evaluated.
    """
    spark, history, evaluated = vectors.sparkSession, starts[None], []
    state, folder = vectors, None
    try:
        for r in range(rounds + 1):
            if r:
                history = np.concatenate([history, _moved_centroids(state, history[-1])[None]])
            state = _next_round(state, history) if r else _first_round(vectors, history)
            old, folder = folder, new_folder(spark, f"bounds-{r}")
            state.write.option("compression", "zstd").parquet(folder)
            state = spark.read.schema(_STATE).parquet(folder)
            if old:
                delete_folder(spark, old)
            evaluated.append(state.agg(F.sum("evaluated")).first()[0] or 0)
        last, dim = history[-1], starts.shape[1]

        def distances(batches):
            for b in batches:
                d = squared(_matrix(b.column("x"), dim, np.int64), last[b.column("cluster").to_numpy()])
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("cluster"), pa.array(d, pa.int64())],
                                                 ["key", "cluster", "distance"])

        found = written(state.select("key", "cluster", "x").mapInArrow(distances, "key long, cluster int, distance long"), "clusters")
    finally:
        if folder:
            delete_folder(spark, folder)
    return found, history, evaluated


def clustered(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: float = 64.0,
              k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """Per whole vector: key, cluster, distance, cluster_inertia, inertia, centroid (array<long>), centroid_sha256."""
    spark = rows.sparkSession
    with scratch(spark):
        vectors = written(integer_vectors(rows, key, vector, dim, scale), "vectors")
        starts = first_centroids(vectors, k, seed)
        if not len(starts):  # no numbered vector at all: any of the others, by their components
            starts = np.array([r.x for r in vectors.orderBy("x").limit(k).select("x").collect()], np.int64).reshape(-1, dim)
        if not len(starts):
            none = spark.createDataFrame([], "key long, cluster int, distance long, cluster_inertia long, inertia long, "
                                             "centroid array<long>, centroid_sha256 string")
            return none.withColumnRenamed("key", key)
        found, history, _ = cluster(vectors, starts, rounds)
        found = written(found, "found", keep=True)
    # One row per centroid: bounded by the parameter k.
    per = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda v: v if v < 1 << 63 else None
    named = spark.createDataFrame(
        [(j, long(per[j]), long(sum(per.values())), c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
         for j, c in enumerate(history[-1].tolist()) if j in per],
        "j int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return found.join(F.broadcast(named), F.col("cluster") == F.col("j")).drop("j").withColumnRenamed("key", key)
