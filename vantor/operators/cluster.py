"""Means, medoids, nearest centroids, k-means and principal components over vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantor.errors import InvalidArgument
from vantor.functions.distance import distance, distance_matrix
from vantor.operators.search import batch_vectors, ranked

#: Centroids are carried to every task; more than this is refused.
MAX_CENTROID_BYTES = 64 << 20


def mean_vector(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """(dim, mean): a row a dimension, partial sums before the shuffle."""
    return vectors.select(F.posexplode(vector_col).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def medoid(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, distance): the row nearest the mean; ties to the smaller id."""
    mean = mean_vector(vectors, vector_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"]).alias("m"))
    scored = vectors.join(F.broadcast(mean)).select(id_col, distance(vector_col, "m", "l2").alias("distance"))  # one row
    best = scored.agg(F.min(F.struct("distance", id_col)).alias("b"))
    return best.select(F.col(f"b.{id_col}").alias(id_col), F.col("b.distance").alias("distance"))


def nearest_centroids(vectors: DataFrame, centroids: DataFrame, k: int = 1, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, rank, cluster, distance): the k nearest of centroids (cluster, centroid) for each row, ties to the smaller cluster.

    The centroids' size is checked, then they travel with the task; rows stay where they are, nothing is shuffled.
    """
    rows = [(r[0], r[1]) for r in centroids.select("cluster", "centroid").sort("cluster").limit(MAX_CENTROID_BYTES).collect()]
    c = np.array([r[1] for r in rows], dtype=np.float64)
    if c.nbytes > MAX_CENTROID_BYTES:
        raise InvalidArgument(f"centroids take {c.nbytes} bytes, more than {MAX_CENTROID_BYTES}")
    names = np.array([r[0] for r in rows], dtype=np.int64)
    kind, k = vectors.schema[id_col].dataType.simpleString(), min(k, len(rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = distance_matrix(batch_vectors(batch.column(1)), c, "l2")
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            n = len(d)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(names[best].ravel()), pa.array(np.take_along_axis(d, best, 1).ravel())]
            yield pa.record_batch(columns, names=[id_col, "rank", "cluster", "distance"])

    return vectors.select(id_col, vector_col).mapInArrow(run, f"{id_col} {kind}, rank int, cluster long, distance float")


def nearest_centroids_columns(vectors: DataFrame, centroids: DataFrame, k: int = 1, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The same as a join of Columns with the small side sent to all tasks by size, not by hint."""
    scored = vectors.join(centroids).select(F.col(id_col).alias("query_id"), "cluster", distance(vector_col, "centroid", "l2").alias("distance"))
    return ranked(scored, k, "cluster").withColumnRenamed("query_id", id_col)


def lloyd_step(vectors: DataFrame, centroids: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(cluster, size, centroid): the mean of the rows nearest each centroid; an empty cluster gets the zero vector.

    Sums are made a cluster and dimension at a time, with map-side aggregates.
    """
    assigned = nearest_centroids(vectors, centroids, 1, id_col, vector_col).select(F.col(id_col).alias("__id"), "cluster")
    cells = vectors.join(assigned, F.col(id_col) == F.col("__id")).select("cluster", F.posexplode(vector_col).alias("dim", "x"))
    means = cells.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    arrays = means.groupBy("cluster").agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"].cast("float")).alias("mean"))
    zero = F.transform("centroid", lambda x: F.lit(0.0).cast("float"))
    out = centroids.select("cluster", "centroid").join(arrays, "cluster", "left")
    return out.select("cluster", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mean", zero).alias("centroid"))


def kmeans(vectors: DataFrame, k: int, iterations: int = 10, tolerance: float = 1e-5, seed: int = 42, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(cluster, size, centroid) after Lloyd's iterations, begun by distance-squared sampling on a bounded sample.

    Each iteration is one pass in which tasks add up their own rows: k * (dim + 1) numbers a task are shuffled.
    """
    sample = [r[0] for r in vectors.orderBy(F.xxhash64(id_col, F.lit(seed))).select(vector_col).limit(50 * k).collect()]  # 50 rows a cluster
    c = _plus_plus(np.array(sample, dtype=np.float64), k, seed)
    size = np.zeros(len(c), dtype=np.int64)
    for _ in range(iterations):
        total, size = _sums(vectors, c, vector_col)
        new = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], 0.0)
        moved = np.abs(new - c).max()
        c = new
        if moved < tolerance:
            break
    rows = [(i, int(size[i]), [float(x) for x in c[i]]) for i in range(len(c))]
    return vectors.sparkSession.createDataFrame(rows, "cluster long, size long, centroid array<float>")


def _plus_plus(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    chosen = [sample[rng.integers(len(sample))]]
    d = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(sample)):
        chosen.append(sample[rng.choice(len(sample), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(sample))])
        d = np.minimum(d, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def _sums(vectors: DataFrame, c: np.ndarray, vector_col: str) -> tuple[np.ndarray, np.ndarray]:
    dim = c.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(c), np.zeros(len(c), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                v = batch_vectors(batch.column(0)).astype(np.float64)
                near = np.argmin((c * c).sum(axis=1)[None, :] - 2 * (v @ c.T), axis=1)
                np.add.at(total, near, v)
                n += np.bincount(near, minlength=len(c))
        on = np.nonzero(n)[0]
        yield pa.record_batch([pa.array(on), pa.array(n[on]), pa.array(total[on].tolist(), pa.list_(pa.float64()))], names=["cluster", "n", "total"])

    parts = vectors.select(vector_col).mapInArrow(run, "cluster long, n long, total array<double>")
    cells = parts.select("cluster", "n", F.posexplode("total").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    total, n = np.zeros((len(c), dim)), np.zeros(len(c), dtype=np.int64)
    for r in cells.collect():  # k * dim rows
        total[r.cluster, r.dim], n[r.cluster] = r.x, r.n
    return total, n


def medoids(vectors: DataFrame, centroids: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(cluster, id, distance): for each centroid the nearest row."""
    queries = centroids.select(F.col("cluster").alias("query_id"), F.col("centroid").alias("query"))
    from vantor.operators.search import search

    return search(vectors, queries, 1, "l2", None, id_col, vector_col).select(F.col("query_id").alias("cluster"), id_col, "distance")


def moments(vectors: DataFrame, dim: int, vector_col: str = "vector") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) over all rows: tasks add up their own outer products, dim * dim numbers each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, o = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                v = batch_vectors(batch.column(0)).astype(np.float64)
                n, s, o = n + len(v), s + v.sum(axis=0), o + v.T @ v
        rows = np.vstack([o, s, np.pad([float(n)], (0, dim - 1))])
        yield pa.record_batch([pa.array(np.arange(dim + 2)), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["row", "cells"])

    cells = vectors.select(vector_col).mapInArrow(run, "row long, cells array<double>").select("row", F.posexplode("cells").alias("dim", "x"))
    out = np.zeros((dim + 2, dim))
    for r in cells.groupBy("row", "dim").agg(F.sum("x").alias("x")).collect():  # (dim + 2) * dim rows
        out[r.row, r.dim] = r.x
    n = int(out[dim + 1, 0])
    mean = out[dim] / max(1, n)
    return n, mean, out[:dim] / max(1, n) - np.outer(mean, mean)


class Pca:
    """Principal components, the rows of `components`; signs are such that each row's sum is not negative."""

    def __init__(self, mean: np.ndarray, components: np.ndarray, variance: np.ndarray) -> None:
        self.mean, self.components, self.variance = mean, components, variance

    @staticmethod
    def fit(vectors: DataFrame, dim: int, k: int | None = None, vector_col: str = "vector") -> Pca:
        _, mean, covariance = moments(vectors, dim, vector_col)
        values, axes = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[: k or dim]
        rows = axes.T[order]
        sums = rows.sum(axis=1)
        lead = rows[np.arange(len(rows)), np.argmax(np.abs(rows), axis=1)]
        rows = rows * np.where(np.where(np.abs(sums) > 1e-9, sums, lead) < 0, -1.0, 1.0)[:, None]
        return Pca(mean, rows, values[order])

    def transform(self, v: np.ndarray) -> np.ndarray:
        return (v - self.mean) @ self.components.T

    def inverse(self, t: np.ndarray) -> np.ndarray:
        return t @ self.components + self.mean

    def apply(self, vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
        """vectors with vector_col in the components' coordinates."""
        at, schema = vectors.columns.index(vector_col), vectors.schema

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                new = pa.array(self.transform(batch_vectors(batch.column(at))).astype(np.float32).tolist(), pa.list_(pa.float32()))
                yield batch.set_column(at, vector_col, new)

        return vectors.mapInArrow(run, schema)


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("size"))


def shards_for(rows: int, dim: int, budget_bytes: int, degree: int = 64) -> int:
    """How many shards keep each graph build within the memory budget; one if all fits."""
    row = 4 * dim + 4 * degree + 64
    return max(1, -(-rows * row // budget_bytes))


def shard_assignment(vectors: DataFrame, centroids: DataFrame, overlap: int = 2, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, vector, shard): each row in its `overlap` nearest shards."""
    near = nearest_centroids(vectors, centroids, overlap, id_col, vector_col).select(F.col(id_col).alias("__id"), F.col("cluster").alias("shard"))
    return vectors.select(id_col, vector_col).join(near, F.col(id_col) == F.col("__id")).drop("__id")


def column_means(matrix: DataFrame, column: str) -> DataFrame:
    """(dim, mean): means over the rows of an array column, a dimension at a time."""
    return mean_vector(matrix, column)


def greedy_held_out(sizes: DataFrame, lower: int, upper: int) -> list[int]:
    """Clusters in falling order of size, one that would pass `upper` skipped, until their rows lie in [lower, upper].

    sizes: (cluster, size), a row a cluster.
    """
    picked, total = [], 0
    for r in sizes.orderBy(F.desc("size"), "cluster").collect():
        if total + r["size"] <= upper:
            picked.append(r["cluster"])
            total += r["size"]
        if lower <= total <= upper:
            break
    return picked


def drift_order(assigned: DataFrame, held: list[int], seed: int = 42, id_col: str = "id") -> DataFrame:
    """assigned (id, cluster, distance) in build order: kept rows by id, then held-out clusters by their distance, shuffled inside."""
    is_held = F.col("cluster").isin(*held) if held else F.lit(False)
    centre = F.avg("distance").over(Window.partitionBy("cluster"))
    rows = assigned.withColumn("is_held", is_held).withColumn("__c", F.when(F.col("is_held"), centre).otherwise(0.0))
    key = F.when(F.col("is_held"), F.xxhash64(id_col, F.lit(seed))).otherwise(F.col(id_col).cast("long"))
    from vantor.operators.mutations import numbered

    rows = rows.withColumn("__k", key).withColumn("__cl", F.when(F.col("is_held"), F.col("cluster")).otherwise(-1))
    return numbered(rows, ["is_held", "__c", "__cl", "__k"], "position").drop("__c", "__cl", "__k")
