"""Synthetic vectors, and workloads of changes over a collection with their recall on what is live."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.errors import InvalidArgument
from vantor.operators.quantize import matrix_rotation
from vantor.operators.search import recall, search
from vantor.sources.shared import cut
from vantor.store import Collection

MODES = ("insert", "churn", "mixed", "eval")


def clustered_vectors(spark: SparkSession, rows: int, dim: int, clusters: int, spread: float = 0.2, seed: int = 42) -> DataFrame:
    """(id, vector, cluster): points around random centres, under one orthogonal map; a row depends on its id and the seed alone."""
    centres = np.random.default_rng(seed).standard_normal((clusters, dim))
    rotation = matrix_rotation(dim, seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            of = np.array([i % clusters for i in ids], dtype=np.int32)
            noise = np.array([np.random.default_rng([seed, i]).standard_normal(dim) for i in ids]).reshape(-1, dim)
            v = ((centres[of] + spread * noise) @ rotation.T).astype(np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
            yield pa.record_batch([batch.column(0), vectors, pa.array(of)], names=["id", "vector", "cluster"])

    return spark.range(rows).mapInArrow(run, "id long, vector array<float>, cluster int")


def run(collection: Collection, stream: DataFrame, queries: DataFrame, mode: str, step: int, steps: int, window: int = 2, limit: int = 10) -> DataFrame:
    """(step, live, recall): a collection under changes, measured after each step against exact search over its live rows.

    stream has id (a long, from 0) and vector; step k takes rows k * step and on. insert adds them; churn adds them and
    deletes those of `window` steps before; mixed does so in every other step; eval changes nothing.
    """
    if mode not in MODES:
        raise InvalidArgument(f"mode must be one of {MODES}")
    spark, out = collection.spark, []
    part = lambda k: stream.where((F.col("id") >= k * step) & (F.col("id") < (k + 1) * step))
    named = lambda df, k: df.select((F.col("id") - k * step).alias("pos"), F.lpad(F.col("id").cast("string"), 12, "0").alias("id"), *[c for c in df.columns if c == "vector"])
    cells = [F.lit("").alias("document"), F.create_map().cast(f"map<string,{collection.cell}>").alias("metadata")]
    for k in range(steps):
        if mode != "eval":
            collection.write(named(part(k), k).select("*", *cells), "upsert")
            if mode != "insert" and k >= window and (mode == "churn" or k % 2):
                collection.write(named(part(k - window).select("id"), k - window), "delete", "partial")
        live = cut(collection.records().select("id", F.col("vector").cast("array<float>").alias("vector")))
        truth = search(live, queries, limit, collection.config.metric)
        found = collection.search(queries, limit).hits
        out.append((k, live.count(), recall(found, truth, limit).first().recall))
    return spark.createDataFrame(out, "step int, live long, recall double")
