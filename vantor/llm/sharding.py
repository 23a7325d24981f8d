"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
#: Source partitions (rows by hash of id and text, so that rows without an id or with one id are spread), and parts of a shard's final order. Both bound tables, not data.
BLOCKS = 4096
PARTS = 256
SEED = 20_259


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good."""
    if min(good, bad, n) == 0 or n == good + bad:
        return 0 if good == 0 or n == 0 else n if bad == 0 else good
    if good + bad < 900_000_000:
        return int(rng.hypergeometric(good, bad, n))
    # numpy goes no further; invert the distribution within 40 deviations of the mean
    total = good + bad
    mean, sd = n * good / total, math.sqrt(n * good * bad * (total - n) / total**2 / (total - 1))
    low, high = max(0, n - bad, int(mean - 40 * sd) - 2), min(n, good, int(mean + 40 * sd) + 2)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.exp(log_p - log_p.max())
    return low + int(min(len(p) - 1, np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right")))


def communication_matrix(counts: list[int], quotas: list[int], rng: np.random.Generator) -> np.ndarray:
    """Rows for blocks, columns for shards: how many rows each block sends, as a uniform shuffle would deal them."""
    out, left = np.zeros((len(counts), len(quotas)), dtype=np.int64), list(quotas)
    for b, n in enumerate(counts):
        rest = sum(left)
        for s, q in enumerate(left):
            rest -= q
            out[b, s] = got = hypergeometric(rng, q, rest, n)
            n -= got
            left[s] -= got
    return out


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, checksum: str | None = None) -> DataFrame:
    """docs with __shard and __slot: shards of sizes at most one apart, slots gapless from 0 in a random order.

    Rows are permuted within their block by a hash, the first ones go to shard 0, the next to shard 1, as the drawn
    matrix says, and are permuted again within the shard. Blocks and parts of shards are counted with partial
    aggregation; windows run within a block, or within a part of a shard. All hashes come from doc_id and text, so that
    recomputed tasks and reruns agree; checksum names a column that stands for the text. Null ids and texts are hashed like values; repeated rows are dealt one by one;
    an empty table gives an empty one.
    """
    spark = docs.sparkSession
    crc = F.coalesce(F.crc32(F.col("text")), F.lit(-1)) if checksum is None else F.col(checksum)
    block = F.pmod(F.xxhash64("doc_id", crc, F.lit(seed)), F.lit(BLOCKS)).cast("int")
    counts = {r[0]: r[1] for r in docs.groupBy(block.alias("b")).count().collect()}  # BLOCKS rows at most
    order = sorted(counts)
    n = sum(counts.values())
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = communication_matrix([counts[b] for b in order], quotas, np.random.default_rng(seed)).cumsum(axis=1)
    sends = spark.createDataFrame([(b, [int(x) for x in row]) for b, row in zip(order, matrix, strict=True)], "__block int, __ends array<bigint>")
    rows = docs.withColumns({"__block": block, "__crc": crc, "__part_hash": F.xxhash64("doc_id", crc, F.lit(seed + 2))})
    local = Window.partitionBy("__block").orderBy(F.xxhash64("doc_id", "__crc", F.lit(seed + 1)), "doc_id", "__crc")
    rows = rows.withColumn("__nth", F.row_number().over(local)).join(F.broadcast(sends), "__block")
    rows = rows.withColumn("__shard", F.size(F.filter("__ends", lambda e: e < F.col("__nth")))).drop("__ends", "__nth", "__block")
    rows = rows.withColumn("__part", F.pmod(F.col("__part_hash"), F.lit(PARTS)).cast("int"))
    parts = rows.groupBy("__shard", "__part").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy("__shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    final = Window.partitionBy("__shard", "__part").orderBy("__part_hash", "doc_id", "__crc")
    rows = rows.withColumn("__slot", F.row_number().over(final)).join(F.broadcast(parts), ["__shard", "__part"])  # shards * PARTS rows
    rows = rows.withColumn("__slot", (F.col("__slot") - 1 + F.col("__before")).cast("long"))
    return rows.drop("__part", "__part_hash", "__crc", "__before")


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs; law is `rows`.

    size: UTF-8 bytes of the text plus 16; a null text has 16, and the checksum of no bytes.
    """
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 16).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    return shard(rows, shards, checksum="text_crc32").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with all columns, and shard and slot (which replace columns of these names)."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return shard(docs, shards).select(*own, F.col("__shard").cast("int").alias("shard"), F.col("__slot").alias("slot"))
