"""SimHash near-duplicates with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import cut, sized
from vantor.llm.components import connected_components
from vantor.llm.near_copies import near_copies

SEED = 42
STEP = 1 << 15


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles; 0 for a text without words (or null)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest, bits, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), max(1, len(words) - width + 1)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + width - 1]
        grams = zip(*(part[k:] for k in range(width)), strict=False) if len(words) >= width else [words]
        hashes = np.array([digest(b" ".join(g), SEED) for g in grams], dtype="<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a signed long), a row for each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint long")


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in at most two bits, enough of them to connect all that do.

    prints: one column, distinct fingerprints. A fingerprint is cut into two segments of 32 bits; of two bits that
    differ one segment has one at most, so both fingerprints share a variant of that segment with one bit left out.
    A variant that just two fingerprints share is a candidate pair, verified in full. Variants that more share could
    hold very many pairs: their fingerprints get variants of the whole 64 bits instead, with one bit changed or none.
    Two fingerprints within two bits share one of those, those that share one are within two bits, and no more than
    65 can share one, so a star links them without pairs.
    """
    f, k = F.col("f"), F.col("k")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = prints.toDF("f").repartition(parts, "f")  # small as they are, they become 64 times as many
    segment = F.when(k < 32, f.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(f, 32))
    left_out = F.bitwise_not(F.expr("shiftleft(1L, k % 32)"))
    key = F.shiftleft(k.cast("long"), 32).bitwiseOR(segment.bitwiseAND(left_out))
    variants = prints.select("f", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select("f", key.alias("key"))
    buckets = variants.groupBy("key").agg(F.count("*").alias("n"), F.min("f").alias("a"), F.max("f").alias("b"))
    buckets = cut(buckets.where("n > 1"))
    pairs = buckets.where("n = 2 and bit_count(a ^ b) <= 2").select("a", "b")
    crowded = variants.join(sized(buckets.where("n > 2").select("key")), "key", "left_semi").select("f").distinct()
    changed = F.when(k < 64, f.bitwiseXOR(F.expr("shiftleft(1L, k % 64)"))).otherwise(f)
    balls = crowded.select("f", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("k")).select("f", changed.alias("key"))
    stars = balls.groupBy("key").agg(F.collect_list("f").alias("fs")).where("size(fs) > 1")
    stars = stars.select(F.explode("fs").alias("a"), F.array_min("fs").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint long, component_id), a row for each row of docs (columns doc_id, text; others are ignored).

    component_id is the smallest doc_id that links of at most two differing bits reach. Null and empty texts have
    fingerprint zero and are linked like any other; equal texts share a component; repeated rows are answered one by
    one; an empty table gives an empty one. Rows without an id have a component, and lend it no id.
    """
    rows = cut(fingerprints(docs, width))
    classes = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")))
    found = connected_components(links(classes.select("fingerprint")))
    linked = classes.join(found, classes["fingerprint"] == found["node"])
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    named = linked.join(least, "component").select("fingerprint", "least")
    named = classes.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("least", "rep").alias("component_id"))
    named = cut(named)  # then both sides of the last join are plain exchanges, and a hot fingerprint's rows can be split
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with one row of each group: of its rows with the smallest doc_id (or none has an id), the first by text.

    groups: (h, component), a row for each distinct xxhash64 of a text. Rows are chosen within a component, so that
    neither a repeated nor a missing id joins what no text does.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h")).join(groups, "h")
    least = rows.groupBy("component").agg(F.min("doc_id").alias("least"))
    kept = rows.join(least, "component").where(F.col("doc_id").eqNullSafe(F.col("least")))
    kept = kept.groupBy("h", F.col("doc_id").alias("__kept_id"), "component").agg(F.count("*").alias("n"))
    kept = cut(kept.withColumnsRenamed({"h": "__h", "component": "__component"}))
    out = docs.join(kept.drop("n"), (F.xxhash64("text") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__kept_id")))
    several = cut(kept.groupBy("__component").agg(F.sum("n").alias("n")).where("n > 1").select("__component"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    if several.limit(1).count() == 0:
        return out.select(*own)
    # an aggregate, not a window: a group of many rows is reduced where they are
    first = out.join(sized(several), "__component", "left_semi").groupBy("__component")
    first = first.agg(F.min_by(F.struct(*own), F.struct(F.xxhash64("text"), "text")).alias("__row")).select("__row.*")
    return out.join(sized(several), "__component", "left_anti").select(*own).unionByName(first)


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies, linked by five-word shingles with a similarity of 0.8 or more.

    Candidates come from fingerprints with deletion variants, and from MinHash bands for what those don't reach.
    It has the smallest id of the group (of rows that repeat the id, the first by text).
    """
    return one_of_each(docs, cut(near_copies(docs)))
