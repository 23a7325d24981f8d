"""Exact top-k search, its reports, and recall against ground truth."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import FloatType, StructField, StructType

from vantor.errors import InvalidArgument, ResourceExhausted
from vantor.functions.distance import METRICS, nearest_pairs
from vantor.sources.shared import cut

#: Queries that one pass over the collection carries to the executors, as an Arrow closure of bounded size.
MAX_QUERIES = 8_192
MAX_QUERY_BYTES = 64 << 20
#: Rows and bytes, as doubles, of a group that joined() makes.
GROUP_ROWS = 8_192
GROUP_BYTES = 16 << 20
#: Cells of a distance tile in a worker.
TILE = 2_000_000


def _check(limit: int, metric: str) -> None:
    if isinstance(limit, bool) or not isinstance(limit, int) or limit <= 0:
        raise InvalidArgument("limit must be a positive integer")
    if metric not in METRICS:
        raise InvalidArgument(f"metric must be one of {METRICS}")


def ranked(scored: DataFrame, limit: int, id_col: str = "id", query_col: str = "query_id") -> DataFrame:
    """The best `limit` rows of each query by (distance, id), once for each id; NaN distances are dropped.

    Rank filters become group limits, so that tasks pass on `limit` rows a query before the shuffle.
    """
    best = Window.partitionBy(query_col).orderBy("distance", id_col)
    rows = scored.where(~F.isnan("distance"))
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select(query_col, "rank", id_col, "distance")


def search(collection: DataFrame, queries: DataFrame, limit: int, metric: str = "l2", where: Column | None = None, id_col: str = "id", vector_col: str = "vector", strategy: str = "arrow", embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(query_id, rank, id, distance): the exact nearest rows of each query (query_id, query).

    strategy `arrow` scores batches in numpy against the queries, which are gathered in slices of bounded size, and
    keeps each batch's best rows; `columns` states the same as a join on columns, for queries of any number, none of which
    passes the driver. With embed (arrow only) vector_col has texts, whose vectors are made where they are scored, once for
    each slice.
    """
    _check(limit, metric)
    if where is not None:
        collection = collection.where(where)
    rows = collection.select(id_col, vector_col)
    if embed is not None and strategy != "arrow":
        raise InvalidArgument("embed needs strategy arrow")
    if strategy == "columns":
        return joined(rows, queries, limit, metric, id_col, vector_col, groups(rows, vector_col), groups(queries, "query"))
    if strategy != "arrow":
        raise InvalidArgument(f"unknown strategy {strategy!r}")
    parts = [_scored(rows, ids, q, limit, metric, id_col, vector_col, queries, embed) for ids, q in slices(queries)]
    if not parts:
        return ranked(rows.join(queries.limit(0).select("query_id")).select("query_id", id_col, F.lit(0.0).cast("float").alias("distance")), limit, id_col)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, limit, id_col)


def groups(rows: DataFrame, vector_col: str) -> int:
    """In how many groups joined() deals these rows, so that a group is of bounded size."""
    n, dim = rows.agg(F.count("*"), F.max(F.size(vector_col))).first()
    return max(1, -(-n // min(GROUP_ROWS, max(1, GROUP_BYTES // (8 * max(1, dim or 1))))))


def joined(rows: DataFrame, queries: DataFrame, limit: int, metric: str, id_col: str, vector_col: str, row_groups: int, query_groups: int) -> DataFrame:
    """search() as a join: both sides are dealt into groups, each group of rows meets each group of queries in a task.

    As in the Column form, vectors with nulls, or of another length than the query, have no distance.
    """

    def dealt(side: DataFrame, key: str, vector: str, own: tuple[str, int], other: tuple[str, int]) -> DataFrame:
        whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
        group = F.pmod(F.xxhash64(key), F.lit(own[1])).cast("int").alias(own[0])
        every = F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1))).alias(other[0])
        return side.where(whole).select(F.col(key).alias("__id"), F.col(vector).alias("__v"), F.size(vector).alias("__d"), group, every)

    a, b = ("__g", row_groups), ("__h", query_groups)
    left, right = dealt(rows, id_col, vector_col, a, b), dealt(queries, "query_id", "query", b, a)
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField(id_col, rows.schema[id_col].dataType), StructField("distance", FloatType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(near: pa.Table, asked: pa.Table) -> pa.Table:
        parts = [pa.table([pa.array([], k) for k in kinds], names=schema.names)]
        if near.num_rows and asked.num_rows:
            near = near.take(pc.sort_indices(near.column("__id"), null_placement="at_start"))  # ties go to the smaller id
            v, q = (x.column("__v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, x.column("__d")[0].as_py()) for x in (near, asked))
            step = max(1, TILE // len(v))
            for at in range(0, len(q), step):
                of, place, d = nearest_pairs(q[at : at + step], v, limit, metric)
                columns = [asked.column("__id").take(pa.array(at + of)).cast(kinds[0]), near.column("__id").take(pa.array(place)).cast(kinds[1]), pa.array(d, pa.float32())]
                parts.append(pa.table(columns, names=schema.names))
        return pa.concat_tables(parts)

    keys = ["__g", "__h", "__d"]
    return ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema), limit, id_col)


def slices(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Queries in slices of at most MAX_QUERIES and MAX_QUERY_BYTES, streamed a partition at a time."""
    ids, vectors, held = [], [], 0
    for r in queries.select("query_id", "query").toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        held += 4 * len(r[1])
        if len(ids) >= MAX_QUERIES or held >= MAX_QUERY_BYTES:
            yield ids, np.array(vectors, dtype=np.float32)
            ids, vectors, held = [], [], 0
    if ids:
        yield ids, np.array(vectors, dtype=np.float32)


def batch_vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _scored(rows: DataFrame, ids: list, q: np.ndarray, limit: int, metric: str, id_col: str, vector_col: str, queries: DataFrame, embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    kind, query_kind = (rows.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString())
    query_ids = pa.array(ids, to_arrow_type(queries.schema["query_id"].dataType))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            order = np.argsort(np.array(keys.to_pylist()), kind="stable")  # ties go to the smaller id
            vectors = batch_vectors(batch.column(1)) if embed is None else np.asarray(embed([t or "" for t in batch.column(1).to_pylist()]), dtype=np.float32)
            vectors = vectors[order]
            step = max(1, TILE // max(1, len(vectors)))
            for at in range(0, len(q) if len(vectors) else 0, step):
                of, place, d = nearest_pairs(q[at : at + step], vectors, limit, metric)
                columns = [query_ids.take(pa.array(at + of)), keys.take(pa.array(order[place])), pa.array(d, pa.float32())]
                yield pa.record_batch(columns, names=["query_id", id_col, "distance"])

    return rows.mapInArrow(run, f"query_id {query_kind}, {id_col} {kind}, distance float")


def completeness(hits: DataFrame, queries: DataFrame, limit: int, incomplete: bool = False) -> DataFrame:
    """(query_id, valid_count, completeness): complete_k with `limit` hits, else eligible_exhausted; queries without hits too.

    incomplete: the search gave up before it had seen all that is eligible, so fewer hits are strategy_incomplete.
    """
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    out = queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("valid_count"))
    return out.withColumn("completeness", F.when(F.col("valid_count") >= limit, "complete_k").otherwise("strategy_incomplete" if incomplete else "eligible_exhausted"))


def csr(hits: DataFrame, queries: DataFrame, id_col: str = "id") -> DataFrame:
    """(query_id, ids, distances, offset, next_offset): results in compressed-row form; offsets run by query_id."""
    lists = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", id_col, "distance"))).alias("h"))
    out = queries.select("query_id").join(lists, "query_id", "left")
    out = out.select("query_id", F.coalesce(F.transform("h", lambda x: x[id_col]), F.array()).alias("ids"), F.coalesce(F.transform("h", lambda x: x["distance"]), F.array()).alias("distances"))
    # sums run within ranges of queries; each adds those of the ranges before its own, a row for each range
    n = max(1, min(1024, int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = cut(out.repartitionByRange(n, "query_id").withColumn("__p", F.spark_partition_id()))
    order = Window.partitionBy("__p").orderBy("query_id").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("next_offset", F.sum(F.size("ids")).over(order))
    sums = out.groupBy("__p").agg(F.max("next_offset").alias("__n"))
    before = sums.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = out.join(F.broadcast(before), "__p").withColumn("next_offset", F.col("next_offset") + F.col("__before")).drop("__p", "__before")
    return out.withColumn("offset", F.col("next_offset") - F.size("ids"))


def payloads(hits: DataFrame, collection: DataFrame, id_col: str = "id") -> DataFrame:
    """hits with the other columns of the rows they name."""
    return hits.join(collection, id_col, "left")


def without(collection: DataFrame, deleted: DataFrame, id_col: str = "id") -> DataFrame:
    return collection.join(deleted.select(id_col), id_col, "left_anti")


def merge_segments(segments: list[DataFrame], limit: int, id_col: str = "id") -> DataFrame:
    """The best `limit` of several result sets, an id counting once with its smallest distance."""
    union = segments[0]
    for s in segments[1:]:
        union = union.unionByName(s)
    return ranked(union.groupBy("query_id", id_col).agg(F.min("distance").alias("distance")), limit, id_col)


def recall(hits: DataFrame, truth: DataFrame, limit: int, id_col: str = "id") -> DataFrame:
    """(recall): hits that are in the truth over queries times limit; an id that a result repeats counts again."""
    found = hits.join(truth.select("query_id", id_col).distinct(), ["query_id", id_col], "left_semi")
    n = truth.select("query_id").distinct().agg(F.count("*").alias("q"))
    return found.agg(F.count("*").alias("found")).join(F.broadcast(n)).select(F.try_divide(F.col("found"), F.col("q") * limit).alias("recall"))


def selectivity(collection: DataFrame, where: Column, sample: int = 256, id_col: str = "id") -> DataFrame:
    """(selectivity): the share of the first `sample` rows in id order that pass; 0 without rows."""
    first = collection.withColumn("__passes", F.coalesce(where, F.lit(False)).cast("int")).orderBy(id_col).limit(sample)
    return first.agg(F.coalesce(F.avg("__passes"), F.lit(0.0)).alias("selectivity"))


def filter_plan(selected: Column | float, has_filter: bool = True, active_graph: bool = False, strict: bool = False) -> Column:
    """prefilter, traversal or postfilter, by selectivity."""
    s = selected if isinstance(selected, Column) else F.lit(selected)
    if not has_filter or active_graph:
        return F.lit("postfilter")
    if strict:
        return F.lit("prefilter")
    return F.when(s <= 0.15, "prefilter").when(s <= 0.60, "traversal").otherwise("postfilter")


def preflight(n_queries: int, live: int, limit: int, dim: int, budget_bytes: int | None) -> int:
    """Scratch bytes that a search would take; above the budget it is refused before any work."""
    need = n_queries * max(live, limit) * 16 + n_queries * dim * 4
    if budget_bytes is not None and need > budget_bytes:
        raise ResourceExhausted(f"search needs {need} bytes, the budget is {budget_bytes}")
    return need


def overfetch(found: Callable[[int], DataFrame], admitted: DataFrame, limit: int, rounds: int = 4, id_col: str = "id", report: dict | None = None) -> DataFrame:
    """The best `limit` admitted rows of an approximate search that knows no filter: found(n) gives its first n hits a query.

    n doubles while some query has too few that are admitted and its hits aren't exhausted, for so many more rounds.
    report gets the number of rounds, and whether some query is still short.
    """
    report = {} if report is None else report
    n = limit
    for k in range(rounds + 1):
        hits = found(n)
        kept = hits.join(admitted.select(id_col).distinct(), id_col, "left_semi")
        counts = hits.groupBy("query_id").agg(F.count("*").alias("all")).join(kept.groupBy("query_id").agg(F.count("*").alias("ok")), "query_id", "left")
        short = counts.where((F.coalesce("ok", F.lit(0)) < limit) & (F.col("all") >= n))
        report |= {"overfetch_rounds": k, "short": short.limit(1).count() > 0}
        if k == rounds or not report["short"]:
            return ranked(kept.select("query_id", id_col, "distance"), limit, id_col)
        n *= 2
    raise AssertionError("not reached")
