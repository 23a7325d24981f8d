"""Proximity graphs: built shard by shard, merged as edge tables, searched best first.

A graph is an edge table (src, dst, slot). Building within a shard is sequential by nature and happens in one task a
shard, whose size shards_for() bounds; all between shards is joins and windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vantor.errors import InvalidArgument
from vantor.functions.distance import distance_pairs, gemm_matrix
from vantor.operators.cluster import kmeans, shard_assignment, shards_for
from vantor.operators.search import batch_vectors, ranked, slices
from vantor.sources.shared import cut

DEGREE = 32
EFFORT = 100
ALPHA = 1.2
#: Rows that a shard of bounded() is to have, about, and up to which build() takes candidates from all pairs.
SHARD_ROWS = 8_192
EXACT_ROWS = 4 * SHARD_ROWS
#: Cells of a worker's tables, and rows that a walk expands at a time.
CELLS = 8_000_000
STRIDE = 4


def robust_prune(point: int, candidates: np.ndarray, d: np.ndarray, vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Of candidates (with distances d to point) a diverse few: each one drops those that are alpha times nearer to it.

    Passes with alpha growing from 1 keep close neighbours before far ones.
    """
    order = np.lexsort((candidates, d))
    candidates, d = candidates[order], d[order]
    keep = np.concatenate([[True], candidates[1:] != candidates[:-1]]) & (candidates != point)
    candidates, d = candidates[keep], d[keep]
    chosen: list[int] = []
    taken = np.zeros(len(candidates), dtype=bool)
    between = gemm_matrix(vectors[candidates], vectors[candidates], "l2") if len(candidates) else np.zeros((0, 0))
    cut = 1.0
    while len(chosen) < degree:
        shadow = taken.copy()
        for k in np.nonzero(taken)[0]:
            shadow |= cut * between[k] <= d
        for k in range(len(candidates)):
            if shadow[k]:
                continue
            chosen.append(int(candidates[k]))
            taken[k] = True
            shadow |= cut * between[k] <= d
            if len(chosen) == degree:
                break
        if cut >= alpha:
            break
        cut = min(alpha, cut * 1.2)
    return chosen


def beam(query: np.ndarray, vectors: np.ndarray, neighbours: list, entry: Iterable[int], effort: int, metric: str = "l2", visit=None) -> tuple[list[tuple[float, int]], list[int]]:
    """Best-first search: the `effort` nearest rows found, as (distance, row), and the rows expanded in order."""
    start = np.array(sorted(set(entry)), dtype=np.int64)
    d = gemm_matrix(query[None, :], vectors[start], metric)[0]
    seen = set(start.tolist())
    open_ = [(float(x), int(i)) for x, i in zip(d, start, strict=True)]
    heapq.heapify(open_)
    best = [(-x, -i) for x, i in open_]
    heapq.heapify(best)
    expanded = []
    while open_:
        x, i = heapq.heappop(open_)
        if len(best) >= effort and x > -best[0][0]:
            break
        expanded.append(i)
        if visit is not None:
            visit(i)
        new = [j for j in neighbours[i] if j not in seen]
        if not new:
            continue
        seen.update(new)
        for y, j in zip(gemm_matrix(query[None, :], vectors[new], metric)[0].tolist(), new, strict=True):
            if len(best) < effort or y < -best[0][0]:
                heapq.heappush(open_, (y, j))
                heapq.heappush(best, (-y, -j))
                if len(best) > effort:
                    heapq.heappop(best)
    return sorted((-x, -i) for x, i in best), expanded


def _link(i: int, vectors: np.ndarray, neighbours: list[list[int]], entry: int, degree: int, effort: int, alpha: float) -> None:
    """Search for row i in the graph, prune what was met to its neighbours, and link these back to it."""
    found, expanded = beam(vectors[i], vectors, neighbours, [entry], effort)
    pool = np.array(sorted(({j for _, j in found} | set(expanded) | set(neighbours[i])) - {i}), dtype=np.int64)
    if not len(pool):
        return
    d = gemm_matrix(vectors[i][None, :], vectors[pool], "l2")[0]
    neighbours[i] = robust_prune(i, pool, d, vectors, degree, alpha)
    for j in neighbours[i]:
        if i in neighbours[j]:
            continue
        neighbours[j].append(i)
        if len(neighbours[j]) > degree:
            own = np.array(neighbours[j], dtype=np.int64)
            neighbours[j] = robust_prune(j, own, gemm_matrix(vectors[j][None, :], vectors[own], "l2")[0], vectors, degree, alpha)


def build(vectors: np.ndarray, degree: int = DEGREE, effort: int = EFFORT, alpha: float = ALPHA, seed: int = 1234, rounds: int = 2) -> tuple[list[list[int]], int]:
    """(neighbours of each row, entry): every row is searched for, pruned and linked both ways, in random order; twice."""
    n = len(vectors)
    if n == 0:
        return [], -1
    entry = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    rng = np.random.default_rng(seed)
    neighbours: list[list[int]] = [rng.choice(n, min(degree // 2, n - 1), replace=False).tolist() if n > 1 else [] for _ in range(n)]
    for i in range(n):
        neighbours[i] = [j for j in neighbours[i] if j != i]
    for r in range(rounds):
        a = 1.0 if r < rounds - 1 else alpha
        for i in rng.permutation(n).tolist():
            _link(i, vectors, neighbours, entry, degree, effort, a)
    return neighbours, entry


def _prune_rows(points: np.ndarray, pool: np.ndarray, vectors: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """robust_prune() of many points at once: pool has each point's candidates, -1 for none; so has the result."""
    out = np.full((len(points), degree), -1, dtype=np.int64)
    step = max(1, CELLS // (pool.shape[1] * max(pool.shape[1], vectors.shape[1])))
    for at in range(0, len(points), step):
        own, c = points[at : at + step], np.sort(pool[at : at + step], axis=1)
        bad = (c < 0) | (c == own[:, None])
        bad[:, 1:] |= c[:, 1:] == c[:, :-1]
        x = vectors[np.where(bad, 0, c)]
        d = np.where(bad, np.inf, np.square(x - vectors[own][:, None, :]).sum(axis=2))
        order = np.argsort(d, axis=1, kind="stable")
        c, d, x = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(x, order[:, :, None], 1)
        norms = (x * x).sum(axis=2)
        between = np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * (x @ x.transpose(0, 2, 1)), 0)
        taken, n, cut = np.zeros(d.shape, dtype=bool), np.zeros(len(own), dtype=np.int64), 1.0
        while True:
            shadow = taken | np.isinf(d)
            for k in range(d.shape[1]):
                shadow |= taken[:, k, None] & (cut * between[:, k] <= d)
            for k in range(d.shape[1]):
                pick = np.nonzero(~shadow[:, k] & (n < degree))[0]
                out[at + pick, n[pick]] = c[pick, k]
                n[pick] += 1
                taken[pick, k] = True
                shadow[pick] |= cut * between[pick, k] <= d[pick]
            if cut >= alpha or (n >= degree).all():
                break
            cut = min(alpha, cut * 1.2)
    return out


def build_exact(vectors: np.ndarray, degree: int = DEGREE, effort: int = EFFORT, alpha: float = ALPHA, seed: int = 1234) -> tuple[list[list[int]], int]:
    """build() for shards of bounded size: the `effort` nearest of all rows and as many random ones as degree are pruned, and linked both ways."""
    n = len(vectors)
    entry = int(np.argmin(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    rng, norms, near = np.random.default_rng(seed), (vectors * vectors).sum(axis=1), min(max(effort, 2 * degree), n - 1)
    pool = np.empty((n, near + 1 + degree), dtype=np.int64)
    step = max(1, CELLS // n)
    for at in range(0, n, step):
        d = norms[None, :] - 2 * (vectors[at : at + step] @ vectors.T)
        pool[at : at + step, : near + 1] = np.argpartition(d, near, axis=1)[:, : near + 1]
    pool[:, near + 1 :] = rng.integers(n, size=(n, degree))
    first = _prune_rows(np.arange(n), pool, vectors, degree, alpha)
    src, slot = np.nonzero(first >= 0)
    dst = first[src, slot]
    # what points at a row joins its own edges, nearest first where there is more than three times the degree
    d = np.square(vectors[src] - vectors[dst]).sum(axis=1)
    order = np.lexsort((src, d, dst))
    src, dst = src[order], dst[order]
    place = np.arange(len(dst)) - np.searchsorted(dst, dst)
    kept = place < 3 * degree
    pool = np.full((n, 4 * degree), -1, dtype=np.int64)
    pool[:, :degree] = first
    pool[dst[kept], degree + place[kept]] = src[kept]
    last = _prune_rows(np.arange(n), pool, vectors, degree, alpha)
    return [x[x >= 0].tolist() for x in last], entry


def walks(queries: np.ndarray, vectors: np.ndarray, neighbours: list[list[int]], entry: int, effort: int, metric: str = "l2") -> tuple[np.ndarray, np.ndarray]:
    """beam() of many queries in step: (rows, distances) of the `effort` nearest found, nearest first, -1 where there are no more."""
    n, width = len(vectors), max(1, max((len(x) for x in neighbours), default=1))
    effort = min(effort, n)
    edges = np.full((n, width), n, dtype=np.int64)  # n stands for no row
    for i, x in enumerate(neighbours):
        edges[i, : len(x)] = x
    v = np.vstack([vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)
    norms, out, far = (v * v).sum(axis=1), [], []

    def measured(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        dot = np.matmul(v[rows], q[:, :, None])[:, :, 0]
        if metric == "l2":
            d = np.maximum((q * q).sum(axis=1)[:, None] + norms[rows] - 2 * dot, 0)
        elif metric == "ip":
            d = -dot
        else:
            scale = np.sqrt((q * q).sum(axis=1)[:, None] * norms[rows])
            d = -np.divide(dot, scale, out=np.zeros_like(dot), where=scale != 0)
        return np.where(rows == n, np.inf, d)

    step = max(1, min(512, CELLS // (n + 1)))
    for at in range(0, len(queries), step):
        q = queries[at : at + step].astype(np.float32)
        seen = np.zeros((len(q), n + 1), dtype=bool)
        best = np.full((len(q), effort), n, dtype=np.int64)
        best[:, 0], seen[:, entry] = entry, True
        d = measured(q, best)
        done = best == n
        active = np.arange(len(q))
        while len(active):
            turn = np.argsort(done[active], axis=1, kind="stable")[:, :STRIDE]  # the nearest that aren't expanded
            new = np.take_along_axis(best[active], turn, 1)
            new[np.take_along_axis(done[active], turn, 1)] = n
            done[active[:, None], turn] = True
            new = np.vstack([edges, np.full((1, width), n)])[new].reshape(len(active), -1)
            new[seen[active[:, None], new]] = n
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            seen[active[:, None], new] = True
            rows, dist = np.hstack([best[active], new]), np.hstack([d[active], measured(q[active], new)])
            flags = np.hstack([done[active], new == n])
            order = np.argsort(dist, axis=1, kind="stable")[:, :effort]
            best[active], d[active], done[active] = (np.take_along_axis(x, order, 1) for x in (rows, dist, flags))
            active = active[~done[active].all(axis=1)]
        out.append(np.where(best == n, -1, best))
        far.append(d)
    return (np.vstack(out), np.vstack(far)) if out else (np.zeros((0, effort), dtype=np.int64), np.zeros((0, effort)))


def build_shards(sharded: DataFrame, degree: int = DEGREE, effort: int = EFFORT, alpha: float = ALPHA, seed: int = 1234, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(shard, src, dst, slot, entry): a graph for each shard of (id, vector, shard); shards must fit in a worker."""
    kind = sharded.schema[id_col].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(id_col)
        ids, shard = table.column(id_col), table.column("shard")[0]
        vectors = batch_vectors(table.column(vector_col).combine_chunks()).astype(np.float32)
        how = build_exact if 1 < len(vectors) <= EXACT_ROWS else build
        neighbours, entry = how(vectors, degree, effort, alpha, seed)
        return _edge_table(ids, neighbours, entry, shard)

    shard_kind = sharded.schema["shard"].dataType.simpleString()
    return sharded.select("shard", id_col, vector_col).groupBy("shard").applyInArrow(run, f"shard {shard_kind}, src {kind}, dst {kind}, slot int, entry {kind}")


def _with_lists(rows: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """rows with near, the neighbours of each in order of their slots, and entry."""
    lists = edges.groupBy("shard", "src").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "dst"))), lambda x: x["dst"]).alias("near"), F.first("entry").alias("entry"))  # degree edges a row
    return rows.join(lists.withColumnRenamed("shard", "__s"), (F.col("shard") == F.col("__s")) & (F.col(id_col) == F.col("src")), "left").drop("__s", "src")


def _graph_of(table: pa.Table, id_col: str, vector_col: str) -> tuple[np.ndarray, list[list[int]], int]:
    """(vectors, neighbours by number, entry) of a shard's rows, sorted by id."""
    at = {x: k for k, x in enumerate(table.column(id_col).to_pylist())}
    vectors = batch_vectors(table.column(vector_col).combine_chunks()).astype(np.float32)
    neighbours = [[at[j] for j in x or [] if j in at] for x in table.column("near").to_pylist()]
    return vectors, neighbours, next((at[x] for x in table.column("entry").to_pylist() if x is not None and x in at), 0)


def _edge_table(ids: pa.ChunkedArray, neighbours: list[list[int]], entry: int, shard: pa.Scalar) -> pa.Table:
    src = np.repeat(np.arange(len(neighbours)), [len(x) for x in neighbours])
    dst = np.array([j for x in neighbours for j in x], dtype=np.int64)
    slot = np.array([k for x in neighbours for k in range(len(x))], dtype=np.int32)
    return pa.table({"shard": pa.array([shard.as_py()] * len(src), shard.type), "src": ids.take(pa.array(src)), "dst": ids.take(pa.array(dst)), "slot": pa.array(slot), "entry": ids.take(pa.array(np.full(len(src), max(entry, 0))))})


def insert_shards(sharded: DataFrame, edges: DataFrame, added: DataFrame, degree: int = DEGREE, effort: int = EFFORT, alpha: float = ALPHA, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """edges with the rows of added (id, vector, shard) linked into their shards' graphs, in order of id.

    sharded and edges may lack rows that were deleted: what pointed at these is left out, consolidate() mends it before.
    """
    kind, shard_kind = (sharded.schema[c].dataType.simpleString() for c in (id_col, "shard"))
    columns = ["shard", id_col, vector_col]
    rows = sharded.select(*columns, F.lit(False).alias("new")).unionByName(added.select(*columns, F.lit(True).alias("new")))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(id_col)
        vectors, neighbours, entry = _graph_of(table, id_col, vector_col)
        for i in np.nonzero(table.column("new").to_numpy())[0].tolist():
            _link(i, vectors, neighbours, entry, degree, effort, alpha)
        return _edge_table(table.column(id_col), neighbours, entry, table.column("shard")[0])

    return _with_lists(rows, edges, id_col).groupBy("shard").applyInArrow(run, f"shard {shard_kind}, src {kind}, dst {kind}, slot int, entry {kind}")


def dispatch(vectors: DataFrame, dim: int, budget_bytes: int, degree: int = DEGREE, effort: int = EFFORT, alpha: float = ALPHA, seed: int = 1234, id_col: str = "id", vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(sharded, edges): one graph if its build fits the budget, else overlapping shards around k-means centres, each of which does."""
    n = shards_for(vectors.count() * 2, dim, budget_bytes, degree)  # each row is in two shards
    if n <= 2:
        sharded = vectors.select(id_col, vector_col, F.lit(0).alias("shard"))
    else:
        sharded = shard_assignment(vectors, kmeans(vectors, n, 5, id_col=id_col, vector_col=vector_col), 2, id_col, vector_col)
    sharded = cut(sharded)
    return sharded, build_shards(sharded, degree, effort, alpha, seed, id_col, vector_col)


def bounded(vectors: DataFrame, rows: int = SHARD_ROWS, overlap: int = 2, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, vector, shard): each row in its `overlap` nearest of as many shards as keep these at about `rows`.

    A shard of more than twice that, around which rows are dense, is dealt by a hash of the id, so that none is longer.
    """
    k = max(2, -(-overlap * vectors.count() // rows))
    sharded = cut(shard_assignment(vectors, kmeans(vectors, k, 5, id_col=id_col, vector_col=vector_col), overlap, id_col, vector_col))
    parts = sharded.groupBy("shard").agg(F.ceil(F.count("*") / (2 * rows)).alias("__parts"))  # a row a shard
    dealt = F.col("shard") + k * F.pmod(F.xxhash64(id_col), F.col("__parts"))
    return sharded.join(F.broadcast(parts), "shard").withColumn("shard", dealt).drop("__parts")


def save(edges: DataFrame, path: str, degree: int = DEGREE) -> None:
    """Write the edges of graphs by shard as a snapshot: edges/ and a one-row meta/ that load() holds them against."""
    edges.write.parquet(f"{path}/edges")
    _facts(edges.sparkSession.read.parquet(f"{path}/edges")).withColumn("degree", F.lit(degree)).coalesce(1).write.parquet(f"{path}/meta")


def _facts(edges: DataFrame) -> DataFrame:
    shards = F.countDistinct("shard").alias("shards")
    return edges.agg(F.count("*").alias("edges"), shards, F.coalesce(F.sum(F.xxhash64("shard", "src", "dst", "slot").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """The edges that save() wrote, if they are whole and form graphs: no loops or repeats, degrees as stated, one entry a shard."""
    edges, meta = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/meta").first()
    if _facts(edges).first().asDict() != {k: v for k, v in meta.asDict().items() if k != "degree"}:
        raise InvalidArgument(f"the graph under {path} is not what was written", "open")
    rows = edges.groupBy("shard", "src").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("distinct"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    bad = rows.where((F.col("n") > meta["degree"]) | (F.col("n") != F.col("distinct")) | (F.col("loops") > 0)).limit(1).count()
    if bad or edges.groupBy("shard").agg(F.countDistinct("entry").alias("n")).where("n <> 1").limit(1).count():
        raise InvalidArgument(f"the edges under {path} are no graph of degree {meta['degree']}", "open")
    return edges


def merge_shards(edges: DataFrame, degree: int = DEGREE, seed: int = 42) -> DataFrame:
    """(src, dst, slot): the shards' edges as one graph: no loops, no repeats, a seeded random `degree` of each row's."""
    rows = edges.where("src <> dst").select("src", "dst").distinct()
    order = Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "dst")
    return rows.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < degree)


def indegrees(edges: DataFrame) -> DataFrame:
    """(indegree, rows): how many rows have so many edges pointing at them."""
    return edges.groupBy("dst").agg(F.count("*").alias("indegree")).groupBy("indegree").agg(F.count("*").alias("rows"))


def purge(edges: DataFrame, dead: DataFrame) -> DataFrame:
    """edges without those from or to dead rows (id); slots are numbered anew."""
    gone = dead.select(F.col("id").alias("__dead")).distinct()
    kept = edges.join(gone, F.col("src") == F.col("__dead"), "left_anti").join(gone, F.col("dst") == F.col("__dead"), "left_anti")
    return kept.withColumn("slot", F.row_number().over(Window.partitionBy("src").orderBy("slot", "dst")) - 1)


def consolidate(edges: DataFrame, dead: DataFrame, degree: int = DEGREE) -> DataFrame:
    """edges without dead rows; whoever pointed at one points at its living neighbours instead, up to degree."""
    gone = dead.select(F.col("id").alias("__dead")).distinct()
    own = purge(edges, dead).select("src", "dst", "slot")
    through = edges.join(gone, F.col("dst") == F.col("__dead"), "left_semi").select(F.col("src"), F.col("dst").alias("__via"))
    onward = edges.select(F.col("src").alias("__via"), "dst", (F.col("slot") + degree).alias("slot"))
    bridged = purge(through.join(onward, "__via").select("src", "dst", "slot"), dead).where("src <> dst").withColumn("slot", F.col("slot") + degree)
    both = own.unionByName(bridged).groupBy("src", "dst").agg(F.min("slot").alias("slot"))
    order = Window.partitionBy("src").orderBy("slot", "dst")
    return both.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < degree)


def relayout(edges: DataFrame, visits: DataFrame) -> DataFrame:
    """edges with each row's slots by falling visits (dst, n), the unvisited last in their old order."""
    counted = edges.join(visits.select("dst", F.col("n").alias("__n")), "dst", "left")
    order = Window.partitionBy("src").orderBy(F.desc_nulls_last("__n"), "slot")
    return counted.withColumn("slot", F.row_number().over(order) - 1).select("src", "dst", "slot")


def search_shards(sharded: DataFrame, edges: DataFrame, queries: DataFrame, limit: int, effort: int = EFFORT, metric: str = "l2", admitted: DataFrame | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, id, distance): best-first search in every shard's graph, merged; admitted (id) may restrict the answers.

    Rows that aren't admitted are walked through but not returned, and a shard is searched with wider beams until it
    has found `limit` admitted rows or all it can reach.
    """
    kind, query_kind = (sharded.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString())
    rows = sharded.select("shard", id_col, vector_col)
    if admitted is None:
        rows = rows.withColumn("ok", F.lit(True))
    else:
        ok = admitted.select(F.col(id_col).alias("__id"), F.lit(True).alias("ok")).distinct()
        rows = rows.join(ok, F.col(id_col) == F.col("__id"), "left").drop("__id").withColumn("ok", F.coalesce("ok", F.lit(False)))
    rows, hits = _with_lists(rows, edges, id_col), None
    for ids, q in slices(queries):
        found = _searched(rows, pa.array(ids, to_arrow_type(queries.schema["query_id"].dataType)), q, limit, effort, metric, id_col, vector_col, f"query_id {query_kind}, {id_col} {kind}, distance float")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = rows.join(queries.limit(0).select("query_id")).select("query_id", id_col, F.lit(0.0).cast("float").alias("distance"))
    best = hits.groupBy("query_id", id_col).agg(F.min("distance").alias("distance"))
    return ranked(best, limit, id_col)


def _searched(rows: DataFrame, query_ids: pa.Array, q: np.ndarray, limit: int, effort: int, metric: str, id_col: str, vector_col: str, schema: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(id_col)
        ok = np.array(table.column("ok").to_pylist())
        vectors, neighbours, entry = _graph_of(table, id_col, vector_col)
        out, left, width = [], np.arange(len(q)), max(effort, limit)
        while len(left) and len(vectors):
            near, _ = walks(q[left], vectors, neighbours, entry, width, metric)
            kept = (near >= 0) & ok[near]
            short = (kept.sum(axis=1) < limit) & (near.shape[1] == width) & (near[:, -1] >= 0)
            of, place = np.nonzero(kept & (np.cumsum(kept, axis=1) <= limit) & ~short[:, None])
            out.append((left[of], near[of, place]))
            left, width = left[short], 2 * width
        k, i = (np.concatenate([x[j] for x in out]) if out else np.zeros(0, dtype=np.int64) for j in (0, 1))
        return pa.table({"query_id": query_ids.take(pa.array(k)), id_col: table.column(id_col).take(pa.array(i)), "distance": pa.array(distance_pairs(q[k], vectors[i], metric), pa.float32())})

    return rows.groupBy("shard").applyInArrow(run, schema)
