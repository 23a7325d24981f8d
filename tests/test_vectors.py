from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantor.functions.distance import distance, distance_matrix, gemm_matrix, hadamard, nearest_pairs
from vantor.operators import cluster, graph, quantize, search


def frame(spark, v, name="vector"):
    return spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], f"id long, {name} array<float>")


def asked(spark, q):
    return spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(q)], "query_id int, query array<float>")


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.distance))
    return out


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(42)
    return rng.standard_normal((400, 64)).astype(np.float32)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_column_and_numpy_agree(spark, sample, metric):
    v = sample[:40].copy()
    v[3] = 0
    a, b = by_query(search.search(frame(spark, v), asked(spark, v[:6]), 7, metric)), by_query(search.search(frame(spark, v), asked(spark, v[:6]), 7, metric, strategy="columns"))
    assert a == b
    d = distance_matrix(v[:6], v, metric)
    assert [i for i, _ in a[0]] == np.lexsort((np.arange(40), d[0]))[:7].tolist()
    assert np.allclose(d, gemm_matrix(v[:6], v, metric), atol=1e-3)


def test_zero_nan_ties(spark):
    rows = spark.createDataFrame([("10", [1.0, 0.0]), ("9", [1.0, 0.0]), ("n", [float("nan"), 0.0]), ("z", [0.0, 0.0])], "id string, vector array<float>")
    q = asked(spark, [[1, 0]])
    assert by_query(search.search(rows, q, 10, "l2"))[0] == [("10", 0.0), ("9", 0.0), ("z", 1.0)]
    assert by_query(search.search(rows, q, 10, "cosine"))[0] == [("10", -1.0), ("9", -1.0), ("z", 0.0)]
    assert by_query(search.search(rows, q, 1, "l2", F.lit(False))) == {}
    assert search.search(rows, q.where("false"), 3).count() == 0
    assert rows.where("id = 'z'").select(distance("vector", "vector", "cosine")).first()[0] == 0.0
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            search.search(rows, q, bad)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_join_is_the_column_form(spark, sample, metric, monkeypatch):
    """Several groups on both sides, copies, nulls, other lengths, NaN and infinity: as the cross join of Columns has it, but for vectors with nulls or of another length."""
    v = np.round(sample[:90, :6], 1).astype(float)
    v[4], v[5, 2], v[6, 1], v[70:80] = 0, np.nan, np.inf, v[:10]
    odd = [(200, None), (201, [1.0] * 5), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [])]
    rows = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)] + odd, "id long, vector array<float>").coalesce(1)
    q = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v[::3])] + odd, "query_id int, query array<float>")
    want = search.ranked(rows.crossJoin(q).where("size(query) = size(vector) AND NOT exists(query, x -> x IS NULL) AND NOT exists(vector, x -> x IS NULL)").select("query_id", "id", distance("query", "vector", metric).alias("distance")).where("distance IS NOT NULL"), 7)
    monkeypatch.setattr(search, "GROUP_ROWS", 17)
    found = search.search(rows, q, 7, metric, strategy="columns")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.columns == want.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_codes_are_joined_in_groups(spark, sample, monkeypatch):
    base, q = frame(spark, sample[:120]), asked(spark, sample[:120:9])
    arrays = quantize.range_arrays(quantize.fit_ranges(base))
    both = lambda t, v: t.crossJoin(arrays).withColumn(v, quantize.decoded(quantize.codes(F.col(v), F.col("low"), F.col("high")), F.col("low"), F.col("high"))).drop("low", "high")
    want = search.ranked(both(base, "vector").crossJoin(both(q, "query")).select("query_id", "id", distance("query", "vector", "l2").alias("distance")), 5)
    monkeypatch.setattr(search, "GROUP_ROWS", 50)
    found = quantize.sq_search(base, q, 5)
    assert by_query(found) == by_query(want)
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_not_a_number_beside_others():
    """A row that is not a number, or infinite, hides no other row of its batch."""
    v = np.array([[np.nan, 0], [1, 0], [np.inf, 0], [0, 2], [3, 0]], dtype=np.float32)
    for metric, want in (("l2", [1, 4]), ("ip", [2, 4])):
        rows, places, d = nearest_pairs(np.array([[1.0, 0.0]], dtype=np.float32), v, 2, metric)
        assert places.tolist() == want and not np.isnan(d).any()


def test_hadamard():
    x = np.random.default_rng(0).standard_normal((3, 128))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(hadamard(hadamard(x)), x)
    with pytest.raises(ValueError):
        hadamard(np.zeros(6))


def test_scalar_codes(spark):
    v = np.array([[0.0, 5.0, 1.0], [1.0, 5.0, 3.0], [0.5, 5.0, 2.0]])
    base = frame(spark, v)
    rows = {r.id: list(r.code) for r in quantize.sq_encode(base, quantize.fit_ranges(base)).collect()}
    assert rows == {0: [0, 0, 0], 1: [255, 0, 255], 2: [127, 0, 127]}
    packed = {r.id: r.p for r in quantize.sq_encode(base, quantize.fit_ranges(base), 15).select("id", quantize.packed4(F.col("code")).alias("p")).collect()}
    assert packed == {0: "0000", 1: "f0f0", 2: "7070"}


def test_rotations(sample):
    for r in (quantize.matrix_rotation(64), quantize.kac_rotation(np.eye(96)), quantize.kac_rotation(np.eye(64))):
        assert np.allclose(r @ r.T, np.eye(len(r)), atol=1e-9)


def test_lookup_tables(sample):
    q = sample[0].astype(float)
    bits = np.packbits(sample[:50] > 0, axis=1)
    signs = np.where(sample[:50] > 0, 1.0, -1.0)
    table = quantize.top_codes(q)
    assert np.allclose(quantize.table_dot(bits, table), signs @ q)
    codes, low, step = quantize.quantized_table(table)
    assert np.abs(low + step * codes - table).max() <= step / 2 + 1e-9


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("unit", [True, False])
def test_two_stage_recall(spark, sample, metric, unit):
    v = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    v = v if unit else v * (0.25 + 17 * np.arange(400)[:, None] % 29 / 29)
    base, q = frame(spark, v), asked(spark, v[::20])
    model = quantize.OneBit.fit(base, 64)
    coded = quantize.onebit_encode(base, model)
    hits = quantize.two_stage_search(base, coded, model, q, 10, metric, 10)
    truth = search.search(base, q, 10, metric)
    assert search.recall(hits, truth, 10).first().recall >= 0.85


def test_graph_recall_and_filters(spark, sample):
    base, q = frame(spark, sample), asked(spark, sample[::20])
    centroids = cluster.kmeans(base, 3, 5)
    sharded = cluster.shard_assignment(base, centroids, 2).cache()
    edges = graph.build_shards(sharded, 16, 48).cache()
    assert edges.groupBy("shard", "src").count().agg(F.max("count")).first()[0] <= 16
    hits = graph.search_shards(sharded, edges, q, 10, 64)
    truth = search.search(base, q, 10)
    assert search.recall(hits, truth, 10).first().recall >= 0.9
    some = base.where("id % 4 = 0")
    found = graph.search_shards(sharded, edges, q, 10, 64, admitted=some)
    assert found.where("id % 4 <> 0").count() == 0 and search.recall(found, search.search(some, q, 10), 10).first().recall >= 0.85


def test_walks_and_prunes_of_many(sample):
    """Many at once as one by one: pruned alike, walked to the same rows; clusters, copies and unreachable rows among them."""
    v = np.vstack([sample[:150], sample[:10], sample[:60] * 0.01 + 3])
    pool = np.stack([np.random.default_rng(k).integers(-1, 150, 30) for k in range(20)])
    got = graph._prune_rows(np.arange(20), pool, v, 6, 1.2)
    for k in range(20):
        c = pool[k][pool[k] >= 0]
        d = gemm_matrix(v[k][None, :], v[c], "l2")[0]
        assert [x for x in got[k] if x >= 0] == graph.robust_prune(k, c, d, v, 6, 1.2)
    neighbours, entry = graph.build_exact(v, 8, 32)
    assert max(map(len, neighbours)) <= 8 and all(i not in x and len(set(x)) == len(x) for i, x in enumerate(neighbours))
    for metric in ("l2", "ip", "cosine"):
        rows, d = graph.walks(v[::7], v, neighbours, entry, 32, metric)
        truth = gemm_matrix(v[::7], v, metric)
        assert np.allclose(np.take_along_axis(truth, rows, 1), d, atol=1e-3) and (np.diff(d, axis=1) >= 0).all()
        want = np.sort(truth, axis=1)[:, :5]
        assert metric != "l2" or (d[:, :5] <= want + 1e-3).mean() >= 0.9
    alone = [[1], [0], [0]]
    assert graph.walks(v[:1], v[:3], alone, 0, 3)[0].tolist() == [[0, 1, -1]]


def test_shards_are_bounded(spark, sample):
    """More rows make more shards, not longer ones, and a dense spot is dealt too; the search of all of them finds what is near."""
    v = np.vstack([sample, np.tile(sample[:1], (300, 1)) + 0.001 * sample[:300]])
    base, q = frame(spark, v), asked(spark, v[::25])
    sharded = graph.bounded(base, 60).cache()
    sizes = [r["count"] for r in sharded.groupBy("shard").count().collect()]
    assert sum(sizes) == 1400 and len(sizes) >= 1400 // 120 and max(sizes) <= 180
    assert sharded.groupBy("id").agg(F.countDistinct("shard").alias("n")).where("n <> 2").count() == 0
    hits = graph.search_shards(sharded, graph.build_shards(sharded, 16, 32), q, 10, 64)
    assert search.recall(hits, search.search(base, q, 10), 10).first().recall >= 0.9


def test_prune_keeps_diverse():
    v = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [5, 5]], dtype=np.float32)
    d = ((v[1:] - v[0]) ** 2).sum(axis=1)
    assert graph.robust_prune(0, np.array([1, 2, 3, 4]), d, v, 3, 1.0) == [1, 3]
    assert graph.robust_prune(0, np.array([0, 1, 1]), np.array([0, 1, 1.0]), v, 3) == [1]


def test_edge_tables(spark):
    edges = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 3, 0), (3, 1, 0), (3, 2, 1)], "src long, dst long, slot int")
    dead = spark.createDataFrame([(2,)], "id long")
    assert sorted(map(tuple, graph.purge(edges, dead).select("src", "dst", "slot").collect())) == [(1, 3, 0), (3, 1, 0)]
    assert sorted(map(tuple, graph.consolidate(edges, dead, 2).select("src", "dst").collect())) == [(1, 3), (3, 1)]
    visits = spark.createDataFrame([(3, 9)], "dst long, n long")
    assert sorted(map(tuple, graph.relayout(edges, visits).collect())) == [(1, 2, 1), (1, 3, 0), (2, 3, 0), (3, 1, 0), (3, 2, 1)]
    merged = graph.merge_shards(edges.unionByName(edges).unionByName(edges.selectExpr("src", "src AS dst", "slot")), 1)
    assert merged.groupBy("src").count().agg(F.max("count")).first()[0] == 1 and merged.where("src = dst").count() == 0


def test_kmeans_and_assignment(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    v = np.vstack([c + rng.standard_normal((50, 2)) * 0.1 for c in centres])
    found = cluster.kmeans(frame(spark, v), 3, 10)
    got = sorted(tuple(round(x) for x in r.centroid) for r in found.collect())
    assert got == sorted(map(tuple, centres.tolist())) and sorted(r["size"] for r in found.collect()) == [50, 50, 50]
    near = cluster.nearest_centroids(frame(spark, v), found, 2)
    other = cluster.nearest_centroids_columns(frame(spark, v), found, 2)
    assert sorted(map(tuple, near.collect())) == sorted((r.id, r.rank, r.cluster, r.distance) for r in other.collect()) and near.count() == 300
    step = cluster.lloyd_step(frame(spark, v), spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [0.0, 10.0]), (3, [99.0, 99.0])], "cluster long, centroid array<float>"))
    assert {r.cluster: list(r.centroid) for r in step.collect()}[3] == [0, 0]
    assert cluster.medoids(frame(spark, v), found).count() == 3
    assert cluster.shards_for(1000, 100, 10**9) == 1 and cluster.shards_for(10**7, 100, 10**9) > 1


def test_pca(spark, sample):
    v = sample[:, :6] * np.array([5, 3, 1, 1, 1, 0.1]) + 7
    p = cluster.Pca.fit(frame(spark, v), 6)
    want = np.linalg.eigvalsh(np.cov(v.T, bias=True))[::-1]
    assert np.allclose(p.variance, want, rtol=1e-3) and (p.components.sum(axis=1) >= -1e-9).all()
    assert np.allclose(p.inverse(p.transform(v)), v, atol=1e-3)
    out = np.array([r.vector for r in p.apply(frame(spark, v)).orderBy("id").collect()])
    assert np.allclose(out, p.transform(v), atol=1e-3)


def test_held_out_clusters(spark):
    sizes = spark.createDataFrame([(0, 50), (1, 30), (2, 20), (3, 5)], "cluster long, size long")
    assert cluster.greedy_held_out(sizes, 22, 27) == [2, 3]
    rows = spark.createDataFrame([(k, k % 3, float(k)) for k in range(9)], "id long, cluster long, distance double")
    order = [(r.position, r.id, r.is_held) for r in cluster.drift_order(rows, [1]).orderBy("position").collect()]
    assert [i for _, i, h in order if not h] == [0, 2, 3, 5, 6, 8] and [p for p, _, _ in order] == list(range(9)) and {i for _, i, h in order if h} == {1, 4, 7}


def test_large_graph_filter_recall(spark):
    """20,000 unit vectors, a tenth of them wanted: the exact search misses none."""
    rng = np.random.default_rng(42)
    v = rng.standard_normal((20_000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame(list(zip(range(20_000), v.tolist(), ["target" if k < 2000 else "other" for k in range(20_000)])), "id long, vector array<float>, label string")
    hits = search.search(rows, asked(spark, v[:1]), 100, "cosine", F.col("label") == "target").collect()
    want = np.argsort(-(v[:2000].astype(float) @ v[0].astype(float)), kind="stable")[:100]
    assert {r.id for r in hits} == set(want.tolist())


def test_overfetch(spark, sample):
    base, q = frame(spark, sample), asked(spark, sample[:3])
    some, asked_for = base.where("id % 7 = 0"), []

    def found(n):
        asked_for.append(n)
        return search.search(base, q, n)

    got = by_query(search.overfetch(found, some, 5, rounds=8))
    assert got == by_query(search.search(some, q, 5)) and asked_for == [5 << k for k in range(len(asked_for))] and len(asked_for) > 2
    assert search.overfetch(found, base.where("false"), 5, rounds=0).count() == 0


def test_graphs_grow_by_insertion(spark, sample):
    base = frame(spark, sample).withColumn("shard", F.lit(0))
    old, new = base.where("id % 4 <> 0"), base.where("id % 4 = 0")
    edges = graph.build_shards(old, 16, 48).cache()
    more = graph.insert_shards(old, edges, new, 16, 48).cache()
    assert more.select("src").distinct().count() == base.count() and more.groupBy("src").count().agg(F.max("count")).first()[0] <= 16
    q = asked(spark, sample[::20])
    assert search.recall(graph.search_shards(base, more, q, 10, 64), search.search(base, q, 10), 10).first().recall >= 0.9


def test_dispatch_by_budget(spark, sample):
    base = frame(spark, sample)
    one, _ = graph.dispatch(base, sample.shape[1], 1 << 30, 8, 16)
    many, edges = graph.dispatch(base, sample.shape[1], 60_000, 8, 16)
    assert one.select("shard").distinct().count() == 1 and many.select("shard").distinct().count() > 2
    assert edges.select("src").distinct().count() == base.count()


def test_snapshots_of_graphs(spark, sample, tmp_path):
    edges = graph.build_shards(frame(spark, sample[:60]).withColumn("shard", F.lit(0)), 8, 16)
    path = str(tmp_path / "graph")
    graph.save(edges, path, 8)
    assert graph.load(spark, path).count() == edges.count()
    spark.read.parquet(f"{path}/edges").limit(3).write.mode("append").parquet(f"{path}/edges")
    with pytest.raises(ValueError):
        graph.load(spark, path)


def test_whole_number_helpers(spark):
    from vantor.functions import maths

    rows = spark.range(1, 5000).select("id", maths.floor_log2(F.col("id")).alias("f"), maths.ceil_log2(F.col("id")).alias("c"), maths.ceil_div(F.col("id"), F.lit(7)).alias("d"), maths.round_up(F.col("id"), F.lit(64)).alias("r"), maths.is_power_of_two(F.col("id")).alias("p")).collect()
    for r in rows:
        assert (r.f, r.c, r.d, r.r, r.p) == (r.id.bit_length() - 1, (r.id - 1).bit_length(), -(-r.id // 7), -(-r.id // 64) * 64, r.id.bit_count() == 1)
