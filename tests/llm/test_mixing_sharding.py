from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from vantor.llm.mixing import MAX_EPOCHS, Mix, mixed_documents, taken_words
from vantor.llm.queries import QUERIES
from vantor.llm.sharding import communication_matrix, hypergeometric, shard_table, sharded_documents


def test_shards_are_a_uniform_deal(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op3_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = defaultdict(list)
    for r in got:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, QUERIES["op3_sharding"](spark, SF).collect()), key=str)


def test_matrix():
    rng = np.random.default_rng(1)
    m = communication_matrix([10, 0, 7, 23], [20, 20], rng)
    assert m.sum(axis=1).tolist() == [10, 0, 7, 23] and m.sum(axis=0).tolist() == [20, 20]
    draws = Counter(int(communication_matrix([2, 2], [2, 2], rng)[0, 0]) for _ in range(3000))
    assert abs(draws[1] / 3000 - 4 / 6) < 0.05 and abs(draws[0] / 3000 - 1 / 6) < 0.04


def test_large_hypergeometric():
    rng = np.random.default_rng(2)
    x = [hypergeometric(rng, 2_000_000_000, 3_000_000_000, 1_000_000_000) for _ in range(20)]
    sd = (1e9 * 0.4 * 0.6 * 4e9 / 5e9) ** 0.5
    assert all(abs(v - 4e8) < 6 * sd for v in x) and len(set(x)) > 1


def test_shuffle_mixes_positions(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    got = shard_table(rows).collect()
    order = np.array([r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))])
    assert abs(np.corrcoef(order, np.arange(4000))[0, 1]) < 0.08
    share = Counter(r.shard for r in got if r.doc_id < 1000)
    assert all(8 <= share[s] <= 44 for s in range(40))


def test_sharding_edges(spark, edge_docs, empty_docs):
    got = shard_table(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(r.slot == 0 for r in got)
    assert next(r for r in got if r.doc_id == 1).size == 16 and next(r for r in got if r.doc_id == 1).text_crc32 == 0
    assert shard_table(empty_docs).count() == 0
    out = sharded_documents(edge_docs)
    assert set(out.columns) == {*edge_docs.columns, "slot"} and out.count() == edge_docs.count()


def targets(sizes):
    """Water filling by repeated clipping."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > MAX_EPOCHS * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: MAX_EPOCHS * sizes[s] for s in over}


def test_mix_hits_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = QUERIES["op5_mixing"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs)
    import re

    size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in docs}
    by_source = defaultdict(int)
    for r in docs:
        by_source[r.source] += size[r.doc_id]
    want, source = targets(by_source), {r.doc_id: r.source for r in docs}
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by_source[source[r.doc_id]] and r.taken <= 3 * r.size
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        taken[source[r.doc_id]] += r.taken
    total = sum(by_source.values())
    assert all(abs(taken[s] - want[s]) <= 0.002 * total + 1 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op5_mixing"](spark, SF).collect()))


def test_pieces_tile_the_mix(spark, docs):
    mix = Mix(docs.select("doc_id", "source", "text"))
    rows = mix.pieces(mix.placed()).collect()
    words = defaultdict(int)
    for r in rows:
        assert r.n_words > 0
        words[r.slot] += r.n_words
    assert sum(v == mix.block for v in words.values()) >= 0.97 * len(words)
    order = [r.source for r in sorted(rows, key=lambda r: (r.slot, r["__at"], r.epoch))]
    half = Counter(order[: len(order) // 2])
    assert all(abs(half[s] / (len(order) // 2) - n / len(order)) < 0.1 for s, n in Counter(order).items())


def test_mixing_edges(edge_docs, empty_docs):
    got = taken_words(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert all(r.taken == 0 for r in got if r.size == 0) and sum(r.taken for r in got) > 0
    assert taken_words(empty_docs).count() == 0
    out = mixed_documents(edge_docs)
    assert out.columns == edge_docs.columns and mixed_documents(empty_docs).count() == 0


@pytest.mark.parametrize("texts", [["a b c"] * 7, ["", None]])
def test_one_source(spark, texts):
    rows = spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")
    got = taken_words(rows).collect()
    assert sum(r.taken for r in got) == sum(r.size for r in got)


def test_small_sources_beside_a_large_one(spark, monkeypatch):
    from vantor.llm import mixing

    monkeypatch.setattr(mixing, "SLOTS", 1 << 12)  # blocks of about 100 words, as a larger table has them
    sizes = {"a": [3] * 4, "b": [10_000] * 41, "c": [1], "d": [40, 41], "e": [170] * 3}
    rows = [(f"{s}{k}", s, "w " * n) for s, ns in sizes.items() for k, n in enumerate(ns)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string")
    want, taken = targets({s: sum(ns) for s, ns in sizes.items()}), defaultdict(int)
    for r in taken_words(docs).collect():
        taken[r.doc_id[0]] += r.taken
    assert all(taken[s] == round(want[s]) for s in "acde"), (taken, want)
    copies = Counter(r.doc_id for r in mixed_documents(docs).collect())
    assert all(copies[f"{s}{k}"] == 3 for s in "acde" for k in range(len(sizes[s])))
    mix = Mix(docs)
    words = Counter()
    for r in mix.pieces(mix.placed()).collect():
        words[r.source] += r.n_words
    assert words == taken


def test_rows_without_an_id_or_of_one_id_are_spread(spark):
    """Blocks of the deal and parts of a source, so that no window has them all; every row is dealt and mixed."""
    from vantor.llm.sharding import BLOCKS

    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7L ELSE id END AS doc_id", "concat('text number ', id) AS text", "'s' AS source")
    got = shard_table(rows)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) - min(sizes) <= 1
    block = F.pmod(F.xxhash64("doc_id", F.crc32("text"), F.lit(20_259)), F.lit(BLOCKS))
    assert rows.groupBy(block).count().agg(F.max("count")).first()[0] < 30
    mix = Mix(rows)
    assert mix.sized.groupBy("__part").count().agg(F.max("count")).first()[0] < 30
    taken = taken_words(rows)
    assert taken.count() == 6000 and taken.agg(F.sum("taken")).first()[0] == taken.agg(F.sum("size")).first()[0]
