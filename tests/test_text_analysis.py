from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantor.operators import analysis, text
from vantor.sources.shared import cut


def test_sentences_like_python(spark):
    texts = ["One. Two! Three? Four", "Dr. Smith went. e.g. this. Mr. X。中文。好！", "", "  a.  b  ", "no end", None, "É. À? ñ! x.y.z. W."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.s) for r in rows.select("doc_id", text.sentences(text.F.coalesce("text", text.F.lit(""))).alias("s")).collect()}
    assert got == {k: [s.strip() for s in re.split(text.SENTENCE_END, t or "") if s.strip()] for k, t in enumerate(texts)}


def test_windows(spark):
    rows = spark.createDataFrame([(1, "a. b. c. d. e.")], "doc_id long, text string")
    assert [r.text for r in text.sentence_chunks(rows, 3, 1).orderBy("chunk").collect()] == ["a. b. c.", "c. d. e.", "e."]
    for size, overlap in ((3, 3), (0, 0), (2, -1)):
        with pytest.raises(ValueError):
            text.sentence_chunks(rows, size, overlap)
        with pytest.raises(ValueError):
            text.fixed_chunks(rows, size, overlap)


def test_fixed_chunks():
    body = "\n".join(f"line {k:03d}" for k in range(50))
    chunks = text.pack_lines(body, 40, 10)
    assert all(len(c) <= 40 for c in chunks) and chunks[0].split("\n")[-1] == chunks[1].split("\n")[0]
    seen = [x for c in chunks for x in c.split("\n")]
    assert sorted(set(seen)) == body.split("\n")
    assert text.pack_lines("", 10, 0) == [] and text.pack_lines("x" * 50, 10, 2) == ["x" * 50]


def test_semantic_chunks(spark):
    embed = text.hash_embedder(64)
    rows = spark.createDataFrame([(1, "cat cat dog. dog cat cat. stock bond price. price bond stock."), (2, None)], "doc_id long, text string")
    got = text.semantic_chunks(rows, embed, 0.5, 1).orderBy("chunk").collect()
    assert [r.text for r in got] == ["cat cat dog. dog cat cat.", "stock bond price. price bond stock."]
    with pytest.raises(ValueError):
        text.chunker("none")
    with pytest.raises(ValueError):
        text.embedder("unknown-model")


def test_rag(spark):
    def embed(texts):
        return np.array([[1, 0, 0] if t in ("alpha", "question") else [0, 1, 0] for t in texts], dtype=np.float32)

    rows = spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id long, text string")
    base = text.ingest(rows, text.sentence_chunks, embed)
    asked = spark.createDataFrame([(7, "question")], "query_id long, text string")
    assert text.retrieve(base, asked, embed, 2).first().context == "alpha\n\nbeta"
    assert sorted(r.id for r in base.collect()) == ["1#0", "2#0"]


def test_history(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(10)]
    got = {r.turn: r.query for r in text.history_queries(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got[8] == "Q: t2\nA: t3\nQ: t4\nA: t5\nQ: t6\nA: t7\n\nNew question：t8" and got[0] == "\n\nNew question：t0"


def test_spearman_ties(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (3.0, 9.0), (5.0, 4.0)], "x double, y double")
    rank = lambda v: np.array([(sum(a < b for a in v) + sum(a <= b for a in v) + 1) / 2 for b in v])
    x, y = [1, 1, 2, 3, 5], [2, 3, 3, 9, 4]
    assert abs(analysis.spearman(rows, "x", "y").first().rho - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-12
    assert analysis.spearman(rows.limit(1), "x", "y").first().rho == 0
    assert analysis.spearman(rows.selectExpr("1D AS x", "y"), "x", "y").first().rho == 0


def test_percentiles(spark):
    v = [5.0, 1.0, 1.0, 9.0, 7.0, 3.0]
    rows = spark.createDataFrame([(x,) for x in v], "v double")
    s = sorted(v)
    for q in (0.0, 0.2, 0.5, 0.99, 1.0):
        assert analysis.lower_percentile(rows, "v", q).first().v == s[int(q * (len(s) - 1))]
        assert analysis.nearest_rank(rows, "v", q).first().v == s[max(1, int(np.ceil(q * len(s)))) - 1]


def test_overlap_and_jaccard(spark):
    a = spark.createDataFrame([(1, k, k) for k in range(1, 5)], "query_id int, rank int, id long")
    b = spark.createDataFrame([(1, k, k + 2) for k in range(1, 5)], "query_id int, rank int, id long")
    assert analysis.overlaps(b, a, 4).first().overlap == 0.5
    s = analysis.overlap_summary(analysis.overlaps(a, a, 4)).first()
    assert (s["mean"], s["min"], s["p50"], s["perfect"]) == (1.0, 1.0, 1.0, 1)
    edges = lambda df: df.selectExpr("query_id AS src", "id AS dst")
    assert analysis.edge_jaccard(edges(a), edges(b)).first().jaccard == 2 / 6
    assert analysis.edge_jaccard(edges(a.where("false")), edges(b.where("false"))).first().jaccard == 1.0
    assert analysis.sampled_rows(spark.range(100), 0.1, 20).count() == 20


def test_interpolation_and_pareto(spark):
    curve = spark.createDataFrame([(0.8, 100.0), (0.9, 50.0), (1.0, 10.0)], "recall double, qps double")
    assert {r.target: r.qps for r in analysis.interpolated(curve, [0.85, 0.95, 0.99, 0.5]).collect()} == pytest.approx({0.85: 75.0, 0.95: 30.0, 0.99: 14.0})
    runs = spark.createDataFrame([("a", 10, 0.9, 100.0), ("b", 10, 0.902, 98.0), ("c", 10, 0.8, 50.0)], "combo string, ef int, recall double, qps double")
    got = {(r.a, r.b): (r.alike, r.dominates) for r in analysis.pareto_pairs(runs).collect()}
    assert got == {("a", "b"): (True, None), ("a", "c"): (False, "a"), ("b", "c"): (False, "b")}


def test_sentence_ends_in_another_order(spark):
    """Fast splitting is the same as by the fixed value, with abbreviations, other scripts, and white space of all kinds at the ends."""
    odd = ["", " ", "\u00a0a.\u2003b. ", "e.g. this. U.S. that! Mr. X? no", "一。二！ 三？四", "\n a.b.c. \u0085", "x\n", "\u2028y?\u2029", "Dr.\tNo. 3.14 is pi.Ok", "...", "a. . .b", "no end", "é.g. ü.B Xy. z\x1f", None]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").unionByName(spark.createDataFrame([(x,) for x in odd], "text string"))
    parts = F.split("text", "(?U)" + text.SENTENCE_END)
    plain = F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))), lambda s: s != "")
    rows = docs.select(text.sentences(F.col("text")).alias("a"), plain.alias("b")).collect()
    assert len(rows) > 200 and all(r.a == r.b for r in rows)


def test_retrieval_stores_no_chunks(spark, monkeypatch):
    """Contexts are those of a stored collection; what is written is the questions and the hits alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "No id here. None at all."), (900001, None)], "doc_id long, text string"))
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    embed, written = text.embedder("hash"), []
    want = text.retrieve(text.cut(text.ingest(docs, text.sentence_chunks, embed)), asked, embed, 3).collect()
    monkeypatch.setattr(text, "cut", lambda df: written.append(df.columns) or cut(df))
    got = text.retrieve_from(docs, asked, text.sentence_chunks, embed, 3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 0
    assert written == [["query_id", "query"], ["query_id", "rank", "id", "distance"]]
