from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from vantor.llm.common import labelled_sample
from vantor.llm.quality_classifier import MAX_LABELLED, classify, co_train, fit_logistic, keep_good, meta_features, text_features
from vantor.llm.queries import QUERIES
from vantor.llm.toxicity import DIMENSIONS, Index, score_toxicity

LARGE = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    p = label.sum()
    return (order[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def held(spark, name, label):
    df = QUERIES[name](spark, LARGE).join(spark.read.parquet(f"{LARGE}/labels.parquet"), "doc_id").where("held_out").select("score", label).toPandas()
    return df.score.to_numpy(), df[label].to_numpy()


def test_toxicity_held_out(spark):
    score, label = held(spark, "op1_toxicity", "toxic")
    assert auc(score + np.random.default_rng(0).random(len(score)) * 1e-9, label) >= 0.95
    assert ((score >= 0.5) == label).mean() >= 0.97 and ((score - label) ** 2).mean() <= 0.03
    assert (score[label == 1] >= 0.5).mean() >= 0.9 and (score[label == 0] >= 0.5).mean() <= 0.01


def test_quality_held_out(spark):
    score, label = held(spark, "op8_quality_classifier", "quality")
    assert auc(score, label) >= 0.98 and ((score >= 0.5) == label).mean() >= 0.97


@pytest.mark.parametrize("spread", [60, 3000])
def test_nearest_is_exact(spread):
    """Against dense cosines, with frequent terms, rare ones and both."""
    rng = np.random.default_rng(spread)
    draw = lambda: np.unique(np.concatenate([rng.choice(30, rng.integers(1, 8)), 30 + rng.choice(spread, rng.integers(1, 8))])).astype(np.int32)
    examples = []
    for k in range(700):
        at = draw()
        examples.append((f"id{k}", int(rng.random() < 0.4), at, rng.integers(1, 4, len(at))))
    scale = np.ones(DIMENSIONS)
    scale[: spread + 30] = rng.random(spread + 30) * 5 + 0.5
    index = Index(examples, scale)
    by_id = {e[0]: e for e in examples}
    dense = np.zeros((len(index.n), spread + 30))
    for k, name in enumerate(index.ids):
        at, weights = index.vector(*by_id[name][2:])
        dense[k, at] = weights
    assert index.n.sum() == 700 and index.positive.sum() == sum(e[1] for e in examples)
    asked = [(at, rng.integers(1, 4, len(at))) for at in (draw() for _ in range(100))]
    vectors = [index.vector(*x) for x in asked]
    for (at, weights), (ids, cosines) in zip(vectors, index.nearest(vectors), strict=True):
        q = np.zeros(spread + 30)
        q[at] = weights
        cos = dense @ q
        assert np.allclose(cosines, np.sort(cos)[::-1][:15], atol=1e-5) and np.allclose(cos[ids], cosines, atol=1e-5)


def test_scores_depend_on_texts_alone(spark):
    """Other ids, of another type, that fall into the same folds and samples give the same scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("crc32(cast(doc_id AS string)) % 5 <> 0")
    as_text = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    free = lambda df: df.where("crc32(concat('d', doc_id)) % 5 <> 0 OR doc_id IS NULL")
    labels = free(labels)
    a = {r.doc_id: (r.score, r.evidence) for r in score_toxicity(docs, labels).collect()}
    b = {r.doc_id: (r.score, r.evidence) for r in score_toxicity(as_text(docs), as_text(labels)).collect()}
    assert {f"d{k}": round(v[0], 9) for k, v in a.items()} == {k: round(v[0], 9) for k, v in b.items()}
    assert all(isinstance(x, str) for v in b.values() for x in v[1])


def test_every_text_with_known_words_has_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).join(docs.where("length(text) > 200"), "doc_id")
    assert got.where("size(evidence) = 0").count() == 0


def test_toxicity_edges(spark, edge_docs, empty_docs, edge_labels):
    got = score_toxicity(edge_docs, edge_labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert score_toxicity(empty_docs, edge_labels).count() == 0
    assert {r.score for r in score_toxicity(edge_docs, edge_labels.where("false")).collect()} == {0.5}


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    for run in (score_toxicity, classify):
        a, b = ({r.doc_id: r.score for r in run(docs, x).collect()} for x in (labels, flipped))
        assert a == b


def test_quality_edges(spark, edge_docs, empty_docs, edge_labels):
    got = classify(edge_docs, edge_labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    assert classify(empty_docs, edge_labels).count() == 0
    assert {r.score for r in classify(edge_docs, edge_labels.where("false")).collect()} == {1.0}
    kept = keep_good(edge_docs, edge_labels)
    assert kept.columns == edge_docs.columns


def test_views_and_exchange():
    rng = np.random.default_rng(2)
    y = (rng.random(600) < 0.7).astype(float)
    x = rng.standard_normal((600, 12)) + y[:, None] * 1.5
    m = np.array([meta_features("good" if v else "bad", "en", 100) for v in y])
    model = co_train(x[:300], m[:300], y[:300], x[300:], m[300:])
    assert len(model.exchanged) == 3 and max(model.exchanged[-1]) > 0
    both, text, meta = model.score(x[300:], m[300:])
    assert auc(both, y[300:]) >= max(auc(text, y[300:]), 0.97)


def test_logistic_against_gradient():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((200, 3)), (rng.random(200) < 0.5).astype(float)
    beta = fit_logistic(x, y, np.ones(200), ridge=1e-3)
    p = 1 / (1 + np.exp(-(np.hstack([x, np.ones((200, 1))]) @ beta)))
    gradient = np.hstack([x, np.ones((200, 1))]).T @ (p - y) + np.r_[np.full(3, 0.2), 1e-6] * beta
    assert np.abs(gradient).max() < 1e-4


def test_features_of_nothing():
    assert text_features(None) == text_features(b"") == text_features(b" \n")
    assert len(set(meta_features(None, None, None))) == 3


def test_sample_is_bounded_and_outside_the_fold(spark, edge_labels):
    many = spark.range(1000).selectExpr("id AS doc_id", "1 AS quality")
    ids = [r.doc_id for r in labelled_sample(many, "quality", 100).collect()]
    import zlib

    assert len(set(ids)) == 100 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert MAX_LABELLED == 20_000
    assert {r.doc_id: r.label for r in labelled_sample(edge_labels, "quality", 10).collect()}.get(5, 1) == 1


def test_repeated_ids_count_once_in_a_fit(spark, monkeypatch):
    from vantor.llm import quality_classifier

    rows = spark.range(400).selectExpr("id % 40 AS doc_id", "concat('some words ', id) AS text", "'s' AS source", "'en' AS lang", "9L AS n_chars")
    labels = spark.range(40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    seen = []
    monkeypatch.setattr(quality_classifier, "co_train", lambda x, m, y, px, pm: seen.append((len(y), len(px))) or quality_classifier.Model())
    quality_classifier.fit(rows, labels)
    fit_rows = labels.where("crc32(cast(doc_id AS string)) % 5 <> 0").count()
    assert seen == [(fit_rows, 40 - fit_rows)]
