"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantor.llm.common import labelled_sample

#: Most labelled rows, and as many unlabelled ones, that a fit looks at.
MAX_LABELLED = 20_000
MAX_POOL = 20_000
ROUNDS = 3
#: A view passes on labels it holds for so likely, at most so many a class and round.
CONFIDENT = 0.95
EXCHANGE = 1_000
META_BUCKETS = 64

_CLASS = np.full(256, 0, dtype=np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 symbol, 5 mark, 6 exclamation
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[list(b"#*$%&|<>{}[]~^=_\\/@")] = 4
_CLASS[list(b".,;:()'\"-?")] = 5
_CLASS[list(b"!")] = 6
TEXT_FEATURES = 12


def text_features(text: bytes | None) -> list[float]:
    """Shares that describe the content; a null or empty text has those of no words."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (TEXT_FEATURES - 1)
    kinds = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=7)
    letters = max(1, int(kinds[1] + kinds[2]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = max(1, n - 1)
    return [
        0.0,
        min(1.0, n / 200),
        kinds[2] / letters,
        kinds[3] / n,
        min(4.0, kinds[4] / n),
        min(4.0, kinds[5] / n),
        min(4.0, kinds[6] / n),
        sum(map(eq, words, words[1:])) / pairs,
        len(set(words)) / n,
        len(set(zip(words, words[1:], strict=False))) / pairs,
        1 - len(set(lines)) / len(lines),
        min(2.0, (len(text) - n) / n / 10),
    ]


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Buckets of the page's metadata: source, language and order of magnitude of the stated length."""
    from zlib import crc32

    size = 0 if n_chars is None or n_chars < 0 else 1 + int(n_chars).bit_length()
    return [crc32(f"{k}={v}".encode(errors="replace")) % META_BUCKETS + META_BUCKETS * k for k, v in enumerate((source, lang, size))]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights, the intercept last, by damped Newton steps on the weighted log-likelihood with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1.0, w.sum()))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ beta)
        gradient = x.T @ (w * (p - y)) + penalty * beta
        hessian = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return beta


@dataclass
class Model:
    """Two views and what combines them; prior is used where nothing could be learnt."""

    prior: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(TEXT_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(TEXT_FEATURES))
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    text_cal: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    meta_cal: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    both: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))
    exchanged: list = field(default_factory=list)

    def views(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of the two views."""
        a = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]) @ self.text
        b = self.meta[:-1][m].sum(axis=1) + self.meta[-1]
        return a * self.text_cal[0] + self.text_cal[1], b * self.meta_cal[0] + self.meta_cal[1]

    def score(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            flat = np.full(len(x), self.prior)
            return flat, flat, flat
        a, b = self.views(x, m)
        return _sigmoid(a * self.both[0] + b * self.both[1] + self.both[2]), _sigmoid(a), _sigmoid(b)


def _one_hot(m: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), 3 * META_BUCKETS))
    np.put_along_axis(out, m, 1.0, axis=1)
    return out


def co_train(x: np.ndarray, m: np.ndarray, y: np.ndarray, pool_x: np.ndarray, pool_m: np.ndarray) -> Model:
    """Fit both views on the labelled rows, let each give the other confident pseudo-labels over rounds, calibrate, combine.

    Every fifth labelled row is set aside to calibrate the views and to weigh them against each other.
    """
    if len(y) < 20 or y.min() == y.max():
        return Model(prior=float(y.mean()) if len(y) else 1.0)
    model = Model(prior=float(y.mean()), mean=x.mean(axis=0), scale=np.maximum(x.std(axis=0), 1e-3))
    cal = np.arange(len(y)) % 5 == 4
    fit = ~cal
    z, pool_z = (x - model.mean) / model.scale, (pool_x - model.mean) / model.scale
    given = {"text": (np.zeros(0, int), np.zeros(0)), "meta": (np.zeros(0, int), np.zeros(0))}
    ones = np.ones(int(fit.sum()))
    for r in range(ROUNDS + 1):
        (ti, ty), (mi, my) = given["text"], given["meta"]
        model.text = fit_logistic(np.vstack([z[fit], pool_z[ti]]), np.concatenate([y[fit], ty]), np.concatenate([ones, np.full(len(ti), 0.5)]))
        model.meta = fit_logistic(_one_hot(np.vstack([m[fit], pool_m[mi]])), np.concatenate([y[fit], my]), np.concatenate([ones, np.full(len(mi), 0.5)]))
        model.text_cal, model.meta_cal = np.array([1.0, 0.0]), np.array([1.0, 0.0])
        a, b = model.views(x[cal], m[cal])
        w = np.ones(int(cal.sum()))
        model.text_cal, model.meta_cal = fit_logistic(a[:, None], y[cal], w), fit_logistic(b[:, None], y[cal], w)
        if r == ROUNDS or not len(pool_x):
            break
        a, b = map(_sigmoid, model.views(pool_x, pool_m))
        for to, p in (("meta", a), ("text", b)):
            high, low = np.argsort(-p, kind="stable")[:EXCHANGE], np.argsort(p, kind="stable")[:EXCHANGE]
            high, low = high[p[high] >= CONFIDENT], low[p[low] <= 1 - CONFIDENT]
            # as many of either class as the labelled rows have, so that the easy class doesn't drown the other
            k = model.prior / (1 - model.prior)
            low = low[: max(1, int(len(high) / k)) if len(high) else 0]
            high = high[: max(1, int(len(low) * k)) if len(low) else 0]
            given[to] = (np.concatenate([high, low]).astype(int), np.concatenate([np.ones(len(high)), np.zeros(len(low))]))
        model.exchanged.append((len(given["text"][0]), len(given["meta"][0])))
    a, b = model.views(x[cal], m[cal])
    model.both = fit_logistic(np.stack([a, b], axis=1), y[cal], np.ones(len(a)))
    return model


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = np.array([text_features(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]).reshape(n, TEXT_FEATURES)
    rows = zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)
    return x, np.array([meta_features(*r) for r in rows], dtype=np.int64).reshape(n, 3)


def _features_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, m = _features(batch)
        kept = [pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(m.tolist(), pa.list_(pa.int64()))]
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), *kept], names=["doc_id", "label", "x", "m"])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> Model:
    """Fit on at most max_labelled labelled rows outside the held-out fold and max_pool others, those of smallest id hash.

    Both bounds are absolute, so what comes to the driver is bounded; the features of a row are 15 numbers.
    """
    known = labelled_sample(labels, "quality", max_labelled)
    pool = docs.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(max_pool)
    ids = pool.join(F.broadcast(known), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("label"))
    ids = known.unionByName(ids)  # at most max_labelled + max_pool rows
    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(ids), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    features = rows.mapInArrow(_features_of, f"doc_id {kind}, label int, x array<double>, m array<bigint>")
    # of rows that repeat an id one counts, so that no more rows come than ids were chosen
    got = features.groupBy("doc_id").agg(F.min(F.struct("label", "x", "m")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    label = np.array([-1 if v is None else v for v in got["label"].to_pylist()], dtype=np.int64)
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, TEXT_FEATURES)
    m = np.array(got["m"].to_pylist(), dtype=np.int64).reshape(-1, 3)
    on = label >= 0
    return co_train(x[on], m[on], (label[on] > 0).astype(float), x[~on], m[~on])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, text_score, meta_score, kept, held_out), a row for each row of docs.

    Scores are likelihoods of good quality; kept: score >= threshold. Null texts count as empty, null metadata as a value
    of its own; a text without words is scored like any other. Without labels of both classes every score is their mean
    (1 without labels). Columns beyond doc_id, text, source, lang, n_chars are ignored; repeated rows are answered one
    by one.
    """
    from vantor.llm.common import held_out

    model = fit(docs, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(*_features(batch))
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, scores)], names=["doc_id", "score", "text_score", "meta_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    out = rows.mapInArrow(run, f"doc_id {kind}, score double, text_score double, meta_score double")
    return out.withColumn("kept", F.col("score") >= threshold).withColumn("held_out", held_out(F.col("doc_id")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns; nothing is shuffled."""
    model = fit(docs, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = model.score(*_features(batch))[0] >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
