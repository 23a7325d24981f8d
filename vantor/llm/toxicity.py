"""Toxicity by the nearest labelled examples in exact TF-IDF cosine, over a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from struct import pack
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vantor.llm.common import cut, held_out, labelled_sample
from vantor.llm.decontaminate import words_of
from vantor.llm.quality_classifier import _sigmoid, fit_logistic

#: Labelled rows whose terms are weighed, examples among them that are indexed, neighbours that vote: absolute bounds.
MAX_LABELLED = 20_000
MAX_EXAMPLES = 3_000
NEIGHBOURS = 15
#: Terms are words and their beginnings of so many bytes, hashed to so many dimensions; 0 stands for no term.
PREFIXES = (3, 4, 6)
DIMENSIONS = 1 << 20
#: A term whose examples' labels deviate by more standard errors than this weighs more, by the square.
DEVIATION = 2.0
#: Examples of a block; a term that one example in FREQUENT has is kept as a dense row with the largest weight of each block.
BLOCK, FREQUENT = 64, 10
#: Texts that are scored at once, words that a task remembers.
BATCH, MEMO = 128, 200_000


class Terms(dict):
    """The dimensions of a word's terms, as bytes, as far as they are remembered."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        # a beginning's hash starts from its length, so that it is no word's
        at = [1 + crc32(word) % (DIMENSIONS - 1)]
        for n in PREFIXES:
            at.append(1 + crc32(word[:n], n) % (DIMENSIONS - 1) if len(word) >= n else 0)
        found = self[word] = pack(f"={len(at)}i", *at)
        return found

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(dimensions, counts) of all terms of the text, in order."""
        at = np.frombuffer(b"".join(map(self.__getitem__, words_of(text))), dtype=np.int32)
        return np.unique(at[at > 0], return_counts=True)


def _term_counts(labelled: bool):
    """(term, n, positive): how many of a task's rows have a term, and how many of these are labelled so."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n, positive = Terms(), np.zeros(DIMENSIONS, dtype=np.int64), np.zeros(DIMENSIONS, dtype=np.int64)
        for batch in batches:
            labels = batch.column(1).to_pylist() if labelled else [0] * batch.num_rows
            for text, label in zip(batch.column(0).cast(pa.large_binary()), labels, strict=True):
                at, _ = terms.of(text.as_py())
                n[at] += 1
                if label > 0:
                    positive[at] += 1
        at = np.nonzero(n)[0]
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(n[at]), pa.array(positive[at])], names=["term", "n", "positive"])

    return run


def _dense(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sums of _term_counts() by dimension; DIMENSIONS rows at most come to the driver."""
    got = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).toArrow()
    n, positive = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    at = got["term"].to_numpy()
    n[at], positive[at] = got["n"].to_numpy(), got["positive"].to_numpy()
    return n, positive


class Index:
    """Distinct example vectors in blocks. Rare terms have postings, frequent ones dense rows with block maxima.

    Examples with equal vectors are one entry that counts them. Entries are sorted by their heaviest term and then by
    their terms, so that a block's examples resemble each other and the bounds are tight; ids play no part.
    """

    def __init__(self, examples: list[tuple], scale: np.ndarray) -> None:
        """examples: (doc_id, label, dimensions, counts); scale: what a term weighs in each dimension."""
        self.scale = scale.astype(np.float32)
        entries: dict[tuple, list] = {}
        for doc_id, label, at, counts in examples:
            at, counts = np.asarray(at, dtype=np.int32), np.asarray(counts, dtype=np.int32)
            e = entries.setdefault((at.tobytes(), counts.tobytes()), [0, 0, doc_id])
            e[0] += 1
            e[1] += label > 0
            e[2] = min(e[2], doc_id)
        n, positive = sum(e[0] for e in entries.values()), sum(e[1] for e in entries.values())
        empty = entries.pop((b"", b""), [0, 0, None])
        self.prior = (positive + 0.5) / (n + 1)
        self.empty = (empty[1] + self.prior) / (empty[0] + 1)
        rows = []
        for (at, counts), e in entries.items():
            terms, weights = self.vector(np.frombuffer(at, dtype=np.int32), np.frombuffer(counts, dtype=np.int32))
            rows.append((int(terms[np.argmax(weights)]), at, counts, terms, weights, e))
        rows.sort(key=lambda r: r[:3])
        self.ids = [r[5][2] for r in rows]
        self.n, self.positive = (np.array([r[5][k] for r in rows], dtype=np.float64) for k in (0, 1))
        self.vectors = [(r[3], r[4]) for r in rows]
        self._lay_out()
        self.calibration = np.array([1.0, 0.0])
        self._calibrate()
        del self.vectors

    def vector(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts.astype(np.float32))) * self.scale[at]
        return at, weights / np.sqrt((weights * weights).sum())

    def _lay_out(self) -> None:
        n = len(self.vectors)
        self.blocks = -(-n // BLOCK)
        terms = np.concatenate([t for t, _ in self.vectors]) if n else np.zeros(0, dtype=np.int32)
        weights = np.concatenate([w for _, w in self.vectors]) if n else np.zeros(0, dtype=np.float32)
        entry = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in self.vectors]) if n else np.zeros(0, dtype=np.int32)
        df = np.bincount(terms, minlength=DIMENSIONS)
        frequent = np.nonzero(df * FREQUENT > max(n, 1))[0]
        self.row = np.full(DIMENSIONS, -1, dtype=np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK), dtype=np.float32)
        often = self.row[terms] >= 0
        self.dense[self.row[terms[often]], entry[often]] = weights[often]
        self.most = self.dense.reshape(len(frequent), self.blocks, BLOCK).max(axis=2)
        order = np.argsort(terms[~often], kind="stable")
        self.posting, self.weight = entry[~often][order], weights[~often][order]
        self.start = np.concatenate([[0], np.cumsum(np.where(self.row >= 0, 0, df))]).astype(np.int64)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: Iterable[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k entries of largest cosine (of equal ones those first in the index) and their cosines, exactly.

        The postings of rare terms are summed. The k-th largest sum bounds the answer from below; a block is completed
        by the frequent terms for those vectors alone whose bound there (its largest sum, and the frequent terms'
        weights times their largest in the block) reaches that.
        """
        sums = np.zeros((len(vectors), self.blocks * BLOCK), dtype=np.float32)
        asked = np.zeros((len(vectors), len(self.dense)), dtype=np.float32)
        for b, (at, weights) in enumerate(vectors):
            rows = self.row[at]
            asked[b, rows[rows >= 0]] = weights[rows >= 0]
            at, weights = at[rows < 0], weights[rows < 0]
            starts, sizes = self.start[at], self.start[at + 1] - self.start[at]
            ends = np.cumsum(sizes)
            if len(ends) and ends[-1]:
                places = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
                sums[b] = np.bincount(self.posting[places], weights=self.weight[places] * np.repeat(weights, sizes), minlength=sums.shape[1])
        k = min(k, len(self.n))
        if not k:
            return [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(vectors)
        for b, own in enumerate(without if without is not None else ()):
            sums[b, own] = -4
        low = np.partition(sums, -k, axis=1)[:, -k]
        bounds = sums.reshape(len(vectors), self.blocks, BLOCK).max(axis=2) + asked @ self.most
        need = bounds >= low[:, None] - 1e-5
        most = need.mean(axis=1) > 0.5  # these take all blocks, which is one product
        sums[most] += asked[most] @ self.dense
        for block in range(self.blocks):
            rows = np.nonzero(need[:, block] & ~most)[0]
            if len(rows):
                part = slice(block * BLOCK, (block + 1) * BLOCK)
                sums[rows, part] += asked[rows] @ self.dense[:, part]
        out, sums = [], sums[:, : len(self.n)]
        for s, least in zip(sums, np.partition(sums, -k, axis=1)[:, -k], strict=True):
            ids = np.nonzero(s >= max(least - 1e-6, 1e-6))[0]
            cosines = np.round(s[ids].astype(np.float64), 6)
            order = np.lexsort((ids, -cosines))[:k]
            out.append((ids[order], cosines[order]))
        return out

    def _share(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        """The share of label 1 among the votes of neighbours, weighed by distance."""
        weights = 1 / (0.05 + 1 - np.minimum(cosines, 1.0))
        return float((weights @ self.positive[ids] + 0.02) / (weights @ self.n[ids] + 0.04))

    def _calibrate(self) -> None:
        """Fit a logistic curve from votes to labels, each example's vote without itself."""
        if self.positive.sum() in (0, self.n.sum()):
            return
        x, y, w = [], [], []
        for at in range(0, len(self.vectors), BATCH):
            own = range(at, min(at + BATCH, len(self.vectors)))
            for k, (ids, cosines) in zip(own, self.nearest([self.vectors[k] for k in own], without=own), strict=True):
                if len(ids):
                    share = self._share(ids, cosines)
                    x.append(np.log(share / (1 - share)))
                    y.append(self.positive[k] / self.n[k])
                    w.append(min(self.n[k], 20.0))
        if len(x) >= 50 and 0 < np.mean(y) < 1:
            fitted = fit_logistic(np.array(x)[:, None], np.array(y), np.array(w), ridge=1e-4)
            if fitted[0] > 0:
                self.calibration = fitted

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[float], list[list]]:
        """The calibrated score and the neighbours' ids for each (dimensions, counts); at most BATCH of them."""
        scores, evidence = [self.empty] * len(found), [[] for _ in found]
        full = [k for k, (at, _) in enumerate(found) if len(at)]
        for k, (ids, cosines) in zip(full, self.nearest([self.vector(*found[k]) for k in full]), strict=True):
            scores[k] = self.prior
            if len(ids):
                share = self._share(ids, cosines)
                scores[k] = float(_sigmoid(np.array(self.calibration[0] * np.log(share / (1 - share)) + self.calibration[1])))
                evidence[k] = [self.ids[i] for i in ids]
        return scores, evidence


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_examples: int = MAX_EXAMPLES) -> Index:
    """The index of at most max_examples examples; terms weigh what at most max_labelled labelled rows say.

    Both are rows outside the held-out fold, those of smallest id hash, equal texts being one. A term weighs its inverse
    frequency among all rows of docs, times the square of its labels' deviation over DEVIATION where that is above 1.
    """
    known = labelled_sample(labels, "toxic", max_labelled)
    texts = docs.join(F.broadcast(known), "doc_id").groupBy(F.xxhash64("text").alias("h"))  # max_labelled ids at most
    texts = cut(texts.agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"), F.first("text").alias("text")))
    n_docs = docs.count()
    df, _ = _dense(docs.select("text").mapInArrow(_term_counts(False), "term long, n long, positive long"))
    n, k = _dense(texts.select("text", "label").mapInArrow(_term_counts(True), "term long, n long, positive long"))
    total, positive = texts.agg(F.count("*"), F.count_if(F.col("label") > 0)).first()
    p = positive / total if total else 0.0
    deviation = np.abs(k - n * p) / np.sqrt(np.maximum(n * max(p * (1 - p), 1e-9), 1e-9))
    scale = (np.log((1 + n_docs) / (1 + df)) + 1) * np.maximum(1.0, (deviation / DEVIATION) ** 2)
    chosen = texts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms.of(t.as_py()) for t in batch.column(2).cast(pa.large_binary())]
            columns = [pa.array([x[j] for x in found], pa.list_(pa.int32())) for j in (0, 1)]
            yield pa.record_batch([batch.column(0).cast(kind), batch.column(1), *columns], names=["doc_id", "label", "terms", "counts"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, terms array<int>, counts array<int>"
    rows = chosen.select("doc_id", "label", "text").mapInArrow(run, schema).toArrow()
    columns = [rows["doc_id"].to_pylist(), rows["label"].to_pylist(), *([x.values.to_numpy() for x in rows[c]] for c in ("terms", "counts"))]
    return Index(list(zip(*columns, strict=True)), scale)


def score_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): a row for each row of docs; evidence: ids of the examples that voted.

    Every text with a word is compared with the examples by all its terms. A text without words (an empty or null one
    too) has the share of label 1 among such examples, drawn to that of all; so has one that shares no term with any
    example; without labels every score is 0.5. Null labels and labels without an id are left out. Only doc_id and
    text are read; repeated rows are answered one by one; an empty table gives an empty one. Ids of any type do: they
    name evidence and play no part in a score.
    """
    docs = docs.select("doc_id", "text")
    schema = docs.schema["doc_id"]
    kind, arrow = schema.dataType.simpleString(), to_arrow_type(schema.dataType)
    # a broadcast of the index, which is bounded: some 40 MB
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled, max_examples))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                scores, evidence = index.value.scores([terms.of(t.as_py()) for t in batch.column(1).cast(pa.large_binary())])
                yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(arrow))], names=["doc_id", "score", "evidence"])

    out = docs.mapInArrow(run, f"doc_id {kind}, score double, evidence array<{kind}>")
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "evidence")
