"""Scalar and one-bit quantizers, the rotations before them, and two-stage search over codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vantor.functions.distance import distance, hadamard, l2_normalize
from vantor.operators.search import TILE, batch_vectors, groups, joined, ranked, slices
from vantor.sources.shared import cut

SEED = 42
#: Candidates for each row that is wanted; one-bit codes of 64 dimensions need so many for a recall of 0.85.
SHORTLIST = 30


def fit_ranges(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """(dim, low, high): the range of each dimension, from 0; map-side aggregates of a row a dimension."""
    cells = vectors.select(F.posexplode(vector_col).alias("dim", "x"))
    return cells.groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def range_arrays(ranges: DataFrame) -> DataFrame:
    """One row (low, high) of arrays, for codes()."""
    at = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("dim", c))), lambda x: x[c]).alias(c)  # noqa: E731  a row a dimension
    return ranges.agg(at("low"), at("high"))


def codes(vector: Column, low: Column, high: Column, levels: int = 255) -> Column:
    """A code from 0 to levels for each dimension, cut off; a dimension of one value has 0, values beyond the range its ends."""
    cells = F.arrays_zip(vector.alias("x"), low.alias("low"), high.alias("high"))

    def code(c: Column) -> Column:
        x, a, b = (c[k].cast("double") for k in ("x", "low", "high"))
        inside = F.floor((x - a) / (b - a) * levels)
        return F.when((a == b) | (x <= a), 0).when(x >= b, levels).otherwise(inside).cast("smallint")

    return F.transform(cells, code)


def decoded(code: Column, low: Column, high: Column, levels: int = 255) -> Column:
    cells = F.arrays_zip(code.alias("c"), low.alias("low"), high.alias("high"))
    return F.transform(cells, lambda c: c["low"].cast("double") + c["c"] * (c["high"].cast("double") - c["low"].cast("double")) / levels)


def packed4(code: Column) -> Column:
    """Two 4-bit codes a byte, the first in the high half, as hexadecimal digits: a digit a code, padded with a 0."""
    digits = F.array_join(F.transform(code, lambda c: F.lower(F.hex(c.cast("int")))), "")
    return F.when(F.size(code) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)


def sq_encode(vectors: DataFrame, ranges: DataFrame, levels: int = 255, vector_col: str = "vector") -> DataFrame:
    """vectors with the column code; ranges is fit_ranges()'s table, of a row a dimension."""
    arrays = range_arrays(ranges)
    return vectors.join(F.broadcast(arrays)).withColumn("code", codes(F.col(vector_col), F.col("low"), F.col("high"), levels)).drop("low", "high")


def sq_search(vectors: DataFrame, queries: DataFrame, limit: int, metric: str = "l2", levels: int = 255, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Nearest rows by the distance of the decoded codes of both sides."""
    arrays = F.broadcast(cut(range_arrays(fit_ranges(vectors, vector_col))))  # one row
    both = lambda v: decoded(codes(F.col(v), F.col("low"), F.col("high"), levels), F.col("low"), F.col("high"), levels)
    base = vectors.join(arrays).select(id_col, both(vector_col).alias("v"))
    asked = queries.join(arrays).select("query_id", both("query").alias("query"))
    return joined(base, asked, limit, metric, id_col, "v", groups(vectors, vector_col), groups(queries, "query"))


# rotations


def matrix_rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """An orthogonal matrix, uniform over all: QR of a Gaussian one, signs put right."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def kac_rotation(x: np.ndarray, seed: int = SEED, rounds: int = 4) -> np.ndarray:
    """Random signs and Hadamard transforms of the largest power of two, at the front and the back in turn, with Givens steps between."""
    x = np.array(x, dtype=np.float64)
    dim = x.shape[-1]
    size = 1 << (dim.bit_length() - 1)
    rng = np.random.default_rng(seed)
    for r in range(rounds):
        x = x * rng.choice([-1.0, 1.0], dim)
        at = slice(0, size) if r % 2 == 0 else slice(dim - size, dim)
        x[..., at] = hadamard(x[..., at])
        if size < dim:
            half = dim // 2
            a, b = x[..., :half].copy(), x[..., dim - half :].copy()
            x[..., :half], x[..., dim - half :] = (a + b) / np.sqrt(2), (a - b) / np.sqrt(2)
    return x


@dataclass
class OneBit:
    """One-bit codes of rotated residuals, with the two factors that make them distance estimates.

    For a row v with centre c, r = R(v - c) and the unit code s = sign(r) / sqrt(dim), the inner product of a rotated
    query residual q with r is about <q, s> * |r|**2 / <r, s>. For cosine, unit is set: rows and queries are normalised
    before anything else.
    """

    centre: np.ndarray
    rotation: np.ndarray
    unit: bool = False

    @staticmethod
    def fit(vectors: DataFrame, dim: int, vector_col: str = "vector", seed: int = SEED, unit: bool = False) -> OneBit:
        """The centre is the mean over all rows: one row a dimension comes to the driver."""
        vector = l2_normalize(vector_col) if unit else F.col(vector_col)
        rows = vectors.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
        centre = np.zeros(dim)
        for r in rows:
            centre[r.dim] = r.m
        return OneBit(centre, matrix_rotation(dim, seed), unit)

    def _own(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30) if self.unit else v

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(packed bits, squared norm of the residual, |r|**2 / <r, s>)."""
        r = (self._own(v) - self.centre) @ self.rotation.T
        norm2 = (r * r).sum(axis=1)
        along = np.abs(r).sum(axis=1) / np.sqrt(r.shape[1])
        return np.packbits(r > 0, axis=1), norm2, np.divide(norm2, along, out=np.zeros_like(norm2), where=along > 0)

    def estimate(self, queries: np.ndarray, bits: np.ndarray, norm2: np.ndarray, factor: np.ndarray, metric: str = "l2") -> np.ndarray:
        """Estimated distances, queries by rows; for cosine the model must be a unit one."""
        dim = len(self.centre)
        queries = self._own(queries)
        q = (queries - self.centre) @ self.rotation.T
        s = np.unpackbits(bits, axis=1, count=dim).astype(np.float64) * 2 - 1
        dot = (q @ s.T) / np.sqrt(dim) * factor[None, :]
        l2 = (q * q).sum(axis=1)[:, None] + norm2[None, :] - 2 * dot
        if metric == "l2":
            return l2
        # <q, v> = <q - c, v - c> + <q, c> + <c, v> - <c, c>; <c, v> is taken as <c, c> plus its residual's estimate
        c = self.rotation @ self.centre
        cv = ((c[None, :] @ s.T) / np.sqrt(dim) * factor[None, :]).ravel()
        return -(dot + queries @ self.centre[:, None] + cv[None, :])


def onebit_encode(vectors: DataFrame, model: OneBit, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, bits, norm2, factor) for each row."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, norm2, factor = model.encode(batch_vectors(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(norm2), pa.array(factor)], names=[id_col, "bits", "norm2", "factor"])

    return vectors.select(id_col, vector_col).mapInArrow(run, f"{id_col} {kind}, bits binary, norm2 double, factor double")


def two_stage_search(vectors: DataFrame, coded: DataFrame, model: OneBit, queries: DataFrame, limit: int, metric: str = "l2", shortlist: int = SHORTLIST, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Nearest rows: limit * shortlist candidates a query by estimate from the codes, then exact distances of these.

    The first stage reads codes only, an eighth of a bit a coordinate's byte, against slices of queries of bounded
    size; just the candidates' vectors are joined. For cosine the model should be a unit one.
    """
    n, guesses = limit * shortlist, None
    kind, query_kind = (coded.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString())
    for ids, q in slices(queries):
        asked = pa.array(ids, to_arrow_type(queries.schema["query_id"].dataType))

        def run(batches: Iterable[pa.RecordBatch], q: np.ndarray = q, asked: pa.Array = asked) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                step = max(1, TILE // max(1, batch.num_rows))
                for at in range(0, len(q) if batch.num_rows else 0, step):
                    d = model.estimate(q[at : at + step], bits, batch.column(2).to_numpy(), batch.column(3).to_numpy(), metric)
                    best = np.argsort(d, axis=1, kind="stable")[:, :n]
                    columns = [asked.take(pa.array(np.repeat(np.arange(at, at + len(d)), best.shape[1]))), batch.column(0).take(pa.array(best.ravel())), pa.array(np.take_along_axis(d, best, 1).ravel().astype(np.float32))]
                    yield pa.record_batch(columns, names=["query_id", id_col, "distance"])

        found = coded.select(id_col, "bits", "norm2", "factor").mapInArrow(run, f"query_id {query_kind}, {id_col} {kind}, distance float")
        guesses = found if guesses is None else guesses.unionByName(found)
    if guesses is None:
        guesses = coded.join(queries.limit(0).select("query_id")).select("query_id", id_col, F.lit(0.0).cast("float").alias("distance"))
    short = ranked(guesses, n, id_col).select("query_id", id_col)
    exact = short.join(vectors.select(id_col, vector_col), id_col).join(queries, "query_id")
    return ranked(exact.select("query_id", id_col, distance("query", vector_col, metric).alias("distance")), limit, id_col)


def top_codes(query: np.ndarray) -> np.ndarray:
    """The lookup table of a rotated query: for every four dimensions the 16 sums of its signed coordinates."""
    q = np.pad(query, (0, -len(query) % 4)).reshape(-1, 4)
    signs = np.array([[1.0 if k >> (3 - j) & 1 else -1.0 for j in range(4)] for k in range(16)])
    return q @ signs.T


def quantized_table(table: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The table in 8 bits: (codes, offset, step), so that table is about offset + step * codes."""
    low, high = table.min(), table.max()
    step = (high - low) / 255 or 1.0
    return np.round((table - low) / step).astype(np.uint8), float(low), float(step)


def table_dot(bits: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inner products of sign codes with the query of top_codes(): one lookup for each four dimensions."""
    nibbles = np.stack([bits >> 4, bits & 15], axis=2).reshape(len(bits), -1)[:, : len(table)]
    return table[np.arange(nibbles.shape[1]), nibbles].sum(axis=1)


def overlap_at(hits: DataFrame, other: DataFrame, m: int, id_col: str = "id") -> DataFrame:
    """(query_id, overlap): shared members of two results' first m, over m."""
    both = hits.where(F.col("rank") <= m).select("query_id", id_col).join(other.where(F.col("rank") <= m).select("query_id", id_col), ["query_id", id_col])
    counted = both.groupBy("query_id").agg(F.count("*").alias("n"))
    asked = hits.select("query_id").distinct()
    return asked.join(counted, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / m).alias("overlap"))


def by_rank(rows: DataFrame, group: str, order: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order)))
