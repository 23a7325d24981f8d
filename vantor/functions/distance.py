"""Distances between dense vectors: Column forms, and numpy forms for Arrow batches.

All are "smaller is closer": l2 is the squared Euclidean distance, ip the negated inner product, cosine the negated
cosine (0 where either vector has norm 0). Sums are in double, left to right, and cast to float at the end, so that both
forms and any SQL engine that sums in order agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine")


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda a, x: a + x)


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def squared_norm(a: Column | str) -> Column:
    return _sum(F.transform(_double(a), lambda x: x * x))


def distance(a: Column | str, b: Column | str, metric: str) -> Column:
    if metric == "l2":
        return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))).cast("float")
    if metric == "ip":
        return (-dot(a, b)).cast("float")
    if metric == "cosine":
        na, nb = squared_norm(a), squared_norm(b)
        return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(-dot(a, b) / F.sqrt(na * nb)).cast("float")
    raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")


def l2_normalize(v: Column | str) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    norm = F.sqrt(squared_norm(v))
    return F.when(norm == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / norm)).cast("array<float>")


def distance_matrix(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """float32 distances, queries by vectors; exact in the order of the Column form, a dimension at a time."""
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    out = np.zeros((len(q), len(v)))
    for d in range(q.shape[1]):
        out += np.square(q[:, d, None] - v[None, :, d]) if metric == "l2" else q[:, d, None] * v[None, :, d]
    if metric == "l2":
        return out.astype(np.float32)
    if metric == "cosine":
        ordered = lambda m: np.add.accumulate(m * m, axis=1)[:, -1]  # noqa: E731  left to right, unlike sum()
        norms = ordered(q)[:, None] * ordered(v)[None, :]
        out = np.divide(out, np.sqrt(norms), out=np.zeros_like(out), where=norms != 0)
    return (-out + 0.0).astype(np.float32)


def distance_pairs(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """float32 distances of a's rows to b's, row by row, in the order of the Column form."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += np.square(a[:, d] - b[:, d]) if metric == "l2" else a[:, d] * b[:, d]
    if metric == "l2":
        return out.astype(np.float32)
    if metric == "cosine":
        ordered = lambda m: np.add.accumulate(m * m, axis=1)[:, -1] if m.shape[1] else np.zeros(len(m))  # noqa: E731  left to right, unlike sum()
        na, nb = ordered(a), ordered(b)
        norms = na * nb
        out = np.divide(out, np.sqrt(norms), out=np.zeros_like(out), where=(na != 0) & (nb != 0) & (norms != 0))
    return (-out + 0.0).astype(np.float32)


def nearest_pairs(queries: np.ndarray, vectors: np.ndarray, limit: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, distance) of the first `limit` vectors of each query by distance, then by place, exactly.

    Products of whole matrices, in double, find what may be among these: all that is not beyond the limit-th by more
    than rounding, single precision included. Those alone are measured in the order that defines a distance, and so is
    all that has no finite product.
    """
    q, v = queries.astype(np.float64), vectors.astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        return _nearest_pairs(q, v, limit, metric)


def _nearest_pairs(q: np.ndarray, v: np.ndarray, limit: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    qq, vv = (q * q).sum(axis=1), (v * v).sum(axis=1)
    longest = vv.max(initial=0.0, where=np.isfinite(vv))
    rough = q @ v.T
    if metric == "l2":
        rough = qq[:, None] + vv[None, :] - 2 * rough
        scale = qq + longest
    elif metric == "ip":
        rough, scale = -rough, np.sqrt(qq * longest)
    else:
        norms = np.sqrt(qq[:, None] * vv[None, :])
        rough, scale = -np.divide(rough, norms, out=np.zeros_like(rough), where=norms != 0), np.ones(len(q))
    k = min(limit, len(v))
    if not np.isfinite(rough.sum()):
        odd = ~np.isfinite(rough)
        rough[odd], scale = -np.inf, np.where(np.isfinite(scale), scale, 0.0)
        # beside these, the limit-th of the others
        spare = np.sort(np.where(odd, np.inf, rough), axis=1)[:, k - 1]
        rows, places = np.nonzero(rough <= np.where(np.isfinite(spare), spare + 1e-6 * np.abs(spare) + 1e-12 * scale, np.inf)[:, None])
        return _measured(q, v, rows, places, k, metric)
    most = np.partition(rough, k - 1, axis=1)[:, k - 1]
    rows, places = np.nonzero(rough <= (most + 1e-6 * np.abs(most) + 1e-12 * scale)[:, None])
    return _measured(q, v, rows, places, k, metric)


def _measured(q: np.ndarray, v: np.ndarray, rows: np.ndarray, places: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    exact = distance_pairs(q[rows], v[places], metric)
    order = np.lexsort((places, exact, rows))
    rows, places, exact = rows[order], places[order], exact[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], places[first], exact[first]


def gemm_matrix(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Distances by matrix products: faster, but not equal to the last bit; for candidates and clustering."""
    q, v = queries.astype(np.float32), vectors.astype(np.float32)
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T), 0)
    if metric == "ip":
        return -(q @ v.T)
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
    return -np.divide(q @ v.T, norms, out=np.zeros((len(q), len(v)), np.float32), where=norms != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis (a power of two), scaled to keep norms."""
    n = x.shape[-1]
    if n & (n - 1) or not n:
        raise ValueError("the last axis must be a power of two")
    x, h = x.astype(np.float64), 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(*x.shape)
        h *= 2
    return x / np.sqrt(n)
