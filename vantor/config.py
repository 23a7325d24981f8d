"""What a collection is made of, and the checks of everything that comes in."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np

from vantor.errors import InvalidArgument, NotSupported
from vantor.functions.distance import METRICS
from vantor.functions.filters import scalar

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")
#: Most bytes of an id.
MAX_ID_BYTES = 64 << 10
#: dtype: (Spark type of an element, smallest, largest)
DTYPES = {"float32": ("float", None, None), "int8": ("tinyint", -128, 127), "uint8": ("smallint", 0, 255)}


def positive_int(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise InvalidArgument(f"{name} must be a positive integer")
    return value


@dataclass(frozen=True)
class FlatIndex:
    """Exact scan."""

    kind: str = field(default="flat", init=False)


@dataclass(frozen=True)
class GraphIndex:
    """Graph search over one-bit codes, with exact distances in the end."""

    kind: str = field(default="qg", init=False)
    max_neighbors: int = 32
    construction_effort: int = 400

    def __post_init__(self) -> None:
        positive_int(self.max_neighbors, "max_neighbors")
        positive_int(self.construction_effort, "construction_effort")


@dataclass(frozen=True)
class CollectionConfig:
    """The immutable schema of a collection."""

    dimension: int
    dtype: str = "float32"
    metric: str = "l2"
    index: FlatIndex | GraphIndex = field(default_factory=GraphIndex)
    auto_seal_rows: int | None = None

    def __post_init__(self) -> None:
        known = {"dtype": DTYPES, "metric": METRICS}
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise InvalidArgument(f"{name} must be one of {tuple(values)}")
        for name in ("dimension", "auto_seal_rows"):
            if name == "dimension" or getattr(self, name) is not None:
                positive_int(getattr(self, name), name)
        if not isinstance(self.index, FlatIndex | GraphIndex):
            raise InvalidArgument("index must be a FlatIndex or a GraphIndex")

    @property
    def element(self) -> str:
        return DTYPES[self.dtype][0]

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> CollectionConfig:
        index = dict(d["index"])
        kind = index.pop("kind")
        return CollectionConfig(**{**d, "index": FlatIndex() if kind == "flat" else GraphIndex(**index)})


def check_platform(config: CollectionConfig) -> None:
    """What a graph index asks of its collection; checked before anything is created."""
    if not isinstance(config.index, GraphIndex):
        return
    if config.dtype != "float32":
        raise NotSupported("a graph index needs float32 vectors")
    if not 33 <= config.dimension <= 2048:
        raise NotSupported("a graph index needs 33 to 2048 dimensions")
    if config.index.max_neighbors not in (32, 64):
        raise NotSupported("max_neighbors must be 32 or 64")
    if config.index.construction_effort < config.index.max_neighbors:
        raise InvalidArgument("construction_effort must not be below max_neighbors")
    if config.auto_seal_rows is not None and config.auto_seal_rows <= 32:
        raise InvalidArgument("auto_seal_rows must be above 32 for a graph index")


def check_name(name: object) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise InvalidArgument("a name has 1 to 128 of A-Z a-z 0-9 . _ - and starts with a letter or digit")
    return name


def check_ids(ids: object, allow_empty: bool = False) -> list[str]:
    if isinstance(ids, str | bytes) or not isinstance(ids, Sequence):
        raise InvalidArgument("ids must be a sequence of strings")
    for x in ids:
        if not isinstance(x, str):
            raise InvalidArgument("ids must be strings")
        if len(x.encode()) > MAX_ID_BYTES:
            raise InvalidArgument(f"an id has {MAX_ID_BYTES} bytes at most")
    if not ids and not allow_empty:
        raise InvalidArgument("ids must not be empty")
    return list(ids)


def check_vectors(vectors: object, rows: int, config: CollectionConfig) -> np.ndarray:
    """rows x dimension, finite, in the range of the dtype."""
    try:
        v = np.asarray(vectors, dtype=np.float64)
    except (TypeError, ValueError) as e:
        raise InvalidArgument("vectors must be numbers in rows of equal length") from e
    if v.ndim != 2 or v.shape != (rows, config.dimension):
        raise InvalidArgument(f"vectors must be {rows} x {config.dimension}, not {v.shape}")
    return _in_range(v, config)


def check_queries(queries: object, config: CollectionConfig) -> np.ndarray:
    """One vector or a non-empty matrix of them, as a matrix."""
    try:
        q = np.asarray(queries, dtype=np.float64)
    except (TypeError, ValueError) as e:
        raise InvalidArgument("queries must be numbers") from e
    q = q[None, :] if q.ndim == 1 else q
    if q.ndim != 2 or not len(q) or q.shape[1] != config.dimension:
        raise InvalidArgument(f"queries must have {config.dimension} dimensions")
    return _in_range(q, config)


def _in_range(v: np.ndarray, config: CollectionConfig) -> np.ndarray:
    if not np.isfinite(v).all():
        raise InvalidArgument("vectors must be finite")
    _, low, high = DTYPES[config.dtype]
    if low is None:
        return v.astype(np.float32)
    if (v != np.floor(v)).any() or (v < low).any() or (v > high).any():
        raise InvalidArgument(f"{config.dtype} vectors have whole numbers from {low} to {high}")
    return v.astype(np.int16)


def check_metadata(metadata: object, rows: int) -> list[dict]:
    if metadata is None:
        return [{}] * rows
    if not isinstance(metadata, Sequence) or len(metadata) != rows:
        raise InvalidArgument("metadata must have as many rows as ids")
    out = []
    for m in metadata:
        m = {} if m is None else m
        if not isinstance(m, dict) or not all(isinstance(k, str) for k in m):
            raise InvalidArgument("metadata rows are mappings of strings to scalars")
        out.append({k: scalar(v) for k, v in m.items()})
    return out


def check_documents(documents: object, rows: int) -> list[str]:
    if documents is None:
        return [""] * rows
    if isinstance(documents, str) or not isinstance(documents, Sequence) or len(documents) != rows:
        raise InvalidArgument("documents must have as many rows as ids")
    if not all(x is None or isinstance(x, str) for x in documents):
        raise InvalidArgument("documents must be strings")
    return [x or "" for x in documents]


def effective_effort(config: CollectionConfig, effort: int | None, limit: int) -> int | None:
    """Candidates that a graph search keeps: max(100, limit) unless stated; an exact index takes none."""
    if isinstance(config.index, FlatIndex):
        if effort is not None:
            raise InvalidArgument("an exact index takes no effort")
        return None
    floor = max(100, limit)
    if effort is not None and positive_int(effort, "effort") < floor:
        raise InvalidArgument(f"effort must not be below {floor}")
    return effort or floor


def capabilities() -> dict:
    return {"indexes": ["flat", "qg"], "metrics": list(METRICS), "dtypes": list(DTYPES), "vectorized": f"numpy {np.__version__}"}
