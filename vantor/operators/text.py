"""Chunkers, embedders and the retrieval pipeline around a collection."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from vantor.errors import InvalidArgument
from vantor.operators.search import search
from vantor.sources.shared import cut

#: Where a sentence ends, unless what comes before looks like an abbreviation.
SENTENCE_END = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!|。|？|！)\s*"
#: SENTENCE_END with what most places fail at first, since all three look behind the same place.
ENDS_FIRST = r"(?<=[.?!。？！])(?<!\w\.\w.)(?<![A-Z][a-z]\.)\s*"
#: Question and answer pairs that a query carries along, and what stands between them and the question.
HISTORY = 3
NEW_QUESTION = "\n\nNew question："
WORDS = re.compile(r"\w+")


def normalize_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    parts = F.split(text, "(?U)" + ENDS_FIRST)
    padded = lambda s: F.concat(F.left(s, F.lit(1)), F.right(s, F.lit(1))).rlike(r"(?U)\s")  # noqa: E731  few are
    return F.filter(F.transform(parts, lambda s: F.when(padded(s), F.trim(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))).otherwise(s)), lambda s: s != "")


def windows(items: Column, size: int, overlap: int) -> Column:
    """Windows of `size` items, each beginning `size - overlap` after the last, joined by spaces; tails are kept."""
    if size <= 0 or not 0 <= overlap < size:
        raise InvalidArgument("overlap must be from 0 to below the chunk size")
    starts = F.sequence(F.lit(1), F.size(items), F.lit(size - overlap))
    joined = F.transform(starts, lambda at: F.array_join(F.slice(items, at, F.lit(size)), " "))
    return F.when(F.size(items) > 0, joined).otherwise(F.array().cast("array<string>"))


def sentence_chunks(docs: DataFrame, size: int = 3, overlap: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, text): windows over each text's sentences, numbered from 0."""
    rows = docs.select(id_col, sentences(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    return rows.select(id_col, F.posexplode(windows(F.col("s"), size, overlap)).alias("chunk", "text"))


def fixed_chunks(docs: DataFrame, size: int = 256, overlap: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, text): lines of a text packed greedily to at most `size` characters, the last `overlap` repeated."""
    if size <= 0 or not 0 <= overlap < size:
        raise InvalidArgument("overlap must be from 0 to below the chunk size")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, chunk, text = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for n, c in enumerate(pack_lines(t or "", size, overlap)):
                    at.append(k)
                    chunk.append(n)
                    text.append(c)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(chunk, pa.int32()), pa.array(text, pa.string())], names=[id_col, "chunk", "text"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, chunk int, text string")


def pack_lines(text: str, size: int, overlap: int) -> list[str]:
    """A line longer than size is one chunk of its own; others are gathered while they fit, and the next chunk begins
    with as many of the last lines as fit in overlap."""
    chunks, held, length = [], [], 0
    for line in (x for x in text.split("\n") if x.strip()):
        extra = len(line) + (1 if held else 0)
        if held and length + extra > size:
            chunks.append("\n".join(held).strip())
            while held and (length > overlap or length + 1 + len(line) > size):
                length -= len(held[0]) + (1 if len(held) > 1 else 0)
                held.pop(0)
            extra = len(line) + (1 if held else 0)
        held.append(line)
        length += extra
    if held:
        chunks.append("\n".join(held).strip())
    return chunks


def semantic_chunks(docs: DataFrame, embed: Callable[[list[str]], np.ndarray], threshold: float = 0.5, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, text): sentences split at '.', cut where the mean vectors of the `width` before and after are less alike than threshold."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, chunk, out = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for n, c in enumerate(semantic_cut([s.strip() for s in (t or "").split(".") if s.strip()], embed, threshold, width)):
                    at.append(k)
                    chunk.append(n)
                    out.append(c)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(chunk, pa.int32()), pa.array(out, pa.string())], names=[id_col, "chunk", "text"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, chunk int, text string")


def semantic_cut(parts: list[str], embed: Callable[[list[str]], np.ndarray], threshold: float, width: int) -> list[str]:
    if not parts:
        return []
    v = embed(parts)
    chunks, held = [], [parts[0]]
    for k in range(1, len(parts)):
        a, b = v[max(0, k - width) : k].mean(axis=0), v[k : k + width].mean(axis=0)
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        if norm == 0 or a @ b / norm < threshold:
            chunks.append(". ".join(held) + ".")
            held = []
        held.append(parts[k])
    return [*chunks, ". ".join(held) + "."]


CHUNKERS = {"sentence": sentence_chunks, "fixed": fixed_chunks, "semantic": semantic_chunks}


def chunker(name: str) -> Callable[..., DataFrame]:
    if name not in CHUNKERS:
        raise InvalidArgument(f"unknown chunker {name!r}; there are {sorted(CHUNKERS)}")
    return CHUNKERS[name]


class _Places(dict):
    """A word's coordinate, and dim more for a negative sign; some are remembered."""

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = crc32(word.encode())
        found = self[word] = h % self.dim + (0 if h >> 16 & 1 else self.dim)
        return found


def hash_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder: words hashed to signed coordinates, unit length; a text without words is zero."""
    found: list[_Places] = []

    def embed(texts: list[str]) -> np.ndarray:
        if not found:
            found.append(_Places(dim))
        words = [WORDS.findall((t or "").lower()) for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        at = np.fromiter(map(found[0].__getitem__, chain.from_iterable(words)), dtype=np.int64, count=len(rows))
        counts = np.bincount(rows * 2 * dim + at, minlength=len(texts) * 2 * dim).reshape(len(texts), 2 * dim)
        out = (counts[:, :dim] - counts[:, dim:]).astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)

    return embed


#: Embedders by the beginning of a model's name; register() adds more.
EMBEDDERS: dict[str, Callable[..., Callable[[list[str]], np.ndarray]]] = {"hash": lambda _name: hash_embedder()}


def register(prefix: str, factory: Callable[[str], Callable[[list[str]], np.ndarray]]) -> None:
    EMBEDDERS[prefix] = factory


def embedder(name: str) -> Callable[[list[str]], np.ndarray]:
    for prefix in sorted(EMBEDDERS, key=len, reverse=True):
        if name.startswith(prefix):
            return EMBEDDERS[prefix](name)
    raise InvalidArgument(f"no embedder for {name!r}; there are {sorted(EMBEDDERS)}")


def embedded(rows: DataFrame, embed: Callable[[list[str]], np.ndarray], text_col: str = "text", to: str = "vector") -> DataFrame:
    """rows with the vectors of a text column, a batch at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.ascontiguousarray(embed([t or "" for t in batch.column(text_col).to_pylist()]), dtype=np.float32)
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * (v.shape[1] if batch.num_rows else 0)
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()))], names=[*batch.schema.names, to])

    schema = StructType([f for f in rows.schema.fields if f.name != to]).add(to, ArrayType(FloatType()))
    return rows.select(*[F.col(f"`{x}`") for x in rows.columns if x != to]).mapInArrow(run, schema)


def history_queries(turns: DataFrame, pairs: int = HISTORY) -> DataFrame:
    """(conv_id, turn, query): each user turn after the last question and answer pairs before it.

    turns: conv_id, turn, role, text. An answer is the turn that follows a question.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("__answer", F.lead("text").over(order)).where("role = 'user'")
    before = order.rowsBetween(-pairs, -1)
    line = F.concat(F.lit("Q: "), F.coalesce("text", F.lit("")), F.lit("\nA: "), F.coalesce("__answer", F.lit("")))
    past = F.collect_list(line).over(before)
    return rows.select("conv_id", "turn", F.concat(F.array_join(past, "\n"), F.lit(NEW_QUESTION), F.coalesce("text", F.lit(""))).alias("query"))


def ingest(docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[list[str]], np.ndarray], id_col: str = "doc_id") -> DataFrame:
    """(id, document, metadata keys chunk and doc, vector) of each chunk, to be added to a cosine collection."""
    chunks = embedded(chunk(docs), embed)
    return chunks.select(F.concat_ws("#", F.col(id_col).cast("string"), "chunk").alias("id"), F.col("text").alias("document"), "chunk", F.col(id_col).alias("doc"), "vector")


def retrieve(collection: DataFrame, questions: DataFrame, embed: Callable[[list[str]], np.ndarray], limit: int = 5) -> DataFrame:
    """(query_id, context): the documents of the nearest rows, nearest first, joined by blank lines.

    The collection is read twice, for the search and for the contexts: write it before, if it is computed.
    """
    asked = cut(embedded(questions.select("query_id", "text"), embed, to="query").select("query_id", "query"))
    hits = search(collection, asked, limit, "cosine")
    return contexts(hits, collection, asked)


def retrieve_from(docs: DataFrame, questions: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[list[str]], np.ndarray], limit: int = 5, id_col: str = "doc_id") -> DataFrame:
    """retrieve() over the chunks of docs that aren't stored: neither chunks nor vectors are written.

    Vectors live in the task that scores them; contexts come from the texts that have hits, which are chunked once more.
    """
    asked = cut(embedded(questions.select("query_id", "text"), embed, to="query").select("query_id", "query"))
    key = F.concat_ws("#", F.col(id_col).cast("string"), "chunk").alias("id")
    hits = cut(search(chunk(docs).select(key, "text"), asked, limit, "cosine", vector_col="text", embed=embed))
    named = hits.select(F.regexp_replace("id", "#?[0-9]+$", "").alias("__doc")).distinct()  # of `limit` rows a query
    own = docs.join(named, F.coalesce(F.col(id_col).cast("string"), F.lit("")) == F.col("__doc"), "left_semi")
    return contexts(hits, chunk(own).select(key, F.col("text").alias("document")), asked)


def contexts(hits: DataFrame, collection: DataFrame, asked: DataFrame, id_col: str = "id", document_col: str = "document") -> DataFrame:
    found = hits.select("query_id", "rank", id_col).join(collection.select(id_col, F.col(document_col).alias("__d")), id_col)
    lists = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "__d"))), lambda x: x["__d"]), "\n\n").alias("context"))  # `limit` rows a query
    return asked.select("query_id").join(lists, "query_id", "left").select("query_id", F.coalesce("context", F.lit("")).alias("context"))
