"""Binary matrix files as a data source: a header of two int32, rows and columns, then the cells row by row.

spark.dataSource.register(MatrixFile); spark.read.format("matrix").option("dtype", "float32").load(path). Partitions
are ranges of rows, so one large file is read in parallel; paths are opened through pyarrow's file systems.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a partition, and of a batch in it.
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
HEADER = 8
CELLS = {"float32": ("float", np.dtype("<f4")), "int32": ("int", np.dtype("<i4")), "uint8": ("smallint", np.dtype("u1")), "int8": ("tinyint", np.dtype("i1"))}


def _open(path: str):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where, name


def shape(path: str) -> tuple[int, int]:
    where, name = _open(path)
    with where.open_input_file(name) as f:
        n, dim = np.frombuffer(f.read_at(HEADER, 0), dtype="<i4")
    return int(n), int(dim)


@dataclass
class Rows(InputPartition):
    first: int
    last: int


class MatrixFile(DataSource):
    """Columns: row (long, from 0) and cells (array). Options: dtype, first and last (a slice of rows)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return f"row bigint, cells array<{CELLS[self.options.get('dtype', 'float32')][0]}>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options)


class MatrixReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.dtype = CELLS[options.get("dtype", "float32")][1]
        self.n, self.dim = shape(self.path)
        self.first = int(options.get("first", 0))
        self.last = min(self.n, int(options.get("last", self.n)))

    def partitions(self) -> list[Rows]:
        step = max(1, PARTITION_BYTES // max(1, self.dim * self.dtype.itemsize))
        return [Rows(k, min(self.last, k + step)) for k in range(self.first, self.last, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        width = self.dim * self.dtype.itemsize
        step = max(1, BATCH_BYTES // max(1, width))
        where, name = _open(self.path)
        with where.open_input_file(name) as f:
            for at in range(partition.first, partition.last, step):
                end = min(partition.last, at + step)
                data = f.read_at((end - at) * width, HEADER + at * width)
                if len(data) != (end - at) * width:
                    raise ValueError(f"{self.path} ends before row {end}")
                flat = np.frombuffer(data, dtype=self.dtype)
                flat = flat.astype(np.int16) if self.dtype == np.dtype("u1") else flat
                cells = pa.ListArray.from_arrays(pa.array(np.arange(end - at + 1, dtype=np.int32) * self.dim), pa.array(flat))
                yield pa.record_batch([pa.array(np.arange(at, end)), cells], names=["row", "cells"])


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int
    dim: int
    first: int


class MatrixWriter(DataSourceArrowWriter):
    """Tasks write parts beside the target; the commit joins them in order of their first row under one header.

    The format is one file, so the join is one sequential copy; rows must be sorted by `row` within and across tasks.
    """

    def __init__(self, options) -> None:
        self.path, self.dtype = options["path"], CELLS[options.get("dtype", "float32")][1]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from uuid import uuid4

        where, name = _open(self.path)
        part = f"{name}.part-{uuid4().hex}"
        rows, dim, first = 0, 0, -1
        with where.open_output_stream(part) as out:
            for batch in iterator:
                if batch.num_rows:
                    cells = batch.column(batch.schema.get_field_index("cells"))
                    first = batch.column(batch.schema.get_field_index("row"))[0].as_py() if first < 0 else first
                    out.write(cells.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).tobytes())
                    rows, dim = rows + batch.num_rows, len(cells[0])
        return Part(part, rows, dim, first)

    def commit(self, messages: list) -> None:
        where, name = _open(self.path)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.first)
        dims = {m.dim for m in parts if m.rows}
        if len(dims) > 1:
            raise ValueError("rows differ in length")
        with where.open_output_stream(f"{name}.staged") as out:
            out.write(np.array([sum(m.rows for m in parts), dims.pop() if dims else 0], dtype="<i4").tobytes())
            for m in parts:
                with where.open_input_stream(m.path) as f:
                    while data := f.read(BATCH_BYTES):
                        out.write(data)
        where.move(f"{name}.staged", name)
        self._drop(parts)

    def abort(self, messages: list) -> None:
        self._drop([m for m in messages if m is not None])

    def _drop(self, parts: list[Part]) -> None:
        for m in parts:
            where, _ = _open(self.path)
            where.delete_file(m.path)
