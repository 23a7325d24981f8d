from __future__ import annotations

import numpy as np
import pytest

from vantor.config import CollectionConfig, FlatIndex
from vantor.sources import vecfile
from vantor.sources.vecfile import MatrixFile
from vantor.store import CELL, connect
from vantor.streaming.upsert import change_stream


@pytest.mark.parametrize(("dtype", "kind"), [("float32", "<f4"), ("int32", "<i4"), ("uint8", "u1")])
def test_matrix_round_trip(spark, tmp_path, monkeypatch, dtype, kind):
    spark.dataSource.register(MatrixFile)
    x = np.random.default_rng(0).integers(0, 200, (100, 7)).astype(kind)
    path = str(tmp_path / "m.bin")
    with open(path, "wb") as f:
        f.write(np.array([100, 7], dtype="<i4").tobytes() + x.tobytes())
    df = spark.read.format("matrix").option("dtype", dtype).load(path)
    got = sorted((r.row, list(r.cells)) for r in df.collect())
    assert [r for r, _ in got] == list(range(100)) and np.array_equal(np.array([c for _, c in got]), x)
    part = spark.read.format("matrix").option("dtype", dtype).option("first", "10").option("last", "20").load(path)
    assert sorted(r.row for r in part.collect()) == list(range(10, 20))
    out = str(tmp_path / "o.bin")
    df.repartitionByRange(3, "row").sortWithinPartitions("row").write.format("matrix").option("dtype", dtype).mode("append").save(out)
    assert open(out, "rb").read() == open(path, "rb").read()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m.bin", "o.bin"]


def test_partitions_cover_the_file(tmp_path, monkeypatch):
    path = str(tmp_path / "m.bin")
    with open(path, "wb") as f:
        f.write(np.array([1000, 4], dtype="<i4").tobytes() + np.zeros((1000, 4), dtype="<f4").tobytes())
    monkeypatch.setattr(vecfile, "PARTITION_BYTES", 1600)
    parts = vecfile.MatrixReader({"path": path}).partitions()
    assert [(p.first, p.last) for p in parts] == [(k, k + 100) for k in range(0, 1000, 100)]


def test_change_stream(spark, tmp_path):
    src = str(tmp_path / "changes")
    kind = f"seq long, id string, op string, vector array<float>, document string, metadata map<string,{CELL}>"
    write = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
    with connect(spark, str(tmp_path / "db")) as engine:
        col = engine.create_collection("c", CollectionConfig(2, index=FlatIndex()))
        run = lambda: change_stream(col, spark.readStream.schema(kind).parquet(src), str(tmp_path / "check"), "changes").awaitTermination(120)
        write([(1, "a", "upsert", [0.0, 0.0], "A", {}), (2, "b", "upsert", [1.0, 1.0], "B", {}), (3, "a", "upsert", [2.0, 2.0], "A2", {})])
        run()
        assert sorted((r.id, r.document) for r in col.records().collect()) == [("a", "A2"), ("b", "B")]
        write([(4, "b", "delete", None, None, None), (5, "c", "upsert", [3.0, 3.0], None, None)])
        run()
        run()
        assert sorted((r.id, r.document) for r in col.records().collect()) == [("a", "A2"), ("c", "")]
        keys = [k for k in col._manifest()["keys"] if k.startswith("changes:")]
        assert len(keys) == 3


def test_read_texts(spark, tmp_path):
    from vantor.sources.texts import read_texts

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("one\n two\t three ")
    (tmp_path / "in" / "deep" / "b.md").write_text("# four")
    (tmp_path / "in" / "c.txt").write_text(" \n")
    (tmp_path / "in" / "d.bin").write_text("no")
    assert sorted(r.text for r in read_texts(spark, str(tmp_path / "in")).collect()) == ["# four", "one two three"]
