from __future__ import annotations

import random

import pytest

from vantor.operators.mutations import delete_statuses, latest, live_rows, numbered, partial_statuses, receipts, replacement_rows, statuses


def sequential(ops, live):
    live, out = set(live), []
    for op, i, valid in ops:
        on = i in live
        if not valid:
            out.append("invalid_argument")
        elif op == "delete":
            out.append("deleted" if on else "not_found")
            live.discard(i)
        elif op == "add" and on:
            out.append("already_exists")
        elif op == "replace" and not on:
            out.append("not_found")
        else:
            out.append("inserted" if not on else "replaced" if op == "replace" else "updated")
            live.add(i)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_partial_is_sequential(spark, seed):
    rng = random.Random(seed)
    ops = [(rng.choice(["add", "replace", "upsert", "delete"]), f"k{rng.randrange(12)}", rng.random() > 0.1) for _ in range(150)]
    live = [f"k{k}" for k in range(0, 12, 2)]
    batch = spark.createDataFrame([(p, i, op, v) for p, (op, i, v) in enumerate(ops)], "pos long, id string, op string, valid boolean")
    got = [r.status for r in partial_statuses(batch, spark.createDataFrame([(x,) for x in live], "id string")).orderBy("pos").collect()]
    assert got == sequential(ops, live)


def test_atomic_delete_downgrade(spark):
    live = spark.createDataFrame([("a",), ("b",)], "id string")
    make = lambda ids: spark.createDataFrame([(k, i, "delete") for k, i in enumerate(ids)], "pos long, id string, op string")
    run = lambda ids: [r.status for r in delete_statuses(make(ids), live).orderBy("pos").collect()]
    assert run(["b", "missing", "a"]) == ["deleted", "not_found", "deleted"]
    assert run(["a", "a"]) == ["aborted", "conflict"] and run(["a", "b"]) == ["deleted", "deleted"]
    assert run(["a", "a", "x"]) == ["deleted", "not_found", "not_found"]


def test_atomic_keeps_only_the_first_failure(spark):
    live = spark.createDataFrame([("a",)], "id string")
    batch = spark.createDataFrame([(0, "x", "add", True), (1, "a", "add", True), (2, "y", "replace", True), (3, "x", "add", True), (4, "z", "add", False)], "pos long, id string, op string, valid boolean")
    got = [r.status for r in statuses(batch, live).orderBy("pos").collect()]
    assert got == ["aborted", "already_exists", "aborted", "aborted", "aborted"]
    rows = receipts(statuses(batch, live), 10, 9).orderBy("pos").collect()
    assert [(r.row_op_id, r.visibility_watermark, r.searchable) for r in rows] == [(11 + k, 9, False) for k in range(5)]


def test_versions(spark):
    log = spark.createDataFrame([("b", 1, "write"), ("a", 2, "write"), ("a", 3, "delete"), ("b", 4, "write"), ("c", 5, "write")], "id string, seq long, op string")
    assert sorted(map(tuple, live_rows(log).collect())) == [("b", 4, "write"), ("c", 5, "write")]
    assert sorted(map(tuple, live_rows(log, 2).collect())) == [("a", 2, "write"), ("b", 1, "write")]
    assert latest(log).count() == 3
    assert [(r.row, r.id) for r in replacement_rows(log).orderBy("row").collect()] == [(0, "b"), (1, "c"), (2, "a")]


def test_numbered(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x")
    assert [(r.x, r.n) for r in numbered(rows, ["x"], "n").orderBy("n").collect()] == [(k, k) for k in range(1000)]
    assert numbered(rows.where("false"), ["x"], "n").count() == 0
