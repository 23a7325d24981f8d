"""Batches of changes against a set of live ids: a status for each row, all or nothing or row by row.

A batch has pos (0, 1, ...), id, op (add, replace, upsert, delete) and optionally valid (false where the row itself is
malformed). live has the column id, of the ids that are live before the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantor.sources.shared import cut

OPS = ("add", "replace", "upsert", "delete")
FAILED = ("already_exists", "not_found", "conflict", "invalid_argument", "aborted")


def _status(live: Column) -> Column:
    """What a row does, given whether its id is live before it."""
    op = F.col("op")
    return (
        F.when(~F.col("valid"), "invalid_argument")
        .when(op == "delete", F.when(live, "deleted").otherwise("not_found"))
        .when((op == "add") & live, "already_exists")
        .when((op == "replace") & ~live, "not_found")
        .when(~live, "inserted")
        .when(op == "replace", "replaced")
        .otherwise("updated")
    )


def _prepared(batch: DataFrame, live: DataFrame) -> DataFrame:
    if "valid" not in batch.columns:
        batch = batch.withColumn("valid", F.lit(True))
    known = live.select(F.col("id").alias("__id"), F.lit(True).alias("__live")).distinct()
    out = batch.join(known, F.col("id") == F.col("__id"), "left").drop("__id")
    return out.withColumn("__live", F.coalesce("__live", F.lit(False)))


def atomic_statuses(batch: DataFrame, live: DataFrame) -> DataFrame:
    """batch with status. The first row that fails keeps its status and all others are aborted; else all succeed.

    Of rows with the same id the later ones are conflicts. The position of the first failure is one aggregate row.
    """
    rows = _prepared(batch, live)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    rows = rows.withColumn("status", F.when(nth > 1, "conflict").otherwise(_status(F.col("__live")))).drop("__live")
    first = rows.where(F.col("status").isin(*FAILED)).agg(F.min("pos").alias("__first"))
    rows = rows.join(F.broadcast(first))  # one row
    kept = F.col("__first").isNull() | (F.col("pos") == F.col("__first"))
    return rows.withColumn("status", F.when(kept, F.col("status")).otherwise("aborted")).drop("__first")


def partial_statuses(batch: DataFrame, live: DataFrame) -> DataFrame:
    """batch with status, rows taken in turn: each sees what earlier rows of the same id did."""
    rows = _prepared(batch, live)
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    left = F.when(F.col("valid") & F.col("op").isin("add", "upsert"), True).when(F.col("valid") & (F.col("op") == "delete"), False)
    now = F.coalesce(F.last(left, ignorenulls=True).over(before), "__live")
    return rows.withColumn("__now", now).withColumn("status", _status(F.col("__now"))).drop("__now", "__live")


def delete_statuses(batch: DataFrame, live: DataFrame) -> DataFrame:
    """Statuses of an atomic delete: with an id that isn't live among them the rows are taken in turn instead."""
    missing = batch.join(live, "id", "left_anti").agg((F.count("*") > 0).alias("__missing"))
    turn = partial_statuses(batch, live).select("pos", F.col("status").alias("__turn"))
    rows = atomic_statuses(batch, live).join(turn, "pos").join(F.broadcast(missing))
    return rows.withColumn("status", F.when(F.col("__missing"), F.col("__turn")).otherwise(F.col("status"))).drop("__turn", "__missing")


def statuses(batch: DataFrame, live: DataFrame, mode: str = "atomic", deletes: bool = False) -> DataFrame:
    if mode == "partial":
        return partial_statuses(batch, live)
    return delete_statuses(batch, live) if deletes else atomic_statuses(batch, live)


def receipts(rows: DataFrame, batch_op_id: int, watermark: int) -> DataFrame:
    """(pos, id, status, batch_op_id, row_op_id, visibility_watermark, searchable): ids count on from the batch's own.

    A row that failed takes an id too, and sees the watermark before the batch.
    """
    done = ~F.col("status").isin(*FAILED)
    op_id = F.lit(batch_op_id) + 1 + F.col("pos")
    return rows.select("pos", "id", "status", F.lit(batch_op_id).alias("batch_op_id"), op_id.alias("row_op_id"), F.when(done, op_id).otherwise(F.lit(watermark)).alias("visibility_watermark"), done.alias("searchable"))


def latest(log: DataFrame, watermark: int | None = None, id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """The last row of each id, of those up to the watermark.

    Found by a narrow aggregate that the rows are joined with, so that payload columns move once, or not at all where
    the caller doesn't select them.
    """
    if watermark is not None:
        log = log.where(F.col(seq_col) <= watermark)
    last = log.groupBy(F.col(id_col).alias("__id")).agg(F.max(seq_col).alias("__seq"))
    return log.join(last, (F.col(id_col) == F.col("__id")) & (F.col(seq_col) == F.col("__seq"))).drop("__id", "__seq")


def live_rows(log: DataFrame, watermark: int | None = None, id_col: str = "id", seq_col: str = "seq", dead: Column | None = None) -> DataFrame:
    """latest() without tombstones."""
    return latest(log, watermark, id_col, seq_col).where(~(F.col("op") == "delete" if dead is None else dead))


def replacement_rows(log: DataFrame, id_col: str = "id", seq_col: str = "seq", dead: Column | None = None) -> DataFrame:
    """latest() with row, as a sealed copy numbers them: live rows first, then tombstones, each in order of id."""
    dead = (F.col("op") == "delete") if dead is None else dead
    rows = latest(log, None, id_col, seq_col).withColumn("is_tombstone", dead)
    return numbered(rows, ["is_tombstone", id_col], "row")


def numbered(rows: DataFrame, order: list[str], name: str, buckets: int = 1024) -> DataFrame:
    """rows with their place in a total order, from 0, without sorting in one task.

    Rows are dealt by range and written, so that they stay where they are; they are counted by partition, and each
    adds those of the partitions before its own.
    """
    spark = rows.sparkSession
    n = max(1, min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sorted_rows = cut(rows.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()))
    local = Window.partitionBy("__p").orderBy(*order)
    counted = sorted_rows.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counted.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = sorted_rows.withColumn("__k", F.row_number().over(local)).join(F.broadcast(before), "__p")  # a row for each partition
    return placed.withColumn(name, (F.col("__before") + F.col("__k") - 1).cast("long")).drop("__p", "__k", "__before")
