"""A stream of changes into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vantor.operators.mutations import numbered
from vantor.store import Collection


def change_stream(collection: Collection, changes: DataFrame, checkpoint: str, query_name: str, available_now: bool = True) -> StreamingQuery:
    """Apply a stream of (seq, id, op upsert or delete, vector, document, metadata) to a collection, exactly once.

    Of a batch's changes to one id the last by seq counts. Each micro-batch has an idempotency key of its own, so that
    a batch that is run again after a failure returns the receipts it had.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("id").agg(F.max("seq").alias("__seq")).withColumnRenamed("id", "__id")
        rows = batch.join(last, (F.col("id") == F.col("__id")) & (F.col("seq") == F.col("__seq"))).drop("__id", "__seq")
        rows = rows.dropDuplicates(["id"])
        for op in ("upsert", "delete"):
            part = rows.where(F.col("op") == op)
            if part.limit(1).count():
                part = numbered(part.select("id", *(["vector", "document", "metadata"] if op == "upsert" else [])), ["id"], "pos")
                collection.write(part, op, "partial", f"{query_name}:{batch_id}:{op}")

    writer = changes.writeStream.queryName(query_name).option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
