"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"
#: Words between ASCII white space.
WORD = f"[^{SPACE}]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a temporary one."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="vantor-"))
    return found or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lineage ends, a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(*frames: DataFrame) -> None:
    """Give back the disk of steps that are done: the files of frames, which cut() wrote, and shuffles that nothing refers to.

    Nothing may read the frames afterwards. Spark drops shuffles when the driver collects its garbage, which it seldom does.
    """
    context = frames[0].sparkSession.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    for df in frames:
        path = jvm.org.apache.hadoop.fs.Path(df._jdf.logicalPlan().rdd().getCheckpointFile().get())
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may use: crc32 of the id's digits, modulo five, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def let(value: Column, body) -> Column:
    """Bind value once for body, where the optimizer would compute it at each mention inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def labelled_sample(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most `bound` rows (doc_id, label): those outside the held-out fold with the smallest hash of their id.

    Rows without an id or a label are left out; of repeated ids the largest label counts.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


#: Rows of a few numbers that may be sent to every task.
SMALL = 1 << 20


def sized(df: DataFrame, bound: int = SMALL) -> DataFrame:
    """df, marked to be sent to every task if it has few enough rows; else joins shuffle it. Cut it before: it is counted."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
