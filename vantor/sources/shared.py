"""Tables written to the folder that driver and executors share, and the file operations of a commit."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder: its lineage ends there and its partitions stay as they are."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if found is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="vantor-"))
    return df.checkpoint(eager=True)


class Files:
    """The Hadoop file system under a path: works alike on local disks and in object stores."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)
        self.gateway = spark.sparkContext._gateway

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path)))

    def mkdirs(self, path: str) -> None:
        self.fs.mkdirs(self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = False) -> None:
        stream = self.fs.create(self.path(path), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write text under path in one step; false if another was there first."""
        staged = f"{path}.{self.jvm.java.util.UUID.randomUUID()}.staged"
        self.write(staged, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(path).toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(self.path(staged), self.path(path), options)
        except Exception as e:
            self.delete(staged)
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def rename(self, old: str, new: str) -> None:
        self.fs.rename(self.path(old), self.path(new))
