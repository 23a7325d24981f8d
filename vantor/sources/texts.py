"""Text files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.operators.text import normalize_whitespace


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """(path, text): a row for each file under path whose name fits, white space made single spaces; empty ones are left out."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).format("text").load(path)
    rows = files.select(F.col("_metadata.file_path").alias("path"), normalize_whitespace(F.col("value")).alias("text"))
    return rows.where("text <> ''")
