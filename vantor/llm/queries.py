"""The queries of this subpackage: thin, over whole tables, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.llm import mixing, quality_rules, warc
from vantor.llm.common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantor.llm.toxicity import score_toxicity

    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantor.llm.warc import round_trip

    return round_trip(read(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantor.llm.sharding import shard_table

    return shard_table(read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantor.llm.decontaminate import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantor.llm.line_dedup import dedup_lines

    return dedup_lines(read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantor.llm.license_scan import scan

    return scan(read(spark, sf_dir, "documents")).drop("detections")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantor.llm.quality_classifier import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.filter_rules(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vantor.llm.simhash_dedup import near_duplicates

    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_warc, op3_sharding, op4_decontaminate, op5_mixing, op6_line_dedup, op7_license_scan, op8_quality_classifier, op9_quality_rules, op10_simhash_dedup)}
ORACLE_SQL = {"op2_warc": warc.ORACLE, "op5_mixing": mixing.ORACLE, "op9_quality_rules": quality_rules.ORACLE}
