"""FASTA files as tables, by Spark's own text reader: any store it reads, split like text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import header_id, remove_suffix


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """record_id, description, seq, source_file, position: a row for each record; white space in sequences goes, a > inside a header stays."""
    # records begin at a line that begins with >; the first keeps its mark
    text = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("v"), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"))
    text = text.withColumn("n", F.monotonically_increasing_id()).where(F.trim("v") != "")
    header, body = F.trim(F.regexp_extract("v", r"^([^\r\n]*)", 1)), F.regexp_replace(F.regexp_replace("v", r"^[^\r\n]*", ""), r"\s+", "")
    return text.select(header_id(header).alias("record_id"), F.trim(F.regexp_replace(header, r"^\S+", "")).alias("description"), body.alias("seq"), "source_file", F.col("n").alias("position"))


def last_of_each_id(records: DataFrame) -> DataFrame:
    """Where ids repeat, the last record (by file, then position) holds."""
    by = W.partitionBy("record_id").orderBy(F.desc("source_file"), F.desc("position"))
    return records.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def genome_of(records: DataFrame, suffix: str = "_protein.faa") -> DataFrame:
    """records with `genome`: the file's name without its suffix."""
    return records.withColumn("genome", remove_suffix(F.regexp_extract("source_file", r"([^/]*)$", 1), suffix))


def write_fasta(records: DataFrame, path: str) -> None:
    """record_id, seq -> text files; headers are the ids."""
    records.select(F.concat(F.lit(">"), F.col("record_id"), F.lit("\n"), F.col("seq"))).write.mode("overwrite").text(path)
