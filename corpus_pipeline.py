"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the
last return the columns of documents. Other columns of docs are let go, whatever
their names. An empty table goes through as one. Repeated rows are documents of
their own, except that the join keeps all rows of a doc_id that it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm import jaccard_join, language_id, line_dedup, mixing, packing
from driftlake.llm._common import Scratch, crc_mod

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no letters (so null and empty texts too), or unlike every language learned, go; lang becomes the predicted language."""
    docs = docs.select(COLUMNS)
    models = language_id.fit(docs.where(crc_mod("doc_id", 3) != 1))
    found = docs.withColumn("found", language_id.identify(docs, models)).where(~F.col("found.rejected"))
    return found.withColumn("lang", F.col("found.lang_pred")).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents share go, in every document; no document does, even if nothing of it is left. A null text becomes empty."""
    return line_dedup.dedup_lines(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle Jaccard of 0.8 or more, the smallest doc_id stays; texts without words are linked with nothing, and a null doc_id goes if it is linked to one that has an id."""
    return jaccard_join.first_of_each(docs.select(COLUMNS)).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so not at all or several times; null sources are one source."""
    return mixing.mixed(docs.select(COLUMNS)).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence; a null or empty text is the end token alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The language models and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
