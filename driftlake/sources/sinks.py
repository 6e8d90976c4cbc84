"""Sinks: manifests, run logs, JSON documents. All append; none reads before it writes, so writers don't meet."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "source string, release string, fetched_at_utc string, files array<struct<path:string,size_bytes:bigint>>, host string, extra map<string,string>"
RUN_LOG = "at timestamp, title string, config string, result string, next_step string, commit string"


def append_manifest(spark: SparkSession, path: str, source: str, release: str, files: dict[str, int | None], host: str = "", extra: dict[str, str] | None = None) -> None:
    """One entry: what was fetched, with sizes (null where a file is missing)."""
    row = spark.createDataFrame([(source, release, None, [(k, v) for k, v in files.items()], host, extra or {})], MANIFEST)
    row.withColumn("fetched_at_utc", F.date_format(F.to_utc_timestamp(F.current_timestamp(), spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def git_commit() -> str:
    """Short hash of the working tree's commit; empty outside of one."""
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip()
    except OSError:
        return ""


def log_run(spark: SparkSession, path: str, title: str, config: str = "", result: str = "", next_step: str = "") -> None:
    row = spark.createDataFrame([(None, title, config, result, next_step, git_commit())], RUN_LOG)
    row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def write_document(table: DataFrame, path: str) -> None:
    """Each row as one JSON document."""
    table.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
