"""Snapshot differencing: which sequences no family matched at T0, and which a new family matches at T1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_version


def new_families(then: DataFrame, now: DataFrame, family: str = "family") -> DataFrame:
    """Families of the later snapshot that the earlier one lacks; a difference of sets, not of counts."""
    return now.select(family).distinct().join(then.select(family).distinct(), family, "left_anti")


def hit_lists(sequences: DataFrame, hits: DataFrame) -> DataFrame:
    """sequences with `families` (sorted, empty where nothing hit) and `n_hits`."""
    lists = hits.groupBy("protein_id").agg(F.sort_array(F.collect_list("family")).alias("families"))
    return sequences.join(lists, "protein_id", "left").withColumn("families", F.coalesce("families", F.array().cast("array<string>"))).withColumn("n_hits", F.size("families").cast("long"))


def snapshot_labels(sequences: DataFrame, hits_then: DataFrame, hits_now: DataFrame, new: DataFrame) -> DataFrame:
    """sequences with dark (no hit at T0), characterised (a versionless hit at T1 among the new families) and positive (both).

    Hits: protein_id, family. Sequences without hits are kept.
    """
    then = hits_then.groupBy("protein_id").agg(F.count("*").alias("n_then"))
    fresh = new.select(F.col("family").alias("bare"))
    now = hits_now.withColumn("bare", strip_version(F.col("family"))).join(fresh, "bare", "left_semi").select("protein_id").distinct().withColumn("new_hit", F.lit(True))
    both = sequences.join(then, "protein_id", "left").join(now, "protein_id", "left")
    dark, seen = F.col("n_then").isNull(), F.coalesce("new_hit", F.lit(False))
    return both.select(*sequences.columns, dark.alias("dark"), seen.alias("characterised"), (dark & seen).alias("positive"))


def summary(labels: DataFrame) -> DataFrame:
    """n, n_dark, n_characterised, n_positive and their shares in percent (null of no rows)."""
    counts = labels.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in ("dark", "characterised", "positive")])
    return counts.select("*", *[F.try_divide(100.0 * F.col(f"n_{c}"), "n").alias(f"pct_{c}") for c in ("dark", "positive")])


def go_no_go(labels: DataFrame, least: int = 50) -> DataFrame:
    """n_positive and what follows from it."""
    return labels.agg(F.count_if("positive").alias("n_positive")).select("n_positive", F.when(F.col("n_positive") >= least, "go").otherwise("widen").alias("decision"))


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def missing_preview(missing: DataFrame, key: str, most: int = 10) -> DataFrame:
    """n_missing, preview: the first keys in order, with `...` if there are more."""
    first = missing.orderBy(key).limit(most).agg(F.array_join(F.sort_array(F.collect_list(key)), ", ").alias("keys"))
    return missing.agg(F.count("*").alias("n_missing")).crossJoin(first).select("n_missing", F.concat("keys", F.when(F.col("n_missing") > most, "...").otherwise("")).alias("preview"))
