"""Planning and progress of ranged transfers, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def byte_ranges(files: DataFrame, part_bytes: int, total: str = "total", done: str = "done", first: str = "next_part") -> DataFrame:
    """files with part_number, start, end (inclusive): the parts from the first undone byte on; none where all is done."""
    n = F.ceil((F.col(total) - F.col(done)) / part_bytes).cast("int")
    part = F.explode(F.sequence(F.lit(0), n - 1))
    rows = files.where(F.col(total) > F.col(done)).withColumn("__k", part)
    start = F.col(done) + F.col("__k").cast("long") * part_bytes
    return rows.select("*", (F.col(first) + F.col("__k")).cast("long").alias("part_number"), start.alias("start"), (F.least(start + part_bytes, F.col(total)) - 1).alias("end")).drop("__k")


def resume_points(parts: DataFrame, key: str) -> DataFrame:
    """key, done (bytes so far), next_part."""
    return parts.groupBy(key).agg(F.sum("size").alias("done"), (F.max("part_number") + 1).alias("next_part"))


def progress(events: DataFrame, key: str, time: str, size: str, total: str) -> DataFrame:
    """events with done, rate (since the event before, null at the first), percent and eta (seconds; infinite at rate 0)."""
    by = W.partitionBy(key).orderBy(time, "event_id")
    done = F.sum(size).over(by.rowsBetween(W.unboundedPreceding, 0))
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    rows = events.withColumn("done", done).withColumn("elapsed", seconds - F.lag(seconds).over(by))
    rate = F.when(F.col("elapsed").isNotNull(), F.coalesce(F.try_divide(F.col(size), "elapsed"), F.lit(0.0)))
    rows = rows.withColumn("rate", rate).withColumn("percent", F.try_divide(100.0 * F.col("done"), total))
    left = F.col(total) - F.col("done")
    return rows.withColumn("eta", F.when(F.col("rate") > 0, left / F.col("rate")).when(F.col("rate").isNotNull(), float("inf")))


def reports(events: DataFrame, key: str, time: str, size: str, gap_seconds: float = 30.0) -> DataFrame:
    """One row for each report: key, report, time, done, rate; a report is due when more than the gap has gone since the last.

    Reports depend on each other, so each key's events are folded in order; the
    fold keeps one state, and a key's events are one transfer's.
    """
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(seconds.alias("t"), F.col("event_id").alias("e"), F.col(size).cast("double").alias("b")))).alias("ev"))
    start = F.struct(F.get("ev", F.lit(0))["t"].alias("last"), F.lit(0.0).alias("done"), F.lit(0.0).alias("base"), F.array().cast("array<struct<t:double,done:double,rate:double>>").alias("out"))

    def step(s, e):
        done, gone = s["done"] + e["b"], e["t"] - s["last"]
        due = gone > gap_seconds
        row = F.struct(e["t"].alias("t"), done.alias("done"), ((done - s["base"]) / gone).alias("rate"))
        return F.when(due, F.struct(e["t"].alias("last"), done.alias("done"), done.alias("base"), F.concat(s["out"], F.array(row)).alias("out"))).otherwise(F.struct(s["last"].alias("last"), done.alias("done"), s["base"].alias("base"), s["out"].alias("out")))

    folded = ordered.select(key, F.aggregate("ev", start, step)["out"].alias("out"))
    return folded.select(key, F.posexplode("out").alias("report", "r")).select(key, (F.col("report") + 1).cast("long").alias("report"), "r.*")
