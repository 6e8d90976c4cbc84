"""Operator 2: mixing sources to target weights, by hash-threshold histograms.

Every document has a fixed 60-bit hash. Words are summed by source and hash
bucket; running sums over a source's buckets show in which bucket its budget
ends, and only that bucket is divided again, until it holds one hash value.
Documents below the threshold get one copy more than the rest. A larger budget
always keeps what a smaller one keeps, and no document is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD, Scratch, free

#: Bits of the hash, and bits by which a bucket is divided at each level.
BITS, STEP = 60, 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the md5 of the id's text, a line end and the text (null: empty)."""
    whole = F.concat_ws("\n", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """source, source_size -> and target: water-filling, one row for each source.

    With sources by size over weight, the first at which an equal share of what
    is left stays below its cap sets the level for it and all later ones.
    """
    one = W.partitionBy(F.lit(1))
    turn = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights) + 1))
    cap = most * F.col("source_size").cast("double")
    order = one.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(one).cast("double") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double")) / F.sum("weight").over(after)
    leveled = weighted.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= cap)
    final = F.min(F.when(F.col("free") & (F.col("source_size") > 0), F.struct(F.col("source_size") / F.col("weight"), F.coalesce("source", F.lit("")), "level"))).over(one)["level"]
    return leveled.withColumn("final", final).select("source", "source_size", F.coalesce(F.least(cap, F.col("final") * F.col("weight")), cap).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame, scratch: Scratch) -> DataFrame:
    """For each source: how many whole rounds it takes (`rounds`), and the `threshold` below which documents get one more.

    rows: source, hash, size. Each level reads only rows of the open buckets.
    """
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("rounds", ratio).withColumn("left", F.col("target") - F.col("rounds") * F.col("source_size"))
    state = scratch.write(state.select(*goals.columns, "rounds", F.col("left").cast("double"), F.lit(0).cast("long").alias("low"), F.lit(False).alias("done")))
    for level in range(1, BITS // STEP + 1):
        width = 1 << (BITS - STEP * level)
        open_ = state.where(~F.col("done")).select(F.col("source").alias("s"), "low")
        inside = rows.join(open_, F.col("source").eqNullSafe(F.col("s"))).where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + width * (1 << STEP)))
        histogram = inside.groupBy("source", "low", F.floor((F.col("hash") - F.col("low")) / width).cast("int").alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("first"), F.max("hash").alias("last"))
        by = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        sums = histogram.withColumn("before", F.coalesce(F.sum("words").over(by), F.lit(0)))
        sums = sums.withColumnRenamed("source", "s").drop("low")
        # the bucket in which the budget ends; none: all of the open bucket is taken
        at = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").where(F.col("done") | F.col("bucket").isNull() | ((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("words"))))
        keep = F.col("done") | F.col("bucket").isNull()
        single = F.col("first") == F.col("last")
        # one hash value is left: it goes in if that brings the sum nearer to the budget
        closed = F.col("first") + F.when(F.col("left") - F.col("before") >= F.col("words") / 2, 1).otherwise(0)
        found = at.select(
            *goals.columns, "rounds",
            F.when(keep, F.col("left")).otherwise(F.col("left") - F.col("before")).alias("left"),
            F.when(keep, F.col("low")).when(single, closed).otherwise(F.col("low") + F.col("bucket") * width).cast("long").alias("low"),
            (keep | single).alias("done"),
        )
        # a source whose budget takes every word keeps its top
        missing = state.join(found.select(F.col("source").alias("s2")), F.col("source").eqNullSafe(F.col("s2")), "left_anti").withColumn("low", F.lit(1 << BITS)).withColumn("done", F.lit(True))
        state = scratch.write(found.unionByName(missing.select(found.columns)))
        if not state.where(~F.col("done")).limit(1).count():
            break
    return state.select(*goals.columns, "rounds", F.col("low").alias("threshold"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, goals). rows: doc_id, source, size, hash of each row; goals: source, source_size, target, rounds, threshold.

    A row is taken `rounds` times, and once more if its hash is below the
    threshold. A null text has size 0; null sources are one source, the last.
    Rows of a source with the same doc_id and text are taken together. Other
    columns are not read. An empty table gives no rows and no goals.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.write(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), row_hash(F.col(doc_id), F.col(text)).alias("hash")))
    goals = scratch.write(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    return rows, scratch.write(thresholds(rows, goals, scratch))


def copies() -> Column:
    return F.col("rounds") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)


def taken(docs: DataFrame, **args) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every row; see `mix`."""
    rows, goals = mix(docs, **args)
    both = rows.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **args) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken; all columns stay."""
    _, goals = mix(docs, doc_id=doc_id, text=text, source=source, **args)
    goal, copy = free(docs, "__goal"), free(docs, "__copy")
    goals = goals.select(F.struct(F.col("source").alias("s"), "rounds", "threshold").alias(goal))
    both = docs.join(goals, F.col(source).eqNullSafe(F.col(goal)["s"]))
    n = F.col(goal)["rounds"] + F.when(row_hash(F.col(doc_id), F.col(text)) < F.col(goal)["threshold"], 1).otherwise(0)
    return both.withColumn(copy, F.explode(F.array_repeat(F.lit(True), n.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
