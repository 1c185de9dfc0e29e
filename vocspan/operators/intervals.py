"""Overlap of time intervals within a recording, without windows over whole recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_SECONDS = 600.0
#: No recording is cut into more blocks than this; longer ones get longer blocks.
MAX_BLOCKS = 10_000


def overlap_seconds(intervals: DataFrame, key: str = "video", start: str = "start_s", end: str = "end_s", who: str = "speaker") -> DataFrame:
    """key, union_seconds, metadata_overlap_seconds (two or more intervals active), different_speaker_overlap_seconds (two or more speakers).

    The measures add up over time, so intervals are cut at the borders of blocks and every block is swept on its own; a
    recording of any length is spread over tasks. Equal stamps add nothing. Rows need start < end; a NULL speaker is one speaker.
    """
    longest = intervals.agg(F.greatest(F.max(end) / MAX_BLOCKS, F.lit(BLOCK_SECONDS)).alias("w"))
    width = F.coalesce(longest.scalar(), F.lit(BLOCK_SECONDS))
    base = intervals.select(F.col(key).alias("key"), F.coalesce(F.col(who), F.lit("")).alias("who"), F.col(start).alias("s"), F.col(end).alias("e"), width.alias("w"))
    cut = base.withColumn("block", F.explode(F.sequence(F.floor(F.col("s") / F.col("w")), F.floor(F.col("e") / F.col("w")))))
    cut = cut.select("key", "who", "block", F.greatest("s", F.col("block") * F.col("w")).alias("s"), F.least("e", (F.col("block") + 1) * F.col("w")).alias("e")).filter("s < e")
    # Equal stamps of one speaker are added up before anything is sorted.
    stamps = cut.select("key", "block", "who", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    deltas = stamps.groupBy("key", "block", "who", F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    own = Window.partitionBy("key", "block", "who").orderBy("at")
    active = deltas.withColumn("n", F.sum("d").over(own)).withColumn("before", F.col("n") - F.col("d"))
    talk = active.select("key", "block", "at", "d", ((F.col("n") > 0).cast("int") - (F.col("before") > 0).cast("int")).alias("sd"))
    moments = talk.groupBy("key", "block", "at").agg(F.sum("d").alias("d"), F.sum("sd").alias("sd"))
    run = Window.partitionBy("key", "block").orderBy("at")
    spans = moments.select("key", F.sum("d").over(run).alias("n"), F.sum("sd").over(run).alias("ns"), (F.lead("at").over(run) - F.col("at")).alias("span")).filter("span is not null")
    total = lambda rule, name: F.sum(F.when(rule, F.col("span")).otherwise(0.0)).alias(name)
    return spans.groupBy("key").agg(total(F.col("n") > 0, "union_seconds"), total(F.col("n") >= 2, "metadata_overlap_seconds"), total(F.col("ns") >= 2, "different_speaker_overlap_seconds")).withColumnRenamed("key", key)


def overlap_totals(per_key: DataFrame) -> DataFrame:
    """Hours over all recordings and the overlapping fraction of the union, NULL when there is none."""
    union, both, other = (F.sum(c) for c in ("union_seconds", "metadata_overlap_seconds", "different_speaker_overlap_seconds"))
    return per_key.agg((union / 3600).alias("union_hours"), (both / 3600).alias("overlap_hours"), (other / 3600).alias("different_speaker_hours"), (both / F.nullif(union, F.lit(0.0))).alias("overlap_fraction"))


def disjoint_check(periods: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, violations: periods that start before the previous one has ended."""
    order = Window.partitionBy(key).orderBy(start, end)
    return periods.withColumn("__prev", F.lag(end).over(order)).groupBy(key).agg(F.count_if(F.col(start) <= F.col("__prev")).alias("violations"))
