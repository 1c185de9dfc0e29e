"""Continuous periods and gaps of overlapping intervals, without one task per entity.

Starts and ends are ranked independently per entity. With equal ranks i, a gap exists where the start of rank i+1
exceeds the end of rank i; the paired boundaries of neighbouring gaps give the periods. Ranks come from counts: equal
instants are added up first (map-side), an entity is cut into blocks of time, and the rank inside a block is
carried on from the totals of the blocks before it. A block of ``block_ms`` holds at most ``block_ms`` distinct instants,
however many rows or copies an entity has, so no task grows with the largest entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspan.session import cut

BLOCK_MS = 600_000
_EDGE = ("rank", "close_ms", "close_rows", "open_ms", "open_rows")


def _block(ms: Column, block_ms: int) -> Column:
    return F.coalesce(F.floor(ms / block_ms), F.lit(0))


def entity_key(keys: list[str]) -> Column:
    """Two 64-bit hashes of the key columns and of which of them are NULL. Long names are not carried through shuffles."""
    parts = [c for k in keys for c in (F.col(k), F.col(k).isNull())]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def _named(edges: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """edges with the key columns in place of the entity."""
    names = known.select(*keys).distinct().select(entity_key(keys).alias("__entity"), *keys)
    return edges.join(names, F.col("entity") == F.col("__entity")).select(*keys, *[c for c in edges.columns if c != "entity"])


def ranked_boundaries(intervals: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """One row per place between ranks where a period opens or closes.

    Columns: ``entity`` (see entity_key), ``rank`` (rows that lie before), ``close_ms`` and ``close_rows`` (the end of the period before and the
    rows that end there), ``open_ms`` and ``open_rows`` (the start of the next). The first place has no close, the last no open.
    Rows need start < end. NULL keys form an entity of their own.
    """
    # One narrow key for all: never NULL itself, so windows and the join share one partitioning and nothing is inferred that would
    # make two plans of one shuffle.
    entity = entity_key(keys).alias("entity")
    instants = (
        intervals.select(entity, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col(start).alias("ms")), F.struct(F.lit(1).alias("kind"), F.col(end).alias("ms")))).alias("at"))
        .groupBy("entity", F.col("at.kind").alias("kind"), F.col("at.ms").alias("ms"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("block", _block(F.col("ms"), block_ms))
    )
    in_block = Window.partitionBy("entity", "kind", "block").orderBy("ms")
    over_blocks = Window.partitionBy("entity", "kind").orderBy("block")
    totals = instants.groupBy("entity", "kind", "block").agg(F.sum("n").alias("total"))
    carried = totals.select("entity", "kind", "block", (F.sum("total").over(over_blocks) - F.col("total")).alias("before"), F.sum("total").over(Window.partitionBy("entity", "kind")).alias("size"))
    ranked = instants.withColumn("upto", F.sum("n").over(in_block)).join(carried, ["entity", "kind", "block"]).withColumn("upto", F.col("before") + F.col("upto"))
    is_end = F.col("kind") == 1
    paired = (
        ranked.groupBy("entity", F.when(is_end, F.col("upto")).otherwise(F.col("upto") - F.col("n")).alias("rank"))
        .agg(
            F.max(F.when(is_end, F.col("ms"))).alias("close_ms"),
            F.max(F.when(is_end, F.col("n"))).alias("close_rows"),
            F.max(F.when(~is_end, F.col("ms"))).alias("open_ms"),
            F.max(F.when(~is_end, F.col("n"))).alias("open_rows"),
            F.max("size").alias("size"),
        )
    )
    # A start alone at rank 0 opens the first period; an end alone at a rank that no start follows closes the last.
    first = (F.col("rank") == 0) & F.col("open_ms").isNotNull()
    between = F.col("open_ms") > F.col("close_ms")
    return paired.filter(first | between | (F.col("rank") == F.col("size"))).select("entity", *_EDGE)


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", block_ms: int = BLOCK_MS, names: DataFrame | None = None) -> DataFrame:
    """Merged periods and the gaps between them: keys, kind (period or gap), start_ms, end_ms, rows, identical.

    names: the keys of all entities (more do no harm), where they are cheaper to get than from the intervals.

    ``rows`` counts a period's rows; ``identical`` is true when all of them have the same start and end; both are NULL for gaps.
    Touching intervals join. Empty input gives no rows; columns other than the keys and times are ignored.
    """
    # Read twice below, and as small as the result: kept, so that the ranks are computed once.
    edges = cut(ranked_boundaries(intervals, keys, start, end, block_ms)).select("entity", *_EDGE, _block(F.coalesce("open_ms", "close_ms"), block_ms).alias("block"))
    inside = Window.partitionBy("entity", "block").orderBy("rank")
    nxt = F.struct("rank", "close_ms", "close_rows")
    # The edge after the last one of a block is the first of the entity's next block that has any.
    heads = edges.groupBy("entity", "block").agg(F.min(nxt).alias("head"))
    follow = heads.select("entity", "block", F.lead("head").over(Window.partitionBy("entity").orderBy("block")).alias("next_head"))
    linked = edges.withColumn("nxt", F.lead(nxt).over(inside)).join(follow, ["entity", "block"]).withColumn("after", F.coalesce("nxt", "next_head"))
    rows = F.col("after.rank") - F.col("rank")
    period = F.when(
        F.col("open_ms").isNotNull() & F.col("after").isNotNull(),
        F.struct(
            F.lit("period").alias("kind"), F.col("open_ms").alias("start_ms"), F.col("after.close_ms").alias("end_ms"), rows.alias("rows"),
            ((F.col("open_rows") == rows) & (F.col("after.close_rows") == rows)).alias("identical"),
        ),
    )
    gap = F.when(
        F.col("open_ms").isNotNull() & F.col("close_ms").isNotNull(),
        F.struct(F.lit("gap").alias("kind"), F.col("close_ms").alias("start_ms"), F.col("open_ms").alias("end_ms"), F.lit(None).cast("long").alias("rows"), F.lit(None).cast("boolean").alias("identical")),
    )
    return _named(linked.select("entity", F.explode(F.array_compact(F.array(period, gap))).alias("x")).select("entity", "x.*"), intervals if names is None else names, keys)
