"""Positions of rows, shards by remainder, and their merge with checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocspan.session import cut


def _ranged(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows cut into sorted ranges and written once, with the number of the range and the place in it, both of which Spark's row id holds."""
    numbered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    return cut(numbered.withColumns({"__part": F.shiftright("__id", 33), "__i": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__id"))


def with_position(rows: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Dense positions from 0 in the order of a unique column, without a window over all rows.

    Rows are cut into ranges; places in a range go on from the sizes of the ranges before it, of which there is one number per task.
    """
    ranged = _ranged(rows, [order])
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    return ranged.join(F.broadcast(before), "__part").select(*rows.columns, (F.col("__i") + F.col("__before")).alias(name))


def with_group_position(rows: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Dense positions from 0 inside every group, in the given order, although one group may hold most rows.

    Rows are cut into ranges of (keys, order), so a hot group lies in many of them; places in a range go on from the sizes of the
    group's parts before it, of which there is one number per range and group.
    """
    ranged = _ranged(rows, [*keys, *order])
    sizes = ranged.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    before = sizes.select(F.col("__part").alias("__p"), *named, (F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n") - F.col("__first")).alias("__before"))
    same = (F.col("__part") == F.col("__p")) & reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return ranged.join(before, same).select(*rows.columns, (F.col("__i") + F.col("__before")).alias(name))


def shard(positioned: DataFrame, index: int, count: int, limit: int | None = None) -> DataFrame:
    """Rows of one shard; with a limit the first ones by position. A limit below 1 and an index out of range are errors."""
    if not 0 <= index < count:
        raise ValueError("shard index out of range")
    if limit is not None and limit < 1:
        raise ValueError("a limit must be at least 1")
    part = positioned.filter(F.col("position") % count == index)
    return part if limit is None else part.orderBy("position").limit(limit)


def assign(positioned: DataFrame, count: int) -> DataFrame:
    """All rows with their shard and their position inside it."""
    return positioned.withColumns({"shard": F.col("position") % count, "local": F.floor(F.col("position") / count)})


def shard_rows(total: int, index: int, count: int) -> int:
    """Rows that a shard must have."""
    return max(0, -(-(total - index) // count))


def merge(shards: list[DataFrame], order: str = "local") -> DataFrame:
    """Shards whose rows have local positions, interleaved to global positions."""
    count = len(shards)
    placed = [s.withColumn("position", F.col(order) * count + i) for i, s in enumerate(shards)]
    return reduce(lambda a, b: a.unionByName(b), placed)


def mismatches(source: DataFrame, merged: DataFrame, columns: list[str], key: str = "position") -> DataFrame:
    """One row: positions that only one side has, and positions whose columns differ (NULLs being equal)."""
    a, b = source.select(key, F.struct(*columns).alias("x")), merged.select(key, F.struct(*columns).alias("y"))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("y").isNull()).alias("missing"), F.count_if(F.col("x").isNull()).alias("surplus"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.col("x").eqNullSafe(F.col("y"))).alias("different"))
