"""Per-key results when a few keys hold most rows.

Every measure is algebraic: each map task keeps a bounded hash table of mergeable states (Spark's partial aggregate,
which falls back to sorting and spilling when the table is full) and only one compact state per key and task is shuffled,
so the work of a hot key is spread over all map tasks. All key columns are handled in one scan: a row is laid out
once per key column, before any state is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(df: DataFrame, key_columns: list[str], measures: list[Column]) -> DataFrame:
    """key_column, key_value and the measures for every value of every key column, NULL values included.

    ``measures`` are aliased aggregates with mergeable states (count, sum, min, max, avg, approximate distinct ...).
    Values are compared as text. An empty table gives no rows; other columns are ignored.
    """
    picked = F.array(*[F.struct(F.lit(k).alias("key_column"), F.col(k).cast("string").alias("key_value")) for k in key_columns])
    return df.withColumn("__key", F.explode(picked)).groupBy(F.col("__key.key_column").alias("key_column"), F.col("__key.key_value").alias("key_value")).agg(*measures)


def heavy_keys(df: DataFrame, key_columns: list[str], share: float, measures: list[Column] | None = None) -> DataFrame:
    """The keys with at least ``share`` of all rows (NULL values count as rows, but are no key), with row counts and measures.

    The totals are one row per key column, a proven bound for the broadcast.
    """
    keyed = per_key(df.select(*key_columns) if measures is None else df, key_columns, [F.count(F.lit(1)).alias("n_rows"), *(measures or [])])
    totals = keyed.groupBy("key_column").agg(F.sum("n_rows").alias("total_rows"))
    return keyed.join(F.broadcast(totals), "key_column").filter(F.col("key_value").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("total_rows")))


def exact_distinct_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact distinct values per key: the (key, value) pairs are made distinct first, hashed on both, so a hot key is spread."""
    return df.select(F.col(key).alias("key_value"), F.col(value).alias("__v")).distinct().groupBy("key_value").agg(F.count("__v").alias("n_distinct"))
