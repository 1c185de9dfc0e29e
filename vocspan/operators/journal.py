"""Journals of attempts: the last state of every key, what is still to do, and the export of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(journal: DataFrame, key: str, order: str) -> DataFrame:
    """The last attempt of every key. The maximum of (order, row) is a partial aggregate: a key that is retried for ever is no hot task."""
    rest = [c for c in journal.columns if c not in (key, order)]
    last = journal.groupBy(key).agg(F.max_by(F.struct(order, *rest), order).alias("x"))
    return last.select(key, "x.*")


def upsert(journal: DataFrame, news: DataFrame, key: str, order: str) -> DataFrame:
    """The journal with the new attempts in place of older ones of their keys."""
    return latest(journal.unionByName(news), key, order)


def pending(rows: DataFrame, state: DataFrame, key: str, done: Column | None = None) -> DataFrame:
    """Rows whose key has no successful state (an empty error); ``done`` widens what counts as settled."""
    settled = F.coalesce(F.col("error"), F.lit("")) == ""
    ready = state.filter(settled if done is None else settled | done).select(key).distinct()
    return rows.join(ready, key, "left_anti")


# The error of a clip that cannot be scored, and the seconds below which no further attempt helps.
SHORT_ERROR, SHORT_SECONDS = "ValueError: Insufficient or invalid audio", 0.25


def settled_short(duration: Column, error: Column, prefix: str = SHORT_ERROR, least: float = SHORT_SECONDS) -> Column:
    """Clips too short to be scored need no further attempt; false where duration or error is missing."""
    return F.coalesce((duration < least) & error.startswith(prefix), F.lit(False))


def reuse(rows: DataFrame, cached: DataFrame, key: str, name: str = "cache_name") -> DataFrame:
    """rows (key, name, ...) with cached: whether the cache has the clip of the key. A key that is cached under another name stops the run.

    cached: key and name of the clips that an earlier run has kept; failed attempts are not among them. A key comes once in it.
    """
    known = cached.select(key, F.col(name).alias("__name"))
    joined = rows.join(known, key, "left")
    same = F.col("__name").isNull() | F.col("__name").eqNullSafe(F.col(name))
    checked = F.when(same, F.col("__name").isNotNull()).otherwise(F.raise_error(F.concat(F.lit("another name is cached for key "), F.col(key).cast("string"))).cast("boolean"))
    return joined.withColumn("cached", checked).drop("__name")


def limited(groups: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """The first n groups by their keys, all without n: an ordered limit. A limit below 1 is an error."""
    if n is not None and n < 1:
        raise ValueError("a limit must be at least 1")
    distinct = groups.select(*keys).distinct()
    return distinct if n is None else distinct.orderBy(*keys).limit(n)


def scope(rows: Column, expected: int, whole: str = "full_tdk", part: str = "subset") -> Column:
    """Label of what a result covers: the whole set if its number of rows is the expected one."""
    return F.when(rows == expected, F.lit(whole)).otherwise(F.lit(part))


def export(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Every row with the text, seconds and error of its key; keys without a state say not_processed."""
    found = state.select(key, F.col("generated_text").alias("journal_text"), F.col("duration_seconds").alias("journal_seconds"), F.coalesce("error", F.lit("")).alias("journal_error"))
    return rows.join(found, key, "left").withColumn("journal_error", F.coalesce("journal_error", F.lit("not_processed")))
