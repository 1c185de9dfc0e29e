"""Samples by hash: bottom-k per group, capped pools, spread representatives, a greedy budget and a uniform sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspan.functions.text import once
from vocspan.session import cut


def bottom_k(rows: DataFrame, keys: list[str], k: int = 128, seed: int = 2026) -> DataFrame:
    """The k rows of every group with the smallest SHA-256 of 'seed/source_row', with rank 1..k; ties by source_row downwards.

    A rank filter lets Spark keep k rows per group and task before it shuffles.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}/"), F.col("source_row").cast("string")), 256)
    order = Window.partitionBy(*keys).orderBy(F.col("priority"), F.col("source_row").desc())
    return rows.withColumn("priority", h).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def clip_pool(rows: DataFrame, keys: list[str], size: int = 24, shortest: float = 2.0, longest: float = 15.0) -> DataFrame:
    """Candidates per group with place 1..: in input order while they fit, else the ``size`` smallest by the hash of the address."""
    fit = rows.filter(F.col("duration").between(shortest, longest)).withColumn("__h", F.sha2(F.coalesce("audio", F.lit("")), 256))
    hashed = Window.partitionBy(*keys).orderBy("__h", "source_row")
    few = fit.withColumn("__r", F.row_number().over(hashed)).filter(F.col("__r") <= size + 1)
    over = F.max("__r").over(Window.partitionBy(*keys)) > size
    marked = few.withColumn("__over", over).filter(F.col("__r") <= size)
    by_row = F.row_number().over(Window.partitionBy(*keys).orderBy("source_row"))
    return marked.withColumn("place", F.when(F.col("__over"), F.col("__r")).otherwise(by_row)).drop("__h", "__r", "__over")


def longest_clip(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The longest clip of every group, the first one on ties."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct("source_row", "start_s", "duration"), F.struct(-F.col("duration"), F.col("source_row"))).alias("x")).select(*keys, "x.*")


def _best(pool: Column, chosen: Column) -> Column:
    """The clip farthest in time from those chosen; the first of the pool on ties."""
    free = F.filter(pool, lambda x: ~F.exists(chosen, lambda y: y["place"] == x["place"]))
    ranked = F.transform(free, lambda x: F.struct((-F.array_min(F.transform(chosen, lambda y: F.abs(x["start_s"] - y["start_s"])))).alias("k"), x["place"].alias("place"), x.alias("clip")))
    return F.get(F.array_sort(ranked), F.lit(0))["clip"]


def _with_next(n: int) -> Callable[[Column], Column]:
    """Pool and choice with one more clip, if the pool has more than n."""

    def step(x: Column) -> Column:
        more = F.concat(x["c"], F.array(_best(x["p"], x["c"])))
        return F.struct(x["p"].alias("p"), F.when(F.size(x["p"]) > n, more).otherwise(x["c"]).alias("c"))

    return step


def representatives(rows: DataFrame, keys: list[str], size: int = 24, shortest: float = 2.0, longest: float = 15.0) -> DataFrame:
    """keys, pick (1..3), source_row: the clip of most usable length up to 5 s, then twice the farthest from those chosen.

    A group without a clip of fitting length has its longest clip. Pools hold at most ``size`` clips, so the arrays are small.
    """
    pools = clip_pool(rows, keys, size, shortest, longest).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "start_s", "duration", "source_row"))).alias("pool"))
    spare = longest_clip(rows, keys).select(*keys, F.array(F.struct(F.lit(1).alias("place"), "start_s", "duration", "source_row")).alias("fallback"))
    same = [pools[k].eqNullSafe(spare[k]) for k in keys]
    group = spare.join(pools, same, "left").select(*[spare[k] for k in keys], F.coalesce("pool", "fallback").alias("pool"))
    ordered = F.transform("pool", lambda x: F.struct((-F.least(x["duration"], F.lit(5.0))).alias("k"), x["place"].alias("place"), x.alias("clip")))
    state = F.struct(F.col("pool").alias("p"), F.array(F.get(F.array_sort(ordered), F.lit(0))["clip"]).alias("c"))
    for n in (1, 2):
        state = once(state, _with_next(n))
    group = group.select(*keys, state["c"].alias("c"))
    return group.select(*keys, F.posexplode("c").alias("pick", "clip")).select(*keys, (F.col("pick") + 1).alias("pick"), F.col("clip.source_row").alias("source_row"))


def greedy_budget(ranked: DataFrame, hours: float, seed: int = 2026) -> DataFrame:
    """Rows of bottom_k (channel, video, rank, source_row, duration) that a round-robin over each channel's videos takes.

    Every channel has an equal part of the hours. Rows are visited rank by rank, videos in the order of their hash; a row is
    taken if it still fits, else skipped. A fold over at most (videos * k) rows per channel, streamed in sorted order: the
    work of a channel is one pass that holds one number.
    """
    if hours <= 0:
        raise ValueError("hours must be positive")
    visit = ranked.select("channel", "video", "rank", "source_row", "duration").withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}/"), F.col("video")), 256))
    visit = cut(visit)  # at most k rows a video, read for the number of channels and for the fold
    channels = max(1, visit.select("channel").distinct().count())
    target = hours * 3600 / channels

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, left = None, 0.0
        for pdf in batches:
            if pdf.empty or (pdf["channel"].iloc[0] == channel == pdf["channel"].iloc[-1] and pdf["duration"].min() > left):
                continue  # nothing in it fits any more
            keep = []
            for c, d in zip(pdf["channel"], pdf["duration"], strict=True):
                if c != channel:
                    channel, left = c, target
                take = d <= left
                left -= d if take else 0.0
                keep.append(take)
            yield pdf.loc[keep, ["channel", "video", "rank", "source_row", "duration"]]

    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("channel", "video", "rank", "source_row", "duration"))
    return visit.repartition("channel").sortWithinPartitions("channel", "rank", "__h", "video").mapInPandas(fold, schema)


def budget_report(selected: DataFrame, candidates: DataFrame, hours: float) -> DataFrame:
    """channel, hours, target_hours, enough: whether at least 95 % of the target is filled."""
    channels = candidates.select("channel").distinct()
    used = selected.groupBy("channel").agg(F.sum("duration").alias("s"))
    target = F.lit(hours) / F.count(F.lit(1)).over(Window.partitionBy())
    out = channels.join(used, "channel", "left").select("channel", (F.coalesce("s", F.lit(0.0)) / 3600).alias("hours"), target.alias("target_hours"))
    return out.withColumn("enough", F.col("hours") >= 0.95 * F.col("target_hours"))


def uniform_sample(rows: DataFrame, n: int, key: str, seed: int = 2026) -> DataFrame:
    """n rows, each equally likely: the smallest SHA-256 of 'seed/key', kept by every task before they meet."""
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")), 256), key).limit(n)
