"""Problem 8: texts into containers of fixed capacity with little unused space, cutting only what exceeds a container.

Best-two-fit: a container is filled greedily with the largest item that fits; then its smallest item is replaced by the
two unpacked items that fill the gap left by it most tightly, as long as that leaves less room. Items are spread by hash
over shards of about ``shard_items`` items, whose number grows with the data; a shard leaves one container partly filled at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspan.llm.tokens import VOCABULARY, token_count
from vocspan.session import cut

SHARD_ITEMS = 20_000


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes are whole numbers from 0 to capacity. Items without size go to the first container."""
    stock = np.bincount(sizes, minlength=capacity + 1)
    stock[0] = 0
    by_size: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable")[::-1]:
        by_size.setdefault(int(sizes[i]), []).append(int(i))
    grid = np.arange(capacity + 1)
    out = np.zeros(len(sizes), np.int64)
    left, number = int(stock.sum()), 0
    # fit[x]: the largest size in stock that is at most x, 0 for none; changed only where a size runs out or comes back.
    fit = np.maximum.accumulate(np.where(stock > 0, grid, 0))

    def take(size: int) -> None:
        stock[size] -= 1
        if stock[size] == 0:
            below = fit[size - 1]
            end = size + int(np.argmax(fit[size:] != size)) if fit[-1] != size else capacity + 1
            fit[size:end] = below

    def put_back(size: int) -> None:
        stock[size] += 1
        if stock[size] == 1:
            np.maximum(fit[size:], size, out=fit[size:])

    while left:
        gap, inside = capacity, []
        while gap and (size := int(fit[gap])):
            inside.append(size)
            take(size)
            gap -= size
        while gap and len(inside):
            small = inside[-1]  # sizes were taken largest first
            room = gap + small
            low = grid[1 : room // 2 + 1]
            low = low[stock[low] > 0]
            if not len(low):
                break
            high = fit[room - low]
            high = np.where((high == low) & (stock[low] < 2), 0, high)
            both = np.where(high > 0, low + high, 0)
            at = int(np.argmax(both))
            if both[at] <= small:
                break
            inside.pop()
            put_back(small)
            for size in (int(high[at]), int(low[at])):
                take(size)
                inside.append(size)
            inside.sort(reverse=True)
            gap = room - int(both[at])
        for size in inside:
            out[by_size[size].pop()] = number
        left -= len(inside)
        number += 1
    return out


def pieces(documents: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key, piece, n_pieces, token_from, token_to: one piece for a text that fits, as many as needed for a longer one."""
    sized = documents.select(F.col(key).alias(key), token_count(F.col(text), path).alias("n")).filter("n is not null")
    n_pieces = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int")
    cut_up = sized.withColumn("n_pieces", n_pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    start = F.col("piece").cast("long") * capacity
    return cut_up.select(key, "piece", "n_pieces", start.alias("token_from"), F.least(start + capacity, F.col("n")).alias("token_to"))


def pack(documents: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """container, key, piece, n_pieces, token_from, token_to, n_tokens of every text.

    NULL texts have no tokens to place and are left out; empty texts take no room and share a container; repeated rows
    are placed again; an empty table gives no containers. Capacity must be positive.
    """
    if capacity is None or capacity < 1:
        raise ValueError("capacity must be at least one token")
    items = cut(pieces(documents, capacity, key, text, path).withColumn("n_tokens", F.col("token_to") - F.col("token_from")))
    shards = max(1, math.ceil(items.count() / shard_items))
    kind = dict(items.dtypes)[key]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", key, "piece"], kind="stable")
        numbers = best_two_fit(pdf["n_tokens"].to_numpy(), capacity)
        return pdf.assign(container=(pdf["shard"].to_numpy().astype("int64") << 32) + numbers).drop(columns="shard")

    schema = f"`{key}` {kind}, piece int, n_pieces int, token_from long, token_to long, n_tokens long, container long"
    # The row's place in the written table is part of the hash: repeated rows and rows without a key are spread as well.
    return items.withColumn("shard", F.pmod(F.xxhash64(key, "piece", F.monotonically_increasing_id()), F.lit(shards))).groupBy("shard").applyInPandas(fill, schema)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """n_containers, n_pieces, n_tokens, fill: the share of all containers' room that is used."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("k"))
    return each.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("k").alias("n_pieces"), F.sum("used").alias("n_tokens"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"))


def found(documents: DataFrame, capacity: int) -> DataFrame:
    """doc_id of the texts that had to be cut."""
    return pack(documents, capacity).filter("n_pieces > 1 and piece = 0").select("doc_id")
