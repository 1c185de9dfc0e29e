"""Quantiles, rolling medians and the bins behind plots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocspan.operators.shards import with_group_position

# Edges of the words-per-second histogram.
RATE_BINS = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 7.5, 10.0, 15.0, 25.0, 50.0, 100.0)


def histogram(df: DataFrame, value: str, edges: tuple[float, ...]) -> DataFrame:
    """bin, low, high, n: half-open bins, the last one closed; values outside are not counted, empty bins have 0."""
    v, k = F.col(value), len(edges) - 1
    number = sum(((v >= e).cast("int") for e in edges[1:-1]), F.lit(1))
    counts = df.filter((v >= edges[0]) & (v <= edges[-1])).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.createDataFrame([(i + 1, float(edges[i]), float(edges[i + 1])) for i in range(k)], "bin int, low double, high double")
    return spine.join(F.broadcast(counts), "bin", "left").fillna(0, ["n"])


def equal_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """histogram over ``bins`` equal bins from the smallest to the largest value."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    return histogram(df, value, tuple(low + i * step for i in range(bins)) + (high,))


#: Rows of one piece of a series.
PIECE = 100_000


def rolling_median(df: DataFrame, keys: list[str], order: str, value: str, rows: int = 50, piece: int = PIECE) -> DataFrame:
    """df with rolling: the median of the last ``rows`` values of the group, of fewer at its start. order: unique inside a group.

    A series is cut into pieces that begin with the last rows of the piece before, so a long one is spread over tasks.
    """
    placed = with_group_position(df, keys, [order], "__at")
    own = F.floor(F.col("__at") / piece)
    lent = F.col("__at") % piece >= piece - rows + 1
    pieces = placed.withColumn("__piece", F.explode(F.when(lent, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*keys, "__piece").orderBy("__at").rowsBetween(-(rows - 1), 0)
    return pieces.withColumn("rolling", F.percentile(value, 0.5).over(w)).filter(F.col("__piece") == own).select(*df.columns, "rolling")


def quantiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Exact quantiles with linear interpolation, one column q<n> each; NULL values are left out.

    Values are put in places by ranges of (keys, value), and the two neighbours of every quantile are picked by their places, so
    no group is held by a task.
    """
    known = df.select(*keys, F.col(value).alias("__v")).filter("__v is not null and not isnan(__v)")
    placed = with_group_position(known, keys, ["__v"], "__at")
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    exact = [F.lit(float(q)) * (F.col("__n") - 1) for q in at]
    ends = F.array(*[f(e).cast("long") for e in exact for f in (F.floor, F.ceil)])
    few = placed.join(sizes, same).filter(F.array_contains(ends, F.col("__at").cast("long")))
    pick = lambda place: F.max(F.when(F.col("__at") == place, F.col("__v")))
    parts = few.groupBy(*keys, "__n").agg(*[pick(f(e)).alias(f"__{side}{i}") for i, e in enumerate(exact) for side, f in (("l", F.floor), ("h", F.ceil))])
    mix = lambda i, e: (F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * (e - F.floor(e))).alias(f"q{i + 1}")
    return parts.select(*keys, *[mix(i, e) for i, e in enumerate(exact)])


def worker_time(reports: DataFrame, seconds: str) -> DataFrame:
    """One row: n, total, least and most seconds over the reports of all shards."""
    return reports.agg(F.count(seconds).alias("n"), F.sum(seconds).alias("total"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))


def hexagons(df: DataFrame, x: str, y: str, width: float, height: float) -> DataFrame:
    """cx, cy, n: counts in hexagons whose centres stand ``width`` apart in a row and ``height`` between rows, for a plot of density.

    A point belongs to the nearer one of two shifted lattices' centres. NULLs are left out.
    """
    u, v = F.col(x) / width, F.col(y) / (2 * height)
    a = (F.round(u), F.round(v))
    b = (F.floor(u) + 0.5, F.floor(v) + 0.5)
    far = lambda c: F.pow(u - c[0], 2) + 3 * F.pow(v - c[1], 2)
    first = far(a) < far(b)
    cell = [F.when(first, p).otherwise(q) for p, q in zip(a, b, strict=True)]
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy((cell[0] * width).alias("cx"), (cell[1] * 2 * height).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
