"""Speaker groups, prototypes, similarity scores, thresholds and the detections made of them."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspan.functions import values as V
from vocspan.operators.gates import gate
from vocspan.operators.periods import periods_and_gaps
from vocspan.operators.shards import with_position
from vocspan.session import cut

# Thresholds of the sweep and the band below the chosen one.
SWEEP = (0.35, 0.40, 0.44, 0.46, 0.48, 0.49, 0.50, 0.52, 0.54, 0.56, 0.60)
NEAR = 0.44


def group_speaker(speaker: Column, row: Column) -> Column:
    """The trimmed label; a missing one is a group of its own row."""
    label = F.trim(F.coalesce(speaker, F.lit("")))
    return F.when(F.lower(label).isin("", "nan", "none", "unknown"), F.concat(F.lit("unlabelled-"), row.cast("string"))).otherwise(label)


def speaker_groups(rows: DataFrame) -> DataFrame:
    """source_row, channel, file, speaker, audio, start_s, end_s, duration of the rows with usable times, with grouped labels."""
    timed = rows.select("source_row", "channel", "file", group_speaker(F.col("speaker"), F.col("source_row")).alias("speaker"), "audio", V.seconds(F.col("start_time")).alias("start_s"), V.seconds(F.col("end_time")).alias("end_s"))
    return timed.filter(V.is_interval(F.col("start_s"), F.col("end_s"))).withColumn("duration", F.col("end_s") - F.col("start_s"))


CHUNK = 4096


def segment_chunks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk, segments (source_row, start_s, end_s) in input order. A chunk covers 4096 input positions, which bounds its list
    whatever the size of the group; the chunks of a group in order are its whole list."""
    chunk = F.floor(F.col("source_row") / CHUNK).alias("chunk")
    return rows.groupBy(*keys, chunk).agg(F.array_sort(F.collect_list(F.struct("source_row", "start_s", "end_s"))).alias("segments"))


def clip_window(start: Column, end: Column, longest: float = 5.0) -> tuple[Column, Column]:
    """The central part of a clip that is longer than allowed."""
    long = end - start > longest
    middle = (start + end) / 2
    return F.when(long, middle - longest / 2).otherwise(start), F.when(long, middle + longest / 2).otherwise(end)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length 1; NULL when it has no direction or is not finite."""
    norm = F.sqrt(dot(vector, vector))
    good = (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    return F.when(good, F.transform(vector, lambda x: x.cast("double") / norm))


def mean_unit(vectors: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """keys, prototype: the mean of the vectors at length 1. A task adds up its batches, so one sum per key and batch is shuffled."""
    kinds = dict(vectors.dtypes)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not pdf.empty:
                groups = pdf.groupby(keys, dropna=False, sort=False)
                sums = [np.sum(np.stack(g[vector].to_numpy()).astype(float), axis=0) for _, g in groups]
                yield groups.size().rename("n").reset_index().assign(s=sums)[[*keys, "n", "s"]]

    parts = vectors.select(*keys, vector).filter(F.col(vector).isNotNull()).mapInPandas(add, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, s array<double>")
    sums = parts.select(*keys, "n", F.posexplode("s").alias("i", "x")).groupBy(*keys, "i").agg((F.sum("x") / F.sum("n")).alias("m"))
    rows = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("z"))
    return rows.select(*keys, unit(F.transform("z", lambda p: p["m"])).alias("prototype"))


# Names of the variants of a reference.
FIRST_HALF, SECOND_HALF, WITHOUT = "first_half", "second_half", "omit_window_"


def leave_one_out(windows: DataFrame, order: str, vector: str) -> DataFrame:
    """variant, prototype of each half of the windows and of all windows but one.

    The sum over all windows, one vector, is known first, and a variant subtracts its own window from it, so nothing is multiplied
    by the number of variants. Windows are numbered by ranges of ``order``, which has to be unique.
    """
    numbered = with_position(windows.select(order, F.col(vector).alias("v")), order, "w")
    sums = numbered.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("double")).alias("t"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    n = sums[0]["n"] if sums else 0
    halves = numbered.withColumn("variant", F.when(F.col("w") < n // 2, F.lit(FIRST_HALF)).otherwise(F.lit(SECOND_HALF)))
    t = F.array(*[F.lit(float(r["t"])) for r in sums]).cast("array<double>")
    rest = F.zip_with("v", t, lambda x, s: (s - x.cast("double")) / F.lit(max(n - 1, 1)))
    omit = numbered.filter(F.lit(n > 1)).select(F.concat(F.lit(WITHOUT), F.col("w").cast("string")).alias("variant"), unit(rest).alias("prototype"))
    return mean_unit(halves, "v", ["variant"]).unionByName(omit)


#: Vectors that are multiplied at once.
BLOCK = 1000


def _packed(vectors: DataFrame, vector: str, block: int = BLOCK) -> DataFrame:
    """matrix (bytes of doubles, row by row), n and rest (the other columns, in Python's own form) of every block of vectors, as they come. NULL vectors are left out."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), block):
                part = pdf.iloc[at : at + block]
                matrix = np.stack(part[vector].to_numpy()).astype("<f8")
                yield pd.DataFrame({"matrix": [matrix.tobytes()], "n": [len(part)], "rest": [pickle.dumps(part.drop(columns=vector).reset_index(drop=True))]})

    return vectors.filter(F.col(vector).isNotNull()).mapInPandas(pack, "matrix binary, n int, rest binary")


def _matrix(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(n, -1)


def cosine_to(vectors: DataFrame, vector: str, prototypes: DataFrame, name: str) -> DataFrame:
    """Every vector (other columns kept, the vector itself not) with its similarity to every prototype, in the column similarity.

    Both sides are packed into blocks of at most 1000 rows, and a task multiplies a block of vectors with a block of prototypes as
    matrices. The prototypes are written once; blocks of vectors meet them partition by partition, however many there are.
    """
    kinds = dict(vectors.dtypes)
    names = [c for c in vectors.columns if c != vector]
    few = cut(_packed(prototypes.select(name, "prototype"), "prototype").select(F.col("matrix").alias("p_matrix"), F.col("n").alias("p_n"), F.col("rest").alias("p_rest")))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rest, labels = pickle.loads(r.rest), pickle.loads(r.p_rest)[name].to_numpy(object)
                product = _matrix(r.matrix, r.n) @ _matrix(r.p_matrix, r.p_n).T
                for i in range(0, r.n, 100):  # a part of the product at a time
                    some = product[i : i + 100]
                    out = rest.iloc[np.repeat(np.arange(i, i + len(some)), r.p_n)].reset_index(drop=True)
                    yield out.assign(**{name: np.tile(labels, len(some)), "similarity": some.ravel()})[[*names, name, "similarity"]]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{name}` {dict(prototypes.dtypes)[name]}, similarity double"
    return _packed(vectors, vector).crossJoin(few).mapInPandas(multiply, schema)  # blocks with blocks


def binned_median(count: Callable[[float, float, int], DataFrame], bins: int = 1 << 16) -> tuple[int, float | None, float | None]:
    """Number, minimum and median of values from -1 to 1 that nobody holds.

    count(low, high, bins) gives bin, n, low, high of the values from low to high, and those below low in bin -1; the bin of the middle
    is divided again until the middle is known. The driver sees the filled bins of one pass.
    """
    n, least, low, high = 0, None, -1.0, 1.0
    while True:
        found = count(low, high, bins).groupBy("bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("bin").collect()
        if least is None:
            if not found:
                return 0, None, None
            n, least = sum(r["n"] for r in found), found[0]["low"]
        middle = []
        for rank in ((n - 1) // 2, n // 2):
            before = 0
            for r in found:
                if rank < before + r["n"]:
                    break
                before += r["n"]
            middle.append(r)
        a, b = middle
        if a["bin"] != b["bin"]:  # neighbours: the last of one bin and the first of the next
            return n, least, (a["high"] + b["low"]) / 2
        if a["low"] == a["high"]:
            return n, least, a["low"]
        low, high = a["low"], a["high"]


def pairwise(vectors: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """n_pairs, min_similarity, median_similarity over the pairs of the windows of one reference.

    Pairs are formed as products of blocks, once per pass of the median, and are counted in the task that forms them. The work is
    the number of pairs, nothing else grows with it. key: unique.
    """
    blocks = cut(_packed(vectors.select(key, vector), vector, block).withColumn("b", F.monotonically_increasing_id()))
    left = blocks.select("matrix", "n", "b")
    right = blocks.select(F.col("matrix").alias("r_matrix"), F.col("n").alias("r_n"), F.col("b").alias("r_b"))

    def count(low: float, high: float, bins: int) -> DataFrame:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    s = _matrix(r.matrix, r.n) @ _matrix(r.r_matrix, r.r_n).T
                    s = s[np.triu_indices(r.n, 1)] if r.b == r.r_b else s.ravel()
                    s = np.clip(s[~np.isnan(s)], -1.0, 1.0)
                    under, s = s[s < low], np.sort(s[(s >= low) & (s <= high)])
                    at = np.minimum(bins - 1, ((s - low) / ((high - low) or 1.0) * bins).astype(np.int64))
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    size = np.diff(np.append(first, len(at)))
                    out = pd.DataFrame({"bin": at[first], "n": size, "low": s[first], "high": s[first + size - 1]})
                    yield pd.concat([out, pd.DataFrame({"bin": [-1], "n": [len(under)], "low": [under.min()], "high": [under.max()]})]) if len(under) else out

        return left.crossJoin(right).filter("b <= r_b").mapInPandas(work, "bin long, n long, low double, high double")  # blocks with blocks

    return vectors.sparkSession.createDataFrame([binned_median(count)], "n_pairs long, min_similarity double, median_similarity double")


def group_similarities(groups: DataFrame, keys: list[str], ids: str, vectors: DataFrame, vector_id: str, vector: str, reference: list[float]) -> DataFrame:
    """keys, similarities (in the order of the ids, NULL where there is no vector), n_missing and median_similarity of every group.

    groups: keys and an array of ids of the clips that stand for the group, at most a handful each. Groups without any vector have
    no median. Vectors are scored first, so only numbers are joined.
    """
    scored = vectors.select(F.col(vector_id).alias("__id"), dot(unit(F.col(vector)), F.array(*[F.lit(float(x)) for x in reference])).alias("s"))
    clips = groups.select(*keys, F.posexplode_outer(ids).alias("at", "__id"))
    parts = clips.join(scored, "__id", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("x"), F.count_if(F.col("at").isNotNull() & F.col("s").isNull()).alias("n_missing"))
    listed = parts.withColumn("similarities", F.transform(F.filter("x", lambda x: x["at"].isNotNull()), lambda x: x["s"]))
    return listed.select(*keys, "similarities", "n_missing", array_median(F.col("similarities")).alias("median_similarity"))


def array_median(values: Column) -> Column:
    """Median of an array, the mean of the middle two for an even number, NULL when empty. NULL entries are left out."""
    s = F.array_sort(F.array_compact(values))
    n = F.size(s)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def close(a: Column, b: Column, absolute: float = 1e-5, relative: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.lit(absolute) + F.lit(relative) * F.abs(b)


def threshold_sweep(scores: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """threshold, n_groups, n_files with at least that median; thresholds that nothing reaches have zeros.

    Each group is counted once, at the highest threshold it reaches, and each file at the best of its groups; running
    sums over the few thresholds give the rest, so scores are not multiplied by thresholds.
    """
    steps = sorted(thresholds)
    level = lambda c: sum(((c >= t).cast("int") for t in steps), F.lit(0))
    known = scores.filter("median_similarity is not null")
    groups = known.groupBy(level(F.col("median_similarity")).alias("l")).agg(F.count(F.lit(1)).alias("g"))
    files = known.groupBy("file").agg(F.max("median_similarity").alias("m")).groupBy(level(F.col("m")).alias("l")).agg(F.count(F.lit(1)).alias("f"))
    spine = scores.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(steps)], "l int, threshold double")
    total = lambda df, n: F.coalesce(F.sum(n), F.lit(0))
    counts = spine.join(F.broadcast(groups), spine["l"] <= groups["l"], "left").groupBy("threshold").agg(total(groups, "g").alias("n_groups"))
    videos = spine.join(F.broadcast(files), spine["l"] <= files["l"], "left").groupBy("threshold").agg(total(files, "f").alias("n_files"))
    return counts.join(videos, "threshold")


def clip_checks(scores: DataFrame, threshold: float = 0.49) -> DataFrame:
    """scores with n_clips_above, all_above (false without clips), n_segments and status (selected, near, rejected, unscorable)."""
    s = F.coalesce("similarities", F.array().cast("array<double>"))
    m = F.col("median_similarity")
    status = F.when(m.isNull(), F.lit("unscorable")).when(m >= threshold, F.lit("selected")).when(m >= NEAR, F.lit("near")).otherwise(F.lit("rejected"))
    return scores.select("channel", "file", "speaker", "median_similarity", F.size(F.filter(s, lambda x: x >= threshold)).alias("n_clips_above"), ((F.size(s) > 0) & (F.array_min(s) >= threshold)).alias("all_above"), F.size("segments").alias("n_segments"), status.alias("status"))


def top_per(rows: DataFrame, key: str, score: str, ties: str, k: int = 3) -> DataFrame:
    """The k best rows of every key with their place; a rank filter, which Spark applies before it shuffles."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc(), ties))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def ranked(scores: DataFrame) -> DataFrame:
    """Groups by falling median, those without one last, ties by their key."""
    return scores.orderBy(F.col("median_similarity").desc_nulls_last(), "channel", "file", "speaker")


def select_groups(scores: DataFrame, threshold: float, note: str) -> DataFrame:
    if not math.isfinite(threshold) or not -1 <= threshold <= 1 or not note.strip():
        raise ValueError("a threshold from -1 to 1 and a note that justifies it are required")
    return scores.filter(F.col("median_similarity") >= threshold)


def unnamed(scores: DataFrame, threshold: float, note: str) -> DataFrame:
    """channel, file, speaker of the selected groups whose recording has no name in the full form, and so no detection."""
    return select_groups(scores, threshold, note).filter(V.video_identity(F.col("file"))[0].isNull()).select("channel", "file", "speaker")


def detections(scores: DataFrame, threshold: float, note: str, strict: bool = False) -> DataFrame:
    """video, start_s, end_s: merged segments of the selected groups of every recording whose name has the full form.

    Segments are merged as whole microseconds; touching ones join. With ``strict`` a selected group whose name has another form
    stops the run; else such groups are left out here and listed by ``unnamed``.
    """
    if strict:
        gate(unnamed(scores, threshold, note).limit(1).isEmpty(), "a selected group has no name in the full form")
    picked = select_groups(scores, threshold, note).withColumn("video", V.video_identity(F.col("file"))[0]).filter("video is not null")
    spans = picked.select("video", F.explode("segments").alias("x")).select("video", F.round(F.col("x")[0] * 1_000_000).cast("long").alias("start_us"), F.round(F.col("x")[1] * 1_000_000).cast("long").alias("end_us"))
    spans = spans.filter((F.col("start_us") >= 0) & (F.col("start_us") < F.col("end_us")))
    merged = periods_and_gaps(spans, ["video"], "start_us", "end_us", block_ms=600_000_000).filter("kind = 'period'")
    return merged.select("video", (F.col("start_ms") / 1_000_000).alias("start_s"), (F.col("end_ms") / 1_000_000).alias("end_s"))


def titles(scores: DataFrame, threshold: float, note: str, known: DataFrame | None = None) -> DataFrame:
    """video, title of every detected recording; a resolved title (video, title) goes before the one in the name."""
    video, title = V.video_identity(F.col("file"))
    own = select_groups(scores, threshold, note).select(video.alias("video"), title.alias("own")).filter("video is not null").groupBy("video").agg(F.min("own").alias("own"))
    if known is None:
        return own.select("video", F.col("own").alias("title"))
    return own.join(known.select("video", "title"), "video", "left").select("video", F.coalesce("title", "own").alias("title"))
