"""Quality features and flags of utterances, the held-out rule, the hash split and the reasons for leaving rows out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspan.functions import text as T
from vocspan.functions import values as V
from vocspan.session import cut

REQUIRED = ("channel", "file", "speaker", "start_time", "end_time", "text", "audio")
# Names and bounds of the mismatch counts over rows outside the test split, as conditions on duration, word_count and
# words_per_second. Three names are this library's own (a bound in words, and the plain name of the indicator).
MISMATCHES = {
    "duration_ge5_words_le1": "duration >= 5 and word_count <= 1",
    "duration_ge5_words_le2": "duration >= 5 and word_count <= 2",
    "duration_ge10_words_le3": "duration >= 10 and word_count <= 3",
    "duration_le1_words_ge8": "duration <= 1 and word_count >= 8",
    "duration_le2_words_ge15": "duration <= 2 and word_count >= 15",
    "wps_lt0_5": "words_per_second < 0.5",
    "wps_gt7_5": "words_per_second > 7.5",
    "singlish": "singlish_indicator",
}


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df, or an error at analysis time that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


# The names of the flags, in the order in which a row lists them, and their bounds.
def _flags(valid: Column, d: Column, n: Column, wps: Column, words: Column, text: Column) -> Column:
    fillers = F.array(*[F.lit(w) for w in T.FILLERS])
    rules = (
        ("invalid_timestamp", ~valid),
        ("empty_or_nonlexical_text", n == 0),
        ("short", valid & (d < 0.5)),
        ("long", d > 20),
        ("sparse_text", (d >= 2) & (wps < 0.5)),
        ("extreme_sparse", (d >= 5) & (n <= 1)),
        ("dense_text", wps > 7.5),
        ("filler_only", (n > 0) & (F.size(F.array_except(words, fillers)) == 0)),
        ("repeated_tokens", (n >= 4) & (F.size(F.array_distinct(words)) == 1)),
        ("repeated_characters", T.repeated_character(text)),
    )
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def with_features(rows: DataFrame) -> DataFrame:
    """rows with video, start_s, end_s, valid, duration, word_count, characters, words_per_second, characters_per_second,
    duration_bucket, singlish_indicator and flags (an array in fixed order).

    Rows with unusable times are kept with duration 0; missing text counts as empty.
    """
    out = require(rows, REQUIRED).withColumns({"video": V.video_key(F.col("file")), "start_s": V.seconds(F.col("start_time")), "end_s": V.seconds(F.col("end_time")), "__words": T.feature_words(F.col("text"))})
    out = out.withColumn("valid", V.is_interval(F.col("start_s"), F.col("end_s")))
    d, n = F.col("duration"), F.col("word_count")
    per_second = lambda k: F.when(F.col("valid"), k / d).otherwise(0.0)
    out = out.withColumns({"duration": F.when(F.col("valid"), F.col("end_s") - F.col("start_s")).otherwise(0.0), "word_count": F.size("__words"), "characters": F.char_length(F.coalesce("text", F.lit("")))})
    out = out.withColumns({"words_per_second": per_second(n), "characters_per_second": per_second(F.col("characters"))})
    lexicon = F.array(*[F.lit(w) for w in T.SINGLISH])
    return out.withColumns({
        "duration_bucket": V.bucket(d, V.DURATION_BUCKETS),
        "singlish_indicator": F.arrays_overlap("__words", lexicon),
        "flags": _flags(F.col("valid"), d, n, F.col("words_per_second"), F.col("__words"), F.col("text")),
    }).drop("__words")


def with_holdout(features: DataFrame, channel: str) -> DataFrame:
    """features with held_out: the video or the audio address also occurs in the held-out channel.

    Two marker joins instead of one join on either key; the planner broadcasts a marker side only if it is small enough.
    """
    keyed = features.withColumn("__audio", F.coalesce("audio", F.lit("")))  # a missing address counts as an empty one
    held = keyed.filter(F.col("channel") == channel)
    videos = held.select("video").distinct().withColumn("__v", F.lit(True))
    audio = held.select("__audio").distinct().withColumn("__a", F.lit(True))
    marked = keyed.join(videos, "video", "left").join(audio, "__audio", "left")
    return marked.withColumn("held_out", F.col("__v").isNotNull() | F.col("__a").isNotNull()).drop("__v", "__a", "__audio")


def with_split(features: DataFrame, channel: str, seed: int = 2026, fraction: float = 0.1) -> DataFrame:
    """features with split (test, validation, train) and exclusion_reason (empty when the row is used).

    The first reason that holds counts: held out; unusable time or text; no https audio; an audio address that an earlier row
    outside the held-out part has; a duration outside 0.3 to 20 s. A video's split depends on its hash alone.
    """
    marked = with_holdout(features, channel)
    # The first use of an address is a minimum: partial aggregates, no window over a frequent address.
    firsts = marked.filter(~F.col("held_out")).groupBy("audio").agg(F.min("source_row").alias("__first"))
    out = marked.join(firsts, "audio", "left")
    by_hash = F.when(V.hash_share(str(seed), F.col("video")) < fraction, F.lit("validation")).otherwise(F.lit("train"))
    flagged = F.arrays_overlap("flags", F.array(F.lit("invalid_timestamp"), F.lit("empty_or_nonlexical_text")))
    reason = (
        F.when(F.col("held_out"), F.lit("tdk_holdout"))
        .when(flagged, F.lit("invalid_timestamp_or_empty_text"))
        .when(~F.coalesce(F.col("audio").startswith("https://"), F.lit(False)), F.lit("invalid_audio_url"))
        .when(F.col("source_row") > F.col("__first"), F.lit("duplicate_audio_url"))
        .when((F.col("duration") < 0.3) | (F.col("duration") > 20), F.lit("pilot_duration_outside_0.3_to_20"))
        .otherwise(F.lit(""))
    )
    return out.withColumns({"split": F.when(F.col("held_out"), F.lit("test")).otherwise(by_hash), "exclusion_reason": reason}).drop("__first")


def audit_by(split: DataFrame, *keys: str) -> DataFrame:
    """n_rows, hours and videos by the keys."""
    return split.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("duration") / 3600).alias("hours"), F.count_distinct("video").alias("videos"))


FLAGS = ("invalid_timestamp", "empty_or_nonlexical_text", "short", "long", "sparse_text", "extreme_sparse", "dense_text", "filler_only", "repeated_tokens", "repeated_characters")


def flag_counts(split: DataFrame) -> DataFrame:
    """flag, n_rows over the rows that are not held out, of the flags that occur.

    One aggregate of ten counts, laid out as rows afterwards: exploding the flags would have the optimizer infer a filter on their
    number, for which it computes them once more at the scan.
    """
    counts = split.filter(~F.col("held_out")).agg(*[F.count_if(F.array_contains("flags", name)).alias(name) for name in FLAGS])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("flag"), F.col(name).alias("n_rows")) for name in FLAGS]))
    return counts.select(each.alias("x")).select("x.flag", "x.n_rows").filter("n_rows > 0")


def mismatch_counts(split: DataFrame) -> DataFrame:
    """One row with the number of rows outside the test split and of every mismatch."""
    measures = [F.count_if(F.expr(rule)).alias(name) for name, rule in MISMATCHES.items()]
    return split.filter("split != 'test'").agg(F.count(F.lit(1)).alias("n_rows"), *measures)


def audit(split: DataFrame) -> DataFrame:
    """section, key, n_rows, hours, videos: every count of the audit of with_split in one table, from one pass over the features.

    Sections: channel (all rows), split (rows in use), duration_bucket, exclusion (rows left out), flag (rows not held out) and
    mismatch (rows outside the test split; key n_rows is their number). hours and videos are NULL where a section has none. The
    features are written once and narrow: five short columns and ten bits a row.
    """
    bits = sum((F.when(F.array_contains("flags", name), F.lit(1 << i)).otherwise(F.lit(0)) for i, name in enumerate(FLAGS)), F.lit(0))
    rules = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(MISMATCHES.values())), F.lit(0))
    kept = cut(split.select("channel", "split", "duration_bucket", "exclusion_reason", "video", "duration", "held_out", bits.alias("bits"), rules.alias("rules")))
    none = [F.lit(None).cast("double").alias("hours"), F.lit(None).cast("long").alias("videos")]

    def counted(section: str, rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(section).alias("section"), "key", "n_rows", *none)

    def measured(section: str, rows: DataFrame, key: str) -> DataFrame:
        return audit_by(rows.withColumn("key", F.col(key)), "key").select(F.lit(section).alias("section"), "key", "n_rows", "hours", "videos")

    def stacked(section: str, rows: DataFrame, column: str, names: list[str]) -> DataFrame:
        counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(column).bitwiseAND(F.lit(1 << i)) != 0).alias(n) for i, n in enumerate(names)])
        shown = names if section == "flag" else ["n_rows", *names]
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("n_rows")) for n in shown]))
        return counts.select(each.alias("x")).select(F.lit(section).alias("section"), "x.key", "x.n_rows", *none)

    parts = [
        measured("channel", kept, "channel"),
        measured("split", kept.filter("exclusion_reason = ''"), "split"),
        counted("duration_bucket", kept, "duration_bucket"),
        counted("exclusion", kept.filter("exclusion_reason != ''"), "exclusion_reason"),
        stacked("flag", kept.filter(~F.col("held_out")), "bits", list(FLAGS)).filter("n_rows > 0"),
        stacked("mismatch", kept.filter("split != 'test'"), "rules", list(MISMATCHES)),
    ]
    return reduce(DataFrame.unionByName, parts)
