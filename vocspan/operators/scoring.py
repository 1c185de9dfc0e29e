"""Word and character error rates of transcripts: per row, pooled, per recording, sliced, compared and bootstrapped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocspan.functions import text as T
from vocspan.functions import values as V
from vocspan.operators.shards import with_position
from vocspan.session import cut

MEASURES = ("base_word_edits", "ft_word_edits", "reference_words", "base_char_edits", "ft_char_edits", "reference_characters")


def ratio(top: Column, bottom: Column) -> Column:
    """NULL where there is nothing to divide by."""
    return top / F.nullif(bottom, F.lit(0))


def succeeded(error: str) -> Column:
    """An empty error column means success."""
    return F.coalesce(F.col(error), F.lit("")) == ""


def score_rows(rows: DataFrame, prediction: str, error: str) -> DataFrame:
    """rows with ok, word_edits, reference_words, character_edits, reference_characters, wer, cer in canonical form.

    Rows with an error have NULL measures; an empty reference has the hypothesis' length as edits and NULL rates.
    """
    out = rows.withColumns({"ok": succeeded(error), "__r": T.canonical_text(F.col("text")), "__h": T.canonical_text(F.col(prediction))})
    only = lambda c: F.when(F.col("ok"), c)
    out = out.withColumns({
        "word_edits": only(T.word_edits(F.col("__r"), F.col("__h"))), "reference_words": only(T.word_count(F.col("__r"))),
        "character_edits": only(T.character_edits(F.col("__r"), F.col("__h"))), "reference_characters": only(F.char_length(F.replace("__r", F.lit(" "), F.lit("")))),
    })
    return out.withColumns({"wer": ratio(F.col("word_edits"), F.col("reference_words")), "cer": ratio(F.col("character_edits"), F.col("reference_characters"))}).drop("__r", "__h")


def score_corpus(scored: DataFrame) -> DataFrame:
    """One row of counts, pooled rates (sum of edits by sum of units) and coverage of score_rows."""
    sums = [F.sum(c).alias(c) for c in ("word_edits", "reference_words", "character_edits", "reference_characters")]
    total = scored.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("ok").alias("scored"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("reference_words") == 0).alias("empty_references"), *sums)
    return total.withColumns({"corpus_wer": ratio(F.col("word_edits"), F.col("reference_words")), "corpus_cer": ratio(F.col("character_edits"), F.col("reference_characters")), "coverage": F.coalesce(ratio(F.col("scored"), F.col("n_rows")), F.lit(0.0))})


def simple_score(rows: DataFrame, prediction: str, error: str) -> DataFrame:
    """n_rows, word_edits, reference_words, corpus_wer over successful rows with the plain normal form; rate 0 without words."""
    good = rows.filter(succeeded(error)).select(T.simple_text(F.col("text")).alias("r"), T.simple_text(F.col(prediction)).alias("h"))
    total = good.select(T.word_edits(F.col("r"), F.col("h")).alias("e"), T.word_count(F.col("r")).alias("n")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("e").alias("word_edits"), F.sum("n").alias("reference_words"))
    return total.withColumn("corpus_wer", F.coalesce(ratio(F.col("word_edits"), F.col("reference_words")), F.lit(0.0)))


def simple_pairs(rows: DataFrame, base: str, tuned: str) -> DataFrame:
    """rows with base_word_edits, ft_word_edits, reference_words of the plain normal form."""
    out = rows.withColumns({"__r": T.simple_text(F.col("text")), "__b": T.simple_text(F.col(base)), "__f": T.simple_text(F.col(tuned))})
    return out.withColumns({"base_word_edits": T.word_edits(F.col("__r"), F.col("__b")), "ft_word_edits": T.word_edits(F.col("__r"), F.col("__f")), "reference_words": T.word_count(F.col("__r"))}).drop("__r", "__b", "__f")


def pair_rows(rows: DataFrame, base: str = "generated_text", tuned: str = "generated_text_ft", errors: tuple[str, str] = ("asr_error", "asr_error_ft")) -> DataFrame:
    """Rows that both models transcribed, with the six measures of MEASURES in canonical form."""
    both = rows.filter(succeeded(errors[0]) & succeeded(errors[1]))
    out = both.withColumns({"__r": T.canonical_text(F.col("text")), "__b": T.canonical_text(F.col(base)), "__f": T.canonical_text(F.col(tuned))})
    return out.withColumns({
        "base_word_edits": T.word_edits(F.col("__r"), F.col("__b")), "ft_word_edits": T.word_edits(F.col("__r"), F.col("__f")), "reference_words": T.word_count(F.col("__r")),
        "base_char_edits": T.character_edits(F.col("__r"), F.col("__b")), "ft_char_edits": T.character_edits(F.col("__r"), F.col("__f")), "reference_characters": F.char_length(F.replace("__r", F.lit(" "), F.lit(""))),
    }).drop("__r", "__b", "__f")


def left_out(rows: DataFrame, errors: tuple[str, str] = ("asr_error", "asr_error_ft")) -> DataFrame:
    """One row: n_rows that pair_rows keeps and left_out ones, for which a model failed. gates.both_succeeded stops where there are any."""
    both = succeeded(errors[0]) & succeeded(errors[1])
    return rows.agg(F.count_if(both).alias("n_rows"), F.count_if(~both).alias("left_out"))


def by_file(pairs: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Sums of the measures per recording, with the row that comes first."""
    return pairs.groupBy("file").agg(F.min("source_row").alias("first_row"), *[F.sum(c).alias(c) for c in measures if c in pairs.columns])


def paired_totals(files: DataFrame) -> DataFrame:
    """One row: videos, pooled rates of both models, their difference and the relative reduction (NULL without base edits)."""
    t = files.agg(F.count(F.lit(1)).alias("videos"), *[F.sum(c).alias(c) for c in MEASURES])
    w, c = F.col("reference_words"), F.col("reference_characters")
    be, fe = F.col("base_word_edits"), F.col("ft_word_edits")
    return t.select("videos", ratio(be, w).alias("base_wer"), ratio(fe, w).alias("ft_wer"), ratio(F.col("base_char_edits"), c).alias("base_cer"), ratio(F.col("ft_char_edits"), c).alias("ft_cer"), ratio(fe - be, w).alias("delta_wer"), ratio(be - fe, be).alias("relative_wer_reduction"))


def error_slices(pairs: DataFrame) -> DataFrame:
    """slice (all and every duration bucket), n_rows, words, edits and rates of both models; rows with usable times only."""
    timed = pairs.withColumns({"__s": V.seconds(F.col("start_time")), "__e": V.seconds(F.col("end_time"))}).filter(V.is_interval(F.col("__s"), F.col("__e")))
    cut = timed.withColumn("bucket", V.bucket(F.col("__e") - F.col("__s"), V.SLICE_BUCKETS))
    sets = cut.groupingSets([[], ["bucket"]], "bucket").agg(F.grouping("bucket").alias("g"), F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(c) for c in ("reference_words", "base_word_edits", "ft_word_edits")])
    name = F.when(F.col("g") == 1, F.lit("all")).otherwise(F.concat(F.lit("duration:"), F.col("bucket")))
    return sets.select(name.alias("slice"), "n_rows", F.col("reference_words").alias("words"), F.col("base_word_edits").alias("base_edits"), F.col("ft_word_edits").alias("ft_edits"), ratio(F.col("base_word_edits"), F.col("reference_words")).alias("base_wer"), ratio(F.col("ft_word_edits"), F.col("reference_words")).alias("ft_wer"))


def outcome(base: Column, tuned: Column) -> Column:
    return F.when(tuned < base, F.lit("improved")).when(tuned > base, F.lit("regressed")).otherwise(F.lit("unchanged"))


def outcomes(pairs: DataFrame) -> DataFrame:
    """level (row or video), outcome, n."""
    label = outcome(F.col("base_word_edits"), F.col("ft_word_edits")).alias("outcome")
    count = lambda df, level: df.select(F.lit(level).alias("level"), label).groupBy("level", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return count(pairs, "row").unionByName(count(by_file(pairs, ("base_word_edits", "ft_word_edits")), "video"))


def edits_from_rate(rate: Column, words: Column) -> Column:
    """Whole edits recovered from a rate: rounded half to even."""
    return F.bround(rate * words, 0).cast("long")


def examples(pairs: DataFrame, k: int = 8, least_words: int = 5) -> DataFrame:
    """kind, place, source_row, base_word_edits, ft_word_edits, reference_words of the k largest changes of the row rate each way.

    Ties: improvements in input order, regressions in reverse. Both are ordered limits, not full sorts.
    """
    delta = (F.col("ft_word_edits") - F.col("base_word_edits")) / F.col("reference_words")
    # The edits are costly and both directions look at them: computed once, four numbers a row.
    pool = cut(pairs.select("source_row", "base_word_edits", "ft_word_edits", "reference_words")).filter(F.col("reference_words") >= least_words).withColumn("delta", delta)

    def top(kind: str, rule: str, order: list[Column]) -> DataFrame:
        few = pool.filter(rule).orderBy(*order).limit(k)
        place = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
        return few.withColumn("kind", F.lit(kind)).withColumn("place", place)

    better = top("improvement", "ft_word_edits < base_word_edits", [F.col("delta").asc(), F.col("source_row").asc()])
    worse = top("regression", "ft_word_edits > base_word_edits", [F.col("delta").desc(), F.col("source_row").desc()])
    return better.unionByName(worse).select("kind", "place", "source_row", "base_word_edits", "ft_word_edits", "reference_words")


#: Recordings whose sums one task holds; draws that one task makes.
RANGE, DRAWS = 250_000, 125


def cluster_bootstrap(files: DataFrame, draws: int = 2000, seed: int = 2026, per_range: int = RANGE, per_task: int = DRAWS) -> dict:
    """Interval of the difference of the rates over resampled recordings, in the order of their first row.

    The numbers drawn are those of NumPy's default generator, so a seed gives the same interval elsewhere and at every size. The
    driver runs through the generator alone, without the recordings, to learn its state every ``per_task`` draws. A task repeats the
    numbers of its draws and adds up the recordings of one range of positions; it holds ``per_range`` recordings and as many
    numbers. Draws without reference words are left out; with fewer than two recordings there is no interval.
    """
    if draws < 100:
        raise ValueError("the number of draws must be 100 or more")
    measures = ["base_word_edits", "ft_word_edits", "reference_words"]
    placed = with_position(cut(files.select("first_row", *measures)), "first_row")  # ranges read their input twice
    packed = placed.groupBy(F.floor(F.col("position") / per_range).alias("range")).agg(F.array_sort(F.collect_list(F.struct("position", *measures))).alias("x"), F.count(F.lit(1)).alias("n"))
    packed = cut(packed.select("range", "n", *[F.col("x")[c].cast("array<long>").alias(c) for c in measures]))
    n = packed.agg(F.sum("n")).first()[0] or 0
    if n < 2:
        return {"clusters": n, "valid_draws": 0, "low": None, "high": None}
    rng, states = np.random.default_rng(seed), []
    for first in range(0, draws, per_task):
        states.append((first, min(per_task, draws - first), rng.bit_generator.state))
        for _ in range(per_task if first + per_task < draws else 0):
            for _ in _numbers(rng, n, per_range):
                pass

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                first, many, state = states[row["block"]]
                own = np.random.default_rng(seed)
                own.bit_generator.state = state
                sums, low = np.stack([np.asarray(row[c], np.int64) for c in measures], axis=1), row["range"] * per_range
                total = np.zeros((many, 3), np.int64)
                for b in range(many):
                    for picks in _numbers(own, n, per_range):
                        picks = picks - low
                        total[b] += sums[picks[(picks >= 0) & (picks < len(sums))]].sum(axis=0)
                yield pd.DataFrame({"draw": np.arange(first, first + many), **{c: total[:, i] for i, c in enumerate(measures)}})

    tasks = packed.crossJoin(F.broadcast(files.sparkSession.range(len(states)).select(F.col("id").alias("block")))).repartition(len(states), "block", "range")
    drawn = tasks.mapInPandas(work, "draw long, base_word_edits long, ft_word_edits long, reference_words long").groupBy("draw").agg(*[F.sum(c).alias(c) for c in measures]).filter("reference_words > 0")
    d = np.array([r["d"] for r in drawn.select("draw", ((F.col("ft_word_edits") - F.col("base_word_edits")) / F.col("reference_words")).alias("d")).collect()])
    low, high = np.quantile(d, [0.025, 0.975]).tolist() if len(d) else (None, None)
    return {"clusters": n, "valid_draws": len(d), "low": low, "high": high}


def _numbers(rng: np.random.Generator, n: int, size: int) -> Iterator[np.ndarray]:
    """The n numbers of one draw in parts; the generator gives the same ones in parts and at once."""
    for at in range(0, n, size):
        yield rng.integers(0, n, size=min(size, n - at))
