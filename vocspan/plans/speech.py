"""Queries over the speech corpus: audit, splits, sampling, scoring, journals and speaker retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocspan.functions import keys as K
from vocspan.functions import text as T
from vocspan.functions import values as V
from vocspan.operators import intervals, journal, quality, sampling, scoring, shards, speakers, stats
from vocspan.session import cut, table

HELD_OUT = "Teh_Dua_Kosong"
THRESHOLD, NOTE = 0.49, "between the medians of the reference speaker and of all others"
SHARDS = 8


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ycsep_static").drop("split")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_split(quality.with_features(_segments(spark, sf_dir)), HELD_OUT)


def quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = quality.with_features(_segments(spark, sf_dir))
    return f.select("source_row", "video", F.round("duration", 6).alias("duration"), "word_count", "characters", F.round("words_per_second", 6).alias("words_per_second"), F.round("characters_per_second", 6).alias("characters_per_second"), "duration_bucket", "singlish_indicator", F.array_join("flags", "|").alias("flags"))


def split_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("source_row", "split", "exclusion_reason")


def metadata_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of the audit in one pass."""
    return quality.audit(_split(spark, sf_dir)).withColumn("hours", F.round("hours", 9))


def audit_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.audit_by(quality.with_features(_segments(spark, sf_dir)), "channel").withColumn("hours", F.round("hours", 9))


def audit_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.audit_by(_split(spark, sf_dir).filter("exclusion_reason = ''"), "split").withColumn("hours", F.round("hours", 9))


def audit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_features(_segments(spark, sf_dir)).groupBy("duration_bucket").agg(F.count(F.lit(1)).alias("n_rows"))


def audit_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).filter("exclusion_reason != ''").groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n_rows"))


def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag_counts(quality.with_holdout(quality.with_features(_segments(spark, sf_dir)), HELD_OUT))


def mismatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the rows outside the test split, which are those that are not held out."""
    marked = quality.with_holdout(quality.with_features(_segments(spark, sf_dir)), HELD_OUT)
    return quality.mismatch_counts(marked.withColumn("split", F.when(F.col("held_out"), F.lit("test")).otherwise(F.lit(""))))


def split_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos that are in more than one split once rows with a reason are left out."""
    used = _split(spark, sf_dir).filter("exclusion_reason = '' or split = 'test'")
    return used.groupBy("video").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1 and video not in ('')").select("video", "n_splits")


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segments(spark, sf_dir).select(V.video_key(F.col("file")).alias("video"), "speaker", V.seconds(F.col("start_time")).alias("start_s"), V.seconds(F.col("end_time")).alias("end_s"))
    return rows.filter(V.is_interval(F.col("start_s"), F.col("end_s")))


def overlap_by_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = intervals.overlap_seconds(_valid(spark, sf_dir))
    return o.select("video", *[F.round(c, 4).alias(c) for c in ("union_seconds", "metadata_overlap_seconds", "different_speaker_overlap_seconds")])


def overlap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = intervals.overlap_totals(intervals.overlap_seconds(_valid(spark, sf_dir)))
    return t.select(*[F.round(c, 7).alias(c) for c in t.columns])


def holdout_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the rows of one channel."""
    return shards.with_position(_segments(spark, sf_dir).filter(F.col("channel") == HELD_OUT), "source_row").select("source_row", "position")


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 rows of shard 3 of 8, a feature of the decoder; shard_all has every row of every shard."""
    placed = shards.with_position(_segments(spark, sf_dir).filter(F.col("channel") == HELD_OUT), "source_row")
    return shards.shard(placed, 3, SHARDS, limit=500).select("source_row", "position")


def shard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of all shards with its position inside the shard."""
    placed = shards.with_position(_segments(spark, sf_dir).filter(F.col("channel") == HELD_OUT), "source_row")
    return shards.assign(placed, SHARDS).select("shard", "local", "source_row")


def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with local positions, merged back and compared with the source."""
    placed = shards.with_position(_segments(spark, sf_dir).filter(F.col("channel") == HELD_OUT), "source_row")
    parts = [shards.shard(placed, i, SHARDS).withColumn("local", F.floor(F.col("position") / SHARDS)).drop("position") for i in range(SHARDS)]
    return shards.mismatches(placed, shards.merge(parts), ["source_row", "file", "speaker", "start_time", "end_time", "text", "audio"])


def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tdk_subset").select("source_row", K.row_key().alias("row_key"))


def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last attempt of every key."""
    return journal.latest(table(spark, sf_dir, "asr_journal"), "row_key", "seq").select("row_key", "seq", "generated_text", F.round("duration_seconds", 6).alias("duration_seconds"), "error")


def journal_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = journal.latest(table(spark, sf_dir, "asr_journal"), "row_key", "seq")
    return journal.pending(table(spark, sf_dir, "tdk_subset").select("source_row", K.row_key().alias("row_key")), state, "row_key").select("source_row")


def journal_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = journal.latest(table(spark, sf_dir, "asr_journal"), "row_key", "seq")
    rows = table(spark, sf_dir, "tdk_subset").select("source_row", K.row_key().alias("row_key"))
    return journal.export(rows, state, "row_key").select("source_row", "journal_text", F.round("journal_seconds", 6).alias("journal_seconds"), "journal_error")


def bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _split(spark, sf_dir).filter("split = 'train' and exclusion_reason = ''")
    return sampling.bottom_k(used, ["channel", "video"]).select("channel", "video", "source_row", "rank")


def clip_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = speakers.speaker_groups(_segments(spark, sf_dir))
    return sampling.clip_pool(groups, ["channel", "file", "speaker"]).select("channel", "file", "speaker", "source_row", "place")


def longest_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = speakers.speaker_groups(_segments(spark, sf_dir))
    return sampling.longest_clip(groups, ["channel", "file", "speaker"]).select("channel", "file", "speaker", "source_row")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.representatives(speakers.speaker_groups(_segments(spark, sf_dir)), ["channel", "file", "speaker"])


def budget_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hours of training rows, an equal part per channel."""
    used = _split(spark, sf_dir).filter("split = 'train' and exclusion_reason = ''")
    return sampling.greedy_budget(sampling.bottom_k(used, ["channel", "video"]), 2.0).select("channel", "video", "rank", "source_row")


def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points behind a scatter plot."""
    return sampling.uniform_sample(quality.with_features(_segments(spark, sf_dir)).filter(F.col("channel") != HELD_OUT), 20_000, "source_row").select("source_row", "duration", "word_count", "words_per_second")


def group_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments per speaker group in input order, in chunks by position."""
    g = speakers.segment_chunks(speakers.speaker_groups(_segments(spark, sf_dir)), ["channel", "file", "speaker"])
    rows = F.array_join(F.transform("segments", lambda x: x["source_row"].cast("string")), ",")
    return g.select("channel", "file", "speaker", "chunk", F.size("segments").alias("n"), rows.alias("source_rows"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form of every reference and prediction."""
    return table(spark, sf_dir, "tdk_subset").select("source_row", *[T.canonical_text(F.col(c)).alias(c) for c in ("text", "generated_text", "generated_text_ft")])


def simple_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tdk_subset").select("source_row", *[F.array_join(T.simple_words(F.col(c)), " ").alias(c) for c in ("text", "generated_text", "generated_text_ft")])


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.score_rows(table(spark, sf_dir, "tdk_subset"), "generated_text", "asr_error")
    return s.select("source_row", "word_edits", "reference_words", "character_edits", "reference_characters", "wer", "cer")


def score_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "tdk_subset")
    base = scoring.score_corpus(scoring.score_rows(rows, "generated_text", "asr_error")).withColumn("model", F.lit("base"))
    return base.unionByName(scoring.score_corpus(scoring.score_rows(rows, "generated_text_ft", "asr_error_ft")).withColumn("model", F.lit("tuned")))


def simple_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.simple_score(table(spark, sf_dir, "tdk_subset"), "generated_text", "asr_error").withColumn("corpus_wer", F.round("corpus_wer", 9))


def _simple_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "tdk_subset").filter(scoring.succeeded("asr_error") & scoring.succeeded("asr_error_ft"))
    return scoring.simple_pairs(rows, "generated_text", "generated_text_ft")


def simple_row_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simple_pairs(spark, sf_dir).select("source_row", "base_word_edits", "ft_word_edits", "reference_words")


def simple_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_file(_simple_pairs(spark, sf_dir))


def simple_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.error_slices(_simple_pairs(spark, sf_dir))
    return s.withColumns({"base_wer": F.round("base_wer", 9), "ft_wer": F.round("ft_wer", 9)})


def simple_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.outcomes(_simple_pairs(spark, sf_dir))


def simple_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.examples(_simple_pairs(spark, sf_dir))


def paired_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_file(scoring.pair_rows(table(spark, sf_dir, "tdk_subset")))


def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled rates of both models and their difference, with the number of rows for which a model failed and which are left out."""
    rows = table(spark, sf_dir, "tdk_subset")
    return scoring.paired_totals(scoring.by_file(scoring.pair_rows(rows))).crossJoin(scoring.left_out(rows))  # one row each


def paired_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.error_slices(scoring.pair_rows(table(spark, sf_dir, "tdk_subset")))


def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.outcomes(scoring.pair_rows(table(spark, sf_dir, "tdk_subset")))


def paired_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.examples(scoring.pair_rows(table(spark, sf_dir, "tdk_subset")))


def wer_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of the rates over resampled recordings."""
    r = scoring.cluster_bootstrap(scoring.by_file(scoring.pair_rows(table(spark, sf_dir, "tdk_subset"))))
    return spark.createDataFrame([(r["clusters"], r["valid_draws"], r["low"], r["high"])], "clusters long, valid_draws long, low double, high double")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.threshold_sweep(table(spark, sf_dir, "group_scores"))


def clip_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.clip_checks(table(spark, sf_dir, "group_scores"), THRESHOLD)


def top_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best groups below the threshold."""
    return speakers.ranked(table(spark, sf_dir, "group_scores").filter(F.col("median_similarity") < THRESHOLD)).select("channel", "file", "speaker", "median_similarity").limit(10)


def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the clips' similarities against the stored ones."""
    m = speakers.array_median(F.col("similarities"))
    return table(spark, sf_dir, "group_scores").select("channel", "file", "speaker", F.round(m, 9).alias("median"), speakers.close(m, F.col("median_similarity")).alias("reproduced"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.detections(table(spark, sf_dir, "group_scores"), THRESHOLD, NOTE)


def detected_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.titles(table(spark, sf_dir, "group_scores"), THRESHOLD, NOTE)


def prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prototype of every label of the embeddings."""
    v = table(spark, sf_dir, "embeddings").select("label", speakers.unit(F.col("embedding")).alias("v")).filter("v is not null")
    return speakers.mean_unit(v, "v", ["label"]).select("label", F.posexplode("prototype").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("x"))


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference windows: the vectors of label 0, which grow with the table."""
    return table(spark, sf_dir, "embeddings").filter("label = 0").select("vec_id", speakers.unit(F.col("embedding")).alias("v"))


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every vector to the reference prototype."""
    protos = speakers.mean_unit(_reference(spark, sf_dir).withColumn("name", F.lit("reference")), "v", ["name"])
    v = table(spark, sf_dir, "embeddings").select("vec_id", speakers.unit(F.col("embedding")).alias("v"))
    return speakers.cosine_to(v, "v", protos, "name").select("vec_id", F.round("similarity", 6).alias("similarity"))


def label_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median similarity per label with its place in falling order."""
    protos = speakers.mean_unit(_reference(spark, sf_dir).withColumn("name", F.lit("reference")), "v", ["name"])
    v = table(spark, sf_dir, "embeddings").select("label", speakers.unit(F.col("embedding")).alias("v"))
    m = stats.quantiles(cut(speakers.cosine_to(v, "v", protos, "name").select("label", "similarity")), ["label"], "similarity", (0.5,))
    return m.select("label", F.round("q1", 6).alias("median_similarity"))


def _stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    protos = speakers.leave_one_out(_reference(spark, sf_dir), "vec_id", "v")
    v = table(spark, sf_dir, "embeddings").select("label", speakers.unit(F.col("embedding")).alias("v"))
    m = speakers.cosine_to(v, "v", protos, "variant").groupBy("variant", "label").agg(F.percentile("similarity", 0.5).alias("m"))
    return m


def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every label under every variant of the reference."""
    place = F.row_number().over(Window.partitionBy("variant").orderBy(F.col("m").desc(), "label"))
    return _stability(spark, sf_dir).select("variant", "label", place.alias("place"), F.round("m", 6).alias("median_similarity"))


def stability_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best labels of every variant."""
    return speakers.top_per(_stability(spark, sf_dir), "variant", "m", "label").select("variant", "label", "place")


def group_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of the clips that stand for every group to the reference, with their median; clips without a vector are counted."""
    reference = speakers.mean_unit(_reference(spark, sf_dir).withColumn("name", F.lit("reference")), "v", ["name"]).first()
    if reference is None:
        raise ValueError("the reference has no vector")
    g = speakers.group_similarities(table(spark, sf_dir, "group_scores"), ["channel", "file", "speaker"], "representative_rows", table(spark, sf_dir, "embeddings"), "vec_id", "embedding", reference["prototype"])
    listed = F.array_join(F.transform("similarities", lambda x: F.coalesce(F.round(x, 5).cast("decimal(9,5)").cast("string"), F.lit("-"))), " ")
    return g.select("channel", "file", "speaker", listed.alias("similarities"), "n_missing", F.round("median_similarity", 6).alias("median_similarity"))


def unnamed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected groups whose recording has no name in the full form; the detections leave them out."""
    return speakers.unnamed(table(spark, sf_dir, "group_scores"), THRESHOLD, NOTE)


def detections_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the title of their recording, in the order of the titles."""
    spans, names = detections(spark, sf_dir), detected_titles(spark, sf_dir)
    return spans.join(names, "video").select("title", "video", "start_s", "end_s").orderBy("title", "video", "start_s")


def group_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred speaker groups by their keys, a feature of the retrieval."""
    return journal.limited(speakers.speaker_groups(_segments(spark, sf_dir)), ["channel", "file", "speaker"], 100)


def cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the cached clips of rows without a clip service."""
    return table(spark, sf_dir, "tdk_subset").select("source_row", K.cache_name(F.col("audio"), F.lit("")).alias("cache_name"))


def dataset_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-sensitive digest of the rows that were decoded, without what models add, and whether they are the whole set."""
    derived = ("generated_text", "asr_duration_seconds", "asr_error", "generated_text_ft", "asr_error_ft", "source_row")
    whole = _segments(spark, sf_dir).filter(F.col("channel") == HELD_OUT).count()
    placed = shards.with_position(table(spark, sf_dir, "tdk_subset"), "source_row")
    return K.identity(placed, "position", derived).withColumn("scope", journal.scope(F.col("n_rows"), whole))


def shard_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of audio over the shards of the journal's last attempts: their sum, the least and the most."""
    state = journal.latest(table(spark, sf_dir, "asr_journal"), "row_key", "seq")
    per_shard = state.groupBy((F.col("seq") % SHARDS).alias("shard")).agg(F.sum("duration_seconds").alias("seconds"))
    t = stats.worker_time(per_shard, "seconds")
    return t.select("n", *[F.round(c, 4).alias(c) for c in ("total", "least", "most")])


def rate_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts behind a density plot of words over seconds."""
    f = quality.with_features(_segments(spark, sf_dir)).filter("valid")
    return stats.hexagons(f.select("duration", F.col("word_count").cast("double").alias("words")), "duration", "words", 1.0, 2.0)


def reference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = speakers.pairwise(_reference(spark, sf_dir), "vec_id", "v")
    return p.select("n_pairs", F.round("min_similarity", 6).alias("min_similarity"), F.round("median_similarity", 6).alias("median_similarity"))


def rate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(quality.with_features(_segments(spark, sf_dir)), "words_per_second", stats.RATE_BINS)


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.equal_histogram(table(spark, sf_dir, "group_scores"), "median_similarity", 60).select("bin", "n")


def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rolling_median(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "event_id", "value").select("event_id", F.round("rolling", 6).alias("rolling"))


def event_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stats.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value")
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")])


QUERIES = {
    f.__name__: f
    for f in (
        quality_features, split_reasons, metadata_audit, audit_channels, audit_splits, audit_buckets, audit_exclusions, audit_flags, mismatch_counts, split_leaks, overlap_by_video, overlap_totals,
        holdout_positions, shard_rows, shard_all, shard_merge, row_keys, journal_state, journal_pending, journal_export, bottom_k, clip_pools, longest_clips, representatives, budget_sample, uniform_sample, group_segments,
        normal_forms, simple_forms, score_rows, score_corpus, simple_wer, simple_row_edits, simple_by_file, simple_slices, simple_outcomes, simple_examples,
        paired_by_file, paired_comparison, paired_slices, paired_outcomes, paired_examples, wer_bootstrap,
        threshold_sweep, clip_checks, top_rejected, group_medians, detections, detected_titles, prototype, similarities, label_medians, stability, stability_top, reference_pairs, group_similarities, unnamed_groups, detections_by_title, group_limit, cache_names, dataset_identity, shard_times, rate_density,
        rate_histogram, score_histogram, rolling_median, event_quantiles,
    )
}
