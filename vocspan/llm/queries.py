"""Queries of the problems that prepare training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspan.llm import lookalike, mixing, overlap, packing, reading, repetition, splits, transcripts
from vocspan.session import table

P1_FIELDS = ["text", "generated_text", "generated_text_ft"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.found(table(spark, sf_dir, "tdk_subset"), "source_row", P1_FIELDS)


def p1_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field value in its one form."""
    return lookalike.canonical_fields(table(spark, sf_dir, "tdk_subset"), "source_row", P1_FIELDS).select("source_row", "field", "canonical")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.found(table(spark, sf_dir, "ycsep_static"))


def p2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered turns per file with clean text, long turns in numbered pieces."""
    return transcripts.turns(table(spark, sf_dir, "ycsep_static"), with_text=True).orderBy("file", "start_ms", "first_row", "piece")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found(table(spark, sf_dir, "ycsep_static"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps counted per split, channel and file, with the coverage of the records."""
    return overlap.report(table(spark, sf_dir, "ycsep_static"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.same_recording(table(spark, sf_dir, "ycsep_static"))


def p5_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every row."""
    return splits.assign_rows(table(spark, sf_dir, "ycsep_static"), table(spark, sf_dir, "split_targets"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by the new splits."""
    return splits.shares(table(spark, sf_dir, "ycsep_static"), table(spark, sf_dir, "split_targets"))


def _spoken_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = table(spark, sf_dir, "ycsep_static").select("source_row", F.lit("text").alias("field"), "text")
    model = table(spark, sf_dir, "tdk_subset").select("source_row", F.lit("generated_text").alias("field"), F.col("generated_text").alias("text"))
    return human.unionByName(model)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.found(_spoken_fields(spark, sf_dir))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, repeated words and their share in every text."""
    return repetition.shares(_spoken_fields(spark, sf_dir))


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "pack_limits").first()["capacity_tokens"]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.found(table(spark, sf_dir, "documents"), _capacity(spark, sf_dir))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text or piece."""
    return packing.pack(table(spark, sf_dir, "documents"), _capacity(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    capacity = _capacity(spark, sf_dir)
    return packing.fill_report(packing.pack(table(spark, sf_dir, "documents"), capacity), capacity)


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture in their order."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached per source."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade and level of every document."""
    documents = table(spark, sf_dir, "documents")
    return reading.score(documents, reading.train(documents, table(spark, sf_dir, "reading_labels")))


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mean grade per source and level, English ones apart."""
    return p10_levels(spark, sf_dir).groupBy("source", "english", "level").agg(F.count(F.lit(1)).alias("n_documents"), F.avg("grade").alias("mean_grade"))


def p10_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors on labelled documents whose source was left out of the training."""
    model = reading.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))
    return spark.createDataFrame(list(model.validation.itertuples(index=False, name=None)), "source string, n long, mean_abs_error double, same_level double, same_side_of_4 double")


QUERIES = {
    "p1_found": p1_found,
    "p1_canonical": p1_canonical,
    "p2_found": p2_found,
    "p2_turns": p2_turns,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p5_found": p5_found,
    "p5_assigned": p5_assigned,
    "p5_shares": p5_shares,
    "p6_found": p6_found,
    "p6_shares": p6_shares,
    "p8_found": p8_found,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_levels": p10_levels,
    "p10_profile": p10_profile,
    "p10_validation": p10_validation,
}
#: For the others SQL lacks the normal forms, tokenizers, folds or models; tests compare them with brute force.
ORACLE = {
    # By the wording alone: an id in the usual place of one name (date--id--title), anywhere in another one that has none there.
    "p5_found": """
WITH names AS (SELECT DISTINCT file FROM ycsep_static WHERE file IS NOT NULL),
cut AS (SELECT file, CASE WHEN file[1:8] SIMILAR TO '[0-9]{8}' AND file[9:10] = '--' AND file[22:23] = '--' AND file[11:21] SIMILAR TO '[A-Za-z0-9_-]{11}' THEN file[11:21] END AS own FROM names),
windows AS (SELECT file, file[i:i+10] AS w FROM (SELECT file, unnest(range(1, length(file) - 9)) AS i FROM cut WHERE own IS NULL)),
shaped AS (SELECT DISTINCT file, w FROM windows WHERE w SIMILAR TO '[A-Za-z0-9_-]{11}' AND NOT w SIMILAR TO '[A-Za-z]?[a-z_-]+[0-9]*'),
known AS (SELECT own AS id FROM cut WHERE own IS NOT NULL UNION SELECT w FROM shaped WHERE w SIMILAR TO '.*[a-z].*' AND w SIMILAR TO '.*[A-Z0-9].*' GROUP BY w HAVING count(*) > 1),
ids AS (SELECT file, own AS id FROM cut WHERE own IS NOT NULL UNION SELECT s.file, s.w FROM shaped s JOIN known ON s.w = known.id)
SELECT DISTINCT a.file AS file_a, b.file AS file_b FROM ids a JOIN ids b USING (id) WHERE a.file < b.file""",
}
