"""Queries of the general problems 4 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspan.functions.labels import clean_speaker
from vocspan.functions.times import parse_ms, valid_interval
from vocspan.operators.hotkeys import exact_distinct_per_key, heavy_keys, per_key
from vocspan.operators.periods import periods_and_gaps
from vocspan.session import table

GAP_MS = 30_000
HEAVY_SHARE = 0.05


def speech_intervals(rows: DataFrame) -> DataFrame:
    """file, speaker (clean), start_ms, end_ms of the rows with valid times and a label in the column."""
    timed = rows.select("file", clean_speaker(F.col("speaker")).alias("speaker"), parse_ms(F.col("start_time")).alias("start_ms"), parse_ms(F.col("end_time")).alias("end_ms"))
    return timed.filter(F.col("speaker").isNotNull() & valid_interval(F.col("start_ms"), F.col("end_ms")))


def p4_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every period and gap per file and speaker."""
    rows = table(spark, sf_dir, "ycsep_static")
    names = rows.select("file", "speaker").distinct().select("file", clean_speaker(F.col("speaker")).alias("speaker"))
    return periods_and_gaps(speech_intervals(rows), ["file", "speaker"], names=names)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    long_gap = (F.col("kind") == "gap") & (F.col("end_ms") - F.col("start_ms") >= GAP_MS)
    merged = (F.col("kind") == "period") & (F.col("rows") >= 2) & ~F.col("identical")
    return p4_periods(spark, sf_dir).filter(long_gap | merged).select("file", "speaker", "kind", "start_ms", "end_ms")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(table(spark, sf_dir, "ycsep_static"), ["channel", "file"], HEAVY_SHARE).select("key_column", "key_value")


def p7_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete results for every channel and file: rows, rows with text, valid rows, milliseconds of speech, first and last start."""
    rows = table(spark, sf_dir, "ycsep_static")
    start, end = parse_ms(F.col("start_time")), parse_ms(F.col("end_time"))
    timed = rows.select("channel", "file", "text", start.alias("s"), end.alias("e")).withColumn("ok", valid_interval(F.col("s"), F.col("e")))
    measures = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count("text").alias("n_text"),
        F.count_if("ok").alias("n_valid"),
        F.sum(F.when(F.col("ok"), F.col("e") - F.col("s")).otherwise(F.lit(0).cast("long"))).alias("speech_ms"),
        F.min(F.when(F.col("ok"), F.col("s"))).alias("first_ms"),
        F.max(F.when(F.col("ok"), F.col("e"))).alias("last_ms"),
    ]
    return per_key(timed, ["channel", "file"], measures)


def p7_distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact number of different texts per channel, where one channel holds almost half of all rows."""
    return exact_distinct_per_key(table(spark, sf_dir, "ycsep_static"), "channel", "text")


QUERIES = {"p4_found": p4_found, "p4_periods": p4_periods, "p7_found": p7_found, "p7_per_key": p7_per_key, "p7_distinct_texts": p7_distinct_texts}

_TIME_SQL = """
CASE WHEN regexp_full_match(trim({c}, ' \t\n'), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
          THEN CAST(round(TRY_CAST(trim({c}, ' \t\n') AS DOUBLE) * 1000) AS BIGINT)
     WHEN regexp_full_match(trim({c}, ' \t\n'), '[+]?[0-9]+:[0-9]{{1,2}}:[0-9]{{1,2}}([.][0-9]*)?')
          THEN CAST(round((CAST(ltrim(split_part(trim({c}, ' \t\n'), ':', 1), '+') AS BIGINT) * 3600 + CAST(split_part(trim({c}, ' \t\n'), ':', 2) AS BIGINT) * 60
               + CAST(split_part(trim({c}, ' \t\n'), ':', 3) AS DOUBLE)) * 1000) AS BIGINT) END"""
_SPEAKER_SQL = """
CASE WHEN speaker IS NULL OR lower(trim(speaker, ' \t\n')) IN ('', 'nan', 'none', 'null', 'unknown', 'n/a') THEN NULL
     ELSE 'SPEAKER_' || CASE WHEN CAST(regexp_extract(speaker, '([0-9]+)', 1) AS BIGINT) < 10 THEN '0' ELSE '' END
          || CAST(CAST(regexp_extract(speaker, '([0-9]+)', 1) AS BIGINT) AS VARCHAR) END"""
_TIMED_SQL = f"""
timed AS (SELECT source_row, channel, file, text, {_SPEAKER_SQL} AS speaker, {_TIME_SQL.format(c="start_time")} AS s, {_TIME_SQL.format(c="end_time")} AS e FROM ycsep_static),
valid AS (SELECT source_row, file, speaker, s, e FROM timed WHERE speaker IS NOT NULL AND s >= 0 AND s < e)"""
#: The SQL merges in one ordered pass, independently of the ranks that the operator uses.
_ISLANDS_SQL = f"""
WITH {_TIMED_SQL},
marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file, speaker ORDER BY s, e, source_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM valid),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY file, speaker ORDER BY s, e, source_row ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (SELECT file, speaker, island, min(s) AS s, max(e) AS e, count(*) AS n, count(DISTINCT (s, e)) = 1 AS identical FROM numbered GROUP BY file, speaker, island),
chained AS (SELECT *, lead(s) OVER (PARTITION BY file, speaker ORDER BY island) AS next_s FROM periods)"""

ORACLE = {
    "p4_periods": f"""{_ISLANDS_SQL}
SELECT file, speaker, 'period' AS kind, s AS start_ms, e AS end_ms, n AS rows, identical FROM chained
UNION ALL SELECT file, speaker, 'gap', e, next_s, NULL, NULL FROM chained WHERE next_s IS NOT NULL""",
    "p4_found": f"""{_ISLANDS_SQL}
SELECT file, speaker, 'period' AS kind, s AS start_ms, e AS end_ms FROM chained WHERE n >= 2 AND NOT identical
UNION ALL SELECT file, speaker, 'gap', e, next_s FROM chained WHERE next_s - e >= {GAP_MS}""",
    "p7_found": f"""
WITH k AS (SELECT 'channel' AS key_column, channel AS key_value FROM ycsep_static UNION ALL SELECT 'file', file FROM ycsep_static)
SELECT key_column, key_value FROM k WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM ycsep_static)""",
    "p7_per_key": f"""
WITH {_TIMED_SQL},
k AS (SELECT 'channel' AS key_column, channel AS key_value, * FROM timed UNION ALL SELECT 'file', file, * FROM timed)
SELECT key_column, key_value, count(*) AS n_rows, count(text) AS n_text, count(*) FILTER (s >= 0 AND s < e) AS n_valid,
       CAST(coalesce(sum(e - s) FILTER (s >= 0 AND s < e), 0) AS BIGINT) AS speech_ms, min(s) FILTER (s >= 0 AND s < e) AS first_ms, max(e) FILTER (s >= 0 AND s < e) AS last_ms
FROM k GROUP BY key_column, key_value""",
    "p7_distinct_texts": "SELECT channel AS key_value, count(DISTINCT text) AS n_distinct FROM ycsep_static GROUP BY channel",
}
