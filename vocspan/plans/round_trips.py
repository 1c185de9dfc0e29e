"""Queries that write a table and read it again, run checks, or pass rows through a service that stands in for a real one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspan.functions import keys as K
from vocspan.operators import gates, intervals, journal, quality, scoring, seams, shards, speakers
from vocspan.plans import speech
from vocspan.plans.speech_sql import _GROUPS, _PAIRS, _q
from vocspan.plans.speech_sql import ORACLE as _SPEECH
from vocspan.session import scratch, table
from vocspan.sources import archives, sinks, tables, wav
from vocspan.streaming import journal_stream

COLUMNS = list(quality.REQUIRED)
ATTEMPTS = journal_stream.ATTEMPTS


def csv_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All utterances as one CSV file, read with the row identity of a file."""
    target = f"{scratch(spark)}/segments.csv"
    sinks.write_csv(table(spark, sf_dir, "ycsep_static"), target, "source_row", COLUMNS, [])
    return tables.read_segments(spark, target).select("source_row", *COLUMNS)


def jsonl_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All attempts as JSON lines."""
    folder = f"{scratch(spark)}/journal"
    sinks.write_jsonl(table(spark, sf_dir, "asr_journal"), folder)
    return tables.read_jsonl(spark, folder, ATTEMPTS)


def routed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in one folder per split, read folder by folder."""
    folder = f"{scratch(spark)}/by-split"
    sinks.write_by(table(spark, sf_dir, "ycsep_static").select("source_row", "channel", "split"), folder, "split")
    parts = [spark.read.parquet(f"{folder}/split={k}").withColumn("split", F.lit(k)) for k in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def written_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct titles as lines of text."""
    folder = f"{scratch(spark)}/titles"
    sinks.write_titles(speech.detected_titles(spark, sf_dir), folder)
    return spark.read.text(folder).withColumnRenamed("value", "title")


def keyed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal as a keyed table, written in two batches of which the later one comes first."""
    folder, attempts = f"{scratch(spark)}/table", table(spark, sf_dir, "asr_journal")
    for odd in (1, 0):
        batch = attempts.filter(F.col("seq") % 2 == odd)
        sinks.upsert_table(journal.latest(batch, "row_key", "seq").select(*attempts.columns), folder, "row_key", "seq")
    return sinks.read_table(spark, folder).select("row_key", "seq", "generated_text", F.round("duration_seconds", 6).alias("duration_seconds"), "error")


def streamed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal as a stream of files, kept as a keyed table."""
    folder = scratch(spark)
    table(spark, sf_dir, "asr_journal").repartition(3, "seq").write.parquet(f"{folder}/in")
    journal_stream.keep_journal(journal_stream.attempts(spark, f"{folder}/in", 1), f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return sinks.read_table(spark, f"{folder}/table").select("row_key", "seq", "generated_text", F.round("duration_seconds", 6).alias("duration_seconds"), "error")


def archived_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts in the place of sounds: packed in archives with manifests, unpacked and verified."""
    rows = table(spark, sf_dir, "tdk_subset").filter("text is not null")
    clips = rows.select(F.col("source_row").cast("string").alias("row_key"), K.cache_name(F.col("audio"), F.col("source_row").cast("string")).alias("cache_name"), F.lit("text").alias("source"), F.lit("").alias("error"), F.encode("text", "UTF-8").alias("payload"))
    folder = f"{scratch(spark)}/clips"
    manifest = archives.write_archives(clips, folder, 4)
    back = archives.verified(archives.read_members(spark, f"{folder}/*.tar"), manifest)
    return back.select("row_key", "cache_name", "bytes", "sha256", F.decode("payload", "UTF-8").alias("text"))


def _stub(data: bytes) -> dict:
    """A transcriber that says what it hears and fails on silence."""
    if not data:
        raise TimeoutError("nothing to hear")
    return {"transcription": data.decode(), "duration": "1.5"}


def stub_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through a transcriber with retries; errors become values."""
    rows = table(spark, sf_dir, "tdk_subset").select("source_row", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    return seams.transcribe(rows, "source_row", "payload", _stub, tries=2, pause=lambda seconds: None)


def stub_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through a batch model, eight at a time."""
    rows = table(spark, sf_dir, "tdk_subset").select("source_row", F.coalesce("text", F.lit("")).alias("text"))
    return seams.map_batches(rows, "source_row", "text", lambda texts: [len(t) for t in texts], "int")


def stub_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through an embedding model whose vectors are checked: no vector has no direction."""
    rows = table(spark, sf_dir, "tdk_subset").select("source_row", F.coalesce("text", F.lit("")).alias("text"))
    got = seams.embed(rows, "source_row", "text", lambda texts: [[float(len(t)), 0.0] for t in texts], dimensions=2)
    return got.select("source_row", F.get("vector", F.lit(0)).alias("x"), "error")


def _known_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that are resolved already: those of videos whose id begins with a digit or a capital."""
    own = speech.detected_titles(spark, sf_dir)
    return own.filter(F.col("video").rlike("^[0-9A-Z]")).select("video", F.upper("title").alias("title"), F.lit("cache").alias("source"))


def known_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of detected recordings; resolved ones go before those in the names."""
    return speakers.titles(table(spark, sf_dir, "group_scores"), speech.THRESHOLD, speech.NOTE, _known_titles(spark, sf_dir))


def resolved_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known titles, others from a service that knows ids beginning with a to m, the rest from the names."""
    videos = speech.detected_titles(spark, sf_dir).select("video", F.col("title").alias("fallback"))
    return seams.resolve_titles(videos, _known_titles(spark, sf_dir), lambda v: f"title of {v}" if "a" <= v[0] <= "m" else None)


def clip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The central five seconds of every clip, and its frames in a recording of an hour."""
    start, end = speakers.clip_window(F.col("start_s"), F.col("end_s"))
    groups = speakers.speaker_groups(table(spark, sf_dir, "ycsep_static")).select("source_row", start.alias("s"), end.alias("e"))
    first, last = wav.frame_range(F.col("s"), F.col("e"), F.lit(16_000), F.lit(3600 * 16_000))
    return groups.select("source_row", F.round("s", 6).alias("start_s"), F.round("e", 6).alias("end_s"), first.cast("long").alias("first_frame"), last.cast("long").alias("last_frame"))


def recovered_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole edits recovered from the rates of rows with words."""
    pairs = speech._simple_pairs(spark, sf_dir).filter("reference_words > 0")
    rate = F.col("base_word_edits") / F.col("reference_words")
    return pairs.select("source_row", scoring.edits_from_rate(rate, F.col("reference_words")).alias("word_edits"))


def short_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed attempts and whether they are settled because the clip is too short. Failures here are timeouts and the like."""
    failed = table(spark, sf_dir, "asr_journal").filter("coalesce(error, '') != ''")
    return failed.select("seq", journal.settled_short(F.coalesce("duration_seconds", F.lit(0.1)), F.concat(F.lit(journal.SHORT_ERROR + ": "), F.col("error"))).alias("settled"))


def detection_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a recording that touch each other; there are none after merging."""
    return intervals.disjoint_check(speech.detections(spark, sf_dir), "video", "start_s", "end_s")


def first_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 rows in which nothing needed is missing, a feature of the notebooks."""
    rows = table(spark, sf_dir, "ycsep_static").na.drop(subset=["speaker", "text", "audio"])
    return rows.orderBy("source_row").limit(25).select("source_row", "speaker", "text")


def _holds(check: Callable[[], object]) -> bool:
    try:
        check()
    except gates.GateError:
        return False
    return True


def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """check, ok: which of the checks that stop a run hold on these tables."""
    rows, tdk, targets = (table(spark, sf_dir, n) for n in ("ycsep_static", "tdk_subset", "split_targets"))
    held, others = rows.filter(F.col("channel") == speech.HELD_OUT), rows.filter(F.col("channel") != speech.HELD_OUT)
    split = speech._split(spark, sf_dir).select("source_row", "video", "split", "exclusion_reason")
    used = split.filter("exclusion_reason = ''")
    counts = {r["split"]: r["n"] for r in used.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = tdk.count()
    reports = [{"shard_index": i, "num_shards": 8, "rows_in_output": shards.shard_rows(total, i, 8), "source_sha256": "s", "execution_path": "e", "model_sha256": "m"} for i in range(8)]
    groups = table(spark, sf_dir, "group_scores").count()
    checks = {
        "one channel": lambda: gates.one_channel(tdk, speech.HELD_OUT),
        "one channel in all rows": lambda: gates.one_channel(rows, speech.HELD_OUT),
        "both models succeeded": lambda: gates.both_succeeded(tdk, "asr_error", "asr_error_ft"),
        "same rows held out": lambda: gates.same_keys(held, tdk, "source_row", "rows differ"),
        "same rows in all": lambda: gates.same_keys(rows, tdk, "source_row", "rows differ"),
        "held-out rows apart": lambda: gates.disjoint(others, tdk, "source_row", "rows in both"),
        "videos of used splits apart": lambda: gates.disjoint(used.filter("split = 'train'"), used.filter("split = 'validation'"), "video", "a video in both"),
        "held-out videos apart": lambda: gates.disjoint(split.filter("split = 'test'"), used.filter("split != 'test'"), "video", "a video in both"),
        "no split is empty": lambda: gates.both_filled(counts),
        "shards complete": lambda: gates.shards_complete(reports, total),
        "a shard is missing": lambda: gates.shards_complete(reports[1:], total),
        "same configuration": lambda: gates.same_config({r["split_name"]: r["target_share"] for r in targets.collect()}, {"train": 0.8, "validation": 0.1, "test": 0.1}),
        "search complete": lambda: gates.search_complete({"groups_total": groups, "groups_processed": groups}, groups),
        "search not complete": lambda: gates.search_complete({"groups_total": groups, "groups_processed": groups - 1}, groups),
        "target is the source": lambda: gates.fresh_target(sf_dir, sf_dir),
    }
    return spark.createDataFrame([(name, _holds(check)) for name, check in checks.items()], "check string, ok boolean")


QUERIES = {
    f.__name__: f
    for f in (
        csv_segments, jsonl_journal, routed_rows, written_titles, keyed_table, streamed_table, archived_clips, stub_transcripts, stub_batches, stub_vectors, known_titles, resolved_titles,
        clip_windows, recovered_edits, short_attempts, detection_overlaps, first_complete, gate_checks,
    )
}

_NAME = "sha256(coalesce(audio, '') || '|' || source_row) || '.mp3'"
_SPLITS = _SPEECH["split_reasons"].rsplit("SELECT source_row, split", 1)[0]
_CHECKS = {
    "one channel": f"(SELECT count(*) = 0 FROM tdk_subset WHERE channel IS DISTINCT FROM '{speech.HELD_OUT}')",
    "one channel in all rows": f"(SELECT count(*) = 0 FROM ycsep_static WHERE channel IS DISTINCT FROM '{speech.HELD_OUT}')",
    "both models succeeded": "(SELECT count(*) = 0 FROM tdk_subset WHERE coalesce(asr_error, '') <> '' OR coalesce(asr_error_ft, '') <> '')",
    "same rows held out": f"(SELECT count(*) = 0 FROM (SELECT source_row FROM ycsep_static WHERE channel = '{speech.HELD_OUT}') a FULL JOIN tdk_subset b USING (source_row) WHERE a.source_row IS NULL OR b.source_row IS NULL)",
    "same rows in all": "(SELECT count(*) = 0 FROM ycsep_static a FULL JOIN tdk_subset b USING (source_row) WHERE a.source_row IS NULL OR b.source_row IS NULL)",
    "held-out rows apart": f"(SELECT count(*) = 0 FROM ycsep_static JOIN tdk_subset USING (source_row) WHERE ycsep_static.channel <> '{speech.HELD_OUT}')",
    "videos of used splits apart": "(SELECT count(*) = 0 FROM (SELECT video FROM split WHERE exclusion_reason = '' AND split = 'train' INTERSECT SELECT video FROM split WHERE exclusion_reason = '' AND split = 'validation'))",
    "held-out videos apart": "(SELECT count(*) = 0 FROM (SELECT video FROM split WHERE split = 'test' INTERSECT SELECT video FROM split WHERE exclusion_reason = '' AND split <> 'test'))",
    "no split is empty": "(SELECT count(DISTINCT split) = 2 FROM split WHERE exclusion_reason = '' AND split IN ('train', 'validation'))",
    "shards complete": "true",
    "a shard is missing": "false",
    "same configuration": "(SELECT count(*) = 3 AND bool_and(target_share = CASE split_name WHEN 'train' THEN 0.8 WHEN 'validation' THEN 0.1 WHEN 'test' THEN 0.1 END) FROM split_targets)",
    "search complete": "true",
    "search not complete": "false",
    "target is the source": "false",
}
_WINDOW = "SELECT source_row, CASE WHEN e - s > 5 THEN (s + e) / 2 - 2.5 ELSE s END AS ws, CASE WHEN e - s > 5 THEN (s + e) / 2 + 2.5 ELSE e END AS we FROM grp"

ORACLE = {
    "csv_segments": "SELECT row_number() OVER (ORDER BY source_row) - 1 AS source_row, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in COLUMNS) + " FROM ycsep_static",
    "jsonl_journal": "SELECT seq, row_key, generated_text, duration_seconds, error FROM asr_journal",
    "routed_rows": "SELECT source_row, channel, split FROM ycsep_static WHERE split IN ('train', 'validation', 'test')",
    "written_titles": f"SELECT DISTINCT title FROM ({_SPEECH['detected_titles']})",
    "keyed_table": _SPEECH["journal_state"],
    "streamed_table": _SPEECH["journal_state"],
    "archived_clips": f"SELECT CAST(source_row AS VARCHAR) AS row_key, {_NAME} AS cache_name, octet_length(encode(text)) AS bytes, sha256(text) AS sha256, text FROM tdk_subset WHERE text IS NOT NULL",
    "stub_transcripts": "SELECT source_row, coalesce(text, '') AS generated_text, CASE WHEN coalesce(text, '') <> '' THEN 1.5 END AS duration_seconds, CASE WHEN coalesce(text, '') = '' THEN 'TimeoutError' ELSE '' END AS error FROM tdk_subset",
    "stub_batches": "SELECT source_row, length(coalesce(text, '')) AS result, '' AS error FROM tdk_subset",
    "stub_vectors": "SELECT source_row, CAST(nullif(length(coalesce(text, '')), 0) AS DOUBLE) AS x, CASE WHEN coalesce(text, '') = '' THEN 'InvalidEmbedding' ELSE '' END AS error FROM tdk_subset",
    "known_titles": f"SELECT video, CASE WHEN regexp_matches(video, '^[0-9A-Z]') THEN upper(title) ELSE title END AS title FROM ({_SPEECH['detected_titles']})",
    "resolved_titles": f"""SELECT video, CASE WHEN regexp_matches(video, '^[0-9A-Z]') THEN upper(title) WHEN regexp_matches(video, '^[a-m]') THEN 'title of ' || video ELSE title END AS title,
        CASE WHEN regexp_matches(video, '^[0-9A-Z]') THEN 'cache' WHEN regexp_matches(video, '^[a-m]') THEN 'service' ELSE 'file name' END AS source FROM ({_SPEECH['detected_titles']})""",
    "clip_windows": _q(_GROUPS, f"w AS ({_WINDOW})", "SELECT source_row, round(ws, 6) AS start_s, round(we, 6) AS end_s, CASE WHEN we <= 3600.15 THEN CAST(floor(ws * 16000) AS BIGINT) END AS first_frame, CASE WHEN we <= 3600.15 THEN CAST(least(ceil(we * 16000), 57600000) AS BIGINT) END AS last_frame FROM w"),
    "recovered_edits": _q(_PAIRS, "SELECT source_row, be AS word_edits FROM pairs WHERE n > 0"),
    "short_attempts": "SELECT seq, coalesce(duration_seconds, 0.1) < 0.25 AS settled FROM asr_journal WHERE coalesce(error, '') <> ''",
    "detection_overlaps": f"SELECT video, 0 AS violations FROM ({_SPEECH['detections']}) GROUP BY video",
    "first_complete": "SELECT source_row, speaker, text FROM ycsep_static WHERE speaker IS NOT NULL AND text IS NOT NULL AND audio IS NOT NULL ORDER BY source_row LIMIT 25",
    "gate_checks": _SPLITS + " UNION ALL ".join(f"SELECT '{name}' AS \"check\", {sql} AS ok" for name, sql in _CHECKS.items()),
}
