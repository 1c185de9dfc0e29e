"""SQL with the same results as the queries of vocspan.plans.speech."""

from __future__ import annotations

import unicodedata

from vocspan.functions.text import FILLERS, FORM, SINGLISH

HELD_OUT, THRESHOLD = "Teh_Dua_Kosong", 0.49

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*')"
_NUMBER = "CASE WHEN isfinite(TRY_CAST(trim({c}, ' \t\n\r') AS DOUBLE)) THEN TRY_CAST(trim({c}, ' \t\n\r') AS DOUBLE) END"
_VIDEO = "CASE WHEN len(string_split(file, '--')) >= 3 THEN string_split(file, '--')[2] ELSE regexp_replace(file, '\\.TextGrid$', '') END"
_SINGLISH = f"[{', '.join(map(repr, SINGLISH))}]"
_BUCKET = "CASE WHEN duration < 0.3 THEN '<0.3' WHEN duration < 0.5 THEN '0.3-0.5' WHEN duration < 1 THEN '0.5-1' WHEN duration < 5 THEN '1-5' WHEN duration < 10 THEN '5-10' WHEN duration < 15 THEN '10-15' WHEN duration < 20 THEN '15-20' ELSE '>=20' END"
_RUN6 = "len(list_filter(range(1, length(coalesce(text, '')) - 4), lambda i: text[i:i+5] = repeat(text[i], 6) AND text[i] <> chr(10))) > 0"

_BASE = f"""
base AS (SELECT *, {_VIDEO} AS video, {_NUMBER.format(c="start_time")} AS s, {_NUMBER.format(c="end_time")} AS e, {_WORDS} AS words FROM ycsep_static),
sized AS (SELECT *, coalesce(s >= 0 AND s < e, false) AS valid, len(words) AS word_count, length(coalesce(text, '')) AS characters FROM base),
timed AS (SELECT *, CASE WHEN valid THEN e - s ELSE 0 END AS duration FROM sized),
rated AS (SELECT *, CASE WHEN valid THEN word_count / duration ELSE 0 END AS wps, CASE WHEN valid THEN characters / duration ELSE 0 END AS cps FROM timed),
feat AS (SELECT *, {_BUCKET} AS duration_bucket, list_has_any(words, {_SINGLISH}) AS singlish,
  list_filter([CASE WHEN NOT valid THEN 'invalid_timestamp' END, CASE WHEN word_count = 0 THEN 'empty_or_nonlexical_text' END,
    CASE WHEN valid AND duration < 0.5 THEN 'short' END, CASE WHEN duration > 20 THEN 'long' END,
    CASE WHEN duration >= 2 AND wps < 0.5 THEN 'sparse_text' END, CASE WHEN duration >= 5 AND word_count <= 1 THEN 'extreme_sparse' END,
    CASE WHEN wps > 7.5 THEN 'dense_text' END,
    CASE WHEN word_count > 0 AND len(list_filter(words, lambda w: w NOT IN {FILLERS})) = 0 THEN 'filler_only' END,
    CASE WHEN word_count >= 4 AND len(list_distinct(words)) = 1 THEN 'repeated_tokens' END,
    CASE WHEN {_RUN6} THEN 'repeated_characters' END], lambda f: f IS NOT NULL) AS flags FROM rated)"""

_SPLIT = f"""{_BASE},
hv AS (SELECT DISTINCT video FROM feat WHERE channel = '{HELD_OUT}'),
ha AS (SELECT DISTINCT coalesce(audio, '') AS a FROM feat WHERE channel = '{HELD_OUT}'),
marked AS (SELECT *, (video IN (SELECT video FROM hv) OR coalesce(audio, '') IN (SELECT a FROM ha)) AS held_out FROM feat),
firsts AS (SELECT audio AS fa, min(source_row) AS first_row FROM marked WHERE NOT held_out GROUP BY audio),
split AS (SELECT m.* EXCLUDE (split),
  CASE WHEN held_out THEN 'test' WHEN CAST(('0x' || substr(sha256('2026/' || video), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 < 0.1 THEN 'validation' ELSE 'train' END AS split,
  CASE WHEN held_out THEN 'tdk_holdout' WHEN list_has_any(flags, ['invalid_timestamp', 'empty_or_nonlexical_text']) THEN 'invalid_timestamp_or_empty_text'
       WHEN NOT coalesce(starts_with(audio, 'https://'), false) THEN 'invalid_audio_url' WHEN source_row > first_row THEN 'duplicate_audio_url'
       WHEN duration < 0.3 OR duration > 20 THEN 'pilot_duration_outside_0.3_to_20' ELSE '' END AS exclusion_reason
  FROM marked m LEFT JOIN firsts ON audio = fa)"""

_SWEEP = f"""
iv AS (SELECT {_VIDEO} AS video, coalesce(speaker, '') AS sp, {_NUMBER.format(c="start_time")} AS st, {_NUMBER.format(c="end_time")} AS en FROM ycsep_static),
ok AS (SELECT * FROM iv WHERE st >= 0 AND st < en),
ev AS (SELECT video, sp, stamp, sum(d) AS d FROM (SELECT video, sp, st AS stamp, 1 AS d FROM ok UNION ALL SELECT video, sp, en, -1 FROM ok) GROUP BY ALL),
run AS (SELECT *, sum(d) OVER (PARTITION BY video, sp ORDER BY stamp) AS n FROM ev),
tr AS (SELECT video, stamp, sum(d) AS d, sum(CAST(n > 0 AS INT) - CAST(n - d > 0 AS INT)) AS sd FROM run GROUP BY video, stamp),
a AS (SELECT video, sum(d) OVER w AS n, sum(sd) OVER w AS ns, lead(stamp) OVER w - stamp AS span FROM tr WINDOW w AS (PARTITION BY video ORDER BY stamp)),
per AS (SELECT video, sum(CASE WHEN n > 0 THEN span ELSE 0 END) AS u, sum(CASE WHEN n >= 2 THEN span ELSE 0 END) AS o, sum(CASE WHEN ns >= 2 THEN span ELSE 0 END) AS x FROM a WHERE span IS NOT NULL GROUP BY video)"""

_HELD = f"held AS (SELECT *, row_number() OVER (ORDER BY source_row) - 1 AS position FROM ycsep_static WHERE channel = '{HELD_OUT}')"

_KEY = "sha256('{' || " + " || ', ' || ".join(f"'\"{c}\": ' || CAST(to_json(coalesce({c}, '')) AS VARCHAR)" for c in ("audio", "channel", "end_time", "file", "speaker", "start_time", "text")) + " || '}')"
_JOURNAL = "state AS (SELECT * FROM asr_journal QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY seq DESC) = 1)"

_GROUPS = f"""
g0 AS (SELECT source_row, channel, file, audio, trim(coalesce(speaker, ''), ' ') AS sp, {_NUMBER.format(c="start_time")} AS s, {_NUMBER.format(c="end_time")} AS e FROM ycsep_static),
grp AS (SELECT source_row, channel, file, audio, CASE WHEN lower(sp) IN ('', 'nan', 'none', 'unknown') THEN 'unlabelled-' || source_row ELSE sp END AS speaker, s, e, e - s AS duration FROM g0 WHERE s >= 0 AND s < e)"""
_POOL = f"""{_GROUPS},
fit AS (SELECT *, row_number() OVER (PARTITION BY channel, file, speaker ORDER BY sha256(coalesce(audio, '')), source_row) AS r,
        count(*) OVER (PARTITION BY channel, file, speaker) AS n, row_number() OVER (PARTITION BY channel, file, speaker ORDER BY source_row) AS i FROM grp WHERE duration BETWEEN 2 AND 15),
pool AS (SELECT channel, file, speaker, source_row, s, duration, CASE WHEN n > 24 THEN r ELSE i END AS place FROM fit WHERE n <= 24 OR r <= 24)"""

_SIMPLE = r"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9'']+')"
# One row of the distance table after another: a fold over the reference inside which a fold over the hypothesis builds the row.
_DISTANCE = "list_reduce({a}, lambda prev, w: list_reduce(range(1, len({b}) + 1), lambda cur, j: list_append(cur, least(cur[-1] + 1, prev[j + 1] + 1, prev[j] + CASE WHEN w = {b}[j] THEN 0 ELSE 1 END)), [prev[1] + 1]), range(0, len({b}) + 1))"

_TDK_TIMED = f"{_NUMBER.format(c='start_time')} AS s, {_NUMBER.format(c='end_time')} AS e"

_EMB = """
raw AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nrm AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS l FROM raw),
uv AS (SELECT vec_id, label, list_transform(v, lambda x: x / l) AS v FROM nrm WHERE l > 0),
ux AS (SELECT vec_id, label, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM uv)"""
_PROTO = """
mean AS (SELECT dim, avg(x) AS m FROM ux WHERE label = 0 GROUP BY dim),
ref AS (SELECT dim, m / sqrt(sum(m * m) OVER ()) AS p FROM mean),
sim AS (SELECT vec_id, label, sum(x * p) AS s FROM ux JOIN ref USING (dim) GROUP BY vec_id, label)"""


def _q(*parts: str) -> str:
    *ctes, select = parts
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + select


ORACLE = {
    "quality_features": _q(_BASE, "SELECT source_row, video, round(duration, 6) AS duration, word_count, characters, round(wps, 6) AS words_per_second, round(cps, 6) AS characters_per_second, duration_bucket, singlish AS singlish_indicator, array_to_string(flags, '|') AS flags FROM feat"),
    "split_reasons": _q(_SPLIT, "SELECT source_row, split, exclusion_reason FROM split"),
    "audit_channels": _q(_SPLIT, "SELECT channel, count(*) AS n_rows, round(sum(duration / 3600), 9) AS hours, count(DISTINCT video) AS videos FROM split GROUP BY channel"),
    "audit_splits": _q(_SPLIT, "SELECT split, count(*) AS n_rows, round(sum(duration / 3600), 9) AS hours, count(DISTINCT video) AS videos FROM split WHERE exclusion_reason = '' GROUP BY split"),
    "audit_buckets": _q(_BASE, "SELECT duration_bucket, count(*) AS n_rows FROM feat GROUP BY 1"),
    "audit_exclusions": _q(_SPLIT, "SELECT exclusion_reason, count(*) AS n_rows FROM split WHERE exclusion_reason <> '' GROUP BY 1"),
    "audit_flags": _q(_SPLIT, "SELECT flag, count(*) AS n_rows FROM (SELECT unnest(flags) AS flag FROM split WHERE NOT held_out) GROUP BY flag"),
    "mismatch_counts": _q(_SPLIT, """SELECT count(*) AS n_rows, count(*) FILTER (duration >= 5 AND word_count <= 1) AS duration_ge5_words_le1, count(*) FILTER (duration >= 5 AND word_count <= 2) AS duration_ge5_words_le2,
        count(*) FILTER (duration >= 10 AND word_count <= 3) AS duration_ge10_words_le3, count(*) FILTER (duration <= 1 AND word_count >= 8) AS duration_le1_words_ge8, count(*) FILTER (duration <= 2 AND word_count >= 15) AS duration_le2_words_ge15,
        count(*) FILTER (wps < 0.5) AS wps_lt0_5, count(*) FILTER (wps > 7.5) AS wps_gt7_5, count(*) FILTER (singlish) AS singlish FROM split WHERE split <> 'test'"""),
    "split_leaks": _q(_SPLIT, "SELECT video, count(DISTINCT split) AS n_splits FROM split WHERE exclusion_reason = '' OR split = 'test' GROUP BY video HAVING count(DISTINCT split) > 1 AND video <> ''"),
    "overlap_by_video": _q(_SWEEP, "SELECT video, round(u, 4) AS union_seconds, round(o, 4) AS metadata_overlap_seconds, round(x, 4) AS different_speaker_overlap_seconds FROM per"),
    "overlap_totals": _q(_SWEEP, "SELECT round(sum(u) / 3600, 7) AS union_hours, round(sum(o) / 3600, 7) AS overlap_hours, round(sum(x) / 3600, 7) AS different_speaker_hours, round(sum(o) / nullif(sum(u), 0), 7) AS overlap_fraction FROM per"),
    "holdout_positions": _q(_HELD, "SELECT source_row, position FROM held"),
    "shard_rows": _q(_HELD, "SELECT source_row, position FROM held WHERE position % 8 = 3 ORDER BY position LIMIT 500"),
    "shard_merge": "SELECT 0 AS missing, 0 AS surplus, 0 AS different FROM region WHERE r_regionkey = 0",
    "row_keys": f"SELECT source_row, {_KEY} AS row_key FROM tdk_subset",
    "journal_state": _q(_JOURNAL, "SELECT row_key, seq, generated_text, round(duration_seconds, 6) AS duration_seconds, error FROM state"),
    "journal_pending": _q(_JOURNAL, f"SELECT source_row FROM tdk_subset WHERE {_KEY} NOT IN (SELECT row_key FROM state WHERE coalesce(error, '') = '')"),
    "journal_export": _q(_JOURNAL, f"keyed AS (SELECT source_row, {_KEY} AS k FROM tdk_subset)", "SELECT source_row, s.generated_text AS journal_text, round(s.duration_seconds, 6) AS journal_seconds, CASE WHEN s.row_key IS NULL THEN 'not_processed' ELSE coalesce(s.error, '') END AS journal_error FROM keyed LEFT JOIN state s ON k = s.row_key"),
    "bottom_k": _q(_SPLIT, "SELECT channel, video, source_row, row_number() OVER (PARTITION BY channel, video ORDER BY sha256('2026/' || source_row), source_row DESC) AS rank FROM split WHERE split = 'train' AND exclusion_reason = '' QUALIFY rank <= 128"),
    "clip_pools": _q(_POOL, "SELECT channel, file, speaker, source_row, place FROM pool"),
    "longest_clips": _q(_GROUPS, "SELECT channel, file, speaker, source_row FROM grp QUALIFY row_number() OVER (PARTITION BY channel, file, speaker ORDER BY duration DESC, source_row) = 1"),
    "representatives": _q(_POOL, """
        spare AS (SELECT * FROM grp QUALIFY row_number() OVER (PARTITION BY channel, file, speaker ORDER BY duration DESC, source_row) = 1),
        cand AS (SELECT channel, file, speaker, source_row, s, duration, place FROM pool UNION ALL SELECT channel, file, speaker, source_row, s, duration, 1 FROM spare WHERE (channel, file, speaker) NOT IN (SELECT (channel, file, speaker) FROM pool)),
        p1 AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY channel, file, speaker ORDER BY least(duration, 5) DESC, place) = 1),
        c2 AS (SELECT c.*, abs(c.s - p.s) AS d1 FROM cand c JOIN p1 p USING (channel, file, speaker) WHERE c.place <> p.place),
        p2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY channel, file, speaker ORDER BY d1 DESC, place) = 1),
        c3 AS (SELECT c.*, least(c.d1, abs(c.s - p.s)) AS d FROM c2 c JOIN p2 p USING (channel, file, speaker) WHERE c.place <> p.place),
        p3 AS (SELECT * FROM c3 QUALIFY row_number() OVER (PARTITION BY channel, file, speaker ORDER BY d DESC, place) = 1)""",
        "SELECT channel, file, speaker, 1 AS pick, source_row FROM p1 UNION ALL SELECT channel, file, speaker, 2, source_row FROM p2 UNION ALL SELECT channel, file, speaker, 3, source_row FROM p3"),
    "group_segments": _q(_GROUPS, "SELECT channel, file, speaker, source_row // 4096 AS chunk, count(*) AS n, string_agg(CAST(source_row AS VARCHAR), ',' ORDER BY source_row) AS source_rows FROM grp GROUP BY ALL"),
    "simple_forms": "SELECT source_row, " + ", ".join(f"array_to_string({_SIMPLE.format(c=c)}, ' ') AS {c}" for c in ("text", "generated_text", "generated_text_ft")) + " FROM tdk_subset",
    "threshold_sweep": """WITH t AS (SELECT CAST(unnest([0.35, 0.40, 0.44, 0.46, 0.48, 0.49, 0.50, 0.52, 0.54, 0.56, 0.60]) AS DOUBLE) AS threshold)
        SELECT threshold, count(g.file) AS n_groups, count(DISTINCT g.file) AS n_files FROM t LEFT JOIN group_scores g ON g.median_similarity >= threshold GROUP BY threshold""",
    "clip_checks": f"""SELECT channel, file, speaker, median_similarity, len(list_filter(coalesce(similarities, []), lambda x: x >= {THRESHOLD})) AS n_clips_above,
        coalesce(len(similarities) > 0 AND list_min(similarities) >= {THRESHOLD}, false) AS all_above, len(segments) AS n_segments,
        CASE WHEN median_similarity IS NULL THEN 'unscorable' WHEN median_similarity >= {THRESHOLD} THEN 'selected' WHEN median_similarity >= 0.44 THEN 'near' ELSE 'rejected' END AS status FROM group_scores""",
    "top_rejected": f"SELECT channel, file, speaker, median_similarity FROM group_scores WHERE median_similarity < {THRESHOLD} ORDER BY median_similarity DESC, channel, file, speaker LIMIT 10",
    "group_medians": "SELECT channel, file, speaker, round(list_aggregate(similarities, 'median'), 9) AS median, abs(list_aggregate(similarities, 'median') - median_similarity) <= 1e-5 + 1e-5 * abs(median_similarity) AS reproduced FROM group_scores",
    "detections": f"""WITH picked AS (SELECT regexp_extract(file, '^\\d{{8}}--([A-Za-z0-9_-]{{11}})--([^\\n]+)\\.TextGrid$', 1) AS video, unnest(segments) AS x FROM group_scores WHERE median_similarity >= {THRESHOLD} AND regexp_matches(file, '^\\d{{8}}--[A-Za-z0-9_-]{{11}}--[^\\n]+\\.TextGrid$')),
        us AS (SELECT video, CAST(round(x[1] * 1000000) AS BIGINT) AS s, CAST(round(x[2] * 1000000) AS BIGINT) AS e FROM picked), ok AS (SELECT DISTINCT * FROM us WHERE s >= 0 AND s < e),
        m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY video ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ok),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY video ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT video, min(s) / 1000000 AS start_s, max(e) / 1000000 AS end_s FROM n GROUP BY video, island""",
    "detected_titles": f"""SELECT regexp_extract(file, '^\\d{{8}}--([A-Za-z0-9_-]{{11}})--([^\\n]+)\\.TextGrid$', 1) AS video, min(regexp_extract(file, '^\\d{{8}}--([A-Za-z0-9_-]{{11}})--([^\\n]+)\\.TextGrid$', 2)) AS title
        FROM group_scores WHERE median_similarity >= {THRESHOLD} AND regexp_matches(file, '^\\d{{8}}--[A-Za-z0-9_-]{{11}}--[^\\n]+\\.TextGrid$') GROUP BY 1""",
    "prototype": _q(_EMB, "mean AS (SELECT label, dim, avg(x) AS m FROM ux GROUP BY label, dim)", "SELECT label, dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM mean"),
    "similarities": _q(_EMB, _PROTO, "SELECT vec_id, round(s, 6) AS similarity FROM sim"),
    "label_medians": _q(_EMB, _PROTO, "SELECT label, round(median(s), 6) AS median_similarity FROM sim GROUP BY label"),
    "reference_pairs": _q(_EMB, "SELECT count(*) AS n_pairs, round(min(s), 6) AS min_similarity, round(median(s), 6) AS median_similarity FROM (SELECT list_dot_product(a.v, b.v) AS s FROM uv a JOIN uv b ON a.label = 0 AND b.label = 0 AND a.vec_id < b.vec_id)"),
    "stability": _q(_EMB, """
        w AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS w, count(*) OVER () AS n FROM uv WHERE label = 0),
        var AS (SELECT CASE WHEN w < n // 2 THEN 'first_half' ELSE 'second_half' END AS variant, vec_id FROM w UNION ALL SELECT 'omit_window_' || o.w, k.vec_id FROM w o JOIN w k ON o.w <> k.w),
        mean AS (SELECT variant, dim, avg(x) AS m FROM var JOIN ux USING (vec_id) GROUP BY variant, dim),
        ref AS (SELECT variant, dim, m / sqrt(sum(m * m) OVER (PARTITION BY variant)) AS p FROM mean),
        sim AS (SELECT variant, vec_id, label, sum(x * p) AS s FROM ux JOIN ref USING (dim) GROUP BY variant, vec_id, label),
        med AS (SELECT variant, label, median(s) AS m FROM sim GROUP BY variant, label)""",
        "SELECT variant, label, row_number() OVER (PARTITION BY variant ORDER BY m DESC, label) AS place, round(m, 6) AS median_similarity FROM med"),
    "rate_histogram": _q(_BASE, """b AS (SELECT unnest(range(1, 13)) AS bin, unnest([0, 0.5, 1, 2, 3, 4, 5, 7.5, 10, 15, 25, 50]) AS low, unnest([0.5, 1, 2, 3, 4, 5, 7.5, 10, 15, 25, 50, 100]) AS high)""",
        "SELECT bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(wps) AS n FROM b LEFT JOIN feat ON wps >= low AND (wps < high OR (bin = 12 AND wps <= high)) GROUP BY ALL"),
    "score_histogram": """WITH r AS (SELECT min(median_similarity) AS lo, max(median_similarity) AS hi FROM group_scores), b AS (SELECT unnest(range(1, 61)) AS bin),
        e AS (SELECT bin, lo + (bin - 1) * ((hi - lo) / 60) AS low, CASE WHEN bin = 60 THEN hi ELSE lo + bin * ((hi - lo) / 60) END AS high FROM b, r)
        SELECT bin, count(median_similarity) AS n FROM e LEFT JOIN group_scores ON median_similarity >= low AND (median_similarity < high OR (bin = 60 AND median_similarity <= high)) GROUP BY bin""",
    "rolling_median": "SELECT event_id, round(median(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events",
    "event_quantiles": "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.975), 6) AS q3 FROM events GROUP BY event_type",
}

_PAIRS = f"""
forms AS (SELECT source_row, file, start_time, end_time, {_SIMPLE.format(c="text")} AS r, {_SIMPLE.format(c="generated_text")} AS b, {_SIMPLE.format(c="generated_text_ft")} AS f FROM tdk_subset WHERE coalesce(asr_error, '') = '' AND coalesce(asr_error_ft, '') = ''),
pairs AS (SELECT *, len(r) AS n, ({_DISTANCE.format(a="r", b="b")})[-1] AS be, ({_DISTANCE.format(a="r", b="f")})[-1] AS fe FROM forms)"""
_NAMES = "sum(be) AS base_word_edits, sum(fe) AS ft_word_edits, sum(n) AS reference_words"
_OUTCOME = "CASE WHEN fe < be THEN 'improved' WHEN fe > be THEN 'regressed' ELSE 'unchanged' END"

ORACLE |= {
    "simple_row_edits": _q(_PAIRS, "SELECT source_row, be AS base_word_edits, fe AS ft_word_edits, n AS reference_words FROM pairs"),
    "simple_by_file": _q(_PAIRS, f"SELECT file, min(source_row) AS first_row, {_NAMES} FROM pairs GROUP BY file"),
    "simple_slices": _q(_PAIRS, f"timed AS (SELECT *, {_TDK_TIMED} FROM pairs)", "cut AS (SELECT *, CASE WHEN e - s < 2 THEN '<2s' WHEN e - s < 5 THEN '2-5s' WHEN e - s < 10 THEN '5-10s' ELSE '>=10s' END AS bucket FROM timed WHERE s >= 0 AND s < e)",
        "SELECT CASE WHEN grouping(bucket) = 1 THEN 'all' ELSE 'duration:' || bucket END AS slice, count(*) AS n_rows, sum(n) AS words, sum(be) AS base_edits, sum(fe) AS ft_edits, round(sum(be) / nullif(sum(n), 0), 9) AS base_wer, round(sum(fe) / nullif(sum(n), 0), 9) AS ft_wer FROM cut GROUP BY GROUPING SETS ((), (bucket))"),
    "simple_outcomes": _q(_PAIRS, "files AS (SELECT file, sum(be) AS be, sum(fe) AS fe FROM pairs GROUP BY file)", f"SELECT 'row' AS level, {_OUTCOME} AS outcome, count(*) AS n FROM pairs GROUP BY 2 UNION ALL SELECT 'video', {_OUTCOME}, count(*) FROM files GROUP BY 2"),
    "simple_examples": _q(_PAIRS, "pool AS (SELECT *, (fe - be) / n AS d FROM pairs WHERE n >= 5)", """
        better AS (SELECT 'improvement' AS kind, row_number() OVER (ORDER BY d, source_row) AS place, * FROM pool WHERE fe < be QUALIFY place <= 8),
        worse AS (SELECT 'regression' AS kind, row_number() OVER (ORDER BY d DESC, source_row DESC) AS place, * FROM pool WHERE fe > be QUALIFY place <= 8)""",
        "SELECT kind, place, source_row, be AS base_word_edits, fe AS ft_word_edits, n AS reference_words FROM (SELECT * FROM better UNION ALL SELECT * FROM worse)"),
    "simple_wer": _q(f"forms AS (SELECT {_SIMPLE.format(c='text')} AS r, {_SIMPLE.format(c='generated_text')} AS b FROM tdk_subset WHERE coalesce(asr_error, '') = '')", f"scored AS (SELECT len(r) AS n, ({_DISTANCE.format(a='r', b='b')})[-1] AS e FROM forms)",
        "SELECT count(*) AS n_rows, sum(e) AS word_edits, sum(n) AS reference_words, round(coalesce(sum(e) / nullif(sum(n), 0), 0), 9) AS corpus_wer FROM scored"),
}


def _fold_rows() -> str:
    """(character, folded compatibility form) of every character for which lower() alone is not enough, by the rules of the runtime's Unicode data."""
    out = []
    for c in map(chr, (*range(0x80, 0xD800), *range(0xF900, 0x30000))):
        plain = unicodedata.normalize("NFC", unicodedata.normalize(FORM.replace("C", "D"), c).casefold())
        if plain != c.lower() and unicodedata.category(c) != "Cn":
            out.append(f"('{c}', '{plain}')")
    return ", ".join(out).replace("'''", "''''")


_FIELDS = ("text", "generated_text", "generated_text_ft")
#: Words of the canonical forms: characters are mapped one by one and put together again. Only texts beyond ASCII take that way.
_CANONICAL = f"""
fold(c, plain) AS (VALUES {_fold_rows()}),
src AS ({" UNION ALL ".join(f"SELECT source_row, '{c}' AS field, coalesce({c}, '') AS t FROM tdk_subset" for c in _FIELDS)}),
odd AS (SELECT source_row, field, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM (SELECT source_row, field, regexp_extract_all(t, '(?s).') AS x FROM src WHERE regexp_matches(t, '[^\\x00-\\x7F]'))),
again AS (SELECT source_row, field, nfc_normalize(string_agg(coalesce(plain, lower(c)), '' ORDER BY i)) AS t FROM odd LEFT JOIN fold USING (c) GROUP BY source_row, field),
said AS (SELECT source_row, field, regexp_extract_all(replace(coalesce(a.t, lower(s.t)), '’', ''''), '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)*') AS w FROM src s LEFT JOIN again a USING (source_row, field)),
form AS (SELECT source_row, any_value(w) FILTER (field = 'text') AS r, any_value(w) FILTER (field = 'generated_text') AS b, any_value(w) FILTER (field = 'generated_text_ft') AS f FROM said GROUP BY source_row),
tdk AS (SELECT form.*, file, start_time, end_time, coalesce(asr_error, '') = '' AS b_ok, coalesce(asr_error_ft, '') = '' AS f_ok FROM tdk_subset JOIN form USING (source_row))"""


def _chars(words: str) -> str:
    return f"array_to_string({words}, '')"


def _character_edits(a: str, b: str) -> str:
    """The built-in distance counts bytes, so it serves plain ASCII only."""
    letters = [f"regexp_extract_all({_chars(w)}, '(?s).')" for w in (a, b)]
    return f"CASE WHEN regexp_matches({_chars(a)} || {_chars(b)}, '[^\\x00-\\x7F]') THEN ({_DISTANCE.format(a=letters[0], b=letters[1])})[-1] ELSE levenshtein({_chars(a)}, {_chars(b)}) END"


def _scored(hypothesis: str, ok: str) -> str:
    return f"""SELECT source_row, {ok} AS ok, CASE WHEN {ok} THEN ({_DISTANCE.format(a="r", b=hypothesis)})[-1] END AS we, CASE WHEN {ok} THEN len(r) END AS rw,
    CASE WHEN {ok} THEN {_character_edits("r", hypothesis)} END AS ce, CASE WHEN {ok} THEN length({_chars("r")}) END AS rc FROM tdk"""


_CANONICAL_PAIRS = f"""{_CANONICAL},
pairs AS (SELECT source_row, file, start_time, end_time, len(r) AS n, length({_chars("r")}) AS nc, ({_DISTANCE.format(a="r", b="b")})[-1] AS be, ({_DISTANCE.format(a="r", b="f")})[-1] AS fe FROM tdk WHERE b_ok AND f_ok)"""
_CANONICAL_SIX = f"""{_CANONICAL_PAIRS},
six AS (SELECT pairs.*, {_character_edits("r", "b")} AS bce, {_character_edits("r", "f")} AS fce FROM pairs JOIN form USING (source_row))"""
_SIX_NAMES = _NAMES + ", sum(bce) AS base_char_edits, sum(fce) AS ft_char_edits, sum(nc) AS reference_characters"
_CORPUS = """SELECT '{model}' AS model, count(*) AS n_rows, count(*) FILTER (ok) AS scored, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (rw = 0) AS empty_references, sum(we) AS word_edits, sum(rw) AS reference_words,
    sum(ce) AS character_edits, sum(rc) AS reference_characters, sum(we) / nullif(sum(rw), 0) AS corpus_wer, sum(ce) / nullif(sum(rc), 0) AS corpus_cer, coalesce(count(*) FILTER (ok) / nullif(count(*), 0), 0.0) AS coverage FROM {rows}"""


def _of_pairs(name: str) -> str:
    """The SQL over simple forms with the canonical pairs in place of the simple ones."""
    return ORACLE[name].replace(_PAIRS.strip(), _CANONICAL_PAIRS.strip())


ORACLE |= {
    "normal_forms": _q(_CANONICAL, "SELECT source_row, array_to_string(r, ' ') AS text, array_to_string(b, ' ') AS generated_text, array_to_string(f, ' ') AS generated_text_ft FROM form"),
    "score_rows": _q(_CANONICAL, f"scored AS ({_scored('b', 'b_ok')})", "SELECT source_row, we AS word_edits, rw AS reference_words, ce AS character_edits, rc AS reference_characters, we / nullif(rw, 0) AS wer, ce / nullif(rc, 0) AS cer FROM scored"),
    "score_corpus": _q(_CANONICAL, f"one AS ({_scored('b', 'b_ok')})", f"two AS ({_scored('f', 'f_ok')})", _CORPUS.format(model="base", rows="one") + " UNION ALL " + _CORPUS.format(model="tuned", rows="two")),
    "paired_by_file": _q(_CANONICAL_SIX, f"SELECT file, min(source_row) AS first_row, {_SIX_NAMES} FROM six GROUP BY file"),
    "paired_comparison": _q(_CANONICAL_SIX, """t AS (SELECT count(DISTINCT coalesce(file, '')) AS videos, count(*) AS n_rows, sum(be) AS be, sum(fe) AS fe, sum(n) AS w, sum(bce) AS bce, sum(fce) AS fce, sum(nc) AS c FROM six)""",
        "SELECT videos, n_rows, (SELECT count(*) FROM tdk_subset) - n_rows AS left_out, be / nullif(w, 0) AS base_wer, fe / nullif(w, 0) AS ft_wer, bce / nullif(c, 0) AS base_cer, fce / nullif(c, 0) AS ft_cer, (fe - be) / nullif(w, 0) AS delta_wer, (be - fe) / nullif(be, 0) AS relative_wer_reduction FROM t"),
    "paired_slices": _of_pairs("simple_slices").replace("round(sum(be) / nullif(sum(n), 0), 9)", "sum(be) / nullif(sum(n), 0)").replace("round(sum(fe) / nullif(sum(n), 0), 9)", "sum(fe) / nullif(sum(n), 0)"),
    "paired_outcomes": _of_pairs("simple_outcomes"),
    "paired_examples": _of_pairs("simple_examples"),
    "uniform_sample": _q(_BASE, f"SELECT source_row, duration, word_count, wps AS words_per_second FROM feat WHERE channel <> '{HELD_OUT}' ORDER BY sha256('2026/' || source_row), source_row LIMIT 20000"),
    # The fold keeps what is left of a channel's part and the rows taken so far.
    "budget_sample": _q(_SPLIT, "few AS (SELECT channel, video, source_row, duration, row_number() OVER (PARTITION BY channel, video ORDER BY sha256('2026/' || source_row), source_row DESC) AS rank FROM split WHERE split = 'train' AND exclusion_reason = '' QUALIFY rank <= 128)",
        "visit AS (SELECT channel, list({'room': CAST(7200 AS DOUBLE) / (SELECT count(DISTINCT channel) FROM few), 'd': duration, 'kept': [source_row]} ORDER BY rank, sha256('2026/' || video), video) AS x FROM few GROUP BY channel)",
        """done AS (SELECT channel, list_reduce(x, lambda a, y: CASE WHEN y.d <= a.room THEN {'room': a.room - y.d, 'd': y.d, 'kept': list_concat(a.kept, y.kept)} ELSE a END, {'room': x[1].room, 'd': CAST(0 AS DOUBLE), 'kept': x[1].kept[1:0]}) AS z FROM visit),
        kept AS (SELECT channel, unnest(z.kept) AS source_row FROM done)""",
        "SELECT few.channel, video, rank, source_row FROM few JOIN kept USING (source_row)"),
    "metadata_audit": _q(_SPLIT, """counted AS (
        SELECT 'channel' AS section, channel AS key, count(*) AS n_rows, round(sum(duration / 3600), 9) AS hours, count(DISTINCT video) AS videos FROM split GROUP BY channel
        UNION ALL SELECT 'split', split, count(*), round(sum(duration / 3600), 9), count(DISTINCT video) FROM split WHERE exclusion_reason = '' GROUP BY split
        UNION ALL SELECT 'duration_bucket', duration_bucket, count(*), NULL, NULL FROM split GROUP BY duration_bucket
        UNION ALL SELECT 'exclusion', exclusion_reason, count(*), NULL, NULL FROM split WHERE exclusion_reason <> '' GROUP BY exclusion_reason
        UNION ALL SELECT 'flag', flag, count(*), NULL, NULL FROM (SELECT unnest(flags) AS flag FROM split WHERE NOT held_out) GROUP BY flag)""",
        "wide AS (" + ORACLE["mismatch_counts"].split("SELECT count(*) AS n_rows", 1)[1].join(["SELECT count(*) AS n_rows", ")"]),
        "SELECT * FROM counted UNION ALL SELECT 'mismatch', key, n_rows, NULL, NULL FROM (UNPIVOT wide ON * INTO NAME key VALUE n_rows)"),
}

_FULL = "regexp_matches(file, '^\\d{8}--[A-Za-z0-9_-]{11}--[^\\n]+\\.TextGrid$')"
ORACLE |= {
    "stability_top": ORACLE["stability"].replace(", round(m, 6) AS median_similarity FROM med", " FROM med QUALIFY place <= 3"),
    "group_similarities": _q(_EMB, _PROTO, "clips AS (SELECT channel, file, speaker, unnest(representative_rows) AS id, generate_subscripts(representative_rows, 1) AS pos FROM group_scores)",
        "lists AS (SELECT channel, file, speaker, string_agg(coalesce(CAST(CAST(round(s, 5) AS DECIMAL(9,5)) AS VARCHAR), '-'), ' ' ORDER BY pos) AS l, count(*) - count(s) AS missing, median(s) AS m FROM clips LEFT JOIN sim ON id = vec_id GROUP BY ALL)",
        "SELECT g.channel, g.file, g.speaker, coalesce(l, '') AS similarities, coalesce(missing, 0) AS n_missing, round(m, 6) AS median_similarity FROM group_scores g LEFT JOIN lists USING (channel, file, speaker)"),
    "unnamed_groups": f"SELECT channel, file, speaker FROM group_scores WHERE median_similarity >= {THRESHOLD} AND NOT {_FULL}",
    "detections_by_title": f"SELECT title, video, start_s, end_s FROM ({ORACLE['detections']}) JOIN ({ORACLE['detected_titles']}) USING (video)",
    "group_limit": _q(_GROUPS, "SELECT DISTINCT channel, file, speaker FROM grp ORDER BY channel, file, speaker LIMIT 100"),
    "cache_names": "SELECT source_row, sha256(coalesce(audio, '') || '|') || '.mp3' AS cache_name FROM tdk_subset",
    # Two levels of 4096 are enough for 16 million rows.
    "dataset_identity": _q(f"one AS (SELECT row_number() OVER (ORDER BY source_row) - 1 AS i, {_KEY} AS d FROM tdk_subset)", "two AS (SELECT i // 4096 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM one GROUP BY i // 4096)",
        f"SELECT (SELECT count(*) FROM one) AS n_rows, CASE WHEN count(*) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS digest, CASE WHEN (SELECT count(*) FROM one) = (SELECT count(*) FROM ycsep_static WHERE channel = '{HELD_OUT}') THEN 'full_tdk' ELSE 'subset' END AS scope FROM two"),
    "shard_times": _q(_JOURNAL, "per AS (SELECT seq % 8 AS shard, sum(duration_seconds) AS s FROM state GROUP BY 1)", "SELECT count(s) AS n, round(sum(s), 4) AS total, round(min(s), 4) AS least, round(max(s), 4) AS most FROM per"),
    "rate_density": _q(_BASE, "p AS (SELECT duration AS u, word_count / 4.0 AS v FROM feat WHERE valid)",
        "c AS (SELECT floor(u) + 0.5 AS p, floor(v) + 0.5 AS q, round(u) AS ra, round(v) AS rb, u, v FROM p)",
        "SELECT CASE WHEN near THEN ra ELSE p END AS cx, CASE WHEN near THEN rb ELSE q END * 4 AS cy, count(*) AS n FROM (SELECT *, (u - ra) ** 2 + 3 * (v - rb) ** 2 < (u - p) ** 2 + 3 * (v - q) ** 2 AS near FROM c) GROUP BY ALL"),
}
