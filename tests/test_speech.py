import hashlib
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from vocspan.functions import keys as K
from vocspan.functions import text as T
from vocspan.functions import values as V
from vocspan.operators import gates, intervals, journal, quality, sampling, scoring, shards, speakers, stats


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


SEGMENTS = "source_row long, channel string, file string, speaker string, start_time string, end_time string, text string, audio string"


def segments(spark, rows):
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    return spark.createDataFrame([tuple({"source_row": i, "channel": "c", "file": "20200101--abc--t.TextGrid", "speaker": "S", "text": "hello there", "audio": f"https://x/{i}"} .__or__(r).get(n) for n in names) for i, r in enumerate(rows)], SEGMENTS)


def test_canonical_text_and_edits(spark):
    rng = random.Random(1)
    pool = ["Straße", "don’t", "DON'T", "ﬁne", "１２", "İstanbul", "naïve", "_x_", "it's'", "--", "a", "b", "c d", "'tis", "你好"]
    pairs = [(" ".join(rng.choices(pool, k=rng.randrange(0, 9))), " ".join(rng.choices(pool, k=rng.randrange(0, 9)))) for _ in range(200)] + [(None, "a"), ("", "")]

    def norm(t):
        out, t = "", unicodedata.normalize("NFKC", t or "").casefold().replace("’", "'")
        for i, c in enumerate(t):
            inner = c == "'" and t[i - 1 : i].isalnum() and t[i + 1 : i + 2].isalnum()
            out += c if c.isalnum() or inner else " "
        return " ".join(out.split())

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    n = df.select("i", T.canonical_text(F.col("a")).alias("a"), T.canonical_text(F.col("b")).alias("b"))
    out = n.select("i", "a", T.word_edits(F.col("a"), F.col("b")).alias("w"), T.word_count(F.col("a")).alias("n"), T.character_edits(F.col("a"), F.col("b")).alias("c")).collect()
    for r in out:
        a, b = (norm(x) for x in pairs[r["i"]])
        assert r["a"] == a
        assert r["n"] == len(a.split())
        assert r["w"] == distance(a.split(), b.split())
        assert r["c"] == distance(a.replace(" ", ""), b.replace(" ", ""))


def test_scores_pool_sums_and_leave_undefined_rates_null(spark):
    rows = [(0, "one two three four", "one two", ""), (1, "", "extra words", ""), (2, "failed", "x", "Timeout"), (3, "ﬁne", "fine", None)]
    df = spark.createDataFrame(rows, "source_row long, text string, p string, e string")
    scored = scoring.score_rows(df, "p", "e")
    got = {r["source_row"]: (r["word_edits"], r["wer"]) for r in scored.collect()}
    assert got == {0: (2, 0.5), 1: (2, None), 2: (None, None), 3: (0, 0.0)}
    t = scoring.score_corpus(scored).first()
    assert (t["n_rows"], t["scored"], t["failed"], t["empty_references"], t["corpus_wer"], t["coverage"]) == (4, 3, 1, 1, 4 / 5, 0.75)
    e = scoring.score_corpus(scored.limit(0)).first()
    assert e["corpus_wer"] is None and e["coverage"] == 0


def test_recorded_example_pair(spark):
    rows = [(0, "f", "1", "3", "power game. I mean, it's a", "Power gives you a little bit of a little bit of a little bit of a little bit of a little bit.", "power gain. I mean, it's great than", "", "")]
    df = spark.createDataFrame(rows, "source_row long, file string, start_time string, end_time string, text string, generated_text string, generated_text_ft string, asr_error string, asr_error_ft string")
    r = scoring.pair_rows(df).first()
    assert (r["base_word_edits"], r["ft_word_edits"], r["reference_words"]) == (20, 3, 6)
    assert {s["slice"] for s in scoring.error_slices(scoring.pair_rows(df)).collect()} == {"all", "duration:2-5s"}


def test_half_even_recovery_and_outcomes(spark):
    df = spark.createDataFrame([(0.5, 1), (1.5, 1), (0.25, 10)], "r double, w int").select(scoring.edits_from_rate(F.col("r"), F.col("w")).alias("e"))
    assert [r["e"] for r in df.collect()] == [0, 2, 2]


def test_bootstrap_is_that_of_the_generator_at_every_size(spark):
    import numpy as np

    rng = random.Random(2)
    rows = [(f"f{i}", (i * 7) % 211, rng.randrange(5, 40), rng.randrange(5, 30), rng.choice([0, 100])) for i in range(211)]
    files = spark.createDataFrame(rows, "file string, first_row long, base_word_edits long, ft_word_edits long, reference_words long").repartition(3)
    m = np.array([r[2:] for r in sorted(rows, key=lambda r: r[1])])
    sums = m[np.random.default_rng(2026).integers(0, 211, size=(500, 211))].sum(axis=1)
    want = np.quantile((sums[:, 1] - sums[:, 0]) / sums[:, 2], [0.025, 0.975]).tolist()
    for per_range, per_task in ((scoring.RANGE, scoring.DRAWS), (50, 160), (211, 499)):
        got = scoring.cluster_bootstrap(files, 500, per_range=per_range, per_task=per_task)
        assert got == {"clusters": 211, "valid_draws": 500, "low": want[0], "high": want[1]}
    assert scoring.cluster_bootstrap(files.limit(1))["low"] is None and scoring.cluster_bootstrap(files.limit(0))["clusters"] == 0
    nothing = scoring.cluster_bootstrap(files.withColumn("reference_words", F.lit(0).cast("long")), 100)
    assert nothing["valid_draws"] == 0 and nothing["low"] is None
    with pytest.raises(ValueError):
        scoring.cluster_bootstrap(files, 10)


def test_rows_left_out_are_counted(spark):
    df = spark.createDataFrame([("", None), ("x", ""), (None, ""), ("", "y")], "asr_error string, asr_error_ft string")
    assert tuple(scoring.left_out(df).first()) == (2, 2)
    gates.both_succeeded(df.filter("coalesce(asr_error, '') = '' and coalesce(asr_error_ft, '') = ''"), "asr_error", "asr_error_ft")
    with pytest.raises(ValueError):
        gates.both_succeeded(df, "asr_error", "asr_error_ft")
    gates.one_channel(df.withColumn("channel", F.lit("a")), "a")
    with pytest.raises(ValueError):
        gates.one_channel(df.withColumn("channel", F.lit(None).cast("string")), "a")


def test_audit_in_one_pass_says_what_the_single_counts_say(spark):
    good = {"start_time": "0", "end_time": "1"}
    rows = [good | {"channel": "held", "audio": "https://h"}, good | {"channel": "a", "file": "b", "text": "um"}, good | {"channel": "a", "file": "b", "end_time": "40", "text": "lah"}, {"channel": None, "file": "c", "start_time": "x"}]
    split = quality.with_split(quality.with_features(segments(spark, rows)), "held")
    got = {(r["section"], r["key"]): (r["n_rows"], r["videos"]) for r in quality.audit(split).collect()}
    for r in quality.flag_counts(split).collect():
        assert got.pop(("flag", r["flag"])) == (r["n_rows"], None)
    for name, n in quality.mismatch_counts(split).first().asDict().items():
        assert got.pop(("mismatch", name)) == (n, None)
    for r in quality.audit_by(split, "channel").collect():
        assert got.pop(("channel", r["channel"])) == (r["n_rows"], r["videos"])
    assert {k[0] for k in got} == {"split", "duration_bucket", "exclusion"} and sum(n for (s, _), (n, _) in got.items() if s == "duration_bucket") == 4
    assert "flag" not in {r["section"] for r in quality.audit(split.limit(0)).collect()}
    flags = quality.flag_counts(split)._jdf.queryExecution().optimizedPlan().toString()
    assert flags.count("THEN repeated_tokens") == 1  # no filter on the flags, for which they would be computed twice


def test_flags(spark):
    rows = [
        {"start_time": "0", "end_time": "1", "text": "um uh hmm"}, {"start_time": "x", "end_time": "1", "text": "..."}, {"start_time": "0", "end_time": "0.4", "text": "no no no no"}, {"start_time": "0", "end_time": "30", "text": "aaaaaaa"},
        {"start_time": "nan", "end_time": "inf", "text": None}, {"start_time": "2", "end_time": "1", "text": "lah don’t"},
    ]
    got = [r["flags"] for r in quality.with_features(segments(spark, rows)).orderBy("source_row").collect()]
    assert got[0] == ["filler_only"] and got[1] == ["invalid_timestamp", "empty_or_nonlexical_text"] and got[2] == ["short", "dense_text", "repeated_tokens"]
    assert got[3] == ["long", "sparse_text", "extreme_sparse", "repeated_characters"] and got[4] == ["invalid_timestamp", "empty_or_nonlexical_text"] and got[5] == ["invalid_timestamp"]
    with pytest.raises(ValueError):
        quality.with_features(segments(spark, rows).drop("audio"))


def test_exclusion_chain(spark):
    good = {"start_time": "0", "end_time": "1"}
    rows = [
        good | {"channel": "held", "file": "20200101--vid--t.TextGrid", "audio": "https://h"}, good | {"file": "20210101--vid--u.TextGrid"}, good | {"file": "b", "audio": "https://h"}, good | {"file": "b", "audio": "https://dup", "end_time": "40"},
        good | {"file": "b", "audio": "https://dup"}, good | {"file": "b", "audio": "ftp://x"}, good | {"file": "b", "text": "--"}, good | {"file": "b", "end_time": "0.29"}, good | {"file": "b", "end_time": "0.3"},
    ]
    got = [(r["split"], r["exclusion_reason"]) for r in quality.with_split(quality.with_features(segments(spark, rows)), "held").orderBy("source_row").collect()]
    assert [r for _, r in got] == ["tdk_holdout"] * 3 + ["pilot_duration_outside_0.3_to_20", "duplicate_audio_url", "invalid_audio_url", "invalid_timestamp_or_empty_text", "pilot_duration_outside_0.3_to_20", ""]
    share = int(hashlib.sha256(b"2026/b").hexdigest()[:16], 16) / 2**64
    assert {s for s, _ in got[3:]} == {"validation" if share < 0.1 else "train"}


def test_overlap_sweep_across_blocks(spark):
    rng = random.Random(3)
    rows = [("v", rng.choice("ab"), s := rng.randrange(0, 4000), s + rng.randrange(1, 900)) for _ in range(60)]
    seconds = {t: [w for _, w, s, e in rows if s <= t < e] for t in range(5000)}
    want = (sum(bool(x) for x in seconds.values()), sum(len(x) > 1 for x in seconds.values()), sum(len(set(x)) > 1 for x in seconds.values()))
    df = spark.createDataFrame([(v, w, float(s), float(e)) for v, w, s, e in rows], "video string, speaker string, start_s double, end_s double")
    r = intervals.overlap_seconds(df).first()
    assert (r[1], r[2], r[3]) == want
    assert intervals.overlap_seconds(df.limit(0)).count() == 0
    assert intervals.overlap_totals(intervals.overlap_seconds(df.limit(0))).first()["overlap_fraction"] is None


def test_row_keys_match_python(spark):
    values = ['plain', 'q"uo\\te', "tab\tnew\nline", "é 你好 / ‘x’", None, "\x01"]
    rows = [{c: v for c in K.ROW_KEY} for v in values]
    df = spark.createDataFrame([tuple(r[c] for c in K.ROW_KEY) + (i,) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in K.ROW_KEY) + ", source_row long")
    want = [hashlib.sha256(json.dumps({k: v or "" for k, v in r.items()}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for r in rows]
    assert [r["k"] for r in df.orderBy("source_row").select(K.row_key().alias("k")).collect()] == want
    ascii_want = [hashlib.sha256(json.dumps({c: (str(i) if c == "source_row" else r[c] or "") for c in K.AUDIO_KEY}, sort_keys=True).encode()).hexdigest() for i, r in enumerate(rows)]
    assert [r["k"] for r in df.orderBy("source_row").select(K.ascii_key().alias("k")).collect()] == ascii_want
    one = spark.createDataFrame([("a b/é.TextGrid", "1911.6785", "2"), ("x", "bad", "2")], "f string, s string, e string").select(K.clip_address(F.col("f"), F.col("s"), F.col("e"), "https://b/", "https://e").alias("u")).collect()
    assert one[0]["u"] == "https://e?url=https%3A%2F%2Fb%2Fa%2520b%2F%25C3%25A9.wav&start=1911.678&end=2.000&fmt=mp3" and one[1]["u"] is None


def test_journal(spark):
    j = spark.createDataFrame([(1, "a", "x", 1.0, "Timeout"), (2, "a", "y", 1.0, ""), (3, "b", None, None, "Timeout"), (4, "c", "z", 1.0, ""), (5, "c", None, None, "late")], "seq long, row_key string, generated_text string, duration_seconds double, error string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "row_key string")
    state = journal.latest(j, "row_key", "seq")
    assert {r["row_key"]: r["seq"] for r in state.collect()} == {"a": 2, "b": 3, "c": 5}
    assert sorted(r[0] for r in journal.pending(rows, state, "row_key").collect()) == ["b", "c", "d", "d"]
    assert {r["row_key"]: r["journal_error"] for r in journal.export(rows, state, "row_key").collect()} == {"a": "", "b": "Timeout", "c": "late", "d": "not_processed"}
    assert journal.latest(j.limit(0), "row_key", "seq").count() == 0


def test_shards(spark):
    rows = spark.createDataFrame([(i * 3, f"t{i}") for i in range(101)], "source_row long, text string").repartition(5)
    placed = shards.with_position(rows, "source_row")
    assert [(r["source_row"], r["position"]) for r in placed.orderBy("source_row").collect()] == [(i * 3, i) for i in range(101)]
    parts = [shards.shard(placed, i, 4) for i in range(4)]
    assert [p.count() for p in parts] == [shards.shard_rows(101, i, 4) for i in range(4)]
    local = [p.withColumn("local", F.floor(F.col("position") / 4)).drop("position") for p in parts]
    assert tuple(shards.mismatches(placed, shards.merge(local), ["source_row", "text"]).first()) == (0, 0, 0)
    assert [r["position"] for r in shards.shard(placed, 1, 4, limit=2).collect()] == [1, 5]
    for bad in ({"limit": 0}, {}):
        with pytest.raises(ValueError):
            shards.shard(placed, 4 if not bad else 0, 4, **bad)


def test_all_shards_are_whole(spark, tmp_path):
    from vocspan.plans import speech

    rows = [(i, speech.HELD_OUT if i % 3 else "other") for i in range(7000)]
    df = spark.createDataFrame(rows, "source_row long, channel string")
    kept = [i for i, c in rows if c == speech.HELD_OUT]
    missing = [c for c in ("file", "speaker", "start_time", "end_time", "text", "audio", "split") if c not in df.columns]
    df.select("*", *[F.lit("").alias(c) for c in missing]).write.parquet(f"{tmp_path}/ycsep_static.parquet")
    got = {(r["shard"], r["local"], r["source_row"]) for r in speech.QUERIES["shard_all"](spark, str(tmp_path)).collect()}
    assert len(kept) > 500 * speech.SHARDS and got == {(i % speech.SHARDS, i // speech.SHARDS, row) for i, row in enumerate(kept)}


def test_greedy_budget_skips_and_goes_on(spark):
    rng = random.Random(4)
    rows = [(c, f"v{rng.randrange(3)}", i, round(rng.uniform(1, 30), 2)) for i, c in enumerate(rng.choices("xy", k=200))]
    df = spark.createDataFrame(rows, "channel string, video string, source_row long, duration double")
    ranked = sampling.bottom_k(df, ["channel", "video"], 20)
    h = lambda x: hashlib.sha256(f"2026/{x}".encode()).hexdigest()
    want = set()
    for c in "xy":
        pools = {}
        for _, v, i, d in sorted((r for r in rows if r[0] == c), key=lambda r: (h(r[2]), -r[2])):
            pools.setdefault(v, []).append((i, d))
        left = 0.2 * 3600 / 2
        for k in range(20):
            for v in sorted(pools, key=h):
                if k < len(pools[v]) and pools[v][k][1] <= left:
                    want.add(pools[v][k][0])
                    left -= pools[v][k][1]
    got = sampling.greedy_budget(ranked, 0.2)
    assert {r["source_row"] for r in got.collect()} == want
    assert all(r["enough"] for r in sampling.budget_report(got, df, 0.2).collect())


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(6)] + [(9, [0.0, 0.0, 0.0])], "id int, v array<double>").withColumn("v", speakers.unit(F.col("v"))).filter("v is not null")
    assert df.count() == 6
    import numpy as np

    m = np.array([r["v"] for r in df.orderBy("id").collect()])
    want = {"first_half": m[:3].mean(0), "second_half": m[3:].mean(0)} | {f"omit_window_{i}": np.delete(m, i, 0).mean(0) for i in range(6)}
    got = {r["variant"]: np.array(r["prototype"]) for r in speakers.leave_one_out(df, "id", "v").collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k] / np.linalg.norm(want[k])) for k in want)
    sims = speakers.cosine_to(df, "v", speakers.leave_one_out(df, "id", "v"), "variant")
    assert sims.count() == 48


def test_more_vectors_than_a_block(spark):
    import numpy as np

    m = np.random.default_rng(8).normal(size=(1203, 3))
    m[:400] = m[0]
    m /= np.linalg.norm(m, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(5000, None)], "id int, v array<double>")
    few = df.filter("id % 401 = 7")
    protos = df.filter("v is not null").select(F.col("id").cast("string").alias("name"), F.col("v").alias("prototype"))
    sims = speakers.cosine_to(few.repartition(3), "v", protos, "name").collect()
    assert len(sims) == 3 * 1203 and all(abs(r["similarity"] - m[r["id"]] @ m[int(r["name"])]) < 1e-12 for r in sims)
    s = (m @ m.T)[np.triu_indices(len(m), 1)]
    for block in (speakers.BLOCK, 70):
        got = speakers.pairwise(df.repartition(2), "id", "v", block).first()
        assert got[0] == len(s) and np.allclose(got[1:], [s.min(), np.median(s)], atol=1e-12, rtol=0)
    assert tuple(speakers.pairwise(df.limit(0), "id", "v").first()) == (0, None, None) and speakers.cosine_to(df.limit(0), "v", protos, "name").count() == 0


def test_binned_median(spark):
    rng = random.Random(6)
    for values in ([], [0.25], [0.5, -0.5], [1.0, 1.0, 1.0, 0.1], [rng.choice([0.1, 0.1 + 1e-17, 0.1 + 2e-16, 0.3]) for _ in range(40)], [rng.uniform(-1, 1) for _ in range(75)]):
        df = spark.createDataFrame([(x,) for x in [*values, None]], "s double").filter("s is not null").coalesce(1)

        def count(low, high, bins, df=df):
            place = F.when(F.col("s") < low, -1).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("s") - low) / (high - low) * bins)))
            return df.filter(F.col("s") <= high).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))

        want = (len(values), min(values, default=None), sorted(values)[(len(values) - 1) // 2] / 2 + sorted(values)[len(values) // 2] / 2 if values else None)
        assert speakers.binned_median(count, bins=4) == want


def test_group_similarities(spark):
    groups = spark.createDataFrame([("a", [3, 1, 9]), ("b", [2]), ("c", []), ("d", None), ("e", [9])], "g string, ids array<long>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 4.0]), (4, [0.0, 0.0])], "id long, v array<double>")
    got = {r["g"]: (r["similarities"], r["n_missing"], r["median_similarity"]) for r in speakers.group_similarities(groups, ["g"], "ids", vectors, "id", "v", [1.0, 0.0]).collect()}
    assert got == {"a": ([0.6, 1.0, None], 1, 0.8), "b": ([0.0], 0, 0.0), "c": ([], 0, None), "d": ([], 0, None), "e": ([None], 1, None)}


def test_unnamed_recordings_are_seen(spark):
    rows = [("c", "20200101--abcdefghijk--t.TextGrid", "S", 0.9, [[0.0, 1.0], [1.0, 2.0]]), ("c", "other.TextGrid", "S", 0.8, [[0.0, 1.0]]), ("c", "bad", "S", 0.1, [[0.0, 1.0]])]
    df = spark.createDataFrame(rows, "channel string, file string, speaker string, median_similarity double, segments array<array<double>>")
    assert [r["file"] for r in speakers.unnamed(df, 0.5, "n").collect()] == ["other.TextGrid"]
    assert [tuple(r) for r in speakers.detections(df, 0.5, "n").collect()] == [("abcdefghijk", 0.0, 2.0)]
    with pytest.raises(ValueError):
        speakers.detections(df, 0.5, "n", strict=True)
    known = spark.createDataFrame([("abcdefghijk", "Resolved"), ("zzzzzzzzzzz", "Z")], "video string, title string")
    assert [tuple(r) for r in speakers.titles(df, 0.5, "n", known).collect()] == [("abcdefghijk", "Resolved")] and [tuple(r) for r in speakers.titles(df, 0.5, "n", known.limit(0)).collect()] == [("abcdefghijk", "t")]
    top = spark.createDataFrame([("v", i, float(i % 3)) for i in range(6)], "variant string, label int, m double")
    assert {(r["label"], r["place"]) for r in speakers.top_per(top, "variant", "m", "label").collect()} == {(2, 1), (5, 2), (1, 3)}


def test_places_in_groups_series_and_quantiles(spark):
    import numpy as np

    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), i, rng.choice([None, float("nan"), rng.random(), 0.5]) if i % 5 == 0 else rng.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(7)
    placed = shards.with_group_position(df, ["k"], ["i"]).collect()
    for k in ("hot", "cold", None):
        mine = sorted((r["i"], r["position"]) for r in placed if r["k"] == k)
        assert [p for _, p in mine] == list(range(sum(r[0] == k for r in rows)))
        values = [r[2] for r in rows if r[0] == k and r[2] is not None and r[2] == r[2]]
        got = next(tuple(r)[1:] for r in stats.quantiles(df, ["k"], "v").collect() if r["k"] == k)
        assert np.allclose(got, np.quantile(values, [0.025, 0.5, 0.975]), atol=1e-12, rtol=0)
    clean = df.withColumn("v", F.when(F.isnan("v"), F.lit(None)).otherwise(F.col("v")))
    rolled = {(r["k"], r["i"]): r["rolling"] for r in stats.rolling_median(clean, ["k"], "i", "v", rows=5, piece=20).collect()}
    for k in ("hot", "cold", None):
        mine = [r for r in rows if r[0] == k]
        for n, r in enumerate(mine):
            last = [x[2] for x in mine[max(0, n - 4) : n + 1] if x[2] is not None and x[2] == x[2]]
            assert rolled[k, r[1]] == (pytest.approx(float(np.median(last))) if last else None)
    assert stats.quantiles(df.limit(0), ["k"], "v").count() == 0 and stats.rolling_median(df.limit(0), ["k"], "i", "v").count() == 0
    assert tuple(stats.worker_time(df.select("v").filter("v = 0.5"), "v").first())[2:] == (0.5, 0.5)


def test_hexagons(spark):
    rng = random.Random(3)
    points = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(200)]
    centres = [(i * 1.0, j * 2.0) for i in range(-1, 11) for j in range(-1, 7)] + [(i + 0.5, j * 2.0 + 1.0) for i in range(-1, 11) for j in range(-1, 7)]
    near = lambda p: min(centres, key=lambda c: (p[0] - c[0]) ** 2 + 3 * ((p[1] - c[1]) / 2) ** 2)
    want = {}
    for p in points:
        want[near(p)] = want.get(near(p), 0) + 1
    got = stats.hexagons(spark.createDataFrame([*points, (None, 1.0)], "x double, y double"), "x", "y", 1.0, 1.0).collect()
    assert {(r["cx"], r["cy"]): r["n"] for r in got} == want


def test_reuse_of_a_cache(spark):
    rows = spark.createDataFrame([("a", "x.mp3"), ("b", "y.mp3"), ("b", "y.mp3")], "row_key string, cache_name string")
    cached = spark.createDataFrame([("b", "y.mp3"), ("z", "q.mp3")], "row_key string, cache_name string")
    assert sorted((r["row_key"], r["cached"]) for r in journal.reuse(rows, cached, "row_key").collect()) == [("a", False), ("b", True), ("b", True)]
    with pytest.raises(Exception, match="another name"):
        journal.reuse(rows, cached.withColumn("cache_name", F.lit("other.mp3")), "row_key").collect()
    assert [r[0] for r in journal.limited(rows, ["row_key"], 1).collect()] == ["a"] and journal.limited(rows, ["row_key"]).count() == 2
    with pytest.raises(ValueError):
        journal.limited(rows, ["row_key"], 0)
    short = spark.createDataFrame([(0.1, "ValueError: Insufficient or invalid audio: 3"), (0.3, "ValueError: Insufficient or invalid audio"), (0.1, "Timeout"), (None, None)], "d double, e string")
    assert [r[0] for r in short.select(journal.settled_short(F.col("d"), F.col("e"))).collect()] == [True, False, False, False]
    assert [r[0] for r in spark.createDataFrame([(5,), (4,)], "n int").select(journal.scope(F.col("n"), 5)).collect()] == ["full_tdk", "subset"]
    names = spark.createDataFrame([("u", "f"), (None, None)], "a string, b string").select(K.cache_name(F.col("a"), F.col("b")).alias("c")).select("c", K.is_cache_name(F.col("c")).alias("ok")).collect()
    assert names[0]["c"] == hashlib.sha256(b"u|f").hexdigest() + ".mp3" and all(r["ok"] for r in names)


def test_digest_of_a_data_set(spark):
    rows = [(i, f"t{i}", None if i % 3 else "x") for i in range(50)]
    df = spark.createDataFrame(rows, "position long, text string, generated_text string").repartition(4)
    level = [hashlib.sha256(json.dumps({"text": t}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for _, t, _ in rows]
    while True:
        level = [hashlib.sha256("".join(level[i : i + 7]).encode()).hexdigest() for i in range(0, len(level), 7)]
        if len(level) == 1:
            break
    assert tuple(K.ordered_digest(df, "position", ["text"], fan=7).first()) == (50, level[0])
    whole = K.identity(df, "position").first()["digest"]
    assert whole == K.identity(df.withColumn("generated_text", F.lit("other")), "position").first()["digest"]
    assert whole != K.identity(df.withColumn("position", 49 - F.col("position")), "position").first()["digest"]
    assert tuple(K.ordered_digest(df.limit(0), "position", ["text"]).first()) == (0, hashlib.sha256(b"").hexdigest())


def test_disjoint_periods(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 4), ("a", 6, 9), ("b", 1, 2)], "k string, s int, e int")
    assert {tuple(r) for r in intervals.disjoint_check(df, "k", "s", "e").collect()} == {("a", 1), ("b", 0)}


def test_windows_and_medians(spark):
    start, end = speakers.clip_window(F.col("s"), F.col("e"))
    rows = spark.createDataFrame([(0.0, 4.0), (0.0, 9.0)], "s double, e double").select(start.alias("a"), end.alias("b")).collect()
    assert [tuple(r) for r in rows] == [(0.0, 4.0), (2.0, 7.0)]
    m = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0],), ([],), (None,)], "v array<double>").select(speakers.array_median(F.col("v")).alias("m")).collect()
    assert [r["m"] for r in m] == [2.0, 2.5, None, None]


def test_video_names(spark):
    f = ["20200101--abcdefghijk--a--b.TextGrid", "x--y.TextGrid", "plain.TextGrid"]
    df = spark.createDataFrame([(x,) for x in f], "f string")
    vid, title = V.video_identity(F.col("f"))
    assert [tuple(r) for r in df.select(V.video_key(F.col("f")), vid, title).collect()] == [("abcdefghijk", "abcdefghijk", "a--b"), ("x--y", None, None), ("plain", None, None)]


def test_gates(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    gates.none_match(df, F.col("k") == "z", "x")
    gates.disjoint(df, df.filter("k = 'q'"), "k", "x")
    gates.same_keys(df, df, "k", "x")
    report = lambda i, **kw: {"shard_index": i, "num_shards": 2, "rows_in_output": shards.shard_rows(5, i, 2), "source_sha256": "s", "execution_path": "e", "model_sha256": "m"} | kw
    gates.shards_complete([report(0), report(1)], 5)
    bad = [lambda: gates.none_match(df, F.col("k") == "a", "x"), lambda: gates.disjoint(df, df, "k", "x"), lambda: gates.same_keys(df, df.limit(1), "k", "x"), lambda: gates.shards_complete([report(0)], 5),
           lambda: gates.shards_complete([report(0), report(1, source_sha256="t")], 5), lambda: gates.shards_complete([report(0), report(1, failed_transcriptions=1)], 5), lambda: gates.same_config({"a": 1}, {"a": 2}), lambda: gates.both_filled({"train": 1}),
           lambda: gates.search_complete({"groups_total": 2, "groups_processed": 1}, 2), lambda: gates.fresh_target("/tmp", "/tmp"), lambda: speakers.select_groups(df, 2.0, "x"), lambda: speakers.select_groups(df, 0.5, " ")]
    for check in bad:
        with pytest.raises(ValueError):
            check()


def test_histograms(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (100.0,), (101.0,), (None,)], "x double")
    assert [r["n"] for r in stats.histogram(df, "x", stats.RATE_BINS).orderBy("bin").collect()] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert sum(r["n"] for r in stats.equal_histogram(df, "x", 4).collect()) == 4
