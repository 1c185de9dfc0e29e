import random

from pyspark.sql import functions as F

from vocspan.llm import overlap as O
from vocspan.llm.transcripts import spoken_words


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def longest_chain(seeds):
    best = {}
    for s in sorted(set(seeds)):
        best[s] = 1 + max((n for t, n in best.items() if t[0] < s[0] and t[1] < s[1]), default=0)
    return max(best.values(), default=0)


def test_chains_and_extension():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice([[], ["x"], ["y"]])
        d, limit = distance(a, b), O.allowed_edits(max(len(a), len(b)))
        seeds = [(i, j) for i in range(len(a) - 4) for j in range(len(b) - 4) if a[i : i + 5] == b[j : j + 5]]
        got = O.extend(a, b, seeds)
        assert O.extend(a, b, []) == (d if d <= limit else None) and (got is None) == (d > limit) and (got is None or d <= got <= limit)
        ends = O.chain(seeds)
        assert len(ends) == longest_chain(seeds) and all(x < u and y < v for (x, y), (u, v) in zip(ends, ends[1:]))
    assert O.chain([(0, 0), (5, 3), (3, 5), (8, 8)]) in ([(0, 0), (5, 3), (8, 8)], [(0, 0), (3, 5), (8, 8)])


def brute(rows):
    out = set()
    words = {r["source_row"]: spoken_words(r.get("text")) for r in rows}
    fit = {k for k, w in words.items() if len(w) >= 20 and len(set(w)) >= 15}
    for a in rows:
        for b in rows:
            if a.get("split") == "train" and b.get("split") in ("validation", "test"):
                x, y = words[a["source_row"]], words[b["source_row"]]
                near = {a["source_row"], b["source_row"]} <= fit and distance(x, y) <= max(len(x), len(y)) // 10
                if near or (a.get("audio") and a.get("audio") == b.get("audio")):
                    out.add((min(a["source_row"], b["source_row"]), max(a["source_row"], b["source_row"])))
    return out


def test_no_pair_is_lost_among_common_phrases(spark, utterances):
    rng = random.Random(7)
    common = "and then they all fell right in front of the house".split()
    rows = []
    for i in range(260):
        if i % 2 and rows and rng.random() < 0.7:
            words = list(spoken_words(rng.choice(rows)["text"]))
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choice([[], [f"new{rng.randrange(99)}"]])
        else:
            words = common + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(8, 30))] + common[: rng.randrange(11)]
        rows.append({"source_row": i, "text": " ".join(words), "split": rng.choice(["train", "train", "test", "validation", "other", None]), "audio": rng.choice([None, "", f"https://h/c/{i}.mp3"])})
    want = brute(rows)
    df = utterances(*rows).withColumns({"h": F.lit("x"), "cls": F.lit(1), "train": F.lit("y"), "said": F.lit(0)})
    assert len(want) > 30 and {tuple(r) for r in O.found(df).collect()} == want
    report = O.report(df).agg(F.sum("n_any")).first()[0]
    assert report == len({b for a, b in want if rows[b]["split"] != "train"} | {a for a, b in want if rows[a]["split"] != "train"})


def test_addresses(spark):
    same = ["https://a.example/c/1.mp3", " HTTPS://A.EXAMPLE/c/1.mp3?x=1", "http://a.example:80/c//./1.mp3#t", "https://a.example:443/c/1%2Emp3", "https://a.example/c/1.mp3\t"]
    none = [None, "", "file:///lost/3", "n/a", "https://", "https://a.example/"]
    rows = spark.createDataFrame([(x,) for x in same + none + ["https://a.example/C/1.mp3"]], "a string").select(O.audio_key(F.col("a")).alias("k")).collect()
    keys = [r["k"] for r in rows]
    assert set(keys[: len(same)]) == {"a.example/c/1.mp3"} and set(keys[len(same) : -1]) == {None} and keys[-1] == "a.example/C/1.mp3"


def test_empty_and_nulls(spark, utterances):
    assert O.found(utterances()).count() == 0
    assert O.found(utterances({}, {}, {"split": "train"}, {"split": "test"})).count() == 0


def test_short_texts_of_many_words(spark, utterances):
    letters = [chr(97 + i) for i in range(16)]
    text = " ".join(letters) + " \u33c2 \u33d8 1"  # 16 + a m, p m, 1 in few characters
    assert len(text) < 39 and len(spoken_words(text)) >= 20 and len(set(spoken_words(text))) >= 15
    assert O.found(utterances({"text": text, "split": "train"}, {"text": text, "split": "test"})).count() == 1


def test_report_forms_no_pairs(spark, utterances):
    text = " ".join(f"w{i}" for i in range(30))
    df = utterances(*[{"text": text, "split": "train", "audio": "https://h/a.mp3"}] * 300, *[{"text": text + (" x" if i % 2 else ""), "split": "test", "audio": "https://h/a.mp3"} for i in range(300)])
    got = O.report(df).first()
    assert (got["n_rows"], got["n_audio"], got["n_exact"], got["n_near"], got["n_any"], round(got["coverage"], 9)) == (300, 300, 150, 150, 300, round((150 + 150 * 30 / 31) / 300, 9))
    kept = O.records(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "train_row" not in kept and "eval_row" not in kept


def test_long_text(spark, utterances):
    text = " ".join(f"w{i % 900}x{i // 7 % 11}" for i in range(20_000))
    df = utterances({"text": text, "split": "train"}, {"text": text.replace("w5x", "v5x"), "split": "test"})
    assert O.found(df).count() == 1


def test_repeated_phrases_inside_a_text(spark, utterances):
    rng = random.Random(11)
    rows = []
    phrase = [f"p{i}" for i in range(9)]
    for i in range(60):
        base = [f"u{i // 2}x{j}" for j in range(8)]
        words = phrase + base + phrase + phrase[: i // 2 % 9]
        if i % 2:
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([["odd"], ["odd", words[at]], []])
        rows.append({"source_row": i, "text": " ".join(words), "split": "test" if i % 2 else "train"})
    want = brute(rows)
    assert len(want) >= 25 and {tuple(r) for r in O.found(utterances(*rows)).collect()} == want


def best_alignment(a, b):
    """Fewest edits and, among alignments with that few, most equal words, over the whole table."""
    prev = [(j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        cur = [(i, 0)]
        for j, y in enumerate(b, 1):
            step = (prev[j - 1][0], prev[j - 1][1] - 1) if x == y else (prev[j - 1][0] + 1, prev[j - 1][1])
            cur.append(min(step, (prev[j][0] + 1, prev[j][1]), (cur[-1][0] + 1, cur[-1][1])))
        prev = cur
    return prev[-1][0], -prev[-1][1]


def test_equal_words():
    rng = random.Random(3)
    for _ in range(600):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 14))] for _ in range(2))
        want = best_alignment(a, b)
        assert all(O.equal_words(a, b, limit) == want for limit in (want[0], want[0] + 3))


def test_coverage_is_that_of_the_alignment(spark, utterances):
    rng = random.Random(5)
    common = "and then they all fell right in front of the house".split()
    rows = []
    for i in range(120):
        if i % 2:
            words = spoken_words(rows[-1]["text"])
            for _ in range(rng.randrange(1, 3)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choice([[], ["odd"], ["odd"]])
        else:
            words = [f"w{i}x{j}" for j in range(15 + i % 30)] + common
        rows.append({"source_row": i, "text": " ".join(words), "split": "test" if i % 2 else "train", "channel": "c", "file": f"f{i}"})
    n26 = [f"v{i}" for i in range(26)]
    rows += [{"source_row": 200, "text": " ".join(n26), "split": "train"}, {"source_row": 201, "text": " ".join([*n26[:13], "odd", *n26[14:]]), "split": "test", "file": "one"}]
    rows += [{"source_row": 300, "split": "train", "audio": "https://a.example/1.mp3"}, {"source_row": 301, "split": "test", "audio": "https://a.example/1.mp3", "file": "heard"}]
    said = {r["source_row"]: spoken_words(r.get("text")) for r in rows}
    rows_split = {r["source_row"]: r["split"] for r in rows}
    want = {}
    for a, b in brute(rows):
        edits, equal = best_alignment(said[a], said[b])
        want[a, b] = equal / len(said[b]) if said[b] else None
    assert len(want) > 40 and want[200, 201] == 25 / 26 and want[300, 301] is None
    df = utterances(*rows)
    best = {}
    for (a, b), c in want.items():
        row = b if rows_split[b] != "train" else a
        best[row] = max(filter(None, (best.get(row), c)), default=None)
    for parts, share in ((1, O.COMMON_SHARE), (7, 0.5)):
        assert {(r["train_row"], r["eval_row"]) for r in O.overlaps(df.repartition(parts), share).collect()} == set(want)
        assert {r["source_row"]: r["covered"] for r in O.records(df.repartition(parts), share).collect()} == best
    report = {r["file"]: (r["n_any"], r["coverage"]) for r in O.report(df).collect()}
    assert report["one"] == (1, 25 / 26) and report["heard"] == (1, 0.0)
