import random

from pyspark.sql import functions as F

from vocspan.llm import repetition as R


def brute(words, run=3):
    marked = set()
    for i in range(len(words) - run + 1):
        if any(words[j : j + run] == words[i : i + run] for j in range(i)):
            marked |= set(range(i, i + run))
    return len(marked)


def test_against_a_quadratic_loop():
    rng = random.Random(1)
    for _ in range(300):
        words = [rng.choice("abcde") for _ in range(rng.randrange(0, 40))]
        assert R.repeated_words(words) == brute(words)


def test_cases(spark):
    long = "we saw the red boat at the pier today "
    texts = {
        1: long * 3, 2: "stove " * 13, 3: "tell me more tell me more", 4: "one two three four five six seven eight nine ten eleven twelve thirteen", 5: None, 6: "", 7: "[music] um uh",
        8: "We saw the red boat at the pier today! we SAW the ｒed boat, um, at the pier today...", 9: long * 20_000, 10: "我们昨天去了那个市场" * 3, 11: "我们昨天去了" * 2,
    }
    df = spark.createDataFrame([(k, "text", t) for k, t in texts.items()] + [(1, "text", texts[1])], "source_row long, field string, text string").withColumns({"x": F.lit(1), "share": F.lit("y")})
    assert sorted(r["source_row"] for r in R.found(df).collect()) == [1, 1, 2, 8, 9, 10, 11]
    shares = {r["source_row"]: (r["n_words"], r["share"]) for r in R.shares(df).collect()}
    assert shares[5] == shares[6] == shares[7] == (0, 0.0) and shares[4] == (13, 0.0) and len(shares) == 11
    assert R.found(df.limit(0)).count() == 0
