from pyspark.sql import functions as F

from vocspan.operators.hotkeys import exact_distinct_per_key, heavy_keys, per_key

SCHEMA = "channel string, file string, text string, n_rows long, key_value string"


def test_heavy_and_complete(spark):
    rows = [("a", f"f{i % 50}", f"t{i % 7}", 1, "z") for i in range(900)] + [("b", "f0", None, 1, None)] * 50 + [(None, None, "t", 1, "z")] * 50
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in heavy_keys(df, ["channel", "file"], 0.05).select("key_column", "key_value", "n_rows").collect()}
    assert got == {("channel", "a", 900), ("channel", "b", 50), ("file", "f0", 68)}
    every = {(r["key_column"], r["key_value"]): r["n"] for r in per_key(df, ["channel", "file"], [F.count(F.lit(1)).alias("n")]).collect()}
    assert every["channel", None] == 50 and sum(n for (c, _), n in every.items() if c == "file") == 1000
    assert {tuple(r) for r in exact_distinct_per_key(df, "channel", "text").collect()} == {("a", 7), ("b", 0), (None, 1)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert heavy_keys(df, ["channel", "file"], 0.05).count() == 0
