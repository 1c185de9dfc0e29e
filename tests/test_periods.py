import random

from pyspark.sql import functions as F

from vocspan.functions.labels import clean_speaker
from vocspan.functions.times import parse_ms
from vocspan.operators.periods import periods_and_gaps

SCHEMA = "e string, start_ms long, end_ms long"


def brute(rows):
    out = set()
    for e in {r[0] for r in rows}:
        mine = sorted((s, t) for k, s, t in rows if k == e)
        merged = []
        for s, t in mine:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
                merged[-1][2].append((s, t))
            else:
                merged.append([s, t, [(s, t)]])
        out |= {(e, "period", s, t, len(m), len(set(m)) == 1) for s, t, m in merged}
        out |= {(e, "gap", a[1], b[0], None, None) for a, b in zip(merged, merged[1:])}
    return out


def found(df, **kw):
    return {tuple(r) for r in periods_and_gaps(df, ["e"], **kw).select("e", "kind", "start_ms", "end_ms", "rows", "identical").collect()}


def test_random_intervals_across_blocks(spark):
    rng = random.Random(5)
    rows = []
    for e in ("a", "b", None):
        for _ in range(120):
            s = rng.randrange(0, 6000)
            rows.append((e, s, s + rng.choice([1, 5, 40, 900])))
        rows += rows[-5:]
    assert found(spark.createDataFrame(rows, SCHEMA), block_ms=700) == brute(rows)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_touching_nested_identical_and_single(spark):
    rows = [("a", 0, 10), ("a", 10, 20), ("b", 0, 100), ("b", 5, 6), ("c", 1, 2), ("c", 1, 2), ("c", 1, 2), ("d", 7, 9)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_hot_entity_of_copies_and_clashing_columns(spark):
    rows = [("hot", 5, 9)] * 3000 + [("hot", 20, 21)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("x"), "kind": F.lit(1), "block": F.lit(2.0), "n": F.lit(0)})
    assert found(df) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_times_in_every_notation(spark):
    cases = {"1.5": 1500, " 1.5\t": 1500, "+34.889": 34889, "1000144E-3": 1000144, "123522e-3": 123522, "0:00:08.045": 8045, "7:57:29.768": 28649768, "5": 5000, ".5": 500, "1,25": 1250, " 2.0 ": 2000, "0": 0,
             "n/a": None, "start": None, "": None, "nan": None, "inf": None, "-1.2": None, None: None, "1:75:00": None, "1e400": None, "x1.5": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_ms(F.col("t")).alias("ms")).collect()
    assert {r["t"]: r["ms"] for r in rows} == cases


def test_speaker_labels(spark):
    cases = {"SPEAKER_00": "SPEAKER_00", "spk_0": "SPEAKER_00", "[SPEAKER_07]": "SPEAKER_07", "Speaker #1": "SPEAKER_01", "S03": "SPEAKER_03", "Speaker-02": "SPEAKER_02", " SPEAKER_04: ": "SPEAKER_04", "SPK100": "SPEAKER_100", "speaker 12": "SPEAKER_12",
             "nan": None, " UNKNOWN ": None, "": None, None: None, "None": None, "host": "HOST"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", clean_speaker(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == cases
