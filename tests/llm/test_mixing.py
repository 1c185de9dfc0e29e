from pyspark.sql import functions as F

from vocspan.llm import mixing as M


def make(spark, counts, targets):
    rows = [(i, " house" * (5 + i % 7), s) for s, n in counts.items() for i in range(n)] + [(1, "x", None), (None, None, "a"), (2, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"h": F.lit(1), "w": F.lit("x"), "slot": F.lit(2), "total": F.lit(3)})
    return docs, spark.createDataFrame(targets, "source string, target_weight double, max_repeats int")


def test_shares_and_repeats(spark):
    docs, targets = make(spark, {"a": 3000, "b": 300, "c": 100, "z": 50}, [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 3), ("gone", 0.1, 2), ("b", 0.1, 1)])
    mixture, shares = M.mix(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["gone"]["actual_share"] == 0 and set(got) == {"a", "b", "c", "gone"}
    there = {s: got[s]["target_share"] / (1 - got["gone"]["target_share"]) for s in "abc"}
    assert all(abs(got[s]["actual_share"] - there[s]) < 0.02 for s in "abc")
    rows = mixture.collect()
    assert [r["virtual_finish"] for r in rows] == sorted(r["virtual_finish"] for r in rows)
    assert max(r["pass_no"] for r in rows if r["source"] == "c") <= 3 and not any(r["source"] == "z" for r in rows)
    assert abs(got["c"]["passes"] - 3) < 0.02  # the scarce source is used up


def test_budget(spark):
    docs, targets = make(spark, {"a": 400, "b": 400}, [("a", 0.75, 1), ("b", 0.25, 1)])
    mixture, _ = M.mix(docs, targets, budget=2000)
    total = mixture.agg(F.sum("n_tokens")).first()[0]
    assert abs(total - 2000) <= 11  # half a document of each source
    everything, _ = M.mix(docs, targets, budget=10**9)
    assert everything.count() == 801  # the two sources once each and the empty text


def test_every_source_is_within_half_a_document(spark):
    for scale in ("0.01", "0.1"):
        folder = f"/root/testdata/sf{scale}"
        mixture, shares = M.mix(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/mix_targets.parquet"))
        largest = {r["source"]: r["n"] for r in mixture.groupBy("source").agg(F.max("n_tokens").alias("n")).collect()}
        got = shares.collect()
        end = min(r["available_tokens"] * k / r["target_share"] for r in got for k in [next(t["max_repeats"] for t in spark.read.parquet(f"{folder}/mix_targets.parquet").collect() if t["source"] == r["source"])])
        assert all(abs(r["n_tokens"] - r["target_share"] * end) <= largest.get(r["source"], 10**6) / 2 + 1 for r in got)


def test_virtual_end_goes_on_without_used_up_sources():
    end = M.virtual_end({"a": 100, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, budget=600)
    assert end == 1000 and min(0.5 * end, 100) + 0.5 * end == 600


def test_nothing_to_mix(spark):
    docs, targets = make(spark, {"a": 3}, [("x", 1.0, 1), ("y", None, None), (None, 1.0, 1)])
    mixture, shares = M.mix(docs, targets)
    assert mixture.count() == 0 and shares.count() == 2
    assert M.mix(docs.limit(0), targets)[0].count() == 0


def test_copies_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(M, "COPIES", 7)
    docs = spark.createDataFrame([(1, " house" * 5, "a")] * 500 + [(i, " house" * 5, "a") for i in range(2, 502)] + [(i, " tree" * 3, "b") for i in range(600, 900)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 5)], "source string, target_weight double, max_repeats int")
    mixture, shares = M.mix(docs, targets)
    rows = mixture.filter("source = 'a'").collect()
    assert len(rows) == len({r["virtual_finish"] for r in rows}) and abs(len(rows) - min(1000, 5 * 300 * 3 / 5)) <= 1
    one = [r for r in rows if r["doc_id"] == 1]
    assert len(one) in range(380, 501) and {r["n_tokens"] for r in one} == {5}
    assert all(abs(r["actual_share"] - 0.5) < 0.002 for r in shares.collect())
    whole, _ = M.mix(docs, targets, budget=10**9)
    assert whole.filter("doc_id = 1").count() == 500 and whole.filter("source = 'b'").count() == 1500
