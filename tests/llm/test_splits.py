import random
from itertools import combinations

from pyspark.sql import functions as F

from vocspan.llm import splits as S

TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def targets(spark, shares=TARGETS):
    return spark.createDataFrame([(k, v) for k, v in shares.items()], "split_name string, target_share double")


def test_ids(spark):
    cases = {
        "20200715--_xxE_yfXG4p--Title.TextGrid": "_xxE_yfXG4p", "20190116---HyFBdXexV4--The Truth.TextGrid": "-HyFBdXexV4", "20190116--HyFBdXexV4-The Truth.TextGrid": "-HyFBdXexV4",
        "20230612-lh-LACnj99b-What If.TextGrid": "lh-LACnj99b", "20220909–M9mYinBtz3n–HOW.TextGrid": "M9mYinBtz3n", "20221109 -- ax5STE5RoO1 -- Inside.TextGrid": "ax5STE5RoO1",
        "UlJXmMNsPlT--What (reupload).TextGrid": "UlJXmMNsPlT", "Why Novel [iOd3_QF7zt2].TextGrid": "iOd3_QF7zt2", "20211206--06U1vgXI2i---Inside.textgrid": "06U1vgXI2i-", "no id here.TextGrid": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "f string").select("f", S.recording_id(F.col("f")).alias("id")).collect()
    assert {r["f"]: r["id"] for r in rows} == cases


def test_pairs_of_names(spark, utterances):
    names = ["20200101--abcdefghijk--A.TextGrid", "B [abcdefghijk].TextGrid", "20200101--ABCDEFGHIJK--A.TextGrid", "plain", "plain", None, "20200101-abcdefghijk-A"]
    got = {tuple(r) for r in S.same_recording(utterances(*[{"file": n} for n in names]).withColumn("id", F.lit(1))).collect()}
    assert got == {tuple(sorted(p)) for p in combinations((names[0], names[1], names[6]), 2)}


def test_ids_anywhere_in_a_name(spark, utterances):
    same = ["20200101--abcdefghijk--A.TextGrid", "Title - abcdefghijk.TextGrid", "Title_abcdefghijk.TextGrid", "abcdefghijk - Title", "abcdefghijk"]
    dashed = ["x [-bcdefghi_k]", "Title-bcdefghi_k.TextGrid"]
    other = ["Title - abcdefghijK.TextGrid", "xabcdefghijk", "Episode-001 a", "Episode-001 b", "abcdefghijk2 - Title", "short", "hello-world", "hello-world 2", "", None]
    df = utterances(*[{"file": n} for n in [*same, *dashed, *other] * 2])
    want = {tuple(sorted(p)) for g in (same, dashed) for p in combinations(g, 2)}
    assert {tuple(r) for r in S.same_recording(df).collect()} == want
    rows = S.assign_rows(df, targets(spark)).collect()
    assert len(rows) == df.count()
    for group in (same, dashed):
        assert len({r["new_split"] for r in rows if r["file"] in group}) == 1
    assert sum(r["n_components"] for r in S.shares(df, targets(spark)).collect()) == 2 + len(other)


def test_ids_that_no_name_has_in_the_usual_place(spark, utterances):
    same = ["My title-dQw4w9WgXcQ", "My_title_dQw4w9WgXcQ", "dQw4w9WgXcQ.TextGrid", "dQw4w9WgXcQ - title"]
    words = ["20240101--engineering--uVw4w9WgXcQ", "20240102--engineering--AAAAAAAAAAA"]
    got = {tuple(r) for r in S.same_recording(utterances(*[{"file": n} for n in [*same, *words]])).collect()}
    assert got == {tuple(sorted(p)) for p in combinations(same, 2)}
    glued = ["20200101--_xxE_yfXG4p--A.TextGrid", "Title_xxE_yfXG4pB.TextGrid"]
    shifted = ["20190116---HyFBdXexV4--The.TextGrid", "20190116--HyFBdXexV4---The.TextGrid"]
    got = {tuple(r) for r in S.same_recording(utterances(*[{"file": n} for n in [*glued, *shifted]])).collect()}
    assert got == {tuple(sorted(glued))}


def test_names_with_several_ids(spark, utterances):
    ids = [f"{chr(65 + i)}q{i}w9WgXcQ{chr(97 + i)}"[:11].ljust(11, "7") for i in range(6)]
    chain = [f"20200101--{ids[i]}--and [{ids[i + 1]}].TextGrid" for i in range(5)] + [f"20200101--{ids[5]}--end.TextGrid"]
    df = utterances(*[{"file": n} for n in [*chain, "other", None]])
    got = {r["file"]: r["component"] for r in S.components(df).collect()}
    assert len({got[n] for n in chain}) == 1 and len(set(got.values())) == 3
    assert len(S.same_recording(df).collect()) == 5


def deviation(bundles, plan):
    total = sum(s * c for s, _, c in bundles)
    return max(abs(sum(s * p.get(k, 0) for (s, _, _), p in zip(bundles, plan)) - share * total) for k, share in TARGETS.items())


def best_deviation(bundles):
    """Over all assignments of components, by sums that can be reached."""
    total = sum(s * c for s, _, c in bundles)
    reach = {(0, 0)}
    for s, _, c in bundles:
        for _ in range(c):
            reach |= {(a + s, b) for a, b in reach} | {(a, b + s) for a, b in reach}
    return min(max(abs(a - 0.1 * total), abs(b - 0.1 * total), abs(total - a - b - 0.8 * total)) for a, b in reach)


def test_the_flow_decides_and_not_proportion():
    bundles = [(1, "x", 50), (50, "x", 1)]
    plan = S.solve(bundles, TARGETS)
    assert plan == [{"test": 10, "train": 30, "validation": 10}, {"test": 0, "train": 1, "validation": 0}]  # in proportion the ones were 40, 5, 5
    rows = S.flow_rows(bundles, {"train": 80, "validation": 10, "test": 10})
    assert rows[1] == {"test": 0, "train": 50, "validation": 0}


def test_solver_against_all_assignments():
    rng = random.Random(8)
    for _ in range(60):
        bundles = sorted((s, p, c) for (s, p), c in {(rng.randrange(1, 60), rng.choice("xy")): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}.items())
        assert deviation(bundles, S.solve(bundles, TARGETS)) <= best_deviation(bundles) + max(s for s, _, _ in bundles) / 2


def test_flow_costs_are_least():
    rng = random.Random(5)
    for _ in range(50):
        f, cost = S.Flow(5), {}
        arcs = {(a, b): (rng.randrange(0, 4), rng.randrange(0, 5)) for a in range(5) for b in range(5) if a != b and a != 1 and b != 0 and rng.random() < 0.7}
        for (a, b), (room, price) in arcs.items():
            cost[a, b] = f.add(a, b, room, price)
        f.run(0, 1)
        value = sum(f.flow(e) for (a, _), e in cost.items() if a == 0)
        # No augmenting path is left, and no cycle of negative cost.
        rest = [(a, b, p) for (a, b), e in cost.items() for a, b, p in [(a, b, arcs[a, b][1])] if f.room[e]] + [(b, a, -arcs[a, b][1]) for (a, b), e in cost.items() if f.flow(e)]
        seen = {0}
        for _ in range(5):
            seen |= {b for a, b, _ in rest if a in seen}
        assert 1 not in seen and value >= 0
        far = dict.fromkeys(range(5), 0)
        for _ in range(5):
            for a, b, p in rest:
                far[b] = min(far[b], far[a] + p)
        assert all(far[b] <= far[a] + p for a, b, p in rest)


def test_many_bundles_are_solved_in_time():
    rng = random.Random(1)
    bundles = [(s, rng.choice("abcdef"), rng.randrange(1, 4)) for s in range(1, 4000)]
    assert deviation(bundles, S.solve(bundles, TARGETS)) <= 1


def test_solver_hits_the_shares():
    rng = random.Random(2)
    for _ in range(20):
        bundles = sorted({(rng.choice([1, 2, 5, 17, 40]), p): rng.randrange(1, 30) for p in "xy" for _ in range(4)}.items())
        bundles = [(s, p, c) for (s, p), c in bundles]
        plan = S.solve(bundles, TARGETS)
        total = sum(s * c for s, _, c in bundles)
        for (_, _, c), part in zip(bundles, plan):
            assert sum(part.values()) == c and min(part.values()) >= 0
        for k, share in TARGETS.items():
            assert abs(sum(s * p.get(k, 0) for (s, _, _), p in zip(bundles, plan)) - share * total) <= 40


def test_recordings_stay_together(spark, utterances):
    rng = random.Random(4)
    names = [f"2020010{i % 9}--{'abcdefghij'}{i % 10}--t{i}.TextGrid" for i in range(20)] + ["x", None]
    rows = [{"file": rng.choice(names), "channel": rng.choice(["a", "b", None])} for _ in range(900)] + [{"file": "hot", "channel": "a"}] * 450
    df = utterances(*rows).withColumns({"component": F.lit(1), "h": F.lit("x"), "slot": F.lit(2), "bundle": F.lit(3)})
    out = S.assign_rows(df, targets(spark))
    assert out.count() == len(rows) and out.filter("new_split is null").count() == 0
    apart = out.join(S.components(df).withColumnRenamed("file", "f"), F.col("file").eqNullSafe(F.col("f"))).groupBy("component").agg(F.count_distinct("new_split").alias("n")).filter("n > 1")
    assert apart.count() == 0
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in S.assign_rows(df, targets(spark)).collect()}


def test_many_equal_recordings_meet_the_shares(spark, utterances):
    df = utterances(*[{"file": f"f{i}", "channel": "a"} for i in range(1000)])
    got = {r["new_split"]: r["n_rows"] for r in S.shares(df, targets(spark)).collect()}
    assert got == {"train": 800, "validation": 100, "test": 100}


def test_empty_and_bad_targets(spark, utterances):
    assert S.assign_rows(utterances(), targets(spark)).count() == 0
    try:
        S.assign_rows(utterances({"file": "a"}), targets(spark, {"train": 0.0}))
    except ValueError:
        pass
    else:
        raise AssertionError
