import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocspan.llm import transcripts as T


def test_cleaning():
    assert T.spoken_words("[00:11:50] >> SPK02: Umm, I uh... told *laughs* YOU (indistinct chatter) ♪ theme ♪ ((coughs)) okay") == ["i", "told", "you", "okay"]
    assert T.spoken_words("<Speaker 4> 00:16:44,757 --> hmm ｕｈ {sighs}") == []
    assert T.spoken_words("at 1999 I'm 25") == ["at", "1999", "i'm", "25"]
    assert T.spoken_text("speaker 3 - so, uhm, we  go. Erm") == "so, we go."
    assert T.head_label("[00:07:16] [SPEAKER_04] hi") == "SPEAKER_04" and T.head_label("hi SPK02: x") is None
    for text in (None, "", "...", "[music]", "Uhhh. um,"):
        assert T.spoken_words(text) == [] and T.spoken_text(text) == ""
    assert [w for w in ("um", "ummm", "UHH", "hmmm", "erm", "ahh", "mm", "uhm") if not T.is_hesitation(w)] == []
    assert [w for w in ("a", "m", "me", "hammer", "meh", "oh", "here") if T.is_hesitation(w)] == []


def brute(rows):
    kept = []
    for r in rows:
        try:
            s, e = float(r["start_time"]), float(r["end_time"])
        except (TypeError, ValueError):
            continue
        if 0 <= s < e and T.spoken_words(r["text"]) and r["speaker"]:
            kept.append((r["file"], s, e, r["source_row"], r["speaker"]))
    out = []
    for f, _, _, row, who in sorted(kept):
        if out and out[-1][0] == f and out[-1][1] == who:
            out[-1][3] = row
        else:
            out.append([f, who, row, row])
    return sorted((b, c, d) for _, b, c, d in out)


def test_hesitations_of_any_length():
    assert T.spoken_words(f"u{'h' * 23} e{'r' * 400}m and H{'M' * 24}") == ["and"]


def test_turns_against_a_loop_for_any_number_of_parts(spark, utterances):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        s = rng.randrange(0, 60) / 2
        rows.append({"source_row": i, "file": rng.choice(["a", "b", "hot", "hot"]), "speaker": rng.choice(["SPEAKER_00", "SPEAKER_01"]), "start_time": str(s), "end_time": str(s + rng.choice([0, 1, 3])), "text": rng.choice(["hello there", "um", "yes", ""])})
    df = utterances(*rows).withColumns({"part": F.lit("x"), "edge": F.lit(3), "label": F.lit("y")})
    for parts in (1, 3, 40):
        got = sorted(map(tuple, T.turns(df, parts=parts).select("speaker", "first_row", "last_row").collect()))
        assert got == brute(rows)


def test_labels_repeats_and_text(spark, utterances):
    row = {"file": "f", "start_time": "1", "end_time": "2"}
    df = utterances(
        row | {"speaker": None, "text": "SPK02: hello"}, row | {"speaker": "nan", "text": "no label"}, row | {"speaker": "S02", "text": "hello"}, row | {"speaker": "S02", "text": "hello"},
        {"file": "f", "speaker": "S02", "start_time": "x", "end_time": "2", "text": "hi"}, {"file": None, "speaker": "spk_1", "start_time": "0:00:01", "end_time": "2e0", "text": "word " * 20_000}, {},
    )
    got = {(r["file"], r["speaker"], r["first_row"], r["last_row"], r["n_segments"]): r["text"] for r in T.turns(df, with_text=True).collect()}
    assert set(got) == {("f", "SPEAKER_02", 0, 3, 3), (None, "SPEAKER_01", 5, 5, 1)}
    assert got["f", "SPEAKER_02", 0, 3, 3] == "hello hello hello"


def test_labels_are_words_of_their_own():
    for text in ("Channel News24: we open", "my PS5: great", "class10: maths", "the Galaxys21: new"):
        assert T.clean_text(text) == text
    assert T.spoken_words("S5: great") == ["great"] and T.spoken_words("(SPK02) news24: now") == ["news24", "now"]


def test_conflicting_constraints_are_dropped_by_rank():
    # In dialogue order: a late row (2) and, after it, one that names its speaker although it lies before (3).
    level, same, cue = np.array([1, 2, 0, 2, 1]), np.array([True] * 5), np.array([False, False, False, False, True])
    source, target, rank, keep = T.resolve(level, same, cue)
    dialogue = {(int(a), int(b)): (int(r), bool(k)) for a, b, r, k in zip(source, target, rank, keep) if r < T.TIMING}
    assert dialogue == {(0, 1): (T.DIALOGUE, True), (1, 2): (T.DIALOGUE, False), (2, 3): (T.DIALOGUE, True), (3, 4): (T.CUE, False)}
    assert len(source) == 3 + 4 + 4 and keep.sum() == len(keep) - 2  # into gates, out of gates, neighbours: no edges for pairs
    order = [v for v in T.topological_order(5 + 2, source[keep], target[keep]) if v < 5]
    assert order == [2, 0, 4, 1, 3]
    with pytest.raises(ValueError, match="contradict"):  # with the conflicting edges there is no order
        T.topological_order(7, source, target)


def test_dialogue_order_against_every_permutation():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 6)
        pdf = pd.DataFrame({"file": ["f"] * n, "block": [0] * n, "start_ms": [rng.randrange(3) for _ in range(n)], "end_ms": [5 + rng.randrange(2) for _ in range(n)], "cue": [rng.random() < 0.4 for _ in range(n)]})
        time = list(zip(pdf["start_ms"], pdf["end_ms"]))
        good = [p for p in itertools.permutations(range(n)) if all(time[a] < time[b] or (time[a] == time[b] and a < b) for a, b in zip(p, p[1:]))]
        assert [tuple(T.dialogue_order(pdf).tolist())] == good


def test_blocks_that_span_batches():
    pdf = pd.DataFrame({"file": ["a"] * 7 + [None] * 0 + ["b"] * 3, "block": [0, 0, 0, 0, 0, 1, 1, 0, 0, 2], "start_ms": [5, 4, 3, 2, 1, 9, 8, 2, 1, 30], "end_ms": [10] * 9 + [40], "cue": [False] * 10, "row": range(10)})
    for size in (1, 2, 3, 5, 10):
        got = [r for part in T._in_order(pdf.iloc[i : i + size] for i in range(0, 10, size)) for r in part["row"]]
        assert got == [4, 3, 2, 1, 0, 6, 5, 8, 7, 9]


def test_a_long_turn_comes_in_pieces(spark, utterances):
    n = 2 * T.PIECE + 300
    df = utterances(*[{"file": "f", "speaker": "S1", "start_time": "1", "end_time": "2", "text": f"w{i}"} for i in range(n)], {"file": "f", "speaker": "S2", "start_time": "3", "end_time": "4", "text": "end"})
    for parts in (1, 7):
        got = T.turns(df, with_text=True, parts=parts).orderBy("start_ms", "piece").collect()
        long = [r for r in got if r["speaker"] == "SPEAKER_01"]
        assert {(r["first_row"], r["last_row"], r["n_segments"]) for r in long} == {(0, n - 1, n)} and [r["piece"] for r in long] == list(range(len(long))) and len(long) >= 3
        assert " ".join(r["text"] for r in long).split() == [f"w{i}" for i in range(n)] and max(len(r["text"].split()) for r in long) <= T.PIECE
        assert [(r["speaker"], r["piece"], r["text"]) for r in got[len(long):]] == [("SPEAKER_02", 0, "end")]


def test_empty(spark, utterances):
    assert T.found(utterances()).count() == 0
