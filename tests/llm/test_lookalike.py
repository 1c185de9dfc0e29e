import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vocspan.llm import lookalike as L

CASES = {
    "Thеn whу lіft.": "Then why lift.", "ｗhen I １２ ok！": "when I 12 ok!", "café": "café", "char‌ger bef­or": "charger befor", "oﬃce": "office",
    "K\U0001d493\U0001d490z": "Kroz", "nly paid 2925": "nly paid 2925", "уοu": "you", "x\x00y": "xy", "﻿hi": "hi",
}
SAME = ["café Zoë", "“boleh” — it’s…", "привет καλημέρα", "\U0001f468‍\U0001f469‍\U0001f467 ❤️", "你好，ok", "வணக்கம்", "", "plain\ttext\n"]


def test_cases_and_plain_text():
    for odd, plain in CASES.items():
        assert L.canonical(odd) == plain
    for text in SAME:
        assert L.canonical(text) == text
    assert L.canonical(None) is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_rewriting_settles(text):
    once = L.canonical(text)
    assert L.canonical(once) == once


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeéüñ ", max_size=40))
def test_decomposed_text_comes_back(text):
    assert L.canonical(unicodedata.normalize("NFD", text)) == text


def test_hidden_characters_all_go():
    assert L.canonical("A" + "\ufe0f" * 20) == "A" and L.canonical("A" + "".join(chr(0xE0041 + i) for i in range(20)) + "b") == "Ab"
    assert L.canonical("e\u200d" * 3 + "\u0301") == "ee\u00e9"
    kept = "\u2764\ufe0f \U0001f468\u200d\U0001f469 1\ufe0f\u20e3"
    assert L.canonical(kept) == kept and L.canonical("\u2764\ufe0f\ufe0f\ufe0f \U0001f468\u200d\u200d\U0001f469 1\ufe0f\u20e3") == kept


def test_letters_of_more_scripts():
    assert L.canonical("\u13aapple s\u03c3me wo\u04cf\u04cf \ua4d0ig \u2c9fld") == "Apple some woll Big old"
    for own in ("\u13aa\u13b3\u13c8", "\u03c3\u03b1\u03c2", "\ua4d0\ua4ea"):
        assert L.canonical(own) == own


def test_long_stretches_take_linear_time():
    for text in ("\u0430a" * 100_000, "\uff01" * 100_000, "A" + "\ufe0f" * 100_000, "\u4f60" + "\uff0c" * 100_000):
        L.canonical(text)


def test_union_find_is_transitive():
    c = L.Classes()
    c.join("a", "b")
    c.join("c", "d")
    c.join("b", "c")
    assert len(c.members()) == 1 and len({c.find(x) for x in "abcd"}) == 1


def test_representatives_follow_the_corpus():
    latin, cyrillic = L.choose({"a": 10, "а": 3}), L.choose({"а": 10, "о": 9, "a": 2})
    assert "a" not in latin and cyrillic["a"] == "а"
    assert L.rewriter(tuple(sorted(cyrillic.items()))).rewrite("mалa") is not None


def test_long_text():
    text = "plаin " * 50_000
    assert L.canonical(text) == "plain " * 50_000


def test_spark_fields(spark):
    rows = [(1, "ok", "ａ", None), (2, None, "", "café"), (2, None, "", "café"), (None, "a​b", None, None)]
    df = spark.createDataFrame(rows, "source_row long, text string, generated_text string, generated_text_ft string").withColumn("field", F.lit("clash"))
    columns = ["text", "generated_text", "generated_text_ft"]
    got = sorted(map(tuple, L.found(df, "source_row", columns).collect()), key=str)
    assert got == sorted([(1, "generated_text"), (2, "generated_text_ft"), (2, "generated_text_ft"), (None, "text")], key=str)
    every = L.canonical_fields(df, "source_row", columns)
    assert every.count() == 7 and every.filter("canonical = 'café'").count() == 2
    assert L.found(df.limit(0), "source_row", columns).count() == 0
