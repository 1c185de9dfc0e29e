"""Problem 6: the share of repeated content inside each document.

A word is repeated when it lies in a second or later saying of a run of three words that the same text already had. Runs
may overlap, so one word said again and again counts from its second saying on. Words are those of the speech: case,
punctuation, look-alike characters, labels, time marks, sound notes and hesitations make no difference, so a repetition
is found although it is written differently each time. A text is handled as a whole by one pass over its words with a table of its
runs, linear in its length; nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspan.llm.transcripts import spoken_words

RUN = 3
MIN_WORDS, MIN_SHARE = 12, 0.5
#: East Asian text has no spaces: each character counts as a word.
_IDEOGRAPH = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]|[^぀-ヿ㐀-䶿一-鿿豈-﫿]+")


def words_of(text: str | None) -> list[str]:
    words = spoken_words(text)
    if text is None or text.isascii():
        return words
    return [piece for w in words for piece in (_IDEOGRAPH.findall(w) if not w.isascii() else (w,))]


def repeated_words(words: list[str], run: int = RUN) -> int:
    """How many words lie in a second or later saying of a run of ``run`` words."""
    seen: set[tuple[str, ...]] = set()
    total, until = 0, 0
    for i in range(len(words) - run + 1):
        gram = tuple(words[i : i + run])
        if gram in seen:
            total += i + run - max(i, until)
            until = i + run
        else:
            seen.add(gram)
    return total


def profile(text: Column) -> Column:
    """struct(n_words, n_repeated, share): 0 words and share 0 for NULL, empty and wordless texts."""

    @F.pandas_udf("n_words int, n_repeated int, share double")
    def measure(texts: pd.Series) -> pd.DataFrame:
        n, again = np.zeros(len(texts), "int32"), np.zeros(len(texts), "int32")
        for i, t in enumerate(texts):
            words = words_of(t)
            n[i] = len(words)
            if len(words) > RUN:
                again[i] = repeated_words(words)
        return pd.DataFrame({"n_words": n, "n_repeated": again, "share": again / np.maximum(n, 1)})

    return measure(text)


def shares(fields: DataFrame) -> DataFrame:
    """source_row, field, n_words, n_repeated, share of every text; fields: source_row, field, text. Repeated rows repeat."""
    return fields.withColumn("x", profile(F.col("text"))).select("source_row", "field", "x.*")


def found(fields: DataFrame) -> DataFrame:
    """source_row, field of the texts of at least 12 words with at least half of them repeated."""
    # Twelve words of ASCII are never shorter than this; other characters may stand for several words.
    long = (F.length("text") >= 2 * MIN_WORDS - 1) | F.col("text").rlike(r"[^\x00-\x7F]")
    return shares(fields.filter(long)).filter((F.col("n_words") >= MIN_WORDS) & (F.col("share") >= MIN_SHARE)).select("source_row", "field")
