"""Problem 10: a reading level for every document.

Gradient-boosted regression trees over distributions of length, vocabulary, syntax and cohesion. Part of the vocabulary
features is learned: the grade of a word is the shrunken mean level of the labelled documents that use it, and a document
has the distribution of its words over those grades. Grades used in training come from the other folds, so no document sees its
own label. Predictions for labelled documents are made with their source left out, and with it all copies of their texts in other
sources. An isotonic curve over these predictions calibrates the trees' output; for the validation by source the curve
is fitted on the predictions of the other sources, so a source has no part in its own figures. Trees and word grades are fitted
from features of at most ``max_labels`` labelled documents, chosen by hash, one task for every source left out and one for the
model itself; all documents are scored in one pass without a shuffle.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspan.llm.boosting import Boosted, isotonic
from vocspan.llm.lookalike import canonical

MIN_WORDS, HARD_LEVEL = 40, 4
MAX_LABELS = 10_000
#: Least share of English function words; dense academic prose has few.
MIN_ENGLISH = 0.015
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_SENTENCE = re.compile(r"[.!?。！？]+[\s\"'”’)]*|\n+")
_DIGIT, _HAN = re.compile(r"\d"), re.compile(r"[\u4e00-\u9fff]")
_VOWELS = re.compile(r"[aeiouy]+")
# Short function words, language by language. A word of several languages stands in each of them.
ENGLISH = frozenset("the of and a an to in is are was were it that this for with on as at by be from or not have has had but they we you he she his her their our my its which who what when would can do did if so than then there about all no only just me us them him i".split())
OTHERS = tuple(frozenset(words.split()) for words in (
    "yang dan di ke dari itu ini dengan untuk pada adalah tidak saya kami kita mereka dia anda akan telah sudah sangat juga oleh atau kerana sebab apa bila boleh lagi sini situ sana bukan ialah dalam kata berkata bahawa harganya tetapi lebih hari orang banyak semua ada jadi mahu hendak kepada",  # Malay
    "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre me hay nos mi fue yo",  # Spanish
    "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já eu também me",  # Portuguese
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son mais comme on je nous vous elle cette très",  # French
    "di e il la che in a un è per una non sono del con le si da i della lo al nel come più ma gli dei alla ha io mi questo anche ho se molto",  # Italian
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei ich wir war sehr aber",  # German
    "de van een het en in is dat op te zijn met voor niet aan er om ook als dan maar bij of uit ik je we hij was naar dit wordt heeft zeer",  # Dutch
    "och i att det som en på är av för med till den har de inte om ett han men var jag sig så vi och er at det på en til af ikke jeg",  # Swedish, Danish, Norwegian
    "i w na z do się nie to że jest o jak ale po co tak za od przez dla był są czy tylko ja ten bardzo",  # Polish
    "ve bir bu da de için ile çok ne gibi daha ben o var olarak ama kadar sonra en mi değil",  # Turkish
    "ang ng sa na mga at ay ko ka ako siya ito para hindi kung may niya kami nila lang po",  # Tagalog
    "și de la în a cu nu pe o un este care să că din mai se pentru ce sunt au dar ca am foarte",  # Romanian
))
# Words that subordinate and words that connect sentences.
SUBORDINATE = frozenset("although because since while whereas unless until whether if that which who whom whose when where though provided insofar lest notwithstanding before after".split())
CONNECTIVE = frozenset("however therefore consequently moreover furthermore nevertheless hence thus conversely accordingly meanwhile then so and but or".split())
PRONOUN = frozenset("i you he she it we they me him her us them my your his its our their this these those".split())
SUFFIX = re.compile(r"(?:tion|sion|ity|ism|ist|ment|ance|ence|ology|ical|ative|ular|ous|ise|ises|ate|ates|isation|ization|ical|ally|aneous)s?$")
GRADE_BINS = np.array([1.4, 1.8, 2.2, 2.5, 2.8, 3.1, 3.4, 3.7, 4.0, 4.3, 4.6])


#: Word lists whose share of a text is a feature or tells its language.
GROUPS = (SUBORDINATE, CONNECTIVE, PRONOUN, ENGLISH, *OTHERS)


@lru_cache(maxsize=200_000)
def _word_facts(word: str) -> tuple[int, int, bool, bool, tuple[int, ...]]:
    """Signed hash, syllables, learned suffix, ASCII, numbers of the GROUPS it is in."""
    h = xxhash.xxh64_intdigest(word)
    return (h - (1 << 64) if h >> 63 else h), len(_VOWELS.findall(word)), len(word) > 6 and bool(SUFFIX.search(word)), word.isascii(), tuple(i for i, g in enumerate(GROUPS) if word in g)


def _quantiles(ordered: list[int], at: tuple[float, ...]) -> list[int]:
    return [ordered[min(len(ordered) - 1, int(q * len(ordered)))] for q in at]


def _counted_quantiles(tally: list[tuple[int, int]], total: int, at: tuple[float, ...]) -> list[int]:
    """Quantiles of values given in order with their counts; at is in order as well."""
    out, seen, values = [], 0, iter(tally)
    size, many = next(values)
    for q in at:
        place = min(total - 1, int(q * total))
        while seen + many <= place:
            seen += many
            size, many = next(values)
        out.append(size)
    return out


def describe(text: str) -> tuple[list[float], np.ndarray, np.ndarray, bool]:
    """(features, word hashes, word counts, English or not) of a whole text."""
    text = canonical(text)
    low = text.casefold()
    words = _WORD.findall(low)
    n = len(words)
    counts = Counter(words)
    sentences = [v for v in map(str.split, _SENTENCE.split(low)) if v]
    sizes = sorted(Counter(map(len, words)).items()) or [(0, 1)]
    spans = sorted(map(len, sentences)) or [0]
    heads = [{w for w in v if len(w) > 3} for v in sentences]
    shared = sum(len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(heads, heads[1:]))
    per = max(n, 1)
    letters = sum(x * c for x, c in sizes)
    mean = letters / per
    longer = lambda m: sum(c for x, c in sizes if x >= m) / per
    facts = [_word_facts(w) for w in counts]
    each = list(counts.values())
    syllables = suffixes = many = latin = 0
    hits = [0] * len(GROUPS)
    for (_, syl, suf, plain, groups), c in zip(facts, each, strict=True):
        syllables += syl * c
        if syl >= 4:
            many += c
        if suf:
            suffixes += c
        if plain:
            latin += c
        for g in groups:
            hits[g] += c
    span_mean = sum(spans) / len(spans)
    en = hits[3] / per
    features = [
        math.log1p(n), *_counted_quantiles(sizes, per, (0.25, 0.5, 0.75, 0.9)), mean, math.sqrt(max(0.0, sum(x * x * c for x, c in sizes) / per - mean * mean)), longer(7), longer(10), longer(13),
        syllables / per, many / per, len(counts) / math.sqrt(2 * per), suffixes / per,
        math.log1p(span_mean), math.sqrt(max(0.0, sum(x * x for x in spans) / len(spans) - span_mean**2)), math.log1p(spans[-1]), *map(math.log1p, _quantiles(spans, (0.25, 0.75))),
        text.count(",") / per, (text.count(";") + text.count(":")) / per, (text.count("!") + text.count("?")) / per,
        hits[0] / per, hits[1] / per, hits[2] / per, en, len(_DIGIT.findall(text)) / per, shared / max(1, len(heads) - 1),
    ]
    english = bool(n) and latin / per > 0.5 and en >= MIN_ENGLISH and hits[3] > max(hits[4:]) and (text.isascii() or len(_HAN.findall(text)) < 0.2 * letters)
    return features, np.array([f[0] for f in facts], np.int64), np.array(each, np.int64), english


def _grades(code: np.ndarray, docs: np.ndarray, y: np.ndarray, use: np.ndarray, n_words: int) -> np.ndarray:
    """Grade of every word from the documents marked in ``use``; words of fewer than three of them have none (not a number)."""
    keep = use[docs]
    if not keep.any():
        return np.full(n_words, np.nan)
    seen = np.bincount(code[keep], minlength=n_words)
    total = np.bincount(code[keep], weights=y[docs[keep]], minlength=n_words)
    return np.where(seen >= 3, (total + 2.0 * y[use].mean()) / (seen + 2.0), np.nan)


def _grade_features(grade: np.ndarray, counts: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Distribution of each document's words over the grades: share per bin, mean, spread, and share of known words. grade: of each word of each document."""
    width = len(GRADE_BINS) + 1
    out = np.zeros((n_docs, width + 3))
    total = np.maximum(np.bincount(docs, weights=counts, minlength=n_docs), 1)
    known = ~np.isnan(grade)
    if known.any():
        d, c, g = docs[known], counts[known].astype(float), grade[known]
        n = np.maximum(np.bincount(d, weights=c, minlength=n_docs), 1)
        out[:, :width] = np.bincount(d * width + np.searchsorted(GRADE_BINS, g), weights=c, minlength=n_docs * width).reshape(n_docs, width) / n[:, None]
        mean = np.bincount(d, weights=c * g, minlength=n_docs) / n
        out[:, width] = mean
        out[:, width + 1] = np.sqrt(np.maximum(np.bincount(d, weights=c * g * g, minlength=n_docs) / n - mean**2, 0))
        out[:, width + 2] = n / total
    return out


@dataclass
class Model:
    trees: Boosted
    words: np.ndarray
    grades: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]
    validation: pd.DataFrame

    def grade(self, features: np.ndarray, hashes: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        grade = np.full(len(hashes), np.nan)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            grade = np.where(self.words[at] == hashes, self.grades[at], np.nan)
        x = np.hstack([features, _grade_features(grade, counts, docs, len(features))])
        return np.clip(np.interp(self.trees.predict(x), *self.knots), 1, 5)


@dataclass
class Sample:
    """Labelled documents: features, words (sorted hashes), for each word of each document its number, count and document, levels, sources, and a hash of each text."""

    features: np.ndarray
    words: np.ndarray
    code: np.ndarray
    counts: np.ndarray
    docs: np.ndarray
    y: np.ndarray
    source: np.ndarray
    text: np.ndarray

    def groups(self) -> np.ndarray:
        """What is left out in turn: the sources; with fewer than two of them five parts by text stand in for them."""
        return self.source if len(np.unique(self.source)) > 1 else (self.text % 5).astype(str)

    def fit_without(self, group: str | None) -> tuple[Boosted, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Trees, words and grades fitted without a group and without the texts in it, and its documents with their predictions; None: fitted on all.

        Where fewer than 20 documents are left to learn from there is no prediction."""
        out = np.zeros(len(self.y), bool) if group is None else self.groups() == group
        use = ~np.isin(self.text, self.text[out])
        mine = np.flatnonzero(out)
        if use.sum() < 20:
            return Boosted(), np.zeros(0, np.int64), np.zeros(0), mine, np.full(len(mine), np.nan)
        n, fold = len(self.y), self.text % 5
        x = np.zeros((n, len(GRADE_BINS) + 4))
        for k in np.unique(fold[use]):  # the grades behind a training document exclude its own fold
            grade = _grades(self.code, self.docs, self.y, use & (fold != k), len(self.words))
            part = use & (fold == k)
            x[part] = _grade_features(grade[self.code], self.counts, self.docs, n)[part]
        trees = Boosted().fit(np.hstack([self.features, x])[use], self.y[use])
        grade = _grades(self.code, self.docs, self.y, use, len(self.words))
        own = np.hstack([self.features, _grade_features(grade[self.code], self.counts, self.docs, n)])[mine]
        known = ~np.isnan(grade)
        return trees, self.words[known], grade[known], mine, trees.predict(own)


def curve(held: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibration of held-out predictions; none where there are fewer than 20 of them."""
    known = np.isfinite(held)
    return isotonic(held[known], y[known]) if known.sum() >= 20 else (np.array([1.0, 5.0]), np.array([1.0, 5.0]))


def validate(sample: Sample, held: np.ndarray) -> pd.DataFrame:
    """Errors by source of held-out predictions, calibrated by a curve over those of the other sources."""
    groups, calibrated = sample.groups(), np.zeros(len(held))
    for g in np.unique(groups):
        mine = groups == g
        calibrated[mine] = np.interp(held[mine], *curve(held[~mine], sample.y[~mine]))
    y = sample.y
    report = pd.DataFrame({"source": groups, "error": np.abs(calibrated - y), "level": np.floor(np.clip(calibrated, 1, 5) + 0.5), "y": y})
    report = report[np.isfinite(held)].copy()
    report["right"] = report["level"] == np.rint(report["y"])
    report["hard_right"] = (report["level"] >= HARD_LEVEL) == (report["y"] >= HARD_LEVEL - 0.5)
    return report.groupby("source").agg(n=("y", "size"), mean_abs_error=("error", "mean"), same_level=("right", "mean"), same_side_of_4=("hard_right", "mean")).reset_index()


def fit(spark: SparkSession, sample: Sample) -> Model:
    """The model of a sample. The sample is sent to all tasks; it has the documented bound of labels."""
    jobs = [None, *np.unique(sample.groups()).tolist()]
    shared = spark.sparkContext.broadcast(sample)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for job in pdf["id"]:
                trees, words, grades, mine, guess = shared.value.fit_without(jobs[job])
                yield pd.DataFrame({"job": [job], "docs": [mine], "guess": [guess], "model": [pickle.dumps((trees, words, grades)) if jobs[job] is None else None]})

    done = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(work, "job long, docs array<long>, guess array<double>, model binary").collect()
    held = np.zeros(len(sample.y))
    for r in done:
        held[np.array(r["docs"], np.int64)] = r["guess"]
    trees, words, grades = pickle.loads(next(r["model"] for r in done if r["model"] is not None))
    return Model(trees, words, grades, curve(held, sample.y), validate(sample, held))


_DESCRIBED = "features array<double>, hashes array<long>, counts array<long>, english boolean"


def train(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Model from the labelled documents. A document's label is the mean of its raters, repeated rows counted once, missing levels left out."""
    target = labels.filter("reading_level between 1 and 5").select("doc_id", "rater", "reading_level").distinct().groupBy("doc_id").agg(F.avg("reading_level").alias("y"))
    chosen = target.orderBy(F.xxhash64("doc_id")).limit(max_labels)
    joined = documents.filter("text is not null").select("doc_id", "text", "source").join(chosen, "doc_id")

    def describe_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [describe(t) for t in pdf["text"]]
            yield pd.DataFrame({"features": [r[0] for r in rows], "hashes": [r[1] for r in rows], "counts": [r[2] for r in rows], "english": [r[3] for r in rows], "y": pdf["y"].to_numpy(), "source": pdf["source"].fillna("").to_numpy(object), "hash": [xxhash.xxh64_intdigest(t) >> 1 for t in pdf["text"]], "doc_id": pdf["doc_id"].to_numpy()})

    got = joined.mapInPandas(describe_all, f"{_DESCRIBED}, y double, source string, hash long, doc_id long").filter("english").toPandas().sort_values(["doc_id", "y"], kind="stable")
    if len(got) < 20:
        raise ValueError("a reading model needs at least 20 labelled English documents")
    words, counts = ([np.asarray(v) for v in got[c]] for c in ("hashes", "counts"))
    docs = np.repeat(np.arange(len(got)), [len(w) for w in words])
    known, code = np.unique(np.concatenate(words), return_inverse=True)
    return fit(documents.sparkSession, Sample(np.array(got["features"].tolist()), known, code.astype("int32"), np.concatenate(counts), docs, got["y"].to_numpy(float), got["source"].to_numpy(str), got["hash"].to_numpy()))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, source, english, n_words, grade, level of every document.

    n_words counts between white space. NULL and empty texts have no words, grade and level NULL; texts in other languages are
    graded by the same trees and marked as not English. Repeated rows repeat; an empty table gives none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            texts = pdf["text"].fillna("").tolist()
            rows = [describe(t) for t in texts]
            docs = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
            grade = shared.value.grade(np.array([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]), docs)
            n = np.array([len(t.split()) for t in texts], "int32")
            level = pd.array(np.floor(grade + 0.5).astype(int), dtype="Int32")
            blank = n == 0
            level[blank] = pd.NA
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "english": [r[3] for r in rows], "n_words": n, "grade": np.where(blank, np.nan, grade), "level": level})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, english boolean, n_words int, grade double, level int").withColumn("grade", F.when(F.col("level").isNotNull(), F.col("grade")))


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id of English documents of at least 40 words with level 4 or 5."""
    return score(documents, train(documents, labels)).filter(F.col("english") & (F.col("n_words") >= MIN_WORDS) & (F.col("level") >= HARD_LEVEL)).select("doc_id")
