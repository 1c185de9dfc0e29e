"""Problem 3: records of evaluation splits that occur again, exactly or nearly, in the training split.

Texts are compared by their spoken words. Exact copies are one class. Near copies are found by winnowing: rolling hashes
of five words, one minimum selected from every window of two neighbouring hashes, joined across the splits. Two texts of n
words with at most n/10 edits always keep a run of six equal words, so they share a selected minimum; no pair is lost.

Common phrases would join everything with everything. The minimum is therefore taken in the order (frequency, hash), and
of every text the most frequent windows are left out as far as the edits allow it: an edit breaks at most six windows, so
a text of n words keeps at least I = n - 5 - 6 * floor(n / 9) windows, and its I - 1 most frequent ones are not needed.
A hash that is kept is kept at all of its places. Frequencies only order the windows; any order gives the same result.
Candidates must agree in place and length up to the allowed edits; their seeds are chained along ascending positions and the
alignment is extended over the gaps between them, and over the whole texts where that does not settle it. Coverage counts the
equal words of the best alignment of a pair, not its seeds, so it depends on the two texts alone.

Pairs of rows are formed for ``found`` only; the report joins records with facts of their classes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspan.functions.text import sequence_edits
from vocspan.llm.transcripts import once, spoken_words
from vocspan.session import cut

GRAM, WINDOW = 5, 2
MIN_WORDS, MIN_DISTINCT = 20, 15
#: A hash in at least this share of all texts counts as common; there are at most (hashes per text / share) of them.
COMMON_SHARE = 1e-4
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=200_000)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def gram_hashes(said: list[str], size: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hashes of ``size`` words of a batch of texts as signed 64-bit numbers, with the number of the text and the place in it."""
    words = [s.split(" ") for s in said]
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter((_word_hash(w) for text in words for w in text), np.uint64, int(n.sum()))
    m = max(0, len(h) - size + 1)
    out = np.zeros(m, np.uint64)
    for j in range(size):
        out = out * _BASE + h[j : j + m]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    text = np.repeat(np.arange(len(words)), n)
    inside = text[:m] == text[size - 1 : size - 1 + m]
    text = text[:m][inside]
    return out[inside].view(np.int64), text, np.flatnonzero(inside) - (n.cumsum() - n)[text]


def allowed_edits(n_words: int) -> int:
    return n_words // 10


def spare_windows(n_words: np.ndarray) -> np.ndarray:
    """How many of a text's windows may be left out: one less than those that survive the most edits a partner may need."""
    reach = GRAM + WINDOW - 1
    return np.maximum(0, n_words - reach - reach * (n_words // 9))


def select_minima(hashes: np.ndarray, text: np.ndarray, n_words: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places in ``hashes`` of the windows' minima that have to be joined. common: sorted common hashes; rank: their frequencies."""
    weight = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        weight = np.where(common[at] == hashes, rank[at], 0)
    left = np.flatnonzero(text[:-1] == text[1:])
    right = left + 1
    first = (weight[left] < weight[right]) | ((weight[left] == weight[right]) & (hashes[left] <= hashes[right]))
    pick = np.where(first, left, right)
    order = np.lexsort((hashes[pick], weight[pick], text[left]))
    pick, owner = pick[order], text[left][order]
    windows = np.bincount(owner, minlength=len(n_words))
    # A hash that a text keeps is kept at all of its places: which of them a partner has is not known here.
    fresh = np.ones(len(pick), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[pick[1:]] != hashes[pick[:-1]])
    place = np.maximum.accumulate(np.where(fresh, np.arange(len(pick)), 0)) - (windows.cumsum() - windows)[owner]
    return np.unique(pick[place < (windows - spare_windows(n_words))[owner]])


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of seeds with ascending positions in both texts, in time n log n."""
    # Of equal first positions the later second one comes first, so a chain takes one of them at most.
    ordered = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    ends: list[int] = []
    at: list[int] = []
    back = [-1] * len(ordered)
    for i, (_, y) in enumerate(ordered):
        k = bisect_left(ends, y)
        back[i] = at[k - 1] if k else -1
        if k == len(ends):
            ends.append(y)
            at.append(i)
        else:
            ends[k], at[k] = y, i
    best, i = [], at[-1] if at else -1
    while i >= 0:
        best.append(ordered[i])
        i = back[i]
    return best[::-1]


def extend(a: list[str], b: list[str], seeds: list[tuple[int, int]]) -> int | None:
    """Edits between two texts, if they are few enough. The gaps between chained seeds are aligned first, which often settles it;
    otherwise the whole texts are aligned."""
    limit = allowed_edits(max(len(a), len(b)))
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return None
    total, x, y = 0, 0, 0
    for i, j in [*chain(seeds), (len(a), len(b))]:
        if i < x or j < y:  # seeds overlap; their words are equal
            continue
        if i > x or j > y:
            total += sequence_edits(a[x:i], b[y:j])
            if total > limit:
                break
        x, y = min(i + GRAM, len(a)), min(j + GRAM, len(b))
    else:
        return total
    whole = sequence_edits(a, b)
    return whole if whole <= limit else None


def equal_words(a: list[str], b: list[str], limit: int) -> tuple[int, int]:
    """Edits and equal words of the alignment with the fewest edits and, among those, the most equal words. limit: at least the edits.

    One cost says both: with D edits, S of them changes, len(a) + len(b) - D - S is twice the number of equal words. Equal
    words at the head and at the end always belong to such an alignment.
    """
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    unit = len(x) + len(y) + 1
    far = unit * unit
    prev = {j: j * unit for j in range(min(len(y), limit) + 1)}
    for i, word in enumerate(x, 1):
        cur: dict[int, int] = {}
        for j in range(max(0, i - limit), min(len(y), i + limit) + 1):
            best = min(prev.get(j, far), cur.get(j - 1, far)) + unit
            if j:
                best = min(best, prev.get(j - 1, far) + (0 if word == y[j - 1] else unit + 1))
            cur[j] = best
        prev = cur
    edits, changed = divmod(prev[len(y)], unit)
    return edits, head + tail + (len(x) + len(y) - edits - changed) // 2


def audio_key(address: Column) -> Column:
    """host/path of an http(s) address; NULL when missing or leading nowhere.

    Scheme, case of the host, standard port, query, fragment, empty and . segments, and percent encoding make no difference.
    """
    text = F.regexp_replace(address, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")
    host = F.lower(F.regexp_extract(text, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    port = F.regexp_replace(F.regexp_extract(text, r"^(?i)https?://[^/?#]*?(:\d+)(?:[/?#]|$)", 1), r"^:(80|443)?$", "")
    path = F.regexp_extract(text, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    path = F.when(path.contains("%"), F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)).otherwise(path)
    path = F.regexp_replace(F.regexp_replace(path, r"(/\.(?=/|$))+", ""), r"/{2,}", "/")
    # Most addresses are written plainly, and for those nothing else is looked at.
    plain = F.when(address.rlike(r"^https://[a-z0-9.-]*[a-z0-9-](?:/[A-Za-z0-9_-]+)+\.[A-Za-z0-9]+$"), F.substring(address, 9, 1 << 20))
    return F.coalesce(plain, F.when((host != "") & ~path.isin("", "/"), F.concat(host, port, path)))


def _side(split: Column) -> Column:
    low = F.lower(F.trim(split))
    return F.when(low == "train", F.lit(True)).when(low.isin("validation", "test"), F.lit(False))


def clips(rows: DataFrame) -> DataFrame:
    """source_row, train, key (128-bit hash of host and path) of the rows whose audio address leads somewhere; written once."""
    keyed = rows.select("source_row", _side(F.col("split")).alias("train"), audio_key(F.col("audio")).alias("key")).filter("key is not null and train is not null")
    return cut(keyed.withColumn("key", F.unhex(F.md5(F.col("key").cast("binary")))))


def audio_pairs(held: DataFrame) -> DataFrame:
    """train_row, eval_row with the same clip. held: see clips."""
    left, right = held.filter("train").select("key", F.col("source_row").alias("train_row")), held.filter("not train").select("key", F.col("source_row").alias("eval_row"))
    return left.join(right, "key").select("train_row", "eval_row")


def eligible(rows: DataFrame) -> DataFrame:
    """source_row, train, cls (128-bit hash of the spoken words), said, n of the texts that can be in a pair."""

    @F.pandas_udf("said string, n int, kinds int")
    def speak(texts: pd.Series) -> pd.DataFrame:
        words = [spoken_words(t) for t in texts]
        return pd.DataFrame({"said": [" ".join(w) for w in words], "n": [len(w) for w in words], "kinds": [len(set(w)) for w in words]}).astype({"n": "int32", "kinds": "int32"})

    # Twenty words of ASCII and the spaces between them are never shorter than this; other characters may stand for several words.
    long = (F.length("text") >= 2 * MIN_WORDS - 1) | F.col("text").rlike(r"[^\x00-\x7F]")
    texts = rows.filter(long).select("source_row", _side(F.col("split")).alias("train"), once(speak)("text").alias("x"))
    out = texts.filter((F.col("x.n") >= MIN_WORDS) & (F.col("x.kinds") >= MIN_DISTINCT) & F.col("train").isNotNull())
    return out.select("source_row", "train", F.unhex(F.md5(F.col("x.said").cast("binary"))).alias("cls"), F.col("x.said").alias("said"), F.col("x.n").alias("n"))


def _common_hashes(classes: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that occur in a share of the texts, with their estimated frequencies. Every text is counted; a batch reports what
    is common in it, so at most (hashes per text / share) numbers come out of a batch and of the sum."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        texts = 0

        def report() -> pd.DataFrame:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(2, share * texts)
            return pd.DataFrame({"h": h[keep], "n": n[keep]})

        for pdf in batches:
            held.append(gram_hashes(pdf["said"].tolist())[0])
            texts += len(pdf)
            if texts >= 100_000:
                yield report()
                held, texts = [], 0
        if held:
            yield report()

    total = classes.count()
    rows = classes.select("said").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2.0, share * total)).toPandas()
    rows = rows.sort_values("h")
    return rows["h"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def classes_of(texts: DataFrame) -> DataFrame:
    """cls, said, n, in_train, in_eval of every class of exact copies. Copies meet in partial aggregates."""
    return texts.groupBy("cls").agg(F.any_value("said").alias("said"), F.max("n").alias("n"), F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval"))


def near_classes(heads: DataFrame, share: float = COMMON_SHARE, with_coverage: bool = False) -> DataFrame:
    """train_cls, eval_cls, edits, n_words, covered of different texts with few enough edits, one in training and one in evaluation.

    ``covered`` is the number of words of the evaluation text that the alignment finds equal in the training text, NULL unless it is
    asked for. heads: see classes_of.
    """
    common, rank = _common_hashes(heads, share)
    spark = heads.sparkSession
    shared = spark.sparkContext.broadcast((common, rank))

    def fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, weight = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            h, text, at = gram_hashes(pdf["said"].tolist())
            pick = select_minima(h, text, pdf["n"].to_numpy(np.int64), hot, weight)
            own = pdf.iloc[text[pick]]
            yield pd.DataFrame({"h": h[pick], "cls": own["cls"].to_numpy(), "n": own["n"].to_numpy(), "at": at[pick].astype("int32")})

    # Few classes are on both sides, so hardly any is hashed twice.
    prints = lambda side: heads.filter(side).select("cls", "said", "n").mapInPandas(fingerprints, "h long, cls binary, n int, at int")
    a = prints("in_train").select("h", F.col("cls").alias("train_cls"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    b = prints("in_eval").select("h", F.col("cls").alias("eval_cls"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    limit = F.floor(F.greatest("n_a", "n_b") / 10)
    hits = a.join(b, "h").filter((F.abs(F.col("at_a") - F.col("at_b")) <= limit) & (F.abs(F.col("n_a") - F.col("n_b")) <= limit) & (F.col("train_cls") != F.col("eval_cls")))
    # At most as many seeds as a text has windows.
    pairs = hits.groupBy("train_cls", "eval_cls").agg(F.collect_set(F.struct("at_a", "at_b")).alias("seeds"))
    said = heads.select("cls", "said")
    both = pairs.join(said.select(F.col("cls").alias("train_cls"), F.col("said").alias("said_a")), "train_cls").join(said.select(F.col("cls").alias("eval_cls"), F.col("said").alias("said_b")), "eval_cls")

    @F.pandas_udf("edits int, covered int, n_words int")
    def align(said_a: pd.Series, said_b: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        edits, covered, size = [], [], []
        for x, y, s in zip(said_a, said_b, seeds, strict=True):
            a, b = x.split(" "), y.split(" ")
            within = extend(a, b, [(p["at_a"], p["at_b"]) for p in s])
            fewest, equal = equal_words(a, b, within) if with_coverage and within is not None else (within, None)
            edits.append(fewest)
            covered.append(equal)
            size.append(len(b))
        return pd.DataFrame({"edits": pd.array(edits, dtype="Int32"), "covered": pd.array(covered, dtype="Int32"), "n_words": np.array(size, "int32")})

    done = both.withColumn("x", once(align)("said_a", "said_b", "seeds")).filter(F.col("x.edits").isNotNull())
    return done.select("train_cls", "eval_cls", "x.edits", "x.n_words", "x.covered")


def overlaps(rows: DataFrame, share: float = COMMON_SHARE) -> DataFrame:
    """train_row, eval_row, kind (audio, exact, near): every overlap across the splits.

    A pair may come once of every kind. NULL or unusable audio, NULL text and unknown splits take no part; repeated rows form pairs
    of their own; other columns are ignored.
    """
    base = rows.select("source_row", "split", "audio", "text")
    texts = cut(eligible(base))
    near = near_classes(cut(classes_of(texts)), share)
    train = texts.filter("train").select(F.col("source_row").alias("train_row"), F.col("cls").alias("train_cls"))
    held = texts.filter("not train").select(F.col("source_row").alias("eval_row"), F.col("cls").alias("eval_cls"))
    exact = train.join(held, F.col("train_cls") == F.col("eval_cls")).select("train_row", "eval_row", F.lit("exact").alias("kind"))
    close = near.join(train, "train_cls").join(held, "eval_cls").select("train_row", "eval_row", F.lit("near").alias("kind"))
    sound = audio_pairs(clips(base)).select("train_row", "eval_row", F.lit("audio").alias("kind"))
    return exact.unionByName(close).unionByName(sound)


def found(rows: DataFrame) -> DataFrame:
    """row_a, row_b of every overlap, smaller first, each pair once."""
    pairs = overlaps(rows)
    return pairs.select(F.least("train_row", "eval_row").alias("row_a"), F.greatest("train_row", "eval_row").alias("row_b")).distinct()


def records(rows: DataFrame, share: float = COMMON_SHARE) -> DataFrame:
    """source_row, exact, near, audio, covered of the evaluation records with an overlap; no pair of rows is formed.

    A record has the facts of its class: whether the class is in training, and the largest share of its words that one near training
    class covers; 1 for exact copies, NULL for audio, which says nothing about words. Copies meet in partial aggregates.
    """
    base = rows.select("source_row", "split", "audio", "text")
    texts = cut(eligible(base))
    classes = cut(classes_of(texts))
    near = near_classes(classes, share, with_coverage=True)
    best = near.groupBy(F.col("eval_cls").alias("cls")).agg(F.max(F.col("covered") / F.col("n_words")).alias("near_covered"))
    facts = classes.filter("in_eval").join(best, "cls", "left").select("cls", F.col("in_train").alias("exact"), F.col("near_covered").isNotNull().alias("near"), F.when(F.col("in_train"), F.lit(1.0)).otherwise(F.col("near_covered")).alias("covered"))
    said = texts.filter("not train").select("source_row", "cls").join(facts.filter("exact or near"), "cls").select("source_row", "exact", "near", F.lit(False).alias("audio"), "covered")
    held = clips(base)
    known = held.groupBy("key").agg(F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_eval")).filter("in_train and in_eval").select("key")
    heard = held.filter("not train").join(known, "key").select("source_row", F.lit(False).alias("exact"), F.lit(False).alias("near"), F.lit(True).alias("audio"), F.lit(None).cast("double").alias("covered"))
    return said.unionByName(heard).groupBy("source_row").agg(*[F.max(k).alias(k) for k in ("exact", "near", "audio", "covered")])


def report(rows: DataFrame) -> DataFrame:
    """split, channel, file, n_rows, n_audio, n_exact, n_near, n_any, coverage of every evaluation split and source, zero where none overlaps.

    A record's coverage is the largest share of its words that one exact or near training record has; other records, those with
    the same audio alone included, count as 0. ``coverage`` is the mean over the source.
    """
    hit = records(rows).withColumnRenamed("source_row", "eval_row")
    held = rows.filter(~_side(F.col("split"))).select("source_row", "split", "channel", "file")
    flags = [F.count_if(F.col(k)).alias(f"n_{k}") for k in ("audio", "exact", "near")]
    joined = held.join(hit, held["source_row"] == hit["eval_row"], "left")
    return joined.groupBy("split", "channel", "file").agg(F.count(F.lit(1)).alias("n_rows"), *flags, F.count("eval_row").alias("n_any"), F.avg(F.coalesce("covered", F.lit(0.0))).alias("coverage"))
