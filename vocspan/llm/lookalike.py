"""Problem 1: bring text that looks the same to one form of characters.

Look-alike classes are the connected components (union-find) of a graph over strings and code points. Its edges come from
the Unicode data of the Python runtime (width and style variants, ligatures, letter plus accent against the accented
letter, spaces, characters that cannot be seen) and from one fixed table of letters that other scripts share with Latin.
Every class is represented by its most frequent admissible member in the corpus; admissible are plain forms, so a corpus
full of styled text is not rewritten towards the style. A multi-pattern automaton rewrites a text greedily, longest match
first, until nothing changes; context decides where a match stands for itself: joiners in emoji and in scripts that
need them, letters of words wholly in another script, full-width marks beside East Asian text.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets that the confusables data of Unicode (UTS #39) or plain sight gives the shape of one
# Latin letter. The Unicode data of the runtime does not hold that table, so they stand here script by script.
LATIN_TWINS = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "в": "b", "н": "h", "м": "m", "т": "t", "ӏ": "l", "ѵ": "v", "ү": "y", "ԍ": "G",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ϲ": "c", "ϳ": "j",
    # Armenian
    "ց": "g", "հ": "h", "ո": "n", "օ": "o", "ս": "u", "ք": "p", "ա": "w", "Օ": "O", "Ս": "U", "Լ": "L",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲥ": "C", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭲ": "T", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ꭵ": "i",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
#: Decompositions that only change how a character is drawn.
_STYLES = ("<font>", "<wide>", "<narrow>", "<circle>", "<square>", "<super>", "<sub>", "<small>")
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2800}
_ALPHABETS = ("GREEK", "CYRILLIC", "ARMENIAN", "COPTIC", "CHEROKEE", "LISU")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[b] = a

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return out


def _is_selector(ch: str) -> bool:
    return "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef"


def _is_tag(ch: str) -> bool:
    return "\U000e0020" <= ch <= "\U000e007f"


@lru_cache(maxsize=1)
def edges() -> tuple[tuple[str, str, str], ...]:
    """(variant, plain, kind) for every rule; kind is style, accent, space, hidden or script."""
    out: list[tuple[str, str, str]] = []
    for cp in range(0x20, 0x30000):
        if 0xD800 <= cp < 0xF900 or 0x4E00 <= cp < 0xA000 or 0x3400 <= cp < 0x4DC0:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cn":
            continue
        if kind in ("Zs", "Zl", "Zp"):
            if ch != " ":
                out.append((ch, " ", "space"))
            continue
        if kind == "Cf" or cp in _INVISIBLE or _is_selector(ch):
            out.append((ch, "", "hidden"))
            continue
        parts = unicodedata.decomposition(ch)
        if not parts:
            continue
        tag = parts.split()[0] if parts[0] == "<" else ""
        if not tag:
            composed = unicodedata.normalize("NFC", ch)
            if composed != ch:  # a character that Unicode replaces by another one
                out.append((ch, composed, "style"))
            else:
                full = unicodedata.normalize("NFD", ch)
                pair = "".join(chr(int(x, 16)) for x in parts.split())
                for apart in {full, pair}:
                    out.append((apart, ch, "accent"))
            continue
        plain = unicodedata.normalize("NFKC", ch)
        letters = all(unicodedata.category(c)[0] in "LNM" for c in plain)
        if (tag in _STYLES or (tag == "<compat>" and letters)) and plain != ch and plain.strip():
            out.append((ch, plain, "style"))
    for cp in (*range(0x00, 0x09), *range(0x0E, 0x1C), *range(0x7F, 0x85), *range(0x86, 0xA0)):
        out.append((chr(cp), "", "hidden"))
    for cp in (*range(0xE0001, 0xE0080), *range(0xE0100, 0xE01F0)):
        out.append((chr(cp), "", "hidden"))
    out += [(a, b, "script") for a, b in LATIN_TWINS.items()]
    return tuple(out)


@lru_cache(maxsize=1)
def classes() -> tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]:
    """(default representative, members, admissible members) of every class but those of the empty string and the space.

    Admissible are members that Unicode's own compatibility form leaves alone; among the letters of several scripts the
    default is the Latin one.
    """
    found = Classes()
    for variant, plain, kind in edges():
        if kind not in ("hidden", "space"):
            found.join(plain, variant)
    out = []
    for members in found.members().values():
        fit = sorted([m for m in members if unicodedata.normalize("NFKC", m) == m] or [m for m in members if unicodedata.normalize("NFC", m) == m], key=lambda m: (not m.isascii(), len(m), m))
        out.append((fit[0], tuple(sorted(members)), tuple(fit)))
    return tuple(sorted(out))


def _twin(fit: tuple[str, ...]) -> bool:
    return len(fit) > 1 and len({_script(m[0]) for m in fit}) > 1


def choose(counts: dict[str, int]) -> dict[str, str]:
    """Representatives that differ from the default one: {default: representative} by the counts of the admissible members.

    Letters shared by several scripts are decided together, by the script that has most of them in the corpus, so that a
    word is never rewritten half into one script and half into another.
    """
    scripts: Counter = Counter()
    for _, _, fit in classes():
        if _twin(fit):
            for m in fit:
                scripts[_script(m[0])] += counts.get(m, 0)
    home = max(scripts, key=lambda s: (scripts[s], s == "LATIN"), default="LATIN")
    out = {}
    for default, _, fit in classes():
        pool = [m for m in fit if _script(m[0]) == home] or [default] if _twin(fit) else fit
        best = max(pool, key=lambda m: (counts.get(m, 0), m == default))
        if best != default:
            out[default] = best
    return out


class Rewriter:
    """The automaton over all variants, with the rules of context."""

    def __init__(self, representatives: dict[str, str] | None = None) -> None:
        chosen = representatives or {}
        self.target: dict[str, tuple[str, str]] = {}
        kinds = {variant: kind for variant, _, kind in edges()}
        for default, members, _ in classes():
            rep = chosen.get(default, default)
            for m in members:
                if m != rep:  # a plain letter without an edge of its own is the twin of another script's representative
                    self.target[m] = (rep, kinds.get(m, "script"))
        for variant, plain, kind in edges():
            if kind in ("hidden", "space"):
                self.target[variant] = (plain, kind)
        self.automaton = ahocorasick.Automaton()
        for variant in self.target:
            self.automaton.add_word(variant, variant)
        self.automaton.make_automaton()

    def rewrite(self, text: str) -> str:
        """The one form of a text: passes until one changes nothing.

        A pass replaces members of classes by representatives, which no pass replaces again, or joins a letter and its
        accents to fewer characters, so passes come to an end.
        """
        while (new := self._pass(text)) != text:
            text = new
        return text

    def _pass(self, text: str) -> str:
        out, at = [], 0
        around = _Context(text)
        for end, variant in self.automaton.iter_long(text):
            start = end - len(variant) + 1
            plain, kind = self.target[variant]
            if kind == "hidden":
                # What stands before is the text as rewritten so far: a hidden character is not needed by one that goes itself.
                before = text[start - 1] if start > at else out[-1][-1] if out else ""
                if _needed(text[start], before, text[end + 1 : end + 2]):
                    continue
            elif kind == "script" and not around.in_word_of(_script(plain[0]), start):
                continue
            elif kind == "style" and around.east_asian_mark(start, end + 1, variant):
                continue
            out += [x for x in (text[at:start], plain) if x]
            at = end + 1
        return "".join((*out, text[at:])) if at else text


def _script(ch: str) -> str:
    return unicodedata.name(ch, "?").split(" ", 1)[0]


def _pictorial(ch: str) -> bool:
    return unicodedata.category(ch) in ("So", "Sk", "Sm") or _is_tag(ch) or _is_selector(ch)


_JOINING = ("ARABIC", "HEBREW", "SYRIAC", "THAANA", "NKO", "MONGOLIAN", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "KHMER", "MYANMAR", "TIBETAN", "THAI", "LAO")


def _needed(ch: str, before: str, after: str) -> bool:
    """A hidden character that its neighbours need: joined emoji, one selector or tags after a symbol, scripts with joiners."""
    if _is_selector(ch):
        return bool(before) and not before.isspace() and not _is_selector(before) and unicodedata.category(before)[0] != "L"
    if _is_tag(ch):
        return bool(before) and _pictorial(before)
    if ch in "\u200c\u200d":
        if before and after and _pictorial(before) and _pictorial(after):
            return True
        return bool(before and after) and _script(before) in _JOINING and _script(after) in _JOINING
    if ch in "\u200e\u200f\u061c":
        return any(x and _script(x) in ("ARABIC", "HEBREW", "SYRIAC", "THAANA", "NKO") for x in (before, after))
    # Signs that are shown although Unicode files them under format characters.
    return ch in "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"


class _Context:
    """What stands around a place of a text. Every word and every stretch without letters is looked at once, however many
    matches lie in it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.word = (0, 0, frozenset(), False)
        self.letters: tuple[list[int], list[int]] | None = None

    def _scripts(self, at: int) -> tuple[frozenset[str], bool]:
        """Scripts of the letters of the word at a place, and whether all of its letters have a Latin twin."""
        i, j, scripts, twins = self.word
        if not i <= at < j:
            i, j = at, at + 1
            while i and _wordly(self.text[i - 1]):
                i -= 1
            while j < len(self.text) and _wordly(self.text[j]):
                j += 1
            word = self.text[i:j]
            scripts = frozenset(s for c in set(word) if c.isalpha() and (s := _plain_script(c)))
            twins = all(c in LATIN_TWINS or not c.isalpha() for c in set(word))
            self.word = (i, j, scripts, twins)
        return scripts, twins

    def in_word_of(self, home: str, at: int) -> bool:
        """Whether the letter stands in a word with letters of the script home, or in one that mixes other alphabets."""
        if _script(self.text[at]) == home:
            return False
        scripts, twins = self._scripts(at)
        return home in scripts or (len(scripts) > 1 and twins)

    def east_asian_mark(self, start: int, end: int, variant: str) -> bool:
        """A full-width mark whose nearest letter in the line, the one before it first, is East Asian stands for itself."""
        if len(variant) != 1 or unicodedata.category(variant)[0] not in "PS" or unicodedata.east_asian_width(variant) != "F":
            return False
        if self.letters is None:
            before, after, last = [-1] * (len(self.text) + 1), [-1] * (len(self.text) + 1), -1
            for i, c in enumerate(self.text):
                before[i] = last
                last = i if c.isalnum() else -1 if c == "\n" else last
            last = -1
            for i in range(len(self.text) - 1, -1, -1):
                c = self.text[i]
                last = i if c.isalnum() else -1 if c == "\n" else last
                after[i] = last
            self.letters = before, after
        nearest = self.letters[0][start] if self.letters[0][start] >= 0 else self.letters[1][end]
        return nearest >= 0 and _script(self.text[nearest]) in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "KATAKANA-HIRAGANA")


def _plain_script(ch: str) -> str:
    """Script of a letter, styled letters counting as what they imitate."""
    name = _script(ch)
    if name in _ALPHABETS or name == "LATIN":
        return name
    plain = unicodedata.normalize("NFKC", ch)
    return _script(plain[0]) if plain != ch and plain[0].isalpha() else ""


def _wordly(ch: str) -> bool:
    return ch.isalpha() or unicodedata.category(ch) in ("Mn", "Cf")


@lru_cache(maxsize=4)
def rewriter(representatives: tuple[tuple[str, str], ...] = ()) -> Rewriter:
    return Rewriter(dict(representatives))


def count_members(texts: Iterable[str | None], counts: Counter | None = None) -> Counter:
    """Occurrences of code points; strings of several characters are counted by their rarest character."""
    counts = Counter() if counts is None else counts
    for t in texts:
        if t is not None:
            counts.update(t)
    return counts


def corpus_representatives(df: DataFrame, columns: list[str]) -> tuple[tuple[str, str], ...]:
    """Representatives chosen by the frequencies in all texts of the columns.

    Every task counts code points in one bounded table; sums of at most one row per code point of Unicode are collected.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for c in pdf.columns:
                count_members(pdf[c].dropna(), counts)
        yield pd.DataFrame({"ch": list(counts), "n": list(counts.values())}, columns=["ch", "n"])

    rows = df.select(*columns).mapInPandas(count, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n")).collect()
    single = {r["ch"]: r["n"] for r in rows}
    counts = dict(single)
    for _, _, fit in classes():
        for m in fit:
            if len(m) > 1:
                counts[m] = min(single.get(c, 0) for c in m)
    # A letter and a separate accent is never the plain form of a letter that has a character of its own.
    return tuple(sorted(choose(counts).items()))


def canonical(text: str | None, representatives: tuple[tuple[str, str], ...] = ()) -> str | None:
    """One form of a text; None stays None and ASCII text without control characters is returned as it is."""
    if text is None:
        return None
    if text.isascii() and (text.isprintable() or not _CONTROLS.intersection(text)):
        return text
    return rewriter(representatives).rewrite(text)


_CONTROLS = {chr(c) for c in (*range(0x00, 0x09), *range(0x0E, 0x1C), 0x7F)}


def canonical_column(text: Column, representatives: tuple[tuple[str, str], ...] = ()) -> Column:
    """The one form of every text. NULL gives NULL, an empty text an empty one; whole texts of any length are rewritten."""

    @F.pandas_udf("string")
    def rewrite(values: pd.Series) -> pd.Series:
        return values.map(lambda t: canonical(t, representatives), na_action="ignore")

    return rewrite(text)


def suspects(text: Column) -> Column:
    """Whether a text has anything but plain ASCII; the others need no Python worker."""
    return text.rlike(r"[^\t\n\x0B\f\r -~]")


def canonical_fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, original, canonical of every non-NULL field value; only values beyond plain ASCII pass through Python.

    Clashing names do no harm: other columns of df are ignored. Repeated rows give repeated results.
    """
    representatives = corpus_representatives(df, columns)
    fields = df.select(F.col(key).alias(key), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("original")) for c in columns])).alias("x")).select(key, "x.field", "x.original")
    fields = fields.filter(F.col("original").isNotNull())
    odd = fields.filter(suspects(F.col("original"))).withColumn("canonical", canonical_column(F.col("original"), representatives))
    plain = fields.filter(~suspects(F.col("original"))).withColumn("canonical", F.col("original"))
    return plain.unionByName(odd)


def found(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field of the values that the rewriting changes."""
    representatives = corpus_representatives(df, columns)
    fields = df.select(F.col(key).alias(key), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("original")) for c in columns])).alias("x"))
    odd = fields.select(key, "x.field", "x.original").filter(suspects(F.col("original")))
    return odd.withColumn("canonical", canonical_column(F.col("original"), representatives)).filter(F.col("canonical") != F.col("original")).select(key, "field")

