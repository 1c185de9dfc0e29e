"""Problem 2: raw, cut-up utterances to ordered speaker turns with clean labels and clean spoken text.

The order of the segments of a file is a graph of precedence constraints. Timing: a segment precedes those with a later
(start, end). Cue: a segment that names its speaker at the head of its text answers the one annotated before it. Dialogue:
a segment precedes the one annotated after it. Constraints that contradict each other (rows that come late) are resolved by
rank, timing before cue before dialogue: the lower one is dropped. What is left is acyclic and is sorted topologically; among
segments that are free at the same time the one annotated first goes first.

A file is cut into blocks of time, and timing puts the blocks in order, so every block is a graph of its own. Files are
spread over tasks by a range partitioning on (file, start, end, source_row), which cuts hot files and groups of copies as
well; a task sorts one batch of whole blocks after another and holds no more. Timing edges run through one gate per instant,
so a block has three edges a segment, however many segments share an instant. Runs of one speaker are complete inside a part
but for its first and last one, which are merged afterwards.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocspan.functions.labels import clean_speaker
from vocspan.functions.times import parse_ms, valid_interval
from vocspan.llm.lookalike import canonical
from vocspan.session import cut

_LABEL = r"(?:speaker|spkr|spk)[ _#.-]*\d{1,3}"
#: A label at the head: SPEAKER_04: / <Speaker 4> / [SPEAKER_04] / >> SPK02: / speaker 3 -
_CUE = re.compile(rf"(?i)(?:>>+\s*)?(?:[\[<(]\s*({_LABEL})\s*[\])>]\s*:?|(?<!\w)({_LABEL}|S\d{{1,3}})\s*(?::|-(?=\s|$)))")
_CLOCK = r"\d{1,3}:\d{1,2}(?::\d{1,2})?(?:[.,]\d{1,6})?"
#: Time marks: any clock or 0h33m14s in brackets, and h:mm:ss with a fraction or an arrow outside.
_MARK = re.compile(rf"(?i)[\[(<{{]\s*(?:{_CLOCK}|\d+h\s*\d+m\s*\d+s?)\s*(?:-->\s*(?:{_CLOCK})?\s*)?[\])>}}]|\b\d{{1,3}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,6}})?(?:\s*-->(?:\s*{_CLOCK})?)?(?!\d)|-->")
#: Sound notes: [laughter] (applause) {sighs} <noise> *laughs* and anything between notes of music.
_NOTE = re.compile(r"\(\([^()]*\)\)?|\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|<[^<>]*>|\*[^*\n]+\*|♪[^♪\n]*♪|[♪♫♩♬#]+(?=\s|$)|[♪♫♩♬]")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
#: Without one of these a text has no label, mark or note.
_ODD = re.compile(r"[\[(<{*♪♫♩♬#:]|-->|-(?:\s|$)")
_STARTS = frozenset("uhemaUHEMA")
_SQUEEZE = re.compile(r"(.)\1+")
#: Hesitation sounds after runs of one letter are squeezed: um, uh, hmm, erm, ah and their mixtures.
HESITATIONS = frozenset({"um", "uh", "uhm", "umh", "hm", "erm", "ehm", "ah", "ahm", "m"})


@lru_cache(maxsize=100_000)
def is_hesitation(word: str) -> bool:
    """um, uh, hmm, erm, ah with any letter drawn out; a single letter is a word."""
    low = word.lower()
    return len(low) > 1 and low[0] in _STARTS and _SQUEEZE.sub(r"\1", low) in HESITATIONS


def head_label(text: str) -> str | None:
    """The speaker label at the head of a canonical text, after any time marks and sound notes; None without one."""
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif m := _CUE.match(text, at):
            return m.group(1) or m.group(2)
        elif (m := _MARK.match(text, at)) or (m := _NOTE.match(text, at)):
            at = max(m.end(), at + 1)
        else:
            return None
    return None


def clean_text(text: str) -> str:
    """The words said and their punctuation, without labels, time marks, sound notes and hesitations."""
    if not _ODD.search(text):
        return text
    return _NOTE.sub(" ", _MARK.sub(" ", _CUE.sub(" ", text)))


def spoken_words(text: str | None) -> list[str]:
    """Lower-case words of the speech in a raw text; case, punctuation and the way characters are written are gone."""
    if not text:
        return []
    said = clean_text(canonical(text)).casefold().replace("’", "'")
    return [w for w in _WORD.findall(said) if w[0] not in _STARTS or not is_hesitation(w)]


def spoken_text(text: str | None) -> str:
    """Clean speech: hesitations go with the punctuation that belongs to them, white space is single."""
    if not text:
        return ""
    said = clean_text(canonical(text))
    said = _WORD.sub(lambda m: "" if is_hesitation(m.group()) else m.group(), said)
    said = re.sub(r"\s+([,.!?;:…]+)", r"\1", re.sub(r"\s+", " ", said))
    said = re.sub(r"([,;:])[,;:. ]*(?=[.!?])|([,;:])(?:\s*[,;:])+", r"\2", said)
    return re.sub(r"^[\s,.;:!?…]+", "", said).strip() if _WORD.search(said) else ""


def once(function):  # noqa: ANN001, ANN201
    """The Python function marked so that a filter on its result is not moved below it, where it would be computed a second time."""
    return function.asNondeterministic()


def segments(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """file, source_row, start_ms, end_ms, speaker, cue (and text) of the rows that take part in turns; cue: the head names the speaker.

    Left out are rows without valid times, without a speaker in the column or at the head of the text, or without speech.
    NULL anywhere but in file and source_row leaves a row out; repeated rows stay.
    """
    timed = rows.select(
        "file", F.col("source_row").cast("long").alias("source_row"), parse_ms(F.col("start_time")).alias("start_ms"), parse_ms(F.col("end_time")).alias("end_ms"), clean_speaker(F.col("speaker")).alias("label"), "text",
    ).filter(valid_interval(F.col("start_ms"), F.col("end_ms")) & F.col("text").isNotNull())

    @F.pandas_udf("head string, speech boolean, said string")
    def look(text: pd.Series, label: pd.Series) -> pd.DataFrame:
        heads, speech, said = [], [], []
        for t, known in zip(text, label, strict=True):
            plain = canonical(t)
            heads.append(None if isinstance(known, str) else head_label(plain))
            if with_text:
                words = spoken_text(plain)
                said.append(words)
                speech.append(bool(_WORD.search(words)))
            else:
                said.append(None)
                speech.append(any(m[0][0] not in _STARTS or not is_hesitation(m[0]) for m in _WORD.finditer(clean_text(plain))))
        return pd.DataFrame({"head": pd.Series(heads, dtype=object), "speech": speech, "said": pd.Series(said, dtype=object)})

    seen = timed.withColumn("x", once(look)("text", "label")).filter(F.col("x.speech"))
    named = seen.select("file", "source_row", "start_ms", "end_ms", F.coalesce("label", clean_speaker(F.col("x.head"))).alias("speaker"), F.col("x.head").isNotNull().alias("cue"), F.col("x.said").alias("text"))
    named = named.filter(F.col("speaker").isNotNull())
    return named if with_text else named.drop("text")


BLOCK_MS = 600_000
#: Segments in one piece of a turn's text; a turn of more comes in several pieces.
PIECE = 1000
TIMING, CUE, DIALOGUE = 3, 2, 1


def resolve(level: np.ndarray, same: np.ndarray, cue: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Precedence edges (from, to, rank) of segments in dialogue order, and whether each one is kept.

    level: place of each segment's (file, start, end) among those of the block; same: whether a segment is in the block of the one
    before it. Nodes from len(level) on are the gates between neighbouring levels. A cue or dialogue edge that leads to an
    earlier level contradicts a path of timing edges and is dropped; all others agree with the order (level, place).
    """
    n = len(level)
    node = np.arange(n)
    late = level < level.max(initial=0)
    into, out = node[late], node[level > 0]
    follow = node[1:][same[1:]]
    source = np.concatenate([into, n + level[out] - 1, follow - 1])
    target = np.concatenate([n + level[into], out, follow])
    rank = np.concatenate([np.full(len(into) + len(out), TIMING), np.where(cue[follow], CUE, DIALOGUE)])
    keep = np.concatenate([np.ones(len(into) + len(out), bool), level[follow - 1] <= level[follow]])
    return source, target, rank, keep


def topological_order(nodes: int, source: np.ndarray, target: np.ndarray) -> list[int]:
    """Nodes so that every edge leads forward; of the nodes that are free the one with the lowest number first. A cycle is an error."""
    by = np.argsort(source, kind="stable")
    heads = np.searchsorted(source[by], np.arange(nodes + 1)).tolist()
    after = target[by].tolist()
    waits = np.bincount(target, minlength=nodes)
    free = np.flatnonzero(waits == 0).tolist()
    waits = waits.tolist()
    out: list[int] = []
    while free:
        v = heapq.heappop(free)
        out.append(v)
        for e in range(heads[v], heads[v + 1]):
            w = after[e]
            waits[w] -= 1
            if not waits[w]:
                heapq.heappush(free, w)
    if len(out) != nodes:
        raise ValueError("the constraints contradict each other")
    return out


def dialogue_order(pdf: pd.DataFrame) -> np.ndarray:
    """Places of the segments of whole blocks, given in the order (file, block, source_row), in their topological order."""
    file = pd.factorize(pdf["file"])[0]  # files come one after the other, so their numbers rise
    instants = np.stack([file, pdf["start_ms"].to_numpy(np.int64), pdf["end_ms"].to_numpy(np.int64)])
    by = np.lexsort(instants[::-1])
    step = np.zeros(len(pdf), np.int64)
    step[by[1:]] = (instants[:, by[1:]] != instants[:, by[:-1]]).any(axis=0)
    level = np.empty(len(pdf), np.int64)
    level[by] = step[by].cumsum()
    block = pdf["block"].to_numpy()
    same = np.ones(len(pdf), bool)
    same[1:] = (file[1:] == file[:-1]) & (block[1:] == block[:-1])
    source, target, _, keep = resolve(level, same, pdf["cue"].to_numpy(bool))
    order = np.array(topological_order(len(pdf) + int(level.max(initial=0)), source[keep], target[keep]))
    return order[order < len(pdf)]


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by (file, block, source_row) in the order of the dialogue; the block at the end of a batch waits for its rest."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        last = (pdf["file"].iloc[-1], pdf["block"].iloc[-1])
        if held and (held[-1]["file"].iloc[-1], held[-1]["block"].iloc[-1]) == (pdf["file"].iloc[0], pdf["block"].iloc[0]) == last:
            held.append(pdf)
            continue
        open_block = (pdf["block"].to_numpy() == last[1]) & (pdf["file"].to_numpy(object) == last[0])
        whole = pd.concat([*held, pdf[~open_block]], ignore_index=True)
        if len(whole):
            yield whole.iloc[dialogue_order(whole)]
        held = [pdf[open_block]]
    if held:
        rest = pd.concat(held, ignore_index=True)
        yield rest.iloc[dialogue_order(rest)]


_RUN = "file string, speaker string, first_row long, last_row long, start_ms long, end_ms long, n_segments long, text string, part int, edge boolean, pos long, piece long"


def _runs(with_text: bool):  # noqa: ANN202
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of one speaker in a part, and records of full pieces of text, which have a number in ``piece``.

        The first and the last run of the part are marked as edges; others are complete. A run's own record holds the rest of its text.
        """
        held: dict | None = None
        said: list[str] = []
        first, pos, pieces = True, 0, 0
        out: list[dict] = []

        def full() -> None:
            nonlocal said, pieces
            while len(said) > PIECE:
                out.append(held | {"text": " ".join(said[:PIECE]), "edge": False, "pos": pos, "piece": pieces})
                said, pieces = said[PIECE:], pieces + 1

        for pdf in _in_order(batches):
            file, who = pdf["file"].to_numpy(object), pdf["speaker"].to_numpy(object)
            rows, start, end, part = (pdf[c].to_numpy() for c in ("source_row", "start_ms", "end_ms", "part"))
            texts = pdf["text"].tolist() if with_text else []
            fresh = np.ones(len(pdf), bool)
            fresh[1:] = (file[1:] != file[:-1]) | (who[1:] != who[:-1])
            begin = np.flatnonzero(fresh)
            stop = np.append(begin[1:], len(pdf))
            for b, e in zip(begin.tolist(), stop.tolist(), strict=True):
                run = {"file": file[b], "speaker": who[b], "first_row": int(rows[b]), "last_row": int(rows[e - 1]), "start_ms": int(start[b]), "end_ms": int(end[b:e].max()), "n_segments": e - b, "part": int(part[b])}
                if held is not None and held["file"] == run["file"] and held["speaker"] == run["speaker"]:
                    held |= {"last_row": run["last_row"], "end_ms": max(held["end_ms"], run["end_ms"]), "n_segments": held["n_segments"] + run["n_segments"]}
                    said += texts[b:e]
                    full()
                    continue
                if held is not None:
                    out.append(held | {"text": " ".join(said), "edge": first, "pos": pos, "piece": None})
                    first, pos, pieces = False, pos + 1, 0
                held, said = run, texts[b:e]
                full()
            if out:
                yield pd.DataFrame(out).astype({"piece": "Int64"})
                out.clear()
        if held is not None:
            out.append(held | {"text": " ".join(said), "edge": True, "pos": pos, "piece": None})
            yield pd.DataFrame(out).astype({"piece": "Int64"})

    return scan


_TURN = ("file", "speaker", "first_row", "last_row", "start_ms", "end_ms", "n_segments")


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edge runs in order; every one comes out with the turn it belongs to. At most two runs per part are held."""
    runs = [r for pdf in batches for r in pdf.to_dict("records")]
    out: list[dict] = []
    begin = 0
    for i, run in enumerate(runs):
        own = {"t_" + c: run[c] for c in ("first_row", "last_row", "start_ms", "end_ms", "n_segments")}
        last = runs[i - 1] if i else None
        # The last run of one part and the first of the next; the two edges of one part are apart.
        if last is not None and (last["file"], last["speaker"]) == (run["file"], run["speaker"]) and run["pos"] == 0 and run["part"] > last["part"]:
            whole = out[begin]
            whole |= {"t_last_row": run["last_row"], "t_end_ms": max(whole["t_end_ms"], run["end_ms"]), "t_n_segments": whole["t_n_segments"] + run["n_segments"]}
            out.append({"part": run["part"], "pos": run["pos"], "head": begin, "first": False})
            continue
        begin = i
        out.append({"part": run["part"], "pos": run["pos"], "head": i, "first": True, **own})
    for row in out:
        row |= {k: v for k, v in out[row["head"]].items() if k.startswith("t_")}
    if out:
        yield pd.DataFrame(out).drop(columns="head")


def turns(rows: DataFrame, with_text: bool = False, parts: int | None = None) -> DataFrame:
    """One row per speaker turn: file, speaker, first_row, last_row, start_ms, end_ms, n_segments.

    With text there are piece and text as well: a turn of more than PIECE segments has one row for each piece of its text, numbered
    from 0, of at most PIECE segments each, so that no row grows with the data; other turns have one row, piece 0. A turn is a longest run of one speaker in the order of the file.
    ``parts`` is the number of parts (the session's shuffle partitions by default). An empty table gives no turns; extra columns are ignored.
    """
    spark = rows.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ["file", "start_ms", "end_ms", "source_row"]
    # The range partitioning reads its input twice, once for the borders: the texts are cleaned once before.
    spread = cut(segments(rows, with_text)).withColumn("block", F.floor(F.col("start_ms") / BLOCK_MS)).repartitionByRange(parts, *key)
    ordered = spread.sortWithinPartitions("file", "block", "source_row").withColumn("part", F.spark_partition_id())
    runs = cut(ordered.mapInPandas(_runs(with_text), _RUN))
    # At most two runs per part: their number is bounded by the number of parts, not by the data.
    edges = runs.filter("edge").select("file", "speaker", "first_row", "last_row", "start_ms", "end_ms", "n_segments", "part", "pos").coalesce(1).sortWithinPartitions("part", "pos")
    merged = edges.mapInPandas(_merge, "part int, pos long, first boolean, t_first_row long, t_last_row long, t_start_ms long, t_end_ms long, t_n_segments long")
    if not with_text:
        joined = runs.filter("edge").join(F.broadcast(merged), ["part", "pos"]).filter("first")
        return runs.filter("not edge").select(*_TURN).unionByName(joined.select("file", "speaker", *[F.col("t_" + c).alias(c) for c in _TURN[2:]]))
    # Pieces belong to the run of their part and place; runs in one piece that no border cuts are turns as they are.
    long = runs.filter("piece is null and not edge and n_segments > %d" % PIECE).select("part", "pos", *[F.col(c).alias("t_" + c) for c in _TURN[2:]])
    short = runs.filter("piece is null and not edge and n_segments <= %d" % PIECE).select(*_TURN, F.lit(0).cast("long").alias("piece"), "text")
    cut_up = runs.filter("edge or piece is not null or n_segments > %d" % PIECE).select("file", "speaker", "part", "pos", "piece", "text").join(merged.drop("first").unionByName(long), ["part", "pos"])
    named = cut_up.select("file", "speaker", *[F.col("t_" + c).alias(c) for c in _TURN[2:]], "part", "pos", F.coalesce("piece", F.lit(1 << 40)).alias("at"), "text")
    # A turn of few segments that a border cuts is put together again; its list has at most PIECE entries.
    joined = named.filter(F.col("n_segments") <= PIECE).groupBy(*_TURN).agg(F.array_sort(F.collect_list(F.struct("part", "pos", "at", "text"))).alias("x"))
    joined = joined.select(*_TURN, F.lit(0).cast("long").alias("piece"), F.array_join(F.transform("x", lambda x: x["text"]), " ").alias("text"))
    number = F.row_number().over(Window.partitionBy("file", "speaker", "first_row").orderBy("part", "pos", "at")) - 1
    several = named.filter(F.col("n_segments") > PIECE).select(*_TURN, number.cast("long").alias("piece"), "text")
    return short.unionByName(joined).unionByName(several)


def found(rows: DataFrame) -> DataFrame:
    """speaker, first_row, last_row of every turn."""
    return turns(rows).select("speaker", "first_row", "last_row")
