"""Where models and services plug in: errors become values, retries and batches are the engine's."""

from __future__ import annotations

import math
import subprocess
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "generated_text string, duration_seconds double, error string"


def check_reply(reply: object) -> tuple[str, float]:
    """Text and seconds of a transcription service's reply; anything but strings with a finite duration from 0 on is an error."""
    if not isinstance(reply, dict) or not isinstance(reply.get("transcription"), str) or not isinstance(reply.get("duration"), str):
        raise ValueError("a reply needs a transcription and a duration")
    seconds = float(reply["duration"])
    if not math.isfinite(seconds) or seconds < 0:
        raise ValueError("a duration must be finite and not negative")
    return reply["transcription"], seconds


def with_retries(call: Callable[[], object], tries: int = 3, pause: Callable[[float], None] = time.sleep) -> object:
    """The result of the first call that succeeds; pauses double up to 15 s, the last error is raised."""
    for n in range(tries):
        try:
            return call()
        except Exception:
            if n == tries - 1:
                raise
            pause(min(2.0**n, 15.0))
    raise ValueError("tries must be at least 1")


def transcribe(rows: DataFrame, key: str, payload: str, service: Callable[[bytes], dict], tries: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, generated_text, duration_seconds, error of every row; an error is the name of its exception, success an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, data in zip(pdf[key], pdf[payload], strict=True):
                try:
                    text, seconds = check_reply(with_retries(lambda d=data: service(d), tries, pause))
                    out.append((k, text, seconds, ""))
                except Exception as problem:  # noqa: BLE001
                    out.append((k, "", None, type(problem).__name__))
            yield pd.DataFrame(out, columns=[key, "generated_text", "duration_seconds", "error"])

    kind = dict(rows.dtypes)[key]
    return rows.select(key, payload).mapInPandas(run, f"`{key}` {kind}, {RESULT}")


def map_batches(rows: DataFrame, key: str, value: str, model: Callable[[list], list], kind: str, size: int = 8, setup: Callable[[], None] | None = None) -> DataFrame:
    """key, result, error of a batch model: ``size`` values a call, as many results as values or the whole batch fails.

    ``setup`` runs once per task, so a model is loaded once and serves all of its batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if setup is not None:
            setup()
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                try:
                    got, error = model(part[value].tolist()), ""
                    if len(got) != len(part):
                        raise ValueError("a batch came back with another length")
                except Exception as problem:  # noqa: BLE001
                    got, error = [None] * len(part), type(problem).__name__
                yield pd.DataFrame({key: part[key].to_numpy(), "result": pd.Series(got, dtype=object), "error": error})

    return rows.select(key, value).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, result {kind}, error string")


def embed(rows: DataFrame, key: str, samples: str, model: Callable[[list], list], dimensions: int = 512, size: int = 8, setup: Callable[[], None] | None = None) -> DataFrame:
    """key, vector, error of a batch model of sounds; a vector of another length, or one that is not finite or has no direction, is an error."""
    got = map_batches(rows, key, samples, model, "array<double>", size, setup)
    v = F.col("result")
    fine = (F.size(v) == dimensions) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    error = F.when(F.col("error") != "", F.col("error")).when(F.coalesce(fine, F.lit(False)), F.lit("")).otherwise(F.lit("InvalidEmbedding"))
    return got.select(key, F.when(error == "", v).alias("vector"), error.alias("error"))


def first_source(rows: DataFrame, key: str, fetchers: dict[str, Callable[[dict], bytes | None]], limit: int = 64 * 1024 * 1024) -> DataFrame:
    """key, payload, source, error: the bytes of the first fetcher that gives any; empty and oversized ones are refused.

    Fetchers are tried in their order with the row as a dictionary, such as a cache, the address in the row, a clip service.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                error = "NotFound"
                for name, fetch in fetchers.items():
                    try:
                        data = fetch(row)
                        if data is None:
                            continue
                        if not 0 < len(data) <= limit:
                            raise ValueError("empty or oversized")
                        out.append((row[key], data, name, ""))
                        break
                    except Exception as problem:  # noqa: BLE001
                        error = type(problem).__name__
                else:
                    out.append((row[key], None, None, error))
            yield pd.DataFrame(out, columns=[key, "payload", "source", "error"])

    return rows.mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, payload binary, source string, error string")


#: Any audio to 16-bit mono at 16 kHz.
TRANSCODE = ("ffmpeg", "-v", "error", "-i", "pipe:0", "-ac", "1", "-ar", "16000", "-c:a", "pcm_s16le", "-f", "wav", "pipe:1")


def transcode(rows: DataFrame, key: str, payload: str, command: tuple[str, ...] = TRANSCODE, seconds: float = 120.0) -> DataFrame:
    """key, payload, error: what a program that reads and writes pipes makes of the bytes; a missing program is an error like any other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, data in zip(pdf[key], pdf[payload], strict=True):
                try:
                    done = subprocess.run(command, input=data, capture_output=True, timeout=seconds, check=True)
                    if not done.stdout:
                        raise ValueError("no output")
                    out.append((k, done.stdout, ""))
                except Exception as problem:  # noqa: BLE001
                    out.append((k, None, type(problem).__name__))
            yield pd.DataFrame(out, columns=[key, "payload", "error"])

    return rows.select(key, payload).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, payload binary, error string")


def resolve_titles(videos: DataFrame, known: DataFrame, resolver: Callable[[str], str | None]) -> DataFrame:
    """video, title, source: known titles stay, others are asked for, and the title in the name is the fallback. videos: video, fallback."""
    fresh = videos.join(known, "video", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v, spare in zip(pdf["video"], pdf["fallback"], strict=True):
                try:
                    title = resolver(v)
                except Exception:  # noqa: BLE001
                    title = None
                out.append((v, title or spare, "service" if title else "file name"))
            yield pd.DataFrame(out, columns=["video", "title", "source"])

    asked = fresh.mapInPandas(ask, "video string, title string, source string")
    return known.select("video", "title", F.col("source")).join(videos.select("video"), "video", "left_semi").unionByName(asked)
