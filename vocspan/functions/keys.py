"""Keys and addresses of rows that must equal those of other tools byte for byte."""

from __future__ import annotations

import hashlib
import json
from urllib.parse import quote, urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a row key, in the order of its JSON text.
ROW_KEY = ("audio", "channel", "end_time", "file", "speaker", "start_time", "text")
AUDIO_KEY = ("audio", "end_time", "file", "source_row", "start_time")


def _json_string(value: Column) -> Column:
    """JSON text of a string, missing as empty, other than ASCII kept."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    wrapped = F.to_json(F.struct(text.alias("v")))
    escaped = F.regexp_replace(F.substring(wrapped, 6, 1 << 30), r"\}$", "")
    return F.when(text.rlike(r'["\\\x00-\x1F]'), escaped).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def row_key(columns: tuple[str, ...] = ROW_KEY) -> Column:
    """SHA-256 of the columns as a JSON object with sorted keys and blanks after separators."""
    parts = [F.concat(F.lit(f'"{c}": '), _json_string(F.col(c))) for c in sorted(columns)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def ascii_key(columns: tuple[str, ...] = AUDIO_KEY) -> Column:
    """As row_key, with everything but ASCII escaped; the escaping is Python's own."""

    @F.pandas_udf("string")
    def digest(rows: pd.DataFrame) -> pd.Series:
        names = sorted(columns)
        values = rows[list(columns)].fillna("")
        return pd.Series([hashlib.sha256(json.dumps(dict(zip(names, r, strict=True)), sort_keys=True).encode()).hexdigest() for r in values[names].itertuples(index=False, name=None)])

    return digest(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]))


def clip_address(file: Column, start: Column, end: Column, audio_base: str, endpoint: str) -> Column:
    """Address of a clip service for a recording; NULL where a time is no number. Python formats and quotes."""

    @F.pandas_udf("string")
    def address(f: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        def one(name: str | None, a: str | None, b: str | None) -> str | None:
            try:
                times = {"start": f"{float(a):.3f}", "end": f"{float(b):.3f}"}
            except (TypeError, ValueError):
                return None
            source = audio_base + quote((name or "").removesuffix(".TextGrid") + ".wav")
            return endpoint + "?" + urlencode({"url": source, **times, "fmt": "mp3"})

        return pd.Series([one(*x) for x in zip(f, s, e, strict=True)], dtype=object)

    return address(file, start.cast("string"), end.cast("string"))


def cache_name(audio: Column, fallback: Column) -> Column:
    """Name of the cached clip: hash of both addresses."""
    return F.concat(F.sha2(F.concat(F.coalesce(audio, F.lit("")), F.lit("|"), F.coalesce(fallback, F.lit(""))), 256), F.lit(".mp3"))


def is_cache_name(name: Column) -> Column:
    return name.rlike(r"^[a-f0-9]{64}\.mp3$")


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's columns as a JSON object with sorted keys, missing values as empty strings."""
    return row_key(tuple(columns))


def ordered_digest(rows: DataFrame, position: str, columns: list[str], fan: int = 4096) -> DataFrame:
    """One row: n_rows and digest, an order-sensitive SHA-256 of a data set of any size.

    ``fan`` row digests in the order of their dense positions are joined and hashed, then ``fan`` of the results, until one is
    left, so no task holds more than ``fan`` of them. An empty set has the digest of an empty text. Columns that are derived by a
    model run are left out of ``columns``, so they do not change the identity.
    """
    level = rows.select(F.col(position).alias("i"), row_digest(columns).alias("d"))
    count = rows.count()
    left = count
    while True:
        packed = level.groupBy(F.floor(F.col("i") / fan).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("x"))
        level = packed.select("i", F.sha2(F.array_join(F.transform("x", lambda x: x["d"]), ""), 256).alias("d"))
        left = -(-left // fan)
        if left <= 1:
            break
    return level.groupBy().agg(F.lit(count).cast("long").alias("n_rows"), F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("digest"))


def identity(rows: DataFrame, position: str, derived: tuple[str, ...] = ("generated_text", "asr_duration_seconds", "asr_error")) -> DataFrame:
    """ordered_digest of everything but the columns that a model run adds and the position itself."""
    return ordered_digest(rows, position, [c for c in rows.columns if c not in derived and c != position])
