"""Clips of PCM recordings: header, frame arithmetic, reading by byte ranges, and checks of decoded audio."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 64 * 1024 * 1024
#: A clip may end this much after the recording.
TOLERANCE = 0.15


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    width: int
    offset: int
    frames: int


def parse_header(data: bytes) -> Header:
    """Header of a RIFF file from its first bytes; the data chunk may go beyond them."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF recording")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt ":
            kind, channels, rate, _, block, bits = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            if kind not in (1, 0xFFFE):
                raise ValueError("not PCM")
            form = (rate, channels, bits // 8, block)
        elif name == b"data":
            if form is None:
                raise ValueError("data before format")
            return Header(form[0], form[1], form[2], at + 8, size // form[3])
        at += 8 + size + size % 2
    raise ValueError("no data chunk in the first bytes")


def frame_range(start: Column, end: Column, rate: Column, frames: Column) -> tuple[Column, Column]:
    """First frame and the frame after the last of a clip; NULL when it starts before the recording or ends too far after it."""
    good = (start >= 0) & (start < end) & (end <= frames / rate + TOLERANCE)
    return F.when(good, F.floor(start * rate)), F.when(good, F.least(F.ceil(end * rate), frames))


class ClipReader:
    """Clips through a function that returns the bytes of a range (name, first, last) exactly; headers are kept."""

    def __init__(self, fetch: Callable[[str, int, int], bytes], headers: int = 2048) -> None:
        self._fetch = fetch
        self.header = lru_cache(maxsize=headers)(lambda name: parse_header(self._exact(name, 0, 4095, short=True)))

    def _exact(self, name: str, first: int, last: int, short: bool = False) -> bytes:
        data = self._fetch(name, first, last)
        if len(data) != last - first + 1 and not (short and data):
            raise ValueError("a range came back with another length")
        return data

    def clip(self, name: str, start: float, end: float) -> bytes:
        if not (0 <= start < end):
            raise ValueError("a clip needs 0 <= start < end")
        h = self.header(name)
        if end > h.frames / h.rate + TOLERANCE:
            raise ValueError("the clip ends after the recording")
        first, last = int(start * h.rate // 1), min(int(-(-end * h.rate // 1)), h.frames)
        block = h.channels * h.width
        if last <= first or (last - first) * block > MAX_BYTES:
            raise ValueError("an empty or oversized clip")
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(h.channels)
            w.setsampwidth(h.width)
            w.setframerate(h.rate)
            w.writeframes(self._exact(name, h.offset + first * block, h.offset + last * block - 1))
        return out.getvalue()


def range_reply(status: int, content_range: str | None, body: bytes, first: int, last: int) -> bytes:
    """The body of a reply to a range request, which must be partial content of exactly that range."""
    if status != 206 or not (content_range or "").startswith(f"bytes {first}-{last}/") or len(body) != last - first + 1:
        raise ValueError("the server did not answer the range")
    return body


def audio_fault(width: Column, channels: Column, rate: Column, measured: Column, expected: Column, peak: Column) -> Column:
    """Why decoded audio is refused; NULL when it is fine: 16-bit mono at 16 kHz, 0.2 to 20.2 s, close to its expected length, not silent."""
    return (
        F.when((width != 2) | (channels != 1) | (rate != 16_000), F.lit("format"))
        .when(~measured.between(0.2, 20.2), F.lit("length"))
        .when(F.abs(measured - expected) > F.greatest(F.lit(0.15), expected * 0.05), F.lit("differs from annotation"))
        .when(peak == 0, F.lit("silent"))
    )


def sample_fault(samples: Column, least: int = 4_000) -> Column:
    """Why samples cannot be embedded; NULL when they can."""
    bad = F.exists(samples, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(samples.isNull() | (F.size(samples) < least), F.lit("short")).when(bad, F.lit("not finite")).when(~F.exists(samples, lambda x: x != 0), F.lit("silent"))


def padded(samples: Column, length: int = 16_000) -> Column:
    """Samples with zeros behind them up to the length."""
    return F.concat(samples, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(samples), F.lit(0))))


def loud_windows(samples: Column, window: int = 80_000, gate: float = 0.005) -> Column:
    """Whole windows whose root mean square reaches the gate; a remainder is left out."""
    starts = F.when(F.size(samples) >= window, F.sequence(F.lit(0), F.floor(F.size(samples) / window).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.slice(samples, i * window + 1, window))
    return F.filter(cut, lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / window) >= gate)
