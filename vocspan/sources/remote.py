"""Bytes over HTTP: exact ranges, clips of remote recordings, and downloads that go on where they stopped."""

from __future__ import annotations

import gzip
import hashlib
import os
import shutil
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame

from vocspan.operators.seams import with_retries
from vocspan.sources.wav import ClipReader, range_reply

Fetch = Callable[[str, int, int], bytes]
BLOCK = 32 * 1024 * 1024


def http_range(url: str, first: int, last: int, timeout: float = 60.0) -> bytes:
    """Bytes first..last of an address; anything but partial content of exactly that range is an error."""
    with urlopen(Request(url, headers={"Range": f"bytes={first}-{last}"}), timeout=timeout) as reply:
        return range_reply(reply.status, reply.headers.get("Content-Range"), reply.read(last - first + 2), first, last)


def clip_reader(base: str, fetch: Fetch = http_range) -> ClipReader:
    """Clips of the recordings under an address."""
    return ClipReader(lambda name, first, last: fetch(base + quote(name), first, last))


def read_ranges(rows: DataFrame, key: str, url: str, first: str, last: str, fetch: Fetch = http_range, tries: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """key, payload, error of every row's range; an error is the name of its exception. Rows are spread over tasks as they come."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, u, a, b in pdf.itertuples(index=False, name=None):
                try:
                    out.append((k, with_retries(lambda u=u, a=a, b=b: fetch(u, int(a), int(b)), tries, pause), ""))
                except Exception as problem:  # noqa: BLE001
                    out.append((k, None, type(problem).__name__))
            yield pd.DataFrame(out, columns=[key, "payload", "error"])

    return rows.select(key, url, first, last).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, payload binary, error string")


def _append(url: str, size: int, target: str, fetch: Fetch, block: int, tries: int, pause: Callable[[float], None]) -> None:
    """Fetch what a partial file lacks, block by block. More bytes than there should be are thrown away and fetched again."""
    have = os.path.getsize(target) if os.path.exists(target) else 0
    if have > size:
        os.remove(target)
        have = 0
    with open(target, "ab") as out:
        while have < size:
            last = min(have + block, size) - 1
            data = with_retries(lambda a=have, b=last: fetch(url, a, b), tries, pause)
            out.write(data)
            out.flush()
            have += len(data)


def _digest(path: str, block: int = 1 << 22) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(block):
            h.update(data)
    return h.hexdigest()


def download(parts: list[dict], target: str, sha256: str, unzip: bool = False, fetch: Fetch = http_range, block: int = BLOCK, tries: int = 3, pause: Callable[[float], None] = time.sleep) -> bool:
    """Put the file of one or several parts (url, bytes, sha256), perhaps compressed, in place; false if it was there already.

    A part that was interrupted goes on where it stopped. A part or a file with another digest is removed and is an error, so the next
    run starts it anew.
    """
    if os.path.exists(target) and _digest(target) == sha256:
        return False
    whole = f"{target}.whole"
    with open(whole, "wb") as out:
        for i, part in enumerate(parts):
            piece = f"{target}.{i}.part"
            _append(part["url"], part["bytes"], piece, fetch, block, tries, pause)
            if _digest(piece) != part["sha256"]:
                os.remove(piece)
                raise ValueError(f"part {i} has another digest")
            with open(piece, "rb") as data:
                shutil.copyfileobj(data, out)
    if unzip:
        with gzip.open(whole, "rb") as data, open(f"{whole}.plain", "wb") as out:
            shutil.copyfileobj(data, out)
        os.replace(f"{whole}.plain", whole)
    if _digest(whole) != sha256:
        os.remove(whole)
        raise ValueError("the file has another digest")
    os.replace(whole, target)
    for i in range(len(parts)):
        os.remove(f"{target}.{i}.part")
    return True
