"""Tar archives of clips with a JSON-lines manifest: writing, verified unpacking and recovery of an interrupted one."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import tarfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspan.functions.keys import is_cache_name
from vocspan.session import cut

MAX_BYTES = 64 * 1024 * 1024
#: Bytes of an archive that are read as one piece, entries and bytes of payload that go on together, and an archive's block.
PIECE, BATCH, BATCH_BYTES, BLOCK = 8 * 1024 * 1024, 4096, 16 * 1024 * 1024, 512
_MEMBER = "archive string, name string, regular boolean, bytes long, payload binary, complete boolean"
_MEMBER_ARROW = pa.schema([("archive", pa.string()), ("name", pa.string()), ("regular", pa.bool_()), ("bytes", pa.int64()), ("payload", pa.binary()), ("complete", pa.bool_())])
_MANIFEST = "row_key string, cache_name string, source string, error string, bytes long, sha256 string, part int"
_MANIFEST_ARROW = pa.schema([*[(c, pa.string()) for c in ("row_key", "cache_name", "source", "error")], ("bytes", pa.int64()), ("sha256", pa.string()), ("part", pa.int32())])
#: Fields of a plain header, as the usual writers fill them.
_NAME = re.compile(rb"([\x01-\x7f]+)\0*")
_NUMBERS = re.compile(rb"(?:[0-7]{7}[ \0]|[0-7]{6} \0){3}([0-7]{11})[ \0][0-7]{11}[ \0]")
_DEVICE = re.compile(rb"(?:[0-7]{7}[ \0]|[0-7]{6} \0|\0{8}){2}")
#: A header without name and size, and the sum of its bytes, of which those of size and sum itself are left out.
_BLANK = tarfile.TarInfo("").tobuf()
_SUM = sum(_BLANK) - sum(_BLANK[124:135]) - sum(_BLANK[148:156]) + 8 * 32
_Entry = tuple[str, bool, int, "bytes | None", bool]


def _end(at: int, size: int) -> int:
    """Where the entry ends whose header is at ``at``."""
    return at + BLOCK + -(-size // BLOCK) * BLOCK


def _plain(header: bytes) -> tuple[str, int] | None:
    """Name and size of a regular file with a short ASCII name; None for every other header, those with a wrong sum among them."""
    if len(header) != BLOCK or header[156:157] != tarfile.REGTYPE or header[257:262] != b"ustar" or any(header[345:500]):
        return None
    name, numbers = _NAME.fullmatch(header, 0, 100), _NUMBERS.fullmatch(header, 100, 148)
    try:
        total = int(header[148:156].strip(b" \0"), 8)
    except ValueError:
        return None
    if not name or not numbers or not _DEVICE.fullmatch(header, 329, 345) or total != sum(header) - sum(header[148:156]) + 8 * 32:
        return None
    return name[1].decode("ascii"), int(numbers[1], 8)


def _pieces(file: BinaryIO, length: int) -> Iterator[tuple[int, int | None]]:
    """Start and end of pieces of whole entries. From the first entry that is not plain or not whole on, all is one piece, and its end None."""
    start = at = 0
    while True:
        file.seek(at)
        header = file.read(BLOCK)
        entry = _plain(header)
        whole = entry is not None and _end(at, entry[1]) <= length
        if start < at and (not whole or at - start >= PIECE):
            yield start, at
            start = at
        if not whole:
            if at == 0 or (header and any(header)):
                yield at, None
            return
        at = _end(at, entry[1])


def _plain_entries(file: BinaryIO, start: int, end: int) -> Iterator[_Entry]:
    file.seek(start)
    while start < end:
        entry = _plain(file.read(BLOCK))
        if entry is None:
            raise OSError("the archive has changed while it was read")
        name, size = entry
        payload = file.read(size) if size <= MAX_BYTES else None
        if payload is not None and len(payload) != size:
            raise OSError("the archive has changed while it was read")
        yield name, True, size, payload, True
        start = _end(start, size)
        file.seek(start)


def _entries(file: BinaryIO, mode: str) -> Iterator[_Entry]:
    """All that follows in an archive of any kind; the last one is not complete if it breaks off."""
    try:
        with tarfile.open(fileobj=file, mode=mode) as tar:
            for entry in tar:
                data = tar.extractfile(entry).read() if entry.isfile() and entry.size <= MAX_BYTES else None
                whole = data is None or len(data) == entry.size
                yield entry.name, entry.isfile(), entry.size, data if whole else None, whole
                if not whole:
                    break
    except (tarfile.ReadError, EOFError):
        yield "", False, 0, None, False


def _member_batches(where: str, entries: Iterator[_Entry]) -> Iterator[pa.RecordBatch]:
    rows: list[_Entry] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([where] * len(rows), *zip(*rows, strict=True)), _MEMBER_ARROW, strict=True)], schema=_MEMBER_ARROW)

    for entry in entries:
        rows.append(entry)
        held += len(entry[3] or b"")
        if len(rows) >= BATCH or held >= BATCH_BYTES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _local(where: str) -> str:
    """Mounted path of a file: address as Spark gives it, which is not quoted."""
    return re.sub("^file:/+", "/", where)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, regular, bytes, payload, complete of every entry; ``complete`` is false on an entry at which an archive breaks off.

    One task per archive goes over its headers and cuts it into pieces of whole entries, which are then read in tasks of their own; what
    follows an entry with extended headers is one piece. Archives in a store that is not mounted are streamed by one task each. Entries
    beyond the size limit come without payload.
    """
    files = spark.read.format("binaryFile").load(path)
    found = files.agg(F.sum("length").alias("length"), F.count_if(~F.col("path").startswith("file:")).alias("remote")).first()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, length in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
                with open(_local(where), "rb") as file:
                    starts, ends = zip(*_pieces(file, length), strict=True)
                yield pa.RecordBatch.from_pydict({"path": [where] * len(starts), "start": pa.array(starts, pa.int64()), "end": pa.array(ends, pa.int64())})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, start, end in zip(*[batch[c].to_pylist() for c in ("path", "start", "end")], strict=True):
                with open(_local(where), "rb") as file:
                    if end is None:
                        file.seek(start)
                    yield from _member_batches(where, _entries(file, "r:") if end is None else _plain_entries(file, start, end))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                yield from _member_batches(where, _entries(io.BytesIO(content), "r|"))

    if found["remote"]:
        return files.select("path", "content").mapInArrow(stream, _MEMBER)
    pieces = files.select("path", "length").mapInArrow(index, "path string, start long, end long")
    return pieces.repartition(-(-max(found["length"] or 0, 1) // PIECE)).mapInArrow(scan, _MEMBER)


def verified(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest (cache_name, bytes, sha256, ...) with payload; anything unexpected, missing or different is an error."""
    wanted = manifest.filter("coalesce(error, '') = ''")
    rows = members.select("name", "regular", F.col("bytes").alias("__bytes"), "payload", "complete")
    joined = wanted.join(rows, F.col("cache_name") == F.col("name"), "full")
    fault = (
        F.when(F.col("cache_name").isNull(), F.concat(F.lit("unexpected entry "), F.col("name")))
        .when(F.col("name").isNull(), F.concat(F.lit("missing entry "), F.col("cache_name")))
        .when(~F.col("regular") | ~F.col("complete") | F.col("payload").isNull() | ~is_cache_name(F.col("name")), F.concat(F.lit("bad entry "), F.col("name")))
        .when(F.col("__bytes") != F.col("bytes"), F.concat(F.lit("wrong size "), F.col("name")))
        .when(F.sha2("payload", 256) != F.col("sha256"), F.concat(F.lit("wrong content "), F.col("name")))
    )
    checked = cut(joined.select(*[wanted[c] for c in wanted.columns], "payload", fault.alias("__fault")))
    first = checked.filter("__fault is not null").select("__fault").limit(1).collect()
    if first:
        raise ValueError(first[0][0])
    return checked.select(*wanted.columns, "payload")


def recovered(members: DataFrame, manifest: DataFrame) -> DataFrame:
    """The entries of an interrupted archive that its manifest confirms, with payload; the rest is left out."""
    rows = members.filter(F.col("complete") & F.col("regular") & F.col("payload").isNotNull()).select("name", F.col("bytes").alias("__bytes"), "payload")
    good = (F.col("cache_name") == F.col("name")) & (F.col("__bytes") == F.col("bytes")) & (F.sha2("payload", 256) == F.col("sha256"))
    return manifest.join(rows, good).select(*manifest.columns, "payload")


def write_archives(clips: DataFrame, folder: str, parts: int, open_file: Callable[[str, str], object] = open) -> DataFrame:
    """Write clips (row_key, cache_name, source, error, payload) as ``parts`` archives with manifests; returns the manifest.

    A task writes to names of its own attempt and renames at the end, so a lost executor leaves no half archive under a final name.
    It stops the run as soon as hopeless() holds for its part, and at the end if every one of its clips has failed.
    """
    os.makedirs(folder, exist_ok=True)
    columns = ("row_key", "cache_name", "source", "error")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        stem = f"{folder}/audio-{part:05d}"
        seen: set[str] = set()
        done = failed = length = 0
        encode = json.JSONEncoder(ensure_ascii=False).encode
        with open_file(f"{stem}.tar.{attempt}", "wb") as raw, open_file(f"{stem}.jsonl.{attempt}", "w") as lines:
            for batch in batches:
                blocks, texts, sizes, sums = [], [], [], []
                for row_key, name, source, error, data in zip(*[batch[c].to_pylist() for c in (*columns, "payload")], strict=True):
                    size = digest = None
                    if not error and data is not None:
                        size, digest = len(data), hashlib.sha256(data).hexdigest()
                        if name not in seen:
                            blocks += (_header(name, size), data, bytes(-size % BLOCK))
                            seen.add(name)
                    else:
                        failed += 1
                    done += 1
                    sizes.append(size)
                    sums.append(digest)
                    texts.append(encode({"row_key": row_key, "cache_name": name, "source": source, "error": error, "bytes": size, "sha256": digest}) + "\n")
                    if hopeless(done, failed):
                        raise ValueError(f"{failed} of {done} clips failed")
                for block in blocks:
                    raw.write(block)
                length += sum(map(len, blocks))
                lines.write("".join(texts))
                if sizes:
                    yield pa.RecordBatch.from_arrays([*[batch[c].cast(pa.string()) for c in columns], pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array([part] * len(sizes), pa.int32())], schema=_MANIFEST_ARROW)
            raw.write(bytes(2 * BLOCK + -(length + 2 * BLOCK) % tarfile.RECORDSIZE))
        if done and failed == done:
            raise ValueError("every clip failed")
        os.replace(f"{stem}.tar.{attempt}", f"{stem}.tar")
        os.replace(f"{stem}.jsonl.{attempt}", f"{stem}.jsonl")

    done = clips.select(*columns, "payload").repartition(parts, "cache_name").mapInArrow(write, _MANIFEST)
    return cut(done)


def _header(name: str, size: int) -> bytes:
    """As tarfile writes it; names of cached clips are put into a header that is made once."""
    if len(name) > 100 or not name.isascii() or "\0" in name or size >= 8**11:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf()
    label, digits = name.encode(), b"%011o" % size
    total = _SUM + sum(label) + sum(digits)
    return b"".join((label, bytes(100 - len(label)), _BLANK[100:124], digits, _BLANK[135:148], b"%06o" % total, _BLANK[154:]))


def hopeless(done: int, failed: int, least: int = 64, share: float = 0.9) -> bool:
    """At least ``least`` done and more than ``share`` of them failed."""
    return done >= least and failed > share * done


def too_many_failures(manifest: DataFrame, least: int = 64, share: float = 0.9) -> bool:
    """At least ``least`` done and more than ``share`` of them failed, or all failed."""
    r = manifest.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("bad")).first()
    return r["n"] > 0 and (r["bad"] == r["n"] or hopeless(r["n"], r["bad"], least, share))


# What a training archive may hold, and the bounds of a clip in it.
TRAINING_FILES, TRAINING_AUDIO = ("train.jsonl", "validation.jsonl"), r"^audio/[^/]+\.wav$"
CLIP_SECONDS = (0.2, 20.2)


def training_members(members: DataFrame, sha256: str | None = None, archive_sha256: str | None = None) -> DataFrame:
    """members of a training archive; an entry that is not a manifest or a clip, not a regular file or not whole is an error.

    With both digests they must be equal, see tables.file_digests.
    """
    if sha256 is not None and sha256 != archive_sha256:
        raise ValueError("the archive is not the one of the manifest")
    known = F.col("name").isin(*TRAINING_FILES) | F.col("name").rlike(TRAINING_AUDIO)
    bad = members.filter(~known | ~F.col("regular") | ~F.col("complete")).select("name").limit(1).collect()
    if bad:
        raise ValueError(f"unexpected entry {bad[0][0]}")
    return members


def check_manifest(manifest: DataFrame, label: str, audio: DataFrame | None = None) -> DataFrame:
    """manifest (audio_filepath, duration, text, split), or an error: a duration outside 0.2 to 20.2 s, another split, a clip that is not in ``audio`` (name)."""
    low, high = CLIP_SECONDS
    fault = F.when(~F.coalesce(F.col("duration").between(low, high), F.lit(False)), F.lit("duration")).when(~F.col("split").eqNullSafe(label), F.lit("split"))
    checked = manifest.withColumn("__fault", fault)
    if audio is not None:
        there = audio.select(F.col("name").alias("audio_filepath")).distinct().withColumn("__there", F.lit(True))
        checked = checked.join(there, "audio_filepath", "left").withColumn("__fault", F.coalesce("__fault", F.when(F.col("__there").isNull(), F.lit("audio")))).drop("__there")
    bad = checked.filter("__fault is not null").select("__fault", "audio_filepath").limit(1).collect()
    if bad:
        raise ValueError(f"manifest entry {bad[0][1]}: {bad[0][0]}")
    return manifest
