"""Scalar rules for times, durations, names and shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (exclusive) and labels of the duration buckets.
DURATION_BUCKETS = ((0.3, "<0.3"), (0.5, "0.3-0.5"), (1.0, "0.5-1"), (5.0, "1-5"), (10.0, "5-10"), (15.0, "10-15"), (20.0, "15-20"), (None, ">=20"))
SLICE_BUCKETS = ((2.0, "<2s"), (5.0, "2-5s"), (10.0, "5-10s"), (None, ">=10s"))


def seconds(value: Column) -> Column:
    """A plain decimal number of seconds; NULL for anything else, not-a-number and the infinities."""
    number = F.trim(value).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def is_interval(start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (start < end), F.lit(False))


def bucket(value: Column, buckets: tuple[tuple[float | None, str], ...]) -> Column:
    """Label of the first bound above the value."""
    out = F.lit(buckets[-1][1])
    for bound, label in reversed(buckets[:-1]):
        out = F.when(value < bound, F.lit(label)).otherwise(out)
    return out


def video_key(file: Column) -> Column:
    """Second of three parts between double hyphens, else the name without its annotation suffix."""
    parts = F.split(file, "--", 3)
    return F.when(F.size(parts) == 3, F.get(parts, F.lit(1))).otherwise(F.regexp_replace(file, r"\.TextGrid$", ""))


def video_identity(file: Column) -> tuple[Column, Column]:
    """(id, title) of a name in the full form, NULL otherwise."""
    # Fixed value: the full form of a name.
    form = r"^\p{Nd}{8}--([A-Za-z0-9_-]{11})--([^\n]+)\.TextGrid$"
    good = file.rlike(form)
    return F.when(good, F.regexp_extract(file, form, 1)), F.when(good, F.regexp_extract(file, form, 2))


def hash_share(seed: Column | str, key: Column) -> Column:
    """A number from 0 to 1 (exclusive) out of the first 64 bits of the SHA-256 of 'seed/key'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}/"), key), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)
