"""Annotated times: text in several notations to exact milliseconds, without a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspan.functions.text import once

#: White space of any kind around a value, and the decimal comma.
_SPACE = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
_NUMBER = r"^[+-]?(\d+[.,]?\d*|[.,]\d+)([eE][+-]?\d{1,3})?$"
_CLOCK = r"^\+?(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:[.,]\d*)?)$"
_DEC = "decimal(30,9)"


def parse_ms(value: Column) -> Column:
    """Milliseconds of seconds (1.5, +1.5, 15e-1, 1,5) or h:mm:ss; NULL when it is missing, not a finite number or negative.

    Decimal arithmetic keeps the result exact; fractions below a millisecond are rounded half up. -0 counts as 0.
    """
    raw = value.cast("string")

    def read(text: Column) -> Column:
        hours = F.coalesce(F.regexp_extract(text, _CLOCK, 1).try_cast("long"), F.lit(0))
        minutes = F.regexp_extract(text, _CLOCK, 2).try_cast("long")
        rest = F.regexp_replace(F.regexp_extract(text, _CLOCK, 3), ",", ".").try_cast(_DEC)
        clock = F.when((minutes < 60) & (rest < 60), (hours * 3600 + minutes * 60).cast("decimal(20,0)") + rest)
        return F.when(text.rlike(_CLOCK), clock).when(text.rlike(_NUMBER), F.regexp_replace(text, ",", ".").try_cast(_DEC))

    # Most values are plain numbers, and for those the patterns are not looked at.
    slow = F.when(raw.rlike(r"\d"), once(F.regexp_replace(raw, _SPACE, ""), read))
    seconds = F.coalesce(raw.try_cast(_DEC), slow)
    return F.when(seconds >= 0, F.round(seconds * 1000, 0).cast("long"))


def valid_interval(start_ms: Column, end_ms: Column) -> Column:
    """Both known and 0 <= start < end."""
    return start_ms.isNotNull() & end_ms.isNotNull() & (start_ms < end_ms)
