"""Speaker labels in many spellings to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspan.functions.text import once

#: speaker_3, Speaker #3, [SPEAKER_03], SPK03, spk_3, S03, Speaker-03, SPEAKER_03:
SPEAKER_LABEL = r"^(?i)[\s\p{Z}\[<(>]*(?:speaker|spkr|spk|s)[\s\p{Z}_#.-]*(\d{1,9})[\s\p{Z}\])>:-]*$"
#: The form that comes out.
CLEAN_LABEL = r"^SPEAKER_(\d{2}|[1-9]\d{2,8})$"
#: Values that stand for no label.
MISSING = ("", "nan", "none", "null", "unknown", "n/a")


def clean_speaker(label: Column) -> Column:
    """SPEAKER_00 (two digits, three from 100 on); NULL when missing; a label of another form is kept, trimmed and in capitals."""
    raw = label.cast("string")

    def read(text: Column) -> Column:
        number = F.regexp_extract(text, SPEAKER_LABEL, 1).try_cast("long").cast("string")
        padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
        return F.when(F.lower(text).isin(*MISSING), F.lit(None).cast("string")).when(number.isNotNull(), F.concat(F.lit("SPEAKER_"), padded)).otherwise(F.upper(text))

    return F.when(raw.rlike(CLEAN_LABEL), raw).when(raw.isNotNull(), once(F.regexp_replace(raw, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""), read))
