"""Writers: one atomic CSV file, JSON lines, one folder per split, reports, titles and a keyed table."""

from __future__ import annotations

import json
import os
import shutil
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspan.operators.journal import upsert
from vocspan.session import cut


def _publish(df_writer, folder: str, target: str, suffix: str) -> None:  # noqa: ANN001
    """Write one part into a folder beside the target and rename it into place."""
    staging = f"{os.path.dirname(os.path.abspath(target))}/.{os.path.basename(target)}.{uuid.uuid4().hex}"
    try:
        df_writer(staging)
        parts = [f for f in os.listdir(staging) if f.startswith("part-") and f.endswith(suffix)]
        if len(parts) != 1:
            raise ValueError(f"expected one part, found {len(parts)}")
        os.replace(f"{staging}/{parts[0]}", target)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def write_csv(df: DataFrame, target: str, order: str, base: list[str], extra: list[str]) -> None:
    """One CSV file in the given order: base columns, then extra ones without repeats; NULL becomes empty. For results that fit one file."""
    names = [*base, *[c for c in extra if c not in base]]
    one = df.orderBy(order).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names]).coalesce(1)
    _publish(lambda folder: one.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder), "", target, ".csv")


def write_jsonl(df: DataFrame, folder: str) -> None:
    """JSON lines with NULL fields kept, one file per task; an existing folder is an error."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(folder)


def write_by(df: DataFrame, folder: str, column: str) -> None:
    """One folder per value, written in one pass; later reads of a value touch its folder only."""
    df.write.mode("errorifexists").partitionBy(column).parquet(folder)


def write_titles(titles: DataFrame, folder: str) -> None:
    """Sorted distinct titles, one per line."""
    titles.select("title").distinct().orderBy("title").write.mode("errorifexists").text(folder)


def write_report(report: dict, target: str) -> None:
    """A JSON object with an indent of two, put in place at once."""
    temporary = f"{target}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as out:
        json.dump(report, out, indent=2, ensure_ascii=False)
    os.replace(temporary, target)


def report_of(row: DataFrame) -> dict:
    """The only row of an aggregate as a dictionary."""
    first = row.limit(2).collect()
    if len(first) != 1:
        raise ValueError("a report needs exactly one row")
    return first[0].asDict(recursive=True)


def counter(df: DataFrame, key: str, value: str) -> dict:
    """A small aggregate as a mapping, keys in order; more than 10,000 keys are an error."""
    rows = df.select(key, value).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("too many keys for a report")
    return {r[0]: r[1] for r in sorted(rows, key=lambda r: str(r[0]))}


def summary_text(report: dict) -> str:
    """Lines 'name: value' of a flat report."""
    return "\n".join(f"{k}: {v}" for k, v in report.items()) + "\n"


def append_progress(record: dict, target: str) -> None:
    """One line of JSON at the end of a file, complete or not at all."""
    line = json.dumps(record, ensure_ascii=False) + "\n"
    with open(target, "ab", buffering=0) as out:
        out.write(line.encode())
        os.fsync(out.fileno())


def write_npz(arrays: dict[str, np.ndarray], target: str) -> None:
    """A NumPy archive of named arrays, without pickled content, put in place at once."""
    if any(np.asarray(a).dtype.hasobject for a in arrays.values()):
        raise ValueError("arrays of objects would need pickle")
    temporary = f"{target}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as out:
        np.savez(out, **arrays)
    os.replace(temporary, target)


BUCKETS = 64


def _current(folder: str) -> dict:
    """The generation of every bucket, and generations that the version before it still names."""
    pointer = f"{folder}/CURRENT"
    if not os.path.exists(pointer):
        return {"buckets": {}, "before": []}
    with open(pointer) as f:
        return json.load(f)


def upsert_table(news: DataFrame, folder: str, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Keyed table in a folder: the last version of each key.

    Keys are spread over buckets by hash, and only the buckets that have news are written again, as a new generation; a pointer file
    then names the generation of every bucket at once. What the version before it named stays until the next upsert, for readers
    that have just begun.
    """
    spark = news.sparkSession
    os.makedirs(folder, exist_ok=True)
    now = _current(folder)
    count = now.get("count", buckets)
    news = cut(news.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(count))))
    touched = sorted(r[0] for r in news.select("__bucket").distinct().collect())
    old = [f"{folder}/{now['buckets'][str(b)]}/__bucket={b}" for b in touched if str(b) in now["buckets"]]
    names = [c for c in news.columns if c != "__bucket"]
    before = spark.read.parquet(*old).select(*names) if old else news.limit(0).select(*names)
    merged = upsert(before, news.select(*names), key, order).select(*names).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(count)))
    new = f"v-{uuid.uuid4().hex}"
    merged.repartition(max(1, len(touched)), "__bucket").write.partitionBy("__bucket").parquet(f"{folder}/{new}")
    after = now["buckets"] | {str(b): new for b in touched}
    pointer = f"{folder}/CURRENT"
    with open(f"{pointer}.{new}", "w") as out:
        json.dump({"count": count, "buckets": after, "before": sorted(set(now["buckets"].values()))}, out)
    os.replace(f"{pointer}.{new}", pointer)
    for stale in set(now["before"]) - set(after.values()) - set(now["buckets"].values()):
        shutil.rmtree(f"{folder}/{stale}", ignore_errors=True)


def read_table(spark, folder: str) -> DataFrame:  # noqa: ANN001
    return spark.read.parquet(*[f"{folder}/{g}/__bucket={b}" for b, g in sorted(_current(folder)["buckets"].items())])
