"""Readers of segments, journals, scores and vectors in the forms they come in."""

from __future__ import annotations

import hashlib
import io
import sqlite3
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from vocspan.operators.shards import with_position

REQUIRED = ("channel", "file", "speaker", "start_time", "end_time", "text", "audio")


def read_segments(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A CSV file with a header, quoted line breaks and perhaps a byte order mark; every column is text, missing is empty.

    ``source_row`` is the position in the file. Such a file cannot be split, so it is read once; store it as parquet for
    every further use.
    """
    # Only the first line is looked at here.
    header = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").option("inferSchema", False).csv(path)
    names = [c.lstrip("﻿") for c in header.columns]
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = header.toDF(*names).na.fill("")
    # Within one unsplit file this number rises in the order of the file.
    return with_position(rows.withColumn("__order", F.monotonically_increasing_id()), "__order", "source_row").drop("__order")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines, plain or gzip; blank lines are skipped and any other bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_torn_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of an interrupted writer: a bad last line is dropped, a bad line anywhere else is an error."""
    fields = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    checked = StructType([*fields.fields, StructField("_bad", StringType())])
    lines = with_position(spark.read.text(path).withColumn("__order", F.monotonically_increasing_id()), "__order", "line").filter(F.trim("value") != "")
    parsed = lines.withColumn("x", F.from_json("value", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = parsed.filter(F.col("x").isNull() | F.col("x._bad").isNotNull())
    last = lines.agg(F.max("line")).first()[0]
    if not bad.filter(F.col("line") != F.lit(last)).limit(1).isEmpty():
        raise ValueError("a line before the last one is damaged")
    return parsed.filter(F.col("x").isNotNull() & F.col("x._bad").isNull()).select([F.col(f"x.{f.name}").alias(f.name) for f in fields.fields])


class _Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Read-only table of an SQLite file, cut into ranges of its row ids.

    Options: path, table, partitions. The schema must be given. Every task opens the file itself, so it lies where all executors see it.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 8))
        self.columns = [f.name for f in schema.fields]

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(Path(self.path).resolve().as_uri() + "?mode=ro", uri=True)

    def _name(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {self._name(self.table)}").fetchone()
        if low is None:
            return [_Rows(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Rows(at, min(at + step, high + 1)) for at in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[tuple]:
        with self._open() as db:
            names = ", ".join(self._name(c) for c in self.columns)
            yield from db.execute(f"select {names} from {self._name(self.table)} where rowid >= ? and rowid < ?", (partition.low, partition.high))


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").schema(schema).options(path=path, table=table, partitions=partitions).load()


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """array, row, vector of every matrix or vector in NumPy archives; pickled content is refused."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as data:
                    for name in data.files:
                        rows = np.atleast_2d(data[name]).astype("float64")
                        yield pd.DataFrame({"array": name, "row": np.arange(len(rows)), "vector": list(rows)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "array string, row long, vector array<double>")


def vector_of_blob(blob: Column) -> Column:
    """32-bit little-endian floats of a binary column as an array."""

    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: np.frombuffer(b, "<f4"), na_action="ignore")

    return decode(blob)


def read_document(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """One row per file that holds one JSON object over many lines; a damaged file is an error."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def file_digests(spark: SparkSession, path: str, block: int = 1 << 22) -> DataFrame:
    """path, bytes, sha256 of files. Only names and lengths are listed by Spark; a task reads its files block by block, so files may be
    larger than memory. Paths are local or on a mounted folder."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = []
            for p in pdf["path"]:
                h = hashlib.sha256()
                with open(unquote(urlparse(p).path), "rb") as f:
                    while data := f.read(block):
                        h.update(data)
                sums.append(h.hexdigest())
            yield pdf.assign(sha256=sums)

    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    return listed.mapInPandas(digest, "path string, bytes long, sha256 string")
