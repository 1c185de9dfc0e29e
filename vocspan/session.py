"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


#: Files of a checkpoint are removed once nothing refers to it any more.
_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only where none is named (local tests) take a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vocspan-ckpt-"))
    if sc.getConf().get(_CLEAN) is None:  # read by Spark whenever something is checkpointed
        sc._jsc.sc().conf().set(_CLEAN, "true")


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for tables and files that a query writes and reads again. It must be a mounted one."""
    ensure_checkpoint_dir(spark)
    base = urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    if base.scheme not in ("", "file"):
        raise ValueError("files need a checkpoint folder that is mounted on all executors")
    folder = f"{unquote(base.path)}/scratch-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: it is computed once and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
