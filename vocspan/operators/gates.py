"""Checks that stop a run."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspan.operators.shards import shard_rows


class GateError(ValueError):
    """A check did not hold."""


def gate(ok: bool, message: str) -> None:
    if not ok:
        raise GateError(message)


def none_match(df: DataFrame, bad: Column, message: str) -> None:
    """No row may match; stops at the first one."""
    gate(df.filter(bad).limit(1).isEmpty(), message)


def disjoint(a: DataFrame, b: DataFrame, key: str, message: str) -> None:
    """No key may be on both sides."""
    gate(a.select(key).join(b.select(key), key, "left_semi").limit(1).isEmpty(), message)


def same_keys(a: DataFrame, b: DataFrame, key: str, message: str) -> None:
    """Both sides must have the same keys."""
    gate(a.join(b, key, "left_anti").limit(1).isEmpty() and b.join(a, key, "left_anti").limit(1).isEmpty(), message)


def both_succeeded(rows: DataFrame, first: str, second: str) -> None:
    """Both models must have transcribed every row."""
    none_match(rows, (F.coalesce(F.col(first), F.lit("")) != "") | (F.coalesce(F.col(second), F.lit("")) != ""), "a model failed on a row")


def one_channel(rows: DataFrame, channel: str) -> None:
    """Every row must be of the channel."""
    none_match(rows, ~F.col("channel").eqNullSafe(channel), f"a row is not of channel {channel}")


def shards_complete(reports: list[dict], total: int) -> None:
    """Every shard once, no failures, equal source, path and model, and the closed form of its number of rows."""
    count = len(reports)
    gate(count > 0 and sorted(r["shard_index"] for r in reports) == list(range(count)), "every shard must be present once")
    for r in reports:
        gate(r.get("num_shards", count) == count, "reports disagree about the number of shards")
        gate(r.get("failed_transcriptions", 0) == 0, "a shard has failures")
        gate(r["rows_in_output"] == shard_rows(total, r["shard_index"], count), "a shard has a wrong number of rows")
    for name in ("source_sha256", "execution_path", "model_sha256"):
        gate(len({r.get(name) for r in reports}) == 1, f"shards disagree in {name}")


def same_config(stored: dict, wanted: dict) -> None:
    gate(stored == wanted, "the stored configuration differs from this run's")


def both_filled(counts: dict[str, int]) -> None:
    gate(all(counts.get(k, 0) > 0 for k in ("train", "validation")), "a split is empty")


def search_complete(report: dict, groups: int) -> None:
    gate(report["groups_total"] == report["groups_processed"] == groups, "the search is not complete")
    gate(not report.get("retryable_failures", 0), "failures can still be retried")


def fresh_target(source: str, target: str) -> None:
    gate(os.path.realpath(source) != os.path.realpath(target), "the target is the source")
    gate(not os.path.exists(target), "the target exists")
