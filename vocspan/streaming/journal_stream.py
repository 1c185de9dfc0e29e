"""A stream of attempts kept as a keyed table: every key once, retried until it succeeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vocspan.operators.journal import latest
from vocspan.sources.sinks import upsert_table

ATTEMPTS = "seq long, row_key string, generated_text string, duration_seconds double, error string"


def attempts(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of new files of attempts."""
    return spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def keep_journal(stream: DataFrame, table: str, checkpoint: str, key: str = "row_key", order: str = "seq") -> StreamingQuery:
    """Start the upsert of every micro-batch. A batch is reduced to one attempt per key before it meets the table; a batch that
    is repeated after a failure leaves the table as it was, since attempts have an order."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert_table(latest(batch, key, order).select(batch.columns), table, key, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
