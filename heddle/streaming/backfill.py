"""The backfill as a stream: new pending rows of a table are embedded once each and appended as updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from heddle.functions.models import Encoder, HashEncoder
from heddle.operators.backfill import embed_chunks, embed_rows


Step = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def _start(spark: SparkSession, source: str, schema: str, updates: str, rejected: str, checkpoint: str, step: Step) -> StreamingQuery:
    """Reads what is new under source, writes updates and rejected rows, and stops when all is read.

    Each batch writes to a folder of its number, in overwrite mode, so a batch that is run again after a failure
    replaces what it had written.
    """

    def batch(df: DataFrame, number: int) -> None:
        good, bad = step(df)
        good.write.mode("overwrite").parquet(f"{updates}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start(spark: SparkSession, source: str, schema: str, updates: str, rejected: str, checkpoint: str, make: Callable[[], Encoder] = HashEncoder, binding: str = "reference") -> StreamingQuery:
    """The backfill of rows with four vectors."""
    return _start(spark, source, schema, updates, rejected, checkpoint, lambda df: embed_rows(df, make, binding))


def start_chunks(spark: SparkSession, source: str, schema: str, updates: str, rejected: str, checkpoint: str, make: Callable[[], Encoder] = HashEncoder) -> StreamingQuery:
    """The backfill of chunks."""
    return _start(spark, source, schema, updates, rejected, checkpoint, lambda df: embed_chunks(df, make))
