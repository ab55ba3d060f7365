"""Incremental runs: pick up new event files, skip events already stored, append the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from spanwave.sinks import tables


def process_new_events(
    spark: SparkSession,
    source: str,
    schema: StructType,
    sink: str,
    checkpoint: str,
    build: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Work through the event files that arrived since the last run and stop.

    The source checkpoint skips files, and each batch leaves out events whose id the sink's ledger
    holds, so a repeated file or a batch retried after a failure adds nothing twice; what a failed
    batch wrote is removed first.
    """

    def handle(batch: DataFrame, _: int) -> None:
        tables.append_unprocessed(batch.dropDuplicates(["event_id"]), build, sink)

    stream = spark.readStream.schema(schema).parquet(source)
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
