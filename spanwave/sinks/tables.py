"""Stage tables, exports and incremental appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwave import schema
from spanwave.functions import times
from spanwave.operators import events, joins
from spanwave.sinks import ledger

PARTITIONS = ("set_name", "deck")
ROWS_PER_FILE = 20_000_000


def write_partitioned(df: DataFrame, path: str, partitions: Sequence[str] = PARTITIONS) -> None:
    """Replace the (set, deck) partitions that ``df`` holds and leave all others.

    The rebalance hint lets adaptive execution split a partition that holds much of the data and
    merge small ones, so neither one task nor a flood of files results.
    """
    (
        df.hint("rebalance", *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(*partitions)
        .parquet(path)
    )


def write_set(path: str, *, records: DataFrame, found: DataFrame, event_sensors: DataFrame) -> None:
    """Write the record, event and event-sensor tables of the sets in hand."""
    write_partitioned(records, f"{path}/sensor_records")
    write_partitioned(schema.conform(found, schema.EVENTS), f"{path}/events")
    write_partitioned(schema.conform(event_sensors, schema.EVENT_SENSORS), f"{path}/event_sensors")


def write_aligned_samples(samples: DataFrame, path: str) -> None:
    """Write aligned samples in single precision, sorted for range skipping by event and sensor."""
    stored = samples.select(
        "event_id",
        "set_name",
        "deck",
        "sensor_name",
        "sample_index",
        "timestamp_utc",
        F.col("value").cast("float").alias("value"),
    )
    spread = stored.hint("rebalance", "set_name", "deck", "event_id")
    (
        spread.sortWithinPartitions("set_name", "deck", "event_id", "sensor_name", "sample_index")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def read_aligned_samples(
    spark: SparkSession,
    path: str,
    *,
    set_name: str | None = None,
    deck: str | None = None,
    sensor_names: Sequence[str] | None = None,
    event_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Aligned samples without gaps; every given choice prunes partitions or row groups."""
    rows = spark.read.schema(schema.STORED_SAMPLES).parquet(path)
    for column, wanted in (("set_name", set_name), ("deck", deck)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    for column, several in (("sensor_name", sensor_names), ("event_id", event_ids)):
        if several is not None:
            rows = rows.filter(F.col(column).isin(list(several)))
    value = F.col("value").cast("double")
    return rows.withColumn("value", value).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def append_new_sensors(incoming: DataFrame, path: str) -> None:
    """Add sensors the stored dimension lacks; stored ones stay as they are."""
    spark = incoming.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as missing:  # the dimension does not exist yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored = spark.createDataFrame([], schema.SENSORS)
    events.new_sensors(incoming, stored).coalesce(1).write.mode("append").parquet(path)


def append_unprocessed(found: DataFrame, build, path: str) -> int:
    """Run ``build`` on the events that ``path`` does not hold yet and append its rows as one batch.

    The ledger beside the rows tells what is held; see ``ledger``. Returns the number of new events.
    """
    return ledger.Ledger(found.sparkSession, path).append(found, build)


def export_samples_csv(samples: DataFrame, sensors: Sequence[str], path: str, *, compressed: bool = True) -> None:
    """Wide aligned samples as CSV per (set, deck), gzip by default."""
    wide = joins.to_wide(samples, [*PARTITIONS, "event_id", "sample_index", "timestamp_utc"], sensors)
    writer = (
        wide.withColumn("timestamp_utc", times.iso_millis(F.col("timestamp_utc")))
        .sortWithinPartitions("event_id", "sample_index")
        .write.mode("overwrite")
        .option("header", True)
        .partitionBy(*PARTITIONS)
    )
    writer.option("compression", "gzip" if compressed else "none").csv(path)


def export_event_csv(samples: DataFrame, event_id: str, sensors: Sequence[str], path: str) -> None:
    """One aligned event as wide CSV with millisecond times, in sample order."""
    one = samples.filter(F.col("event_id") == event_id)
    wide = joins.to_wide(one, ["sample_index", "timestamp_utc"], sensors)
    ordered = wide.orderBy("sample_index").withColumn("timestamp_utc", times.iso_millis(F.col("timestamp_utc")))
    ordered.drop("sample_index").write.mode("overwrite").option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str, *, form: str = "parquet") -> None:
    """Write each table under its name: feature tables, tensors, bundles (``json``), errors (``csv``)."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if form == "csv":
            writer = writer.option("header", True)
        writer.format(form).save(f"{path}/{name}")


def read_feature_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stored feature tables in their reading order."""
    # Sort keys of each table.
    order = {
        "sensor_event_features": ("set_name", "deck", "event_id", "sensor_order"),
        "deck_modal_peaks": ("set_name", "deck", "feature_family", "peak_rank"),
        "deck_mode_shape_components": ("set_name", "deck", "peak_rank", "sensor_name"),
        "feature_family_status": ("set_name", "deck", "feature_family"),
    }
    return {name: spark.read.parquet(f"{path}/{name}").orderBy(*keys) for name, keys in order.items()}
