"""Sensor-shaped views over the bundled benchmark tables.

``events`` plays the raw readings, ``embeddings`` the packaged tensor rows. Each view is a pure
projection or aggregation of its table, so its size follows the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwave.functions import naming, times
from spanwave.operators import sequence

WINDOW_SECONDS = 6 * 3600
TILE_SECONDS = 3600

# Which sensor each kind of reading stands for.
SENSOR_SUFFIX = {
    "click": "MID_ACC_Z",
    "view": "MID_ACC_Y",
    "purchase": "INF_STR",
    "signup": "SUP_STR",
    "error": "SHE_STR",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sensor_suffix(kind: Column) -> Column:
    suffix = F
    for value, text in SENSOR_SUFFIX.items():
        suffix = suffix.when(kind == value, F.lit(text))
    return suffix


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sample: sensor, set, raw file, recording window, time, value, temperature."""
    ts = F.col("ts").cast("timestamp")
    user = F.col("user_id")
    deck = F.when(user % 2 == 0, F.lit("OLD")).otherwise(F.lit("NEW"))
    span = F.when(F.floor(user / 2) % 2 == 0, F.lit("S1")).otherwise(F.lit("S2"))
    set_no = F.floor(F.datediff(ts, F.lit("2024-01-01").cast("date")) / 6) + 1
    sensor = F.concat_ws("_", deck, span, F.lit("DO"), _sensor_suffix(F.col("event_type")))
    return (
        read_table(spark, folder, "events")
        .select(
            F.col("event_id").alias("reading_id"),
            F.concat(F.lit("SPAN_SET"), set_no, F.lit("_2024_01")).alias("set_name"),
            deck.alias("deck"),
            sensor.alias("sensor_name"),
            ts.alias("timestamp_utc"),
            F.col("value"),
            F.get_json_object("props", "$.k").try_cast("double").alias("temperature"),
            times.floor_time(ts, WINDOW_SECONDS).alias("window_start"),
            times.time_tile(ts, TILE_SECONDS).alias("tile"),
        )
        .withColumn("raw_file", F.concat_ws("_", "sensor_name", F.date_format("timestamp_utc", "yyyyMMdd")))
    )


def raw_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as rows of raw day files, numbered from 1 inside each file."""
    return number_rows(readings(spark, folder))


def number_rows(rows: DataFrame, **options) -> DataFrame:
    """Whole files of the readings, numbered from 1 inside each file; ``options`` as for ``sequence.ordinal``."""
    numbered = sequence.ordinal(
        rows,
        ["set_name", "sensor_name", "raw_file"],
        ["timestamp_utc", "reading_id"],
        "tile",
        "row_1based",
        **options,
    )
    return numbered.withColumn("row_1based", F.col("row_1based") + 1)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The index table: one row per sensor and recording window, pointing into a raw file.

    Row ranges come from per-window counts, so no row-level ordering is needed; a sensor has at
    most 24 windows in a six-day set, so the windows below are short at any data size.
    """
    first = F.struct("timestamp_utc", "reading_id")
    keys = ["set_name", "deck", "sensor_name", "raw_file", "window_start"]
    per_window = readings(spark, folder).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("timestamp_utc").alias("end_time_utc"),
        F.min_by("value", first).alias("start_value"),
        F.max_by("value", first).alias("end_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("mean_value"),
        F.avg("temperature").alias("temperature"),
    )
    in_set = Window.partitionBy("set_name", "sensor_name").orderBy("window_start")
    in_file = Window.partitionBy("set_name", "sensor_name", "raw_file").orderBy("window_start")
    end_row = F.sum("n").over(in_file)
    return per_window.withColumn("record_uid", (F.row_number().over(in_set) * 10 + 1000).cast("bigint")).select(
        "set_name",
        "deck",
        "sensor_name",
        "raw_file",
        "record_uid",
        (end_row - F.col("n") + 1).alias("start_row_1based"),
        end_row.alias("end_row_1based"),
        F.col("window_start").alias("start_time_utc"),
        "end_time_utc",
        # Whole milliseconds, the precision of stored times.
        (F.floor((F.unix_micros("end_time_utc") - F.unix_micros("window_start")) / 1000) / 1000).alias("duration"),
        "start_value",
        "end_value",
        (F.col("end_value") - F.col("start_value")).alias("diff_value"),
        "min_value",
        "max_value",
        "mean_value",
        (F.col("max_value") - F.col("min_value")).alias("range_value"),
        "temperature",
    )


def waveforms(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as per-event sensor waveforms with a 0-based sample index."""
    rows = readings(spark, folder).withColumn(
        "event_id",
        F.concat_ws("__", "set_name", "deck", naming.event_time_token(F.col("window_start"))),
    )
    return sequence.ordinal(
        rows, ["event_id", "sensor_name"], ["timestamp_utc", "reading_id"], "tile", "sample_index"
    ).select(
        "event_id",
        "set_name",
        "deck",
        "window_start",
        "sensor_name",
        "reading_id",
        "tile",
        "sample_index",
        "timestamp_utc",
        "value",
        "temperature",
    )


def tensors(spark: SparkSession, folder: str) -> DataFrame:
    """Packaged tensor rows: one per event, with its set and its 64 values."""
    return read_table(spark, folder, "embeddings").select(
        F.format_string("SPAN_SET%d_2024_01__OLD__%08d", F.col("label") + 1, "vec_id").alias("event_id"),
        F.concat(F.lit("SPAN_SET"), F.col("label") + 1, F.lit("_2024_01")).alias("set_name"),
        F.col("vec_id"),
        F.col("embedding").cast("array<double>").alias("values"),
    )


def tensor_values(spark: SparkSession, folder: str) -> DataFrame:
    """Tensor rows exploded: position 0..63, channel of 8 positions each, place in the channel."""
    return tensors(spark, folder).select(
        "event_id", "set_name", "vec_id", F.posexplode("values").alias("position", "value")
    ).withColumns(
        {
            "channel": F.floor(F.col("position") / 8).cast("int"),
            "place": F.pmod(F.col("position"), F.lit(8)),
        }
    )
