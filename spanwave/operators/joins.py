"""Record-to-sample, as-of and positional joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwave.functions import times
from spanwave.operators import events, sequence

ROWS_PER_BLOCK = 4096


def slice_records(
    records: DataFrame, samples: DataFrame, *, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Join records to their 1-based inclusive row range of a raw file.

    Both sides meet on (set, sensor, file, block of rows), so a file is split over many tasks and
    a sample is compared only with the records that touch its block.
    """
    block = lambda c: F.floor((F.col(c) - 1) / F.lit(rows_per_block))
    keys = ["set_name", "sensor_name", "raw_file", "_block"]
    pieces = records.withColumn(
        "_block", F.explode(F.sequence(block("start_row_1based"), block("end_row_1based")))
    )
    rows = samples.select(
        "set_name", "sensor_name", "raw_file", "row_1based", "timestamp_utc", "value"
    ).withColumn("_block", block("row_1based"))
    inside = F.col("row_1based").between(F.col("start_row_1based"), F.col("end_row_1based"))
    return pieces.join(rows, keys).filter(inside).drop("_block")


def drop_unparsed(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("timestamp_utc").isNotNull())


def unparsed_counts(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows of each group have no usable timestamp."""
    return samples.groupBy(*keys).agg(
        F.count_if(F.col("timestamp_utc").isNull()).alias("dropped_rows"),
        F.count(F.lit(1)).alias("row_count"),
    )


def in_table_order(records: DataFrame) -> list[str]:
    """Columns that give the order of a sensor's index table."""
    if "table_row" in records.columns:
        return ["table_row"]
    return ["start_time_utc", "raw_file", "start_row_1based"]


def kth_records(records: DataFrame, k: int = 0) -> DataFrame:
    """The record at 0-based place ``k`` of every sensor's index table; shorter sensors are left out."""
    table = Window.partitionBy("set_name", "sensor_name").orderBy(*in_table_order(records))
    return records.withColumn("_place", F.row_number().over(table)).filter(F.col("_place") == k + 1).drop("_place")


def first_of(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first record of each key in the order of the index table."""
    table = Window.partitionBy(*keys).orderBy(*in_table_order(records))
    return records.withColumn("_place", F.row_number().over(table)).filter("_place = 1").drop("_place")


def read_record(
    records: DataFrame,
    samples: DataFrame,
    sensor_name: str,
    *,
    set_name: str | None = None,
    record_uid: int | None = None,
    place: int = 0,
) -> DataFrame:
    """The rows of one record of a sensor, by its UID or else by its 0-based place in the index table.

    A UID that occurs more than once means its first record; a record that is absent is a
    ``LookupError``.
    """
    own = records.filter(F.col("sensor_name") == sensor_name)
    own = own if set_name is None else own.filter(F.col("set_name") == set_name)
    wanted = own if record_uid is None else own.filter(F.col("record_uid") == record_uid)
    chosen = kth_records(wanted, place if record_uid is None else 0)
    if chosen.isEmpty():
        what = f"UID {record_uid}" if record_uid is not None else f"place {place}"
        raise LookupError(f"{sensor_name} has no record of {what}")
    return slice_records(chosen, samples)


def records_around(records: DataFrame, timestamp: str, **selection) -> DataFrame:
    """Every selected sensor with the collapsed record strictly around ``timestamp``, if it has one."""
    selected = events.filter_records(records, **selection)
    at = times.parse_utc(F.lit(timestamp))
    hits = selected.filter((F.col("start_time_utc") < at) & (F.col("end_time_utc") > at))
    collapsed = events.collapse_records(hits, ["set_name", "sensor_name"]).drop("sensor_order", "deck")
    sensors = selected.select("set_name", "deck", "sensor_name", "sensor_order").distinct()
    return sensors.join(collapsed, ["set_name", "sensor_name"], "left")


def load_events(records: DataFrame, requests: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Load any number of events at once: the sensors of each request with their records, and their waveforms.

    ``requests`` are as for ``events.resolve_event_records``, and may hold ``sensors``, the names to load; NULL
    loads all that are found. Several records of a sensor are widened into one.

    The first table has one row per (request, sensor) with its record, the number of its files, the rows
    kept and the rows dropped for want of a usable time; a sensor spread over files cannot be cut out and
    keeps none. A request that nothing matches has no row. The second table holds the kept rows.
    """
    keys = ["request_id", "sensor_name"]
    found = events.resolve_event_records(records, requests.drop("sensors"))
    if "sensors" in requests.columns:
        named = requests.select("request_id", F.col("sensors").alias("_wanted"))
        listed = F.col("_wanted").isNull() | F.array_contains("_wanted", F.col("sensor_name"))
        found = found.join(named, "request_id").filter(listed).drop("_wanted")
    collapsed = events.collapse_records(found, keys)
    rows = slice_records(collapsed.filter("raw_file_count = 1"), samples)
    counts = rows.groupBy(*keys).agg(
        F.count("timestamp_utc").alias("row_count"), F.count_if(F.col("timestamp_utc").isNull()).alias("dropped_rows")
    )
    sensors = collapsed.join(counts, keys, "left").fillna(0, ["row_count", "dropped_rows"])
    return sensors, drop_unparsed(rows)


def asof_backward(
    reference: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    *,
    tile: str = "tile",
    time: str = "timestamp_utc",
    position: str = "sample_index",
) -> DataFrame:
    """For each target row the 1-based place of the latest reference row at or before it, else 0.

    Of reference rows with one timestamp the last counts; places are those of the reference as
    given, so it need not be sorted. Both sides need ``keys``, ``tile``, ``time``, ``position``.
    """
    marked = reference.select(
        *keys, tile, time, position, F.lit(0).alias("_side"), (F.col(position) + 1).alias("_place")
    )
    probes = target.withColumns({"_side": F.lit(1), "_place": F.lit(None).cast("bigint")})
    both = probes.unionByName(marked, allowMissingColumns=True)
    filled = sequence.fill_forward(
        both, keys, [time, "_side", position], tile, {"reference_index": F.col("_place")}
    )
    return (
        filled.filter(F.col("_side") == 1)
        .withColumn("reference_index", F.coalesce("reference_index", F.lit(0)).cast("bigint"))
        .drop("_side", "_place")
    )


def shortest_sensors(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the shortest sensor of each event."""
    lengths = samples.groupBy(*keys, "sensor_name").agg(F.count(F.lit(1)).alias("_n"))
    return lengths.groupBy(*keys).agg(F.min("_n").alias("_n"))


def positional_rows(samples: DataFrame, keys: Sequence[str], *, shortest: DataFrame | None = None) -> DataFrame:
    """Sensors of an event side by side by sample index, cut to the shortest sensor.

    ``shortest`` are the lengths to cut to, as from :func:`shortest_sensors`, if they are known.
    """
    shortest = shortest_sensors(samples, keys) if shortest is None else shortest
    return samples.join(shortest, list(keys)).filter(F.col("sample_index") < F.col("_n")).drop("_n")


def to_wide(samples: DataFrame, keys: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """One column per requested sensor, in the order given; an absent sensor is all NULL."""
    picked = [
        F.max(F.when(F.col("sensor_name") == s, F.col("value"))).alias(s) for s in sensors
    ]
    return samples.groupBy(*keys).agg(*picked)


def to_long(wide: DataFrame, keys: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """The reverse of :func:`to_wide`; missing values are dropped."""
    return wide.unpivot(list(keys), list(sensors), "sensor_name", "value").filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on every column name the two sides share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no common columns to join on")
    return left.join(right, shared)
