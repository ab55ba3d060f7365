"""Multi-sensor alignment by shrinking a reference clock, with no interpolation.

The first sensor of an event lends its timestamps. Sensor by sensor, a reference row survives
only if the sensor has a sample at or after it and before the next surviving row; each surviving
row finally takes every sensor's first sample at or after it. Samples are taken in time order.

The literal procedure walks one event at a time. Here it is three set-wise steps:

1. every reference row gets, per sensor, its first sample at or after it (a backward fill over
   tiles);
2. inside each (event, tile) rows are kept or dropped level by level wherever the answer cannot
   depend on later tiles - in practice all but the last rows of a tile;
3. the undecided rows meet, per event, one marker row per tile that carries the first surviving
   row of that tile at each level.

No task ever holds more than a tile of samples or a per-tile summary of an event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwave.functions import times
from spanwave.operators import conditioning, joins, sequence
from spanwave.session import cut_lineage

KEY = "event_id"


def add_slots(event_sensors: DataFrame) -> DataFrame:
    """Number the sensors of each event from 0 in sensor order; slot 0 is the reference."""
    in_order = Window.partitionBy(KEY).orderBy("sensor_order", "sensor_name")
    return event_sensors.withColumn("slot", F.row_number().over(in_order) - 1)


def align(samples: DataFrame, slots: int, *, tile: str = "tile") -> DataFrame:
    """Align the events in ``samples`` (``event_id, slot, tile, timestamp_utc, sample_index, value``).

    ``slots`` bounds the sensors per event and comes from the sensor dimension; a slot outside it
    fails the job. One row per
    surviving reference row: ``event_id, tile, timestamp_utc, sample_index`` (of the reference)
    and ``values``, an array by slot that is NULL where the event lacks the slot.
    """
    outside = F.raise_error(F.concat(F.lit(f"more than {slots} sensors in event "), F.col(KEY)))
    bounded = samples.withColumn("slot", F.when(F.col("slot") < slots, F.col("slot")).otherwise(outside.cast("int")))
    first_samples = _first_samples_at_or_after(bounded, slots, tile)
    judged = _judge_within_tiles(first_samples, slots, tile)
    settled = judged.filter(~F.col("_open") & (F.col(f"_alive_{slots - 1}") == 1)).select(KEY, tile, "timestamp_utc", "sample_index", "values")
    late = _judge_across_tiles(judged, slots, tile)
    return settled.unionByName(late)


def _names(slots: int) -> list[str]:
    return [f"s{i}" for i in range(1, slots)]


def _first_samples_at_or_after(samples: DataFrame, slots: int, tile: str) -> DataFrame:
    packed = F.struct("timestamp_utc", F.col(tile).alias("tile"), "value")
    values = {name: F.when(F.col("slot") == i, packed) for i, name in enumerate(_names(slots), start=1)}
    # At equal times the reference row must come first, so that it sees the sample beside it.
    order = ["timestamp_utc", (F.col("slot") != 0).cast("int"), "sample_index", "slot"]
    filled = sequence.fill_forward(samples, [KEY], order, tile, values, backward=True, presence=True)
    return filled.filter(F.col("slot") == 0).select(
        KEY,
        tile,
        "timestamp_utc",
        "sample_index",
        *[F.col(f"{n}_present") for n in values],
        *[F.col(f"{n}.timestamp_utc").alias(f"{n}_at") for n in values],
        *[F.col(f"{n}.tile").alias(f"{n}_tile") for n in values],
        F.array("value", *[F.col(f"{n}.value") for n in values]).alias("values"),
    )


def _judge_within_tiles(rows: DataFrame, slots: int, tile: str) -> DataFrame:
    """Add the verdict after each level, 1 kept, 0 dropped, NULL undecided; and ``_open`` for rows
    that were undecided at any level.
    """
    later = (
        Window.partitionBy(KEY, tile)
        .orderBy(F.desc("timestamp_utc"), F.desc("sample_index"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = rows.withColumn("_alive_0", F.lit(1))
    at = F.col("timestamp_utc")
    for level, name in enumerate(_names(slots), start=1):
        before = F.col(f"_alive_{level - 1}")
        sample = F.col(f"{name}_at")
        # The nearest later row that may survive bounds the next row from below, the nearest one
        # sure to survive from above. With neither in the tile the next row is in a later tile.
        maybe = F.last(F.when(before.isNull() | (before == 1), at), ignorenulls=True).over(later)
        sure = F.last(F.when(before == 1, at), ignorenulls=True).over(later)
        out = out.withColumns({"_maybe": maybe, "_sure": sure})
        inside = F.when(F.col("_maybe").isNotNull(), sample < F.col("_maybe")).otherwise(
            F.col(f"{name}_tile") == F.col(tile)
        )
        verdict = (
            F.when(before == 0, 0)
            .when(~F.col(f"{name}_present"), before)
            .when(sample.isNull(), 0)
            .when(inside, before)
            .when(sample >= F.col("_sure"), 0)
        )
        out = out.withColumn(f"_alive_{level}", verdict).drop("_maybe", "_sure")
    undecided = F.lit(False)
    for level in range(1, slots):
        undecided = undecided | F.col(f"_alive_{level}").isNull()
    return out.withColumn("_open", undecided)


def _judge_across_tiles(judged: DataFrame, slots: int, tile: str) -> DataFrame:
    names = _names(slots)
    # The first row of a tile that is sure to survive each level stands for the tile.
    firsts = [
        F.min(F.when(F.col(f"_alive_{i}") == 1, F.col("timestamp_utc"))).alias(f"_first_{i}")
        for i in range(slots)
    ]
    row = F.struct(
        "timestamp_utc", "sample_index", "values", *[f"{n}_at" for n in names], *[f"{n}_present" for n in names]
    )
    # One row per tile: its marker and its undecided rows, the last few of the tile.
    per_tile = judged.groupBy(KEY, tile).agg(*firsts, F.collect_list(F.when(F.col("_open"), row)).alias("_late"))
    marker = F.array(F.lit(None).cast(judged.select(row.alias("r")).schema["r"].dataType))
    rows = per_tile.select(
        KEY, tile, *[f"_first_{i}" for i in range(slots)], F.explode(F.concat(marker, "_late")).alias("_row")
    ).select(KEY, tile, *[f"_first_{i}" for i in range(slots)], F.col("_row").isNotNull().alias("_open"), "_row.*").withColumn(
        "_marker", (~F.col("_open")).cast("int")
    )
    later = (
        Window.partitionBy(KEY)
        .orderBy(F.desc(tile), "_marker", F.desc("timestamp_utc"), F.desc("sample_index"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = rows.withColumn("_on", F.col("_open"))
    for level, name in enumerate(_names(slots), start=1):
        stands: Column = F.when(F.col("_open"), F.when(F.col("_on"), F.col("timestamp_utc"))).otherwise(
            F.col(f"_first_{level - 1}")
        )
        out = out.withColumn("_next", F.last(stands, ignorenulls=True).over(later))
        sample = F.col(f"{name}_at")
        hit = sample.isNotNull() & (F.col("_next").isNull() | (sample < F.col("_next")))
        out = out.withColumn("_on", F.col("_on") & (~F.col(f"{name}_present") | hit)).drop("_next")
    return out.filter(F.col("_open") & F.col("_on")).select(
        KEY, tile, "timestamp_utc", "sample_index", "values"
    )


def aligned_long(
    aligned: DataFrame, event_sensors: DataFrame, *, tile: str = "tile", keep: Sequence[str] = ()
) -> DataFrame:
    """Aligned rows as (event, sensor, sample_index, time, value), index from 0 per event; columns
    named in ``keep`` come from the event-sensor table.
    """
    numbered = sequence.ordinal(
        aligned.withColumnRenamed("sample_index", "reference_row"),
        [KEY],
        ["timestamp_utc", "reference_row"],
        tile,
        "sample_index",
    )
    rows = numbered.select(
        KEY, "sample_index", "timestamp_utc", F.posexplode("values").alias("slot", "value")
    )
    return rows.join(event_sensors.select(KEY, "slot", "sensor_name", *keep), [KEY, "slot"])


def diagnostics(samples: DataFrame, aligned: DataFrame, event_sensors: DataFrame) -> DataFrame:
    """Per event and sensor: rows of the reference, rows after alignment, matched and unmatched."""
    counts = samples.groupBy(KEY, "slot").agg(F.count(F.lit(1)).alias("sensor_rows"))
    after = aligned.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows_after_alignment"))
    reference = counts.filter("slot = 0").select(KEY, F.col("sensor_rows").alias("rows_reference"))
    named = event_sensors.filter("slot = 0").select(KEY, F.col("sensor_name").alias("reference_sensor"))
    rows, matched = F.coalesce("sensor_rows", F.lit(0)), F.coalesce("rows_after_alignment", F.lit(0))
    return (
        event_sensors.select(KEY, "slot", "sensor_name")
        .join(counts, [KEY, "slot"], "left")
        .join(after, KEY, "left")
        .join(reference, KEY, "left")
        .join(named, KEY)
        .select(
            KEY,
            "sensor_name",
            "reference_sensor",
            F.coalesce("rows_reference", F.lit(0)).alias("rows_reference"),
            matched.alias("rows_after_alignment"),
            matched.alias("matched_rows"),
            F.greatest(rows - matched, F.lit(0)).alias("unmatched_rows"),
        )
    )


def timestamp_query(
    records: DataFrame,
    samples: DataFrame,
    timestamp: str,
    *,
    deck: str,
    sensor_pattern: str,
    slots: int,
    tile_seconds: int = 60,
    zeroing: str = "linear_endpoints",
) -> DataFrame:
    """Waveforms of the selected sensors around one moment, zeroed and aligned, in long form.

    A selected sensor with no record around the moment comes back as NULL values; if that sensor
    is the first one there is no clock and the result is empty.
    """
    around = joins.records_around(records, timestamp, deck=deck, sensor_pattern=sensor_pattern).withColumn(
        KEY, F.concat_ws("__", "set_name", "deck")
    )
    sensors = add_slots(around.select(KEY, "set_name", "deck", "sensor_name", "sensor_order"))
    found = around.filter(F.col("raw_file").isNotNull()).select(
        KEY, "set_name", "sensor_name", "raw_file", "start_row_1based", "end_row_1based", "start_time_utc"
    )
    sliced = joins.drop_unparsed(joins.slice_records(found, samples)).withColumn(
        "tile", times.time_tile(F.col("timestamp_utc"), tile_seconds)
    )
    indexed = sequence.ordinal(
        sliced, [KEY, "sensor_name"], ["timestamp_utc", "row_1based"], "tile", "sample_index"
    )
    zeroed = conditioning.zero_waveforms(cut_lineage(indexed), [KEY, "sensor_name"], method=zeroing)
    slotted = zeroed.join(sensors.select(KEY, "sensor_name", "slot"), [KEY, "sensor_name"])
    return aligned_long(align(slotted, slots), sensors, keep=("set_name", "deck"))
