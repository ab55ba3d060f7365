"""Fixed-shape model inputs: channel selection, packaging gates, windows, spectra, splits, scaling.

Nothing here is a dense array: a tensor is rows of ``(event_id, channel, position, value)`` or one
bounded array per event and channel.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwave.functions import naming
from spanwave.operators import sequence, transform

BLOCK = 1 << 16  # samples transformed in one task
EXCLUDED_NOTE = "excluded_from_neural_input"  # fixed value


def channel_map(
    sensors: DataFrame,
    *,
    decks: Sequence[str] = (),
    strain_locations: Sequence[str] = ("INF", "SUP"),
    acc_axis: str = "Z",
) -> DataFrame:
    """Number the model channels: strain by location, acceleration by axis, in sensor order.

    ``sensors`` holds ``sensor_name, deck, sensor_order`` and may repeat a sensor over sets; its
    lowest order counts. Sensors outside the selection keep NULL numbers.
    """
    if decks:
        sensors = sensors.filter(F.col("deck").isin(list(decks)))
    unique = sensors.groupBy("sensor_name").agg(F.min("sensor_order").alias("source_sensor_order"))
    parts = naming.sensor_parts(F.col("sensor_name"))
    is_strain = (parts["quantity"] == "STR") & parts["location"].isin(list(strain_locations))
    is_acc = (parts["quantity"] == "ACC") & F.coalesce(parts["axis"] == acc_axis, F.lit(False))
    kind = F.when(is_strain, F.lit("strain")).when(is_acc, F.lit("acc"))
    in_order = Window.partitionBy("modality").orderBy("source_sensor_order", "sensor_name")
    everyone = Window.partitionBy(F.lit(0))
    included = F.col("modality").isNotNull()
    prefix = F.when(F.col("modality") == "strain", F.lit("STR")).otherwise(F.lit(f"ACC{acc_axis}"))
    return (
        unique.withColumn("modality", kind)
        .withColumn(
            "model_channel_index",
            F.when(included, (F.row_number().over(in_order) - 1).cast("bigint")),
        )
        .withColumn("_strain", F.count_if(F.col("modality") == "strain").over(everyone))
        .select(
            "sensor_name",
            parts["quantity"].alias("sensor_type"),
            *[parts[p] for p in ("deck", "span", "side", "location")],
            F.coalesce(parts["axis"], parts["location"]).alias("axis_or_type"),
            "source_sensor_order",
            "modality",
            "model_channel_index",
            F.when(F.col("modality") == "strain", F.col("model_channel_index"))
            .when(F.col("modality") == "acc", F.col("_strain") + F.col("model_channel_index"))
            .alias("global_model_channel_index"),
            F.when(
                included, F.concat(prefix, F.lpad(F.col("model_channel_index").cast("string"), 2, "0"))
            )
            .otherwise(F.lit(""))
            .alias("model_channel_id"),
            included.alias("include_flag"),
            F.when(included, F.lit("")).otherwise(F.lit(EXCLUDED_NOTE)).alias("notes"),
        )
    )


def selected_channels(channels: DataFrame) -> DataFrame:
    return channels.filter("include_flag").select("sensor_name", "modality", "model_channel_index")


def coverage(samples: DataFrame, channels: DataFrame) -> DataFrame:
    """Per event, which required sensors are missing from its aligned samples."""
    required = channels.agg(F.array_sort(F.collect_set("sensor_name")))
    present = samples.groupBy("event_id").agg(F.collect_set("sensor_name").alias("present"))
    return present.select(
        "event_id", F.array_except(required.scalar(), "present").alias("missing_sensors")
    ).withColumn("complete", F.size("missing_sensors") == 0)


def peak_window(
    peak: Column, length: Column, half: int
) -> tuple[Column, Column]:
    """Start (inclusive) and stop (exclusive) of the fixed-length window around ``peak``, shifted
    inside the record; NULL when the record is shorter than the window.
    """
    size = 2 * half
    start = F.greatest(F.least(peak - half, length - size), F.lit(0))
    fits = (length >= size) & (F.lit(size) > 0)
    return F.when(fits, start), F.when(fits, start + size)


def package(
    events: DataFrame,
    samples: DataFrame,
    channels: DataFrame,
    *,
    half_window: int = 100,
    min_aligned_samples: int = 500,
) -> DataFrame:
    """Judge each event for packaging: status, first failing reason, peak row and window bounds.

    Gates in order: no rows, missing channels, non-finite values, too short, no channel of a
    modality, window outside the record. ``samples`` is the aligned long table.
    """
    strain_count = channels.agg(F.count_if(F.col("modality") == "strain")).scalar()
    acc_count = channels.agg(F.count_if(F.col("modality") == "acc")).scalar()
    v = F.col("value")
    is_strain = F.col("modality") == "strain"
    channel = 2 * F.col("model_channel_index") + (F.col("modality") == "acc").cast("int")
    at_peak = F.struct(F.abs(v), -F.col("sample_index"), -F.col("model_channel_index"))
    broken = F.col("modality").isNotNull() & (
        v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    )
    per_event = samples.join(channels, "sensor_name", "left").groupBy("event_id").agg(
        (F.max("sample_index") + 1).alias("row_count"),
        # One bit a channel, set inside the tasks: no row per event and sensor is shuffled.
        F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(channel + 1))).alias("_have"),
        F.max(broken).alias("_broken"),
        F.max_by("sample_index", F.when(is_strain & v.isNotNull(), at_peak)).alias("peak_row"),
    )
    judged = events.join(per_event, "event_id", "left").withColumns(
        {"row_count": F.coalesce("row_count", F.lit(0)), "_strain": strain_count, "_acc": acc_count}
    )
    start, stop = peak_window(F.col("peak_row"), F.col("row_count"), half_window)
    reason = (
        F.when(F.col("row_count") == 0, F.lit("empty_aligned_event"))
        .when(F.col("_have") < F.col("_strain") + F.col("_acc"), F.lit("missing_aligned_columns"))
        .when(F.col("_broken"), F.lit("nonfinite_values"))
        .when(F.col("row_count") < min_aligned_samples, F.lit("acc_too_short"))
        .when((F.col("_strain") == 0) | (F.col("_acc") == 0), F.lit("empty_required_matrix"))
        .when(start.isNull(), F.lit("strain_window_out_of_bounds"))
    )
    kept = reason.isNull()
    return judged.select(
        *events.columns,
        "row_count",
        F.when(kept, F.lit("keep")).otherwise(F.lit("discard")).alias("status"),
        reason.alias("discard_reason"),
        "peak_row",
        F.when(kept, start).alias("window_start_row"),
        F.when(kept, stop).alias("window_stop_row"),
    )


def mean_temperature(event_sensors: DataFrame, channels: DataFrame) -> DataFrame:
    """Mean temperature over the selected sensors of an event and how many reported one."""
    t = F.when(~F.isnan("temperature"), F.col("temperature"))
    return (
        event_sensors.join(channels.select("sensor_name"), "sensor_name", "left_semi")
        .groupBy("event_id")
        .agg(F.avg(t).alias("temperature_mean"), F.count(t).alias("temperature_sensor_count"))
    )


def coverage_tallies(covered: DataFrame, packaged: DataFrame) -> DataFrame:
    """One row: events seen, complete, incomplete, rejected in packaging, packaged."""
    by_event = covered.select("event_id", "complete").join(
        packaged.select("event_id", "status"), "event_id", "full_outer"
    )
    complete = F.coalesce("complete", F.lit(False))
    kept = complete & (F.col("status") == "keep")
    return by_event.agg(
        F.count(F.lit(1)).alias("retained_events"),
        F.count_if(complete).alias("complete_events"),
        F.count_if(~complete).alias("incomplete_events"),
        F.count_if(complete & (F.col("status") != "keep")).alias("packaging_rejected_events"),
        F.count_if(kept).alias("packaged_events"),
    )


def strain_windows(samples: DataFrame, packaged: DataFrame, channels: DataFrame) -> DataFrame:
    """Strain values inside each kept event's window, re-indexed from 0."""
    kept = packaged.filter("status = 'keep'").select("event_id", "window_start_row", "window_stop_row")
    return (
        samples.join(channels.filter("modality = 'strain'"), "sensor_name")
        .join(kept, "event_id")
        .filter(
            (F.col("sample_index") >= F.col("window_start_row"))
            & (F.col("sample_index") < F.col("window_stop_row"))
        )
        .select(
            "event_id",
            "model_channel_index",
            (F.col("sample_index") - F.col("window_start_row")).alias("position"),
            "value",
        )
    )


def transform_length(packaged: DataFrame) -> int:
    """Samples of the longest kept record: one number, read back to the driver."""
    row = packaged.filter("status = 'keep'").agg(F.max("row_count").alias("n")).first()
    return int(row["n"] or 0)


def frequency_bins(
    spark, n_fft: int, *, sampling_rate_hz: float = 100.0, low_hz: float = 0.5, high_hz: float = 20.0
) -> DataFrame:
    """The kept transform bins: number ``k`` and frequency, limits included."""
    frequency = F.col("id") * F.lit(sampling_rate_hz) / F.lit(max(n_fft, 1))
    return (
        spark.range(0, n_fft // 2 + 1 if n_fft else 0)
        .select(F.col("id").alias("bin"), frequency.alias("frequency_hz"))
        .filter(F.col("frequency_hz").between(low_hz, high_hz))
    )


def spectra(
    samples: DataFrame,
    keys: Sequence[str],
    n_fft: int,
    *,
    sampling_rate_hz: float = 100.0,
    low_hz: float = 0.5,
    high_hz: float = 20.0,
    block: int = BLOCK,
) -> DataFrame:
    """Magnitude of the zero-padded transform of each waveform on the kept bins.

    A waveform of at most ``block`` samples is transformed in one task; longer ones, which no task
    should hold, by split transforms (``transform.long_transform``). Both take n log n.
    """
    keys = list(keys)
    bins = np.arange(n_fft // 2 + 1)
    hz = bins * sampling_rate_hz / max(n_fft, 1)
    bins = bins[(hz >= low_hz) & (hz <= high_hz)]
    first, last = (int(bins[0]), int(bins[-1])) if len(bins) else (0, -1)
    # Single-precision input as stored, double inside the transform.
    single = samples.select(*keys, "sample_index", F.col("value").cast("float").cast("double").alias("value"))
    if n_fft > block:
        return transform.long_transform(single, keys, n_fft, first, last)
    waves = single.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample_index", "value"))).alias("_rows"))

    @F.pandas_udf("array<double>")
    def magnitudes(x: pd.Series) -> pd.Series:
        return pd.Series([np.abs(np.fft.rfft(np.asarray(v, dtype=float), n=n_fft)[bins]) for v in x], dtype=object)

    lines = waves.select(*keys, F.posexplode(magnitudes(F.col("_rows.value"))).alias("_i", "magnitude"))
    return lines.select(*keys, (F.col("_i") + first).cast("bigint").alias("bin"), "magnitude")


def pack_arrays(long: DataFrame, keys: Sequence[str], position: str, value: str, name: str) -> DataFrame:
    """Fold positions of bounded number (window samples, bins) into one array per key."""
    ordered = F.array_sort(F.collect_list(F.struct(position, F.col(value).cast("float").alias("_v"))))
    return long.groupBy(*keys).agg(ordered.alias("_rows")).select(*keys, F.col("_rows._v").alias(name))


def manifest(packaged: DataFrame) -> DataFrame:
    """Kept events numbered from 0 in catalogue order."""
    kept = packaged.filter("status = 'keep'").withColumn("_all", F.lit(0))
    tiled = kept.withColumn(
        "_tile", F.concat_ws("/", "set_name", "deck", F.date_format("start_time_utc", "yyyyMMdd"))
    )
    numbered = sequence.ordinal(
        tiled, ["_all"], ["set_name", "deck", "start_time_utc", "event_id"], "_tile", "row_index"
    )
    return numbered.select("row_index", "event_id", "set_name", "deck", "start_time_utc", "end_time_utc")


def check_event_axis(*modalities: DataFrame) -> DataFrame:
    """Events that some modality lacks; empty when all share one event axis."""
    tagged = None
    for i, frame in enumerate(modalities):
        ids = frame.select("event_id").distinct().withColumn("_m", F.lit(i))
        tagged = ids if tagged is None else tagged.unionByName(ids)
    return (
        tagged.groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("modalities"))
        .filter(F.col("modalities") < len(modalities))
    )


def finite_counts(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    v = F.col("value")
    bad = F.coalesce(F.isnan(v), F.lit(True))
    infinite = F.coalesce(F.abs(v) == F.lit(float("inf")), F.lit(False))
    return values.groupBy(*keys).agg(
        F.count_if(~bad & ~infinite & v.isNotNull()).alias("finite_count"),
        F.count_if(bad).alias("nan_count"),
    )


def split_counts(n: int, fractions: Sequence[float]) -> list[int]:
    """How many of ``n`` events each part gets: whole shares, then one more by largest remainder.

    Of equal remainders the later part comes first; shares are doubles, so remainders level on paper may
    differ in the last digit. The first part takes one event from the next that has any, should it come
    out empty.
    """
    check_fractions(fractions)
    shares = [f * n for f in fractions]
    counts = [math.floor(share) for share in shares]
    by_remainder = sorted(range(len(shares)), key=lambda i: (shares[i] - counts[i], i))
    left_over = n - sum(counts)
    for part in by_remainder[len(shares) - left_over :]:
        counts[part] += 1
    if n and not counts[0]:
        giver = min(part for part, count in enumerate(counts) if count)
        counts[giver], counts[0] = counts[giver] - 1, 1
    return counts


def check_fractions(fractions: Sequence[float]) -> None:
    if min(fractions) < 0 or not math.isclose(sum(fractions), 1.0, rel_tol=1e-5):
        raise ValueError(f"fractions must not be negative and must add up to 1: {list(fractions)}")


def _shuffled(events: DataFrame, seed: int) -> DataFrame:
    """Repeatable order by hash, numbered from 0; the first digits of the hash are the tile."""
    hashed = events.withColumn("_hash", F.md5(F.concat(F.col("event_id"), F.lit(str(seed)))))
    tiled = hashed.withColumns({"_tile": F.substring("_hash", 1, 3), "_all": F.lit(0)})
    return sequence.ordinal(tiled, ["_all"], ["_hash", "event_id"], "_tile", "draw").drop(
        "_hash", "_tile", "_all"
    )


def split_events(
    events: DataFrame,
    *,
    seed: int = 2026,
    fractions: Sequence[float] = (0.7, 0.2, 0.1),
    names: Sequence[str] = ("train", "validation", "test"),
    remainder_to: str | None = None,
) -> DataFrame:
    """Assign each event to a split in seeded random order.

    Counts follow :func:`split_counts`, or the floor of each fraction with what is left going to
    ``remainder_to``. The number of events is the one value read back to the driver.
    """
    n = events.count()
    if n <= 0:
        raise ValueError("there are no events to split")
    if remainder_to is None:
        counts = split_counts(n, fractions)
    else:
        check_fractions(fractions)
        counts = [0 if name == remainder_to else int(f * n) for name, f in zip(names, fractions, strict=True)]
        counts[list(names).index(remainder_to)] = n - sum(counts)
    edges = np.cumsum(counts)
    split = F.lit(names[-1])
    for name, edge in reversed(list(zip(names, edges, strict=True))[:-1]):
        split = F.when(F.col("draw") < int(edge), F.lit(name)).otherwise(split)
    return _shuffled(events, seed).withColumn("split", split)


def sample_events(events: DataFrame, count: int, *, seed: int = 2026) -> DataFrame:
    """A repeatable sample of ``count`` events."""
    return _shuffled(events, seed).filter(F.col("draw") < count).drop("draw")


def split_manifest(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("split").agg(F.count(F.lit(1)).alias("event_count"))


def scaling(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the training rows; a deviation of 0 becomes 1."""
    v = F.when(~F.isnan("value"), F.col("value"))
    std = F.stddev_pop(v)
    return values.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std")
    )


def scale(values: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Apply fitted means and deviations unchanged."""
    return values.join(fitted, list(keys)).withColumn(
        "value", (F.col("value") - F.col("mean")) / F.col("std")
    ).drop("mean", "std")


def channel_samples(tensors: DataFrame, channels: int) -> DataFrame:
    """One row per event and channel with that channel's slice of the packed values.

    ``values`` is channel-major; an event-level temperature is repeated on every channel.
    """
    width = F.floor(F.size("values") / F.lit(channels)).cast("int")
    channel = F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel")
    return tensors.select("*", channel).withColumn(
        "values", F.slice("values", F.col("channel") * width + 1, width)
    )


def scale_arrays(rows: DataFrame, reference: Column, width: int) -> DataFrame:
    """Scale ``values`` by each array position's mean and deviation over the reference rows.

    The fit is one row of ``width`` pairs and reaches the rows as a scalar, so nothing is shuffled
    but its partial sums.
    """

    def fit(i: int) -> Column:
        at = F.get("values", F.lit(i))
        v = F.when(~F.isnan(at), at)
        std = F.stddev_pop(v)
        return F.struct(F.avg(v).alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"))

    fitted = rows.filter(reference).agg(F.array(*[fit(i) for i in range(width)]))
    scaled = F.zip_with("values", "_fit", lambda v, f: (v - f["mean"]) / f["std"])
    return rows.withColumn("_fit", fitted.scalar()).withColumn("values", scaled).drop("_fit")


def duplicate_channels(rows: DataFrame, channels: int, *, tolerance: float = 1e-6) -> DataFrame:
    """Channel pairs whose values never differ by ``tolerance`` or more, with the largest gap.

    ``values`` is channel-major. Pairs are compared inside the row; their number is bounded by the
    channel count, and only one maximum per pair and task is shuffled.
    """
    width = (F.size("values") / F.lit(channels)).cast("int")
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(channels) for b in range(a + 1, channels)]
    each = rows.select("values", width.alias("_width"), F.explode(F.array(*pairs)).alias("p"))
    own, other = (F.slice("values", F.col(f"p.{side}") * F.col("_width") + 1, F.col("_width")) for side in "ab")
    gap = F.array_max(F.zip_with(own, other, lambda x, y: F.abs(x - y)))
    found = each.groupBy(F.col("p.a").alias("channel"), F.col("p.b").alias("other_channel"))
    return found.agg(F.max(gap).alias("max_abs_diff")).withColumn("duplicate", F.col("max_abs_diff") < tolerance)
