"""Waveform features per event and sensor, and baselines built from earlier events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwave.functions import naming, numbers, times
from spanwave.operators import sequence

STATISTICS = (
    "mean", "std", "rms", "min", "max", "peak_to_peak", "energy",
    "crest_factor", "zero_crossing_rate", "skewness", "kurtosis",
)


def waveform_statistics(
    samples: DataFrame, keys: Sequence[str], *, tile: str = "tile", sampling_rate_hz: float = 100.0
) -> DataFrame:
    """All waveform features of each group of ``(tile, sample_index, timestamp_utc, value)`` rows."""
    keys = list(keys)
    known = samples.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    v = F.col("value")
    n = F.count(F.lit(1))
    clocked = F.count("timestamp_utc") == n
    span = times.seconds_between(
        F.min_by("timestamp_utc", "sample_index"), F.max_by("timestamp_utc", "sample_index")
    )
    moments = known.groupBy(*keys).agg(
        n.alias("sample_count"),
        F.when(n < 2, F.lit(0.0))
        .when(clocked, span)
        .otherwise((n - 1) / F.lit(sampling_rate_hz))
        .alias("aligned_duration_s"),
        F.avg(v).alias("mean"),
        F.when(n > 1, F.stddev_samp(v)).alias("std"),
        numbers.rms(v).alias("rms"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("peak_to_peak"),
        F.sum(v * v).alias("energy"),
        numbers.crest_factor(v).alias("crest_factor"),
        numbers.sample_skewness(v).alias("skewness"),
        numbers.sample_kurtosis(v).alias("kurtosis"),
    )
    crossings = zero_crossings(known, keys, tile=tile)
    return (
        moments.join(crossings, keys)
        .withColumn(
            "zero_crossing_rate",
            F.coalesce(F.try_divide(F.col("zero_crossings"), F.col("sample_count") - 1), F.lit(0.0)),
        )
        .drop("zero_crossings")
    )


def zero_crossings(samples: DataFrame, keys: Sequence[str], *, tile: str = "tile") -> DataFrame:
    """Strict sign changes between neighbouring samples; a zero sample breaks a crossing."""
    keys = list(keys)
    in_tile = Window.partitionBy(*keys, tile).orderBy("sample_index")
    sign = F.signum("value")
    per_tile = (
        samples.select(*keys, tile, "sample_index", sign.alias("_s"))
        .withColumn("_flip", F.col("_s") * F.lag("_s").over(in_tile) < 0)
        .groupBy(*keys, tile)
        .agg(
            F.count_if("_flip").alias("_inside"),
            F.min_by("_s", "sample_index").alias("_opens"),
            F.max_by("_s", "sample_index").alias("_closes"),
        )
    )
    seam = F.col("_opens") * F.lag("_closes").over(Window.partitionBy(*keys).orderBy(tile)) < 0
    return (
        per_tile.withColumn("_seam", seam)
        .groupBy(*keys)
        .agg((F.sum("_inside") + F.count_if("_seam")).alias("zero_crossings"))
    )


def sensor_event_features(event_sensors: DataFrame, samples: DataFrame, **options) -> DataFrame:
    """The feature table: one row per event and included sensor, waveform features beside the
    record's own table values; sensors without samples keep a count of 0.
    """
    stats = waveform_statistics(samples, ["event_id", "sensor_name"], **options)
    parts = naming.sensor_parts(F.col("sensor_name"))
    table_values = {
        "table_duration": "duration",
        "table_start_value": "start_value",
        "table_end_value": "end_value",
        "table_diff_value": "diff_value",
        "table_min_value": "min_value",
        "table_max_value": "max_value",
        "table_mean_value": "mean_value",
        "table_range_value": "range_value",
        "table_temperature": "temperature",
    }
    return (
        event_sensors.filter(F.col("sensor_status") == "included")
        .join(stats, ["event_id", "sensor_name"], "left")
        .select(
            "event_id",
            "set_name",
            "deck",
            "sensor_name",
            "sensor_order",
            parts["quantity"],
            parts["axis"],
            F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
            "aligned_duration_s",
            *[F.col(source).alias(name) for name, source in table_values.items()],
            *[F.col(s).alias(f"waveform_{s}") for s in STATISTICS],
        )
    )


def mean_abs(samples: DataFrame) -> DataFrame:
    return samples.groupBy("event_id", "sensor_name").agg(F.avg(F.abs("value")).alias("mean_abs_value"))


def event_ordinals(events: DataFrame, *, time: str = "start_time_utc", tile_seconds: int = 86400) -> DataFrame:
    """Number events from 1 in order of start time."""
    tiled = events.withColumn("_tile", times.time_tile(F.col(time), tile_seconds)).withColumn(
        "_all", F.lit(0)
    )
    numbered = sequence.ordinal(tiled, ["_all"], [time, "event_id"], "_tile", "event_ordinal")
    return numbered.withColumn("event_ordinal", F.col("event_ordinal") + 1).drop("_all", "_tile")


def span_ratio(mean_abs_values: DataFrame) -> DataFrame:
    """Summed activity of span S1 over that of span S2 per event; NULL when S2 shows none."""
    def total(span: str):
        of_span = F.contains(F.col("sensor_name"), F.lit(f"_{span}_"))
        return F.coalesce(F.sum(F.when(of_span, F.col("mean_abs_value"))), F.lit(0.0))

    return mean_abs_values.groupBy("event_id").agg(F.try_divide(total("S1"), total("S2")).alias("ratio"))


def trailing_baseline(event_means: DataFrame, *, window: int = 100) -> DataFrame:
    """Mean and sample deviation of the previous ``window`` event means of each sensor.

    Needs ``sensor_name, position, event_mean``; position is the sensor's 0-based event number.
    """
    return sequence.trailing(
        event_means,
        ["sensor_name"],
        "position",
        window,
        {
            "baseline_mean": F.avg("event_mean"),
            "baseline_std": F.stddev_samp("event_mean"),
        },
    )


def event_means(samples: DataFrame, *, time: str = "window_start") -> DataFrame:
    """Mean value of each event per sensor, numbered by event start."""
    means = samples.groupBy("event_id", "sensor_name", time).agg(F.avg("value").alias("event_mean"))
    tiled = means.withColumn("_tile", times.time_tile(F.col(time), 86400))
    return sequence.ordinal(tiled, ["sensor_name"], [time, "event_id"], "_tile", "position").drop("_tile")


def point_anomalies(samples: DataFrame, baseline: DataFrame, *, threshold: float = 3.0) -> DataFrame:
    """Samples further than ``threshold`` deviations from the trailing baseline, count and rate."""
    ready = baseline.filter(F.col("baseline_mean").isNotNull()).select(
        "event_id", "sensor_name", "baseline_mean", "baseline_std"
    )
    far = F.abs(F.col("value") - F.col("baseline_mean")) > threshold * F.col("baseline_std")
    return (
        samples.join(ready, ["event_id", "sensor_name"])
        .groupBy("event_id", "sensor_name")
        .agg(
            F.count_if(far).alias("anomaly_count"),
            (F.count_if(far) / F.count(F.lit(1))).alias("anomaly_rate"),
        )
    )


def irregular_events(samples: DataFrame, expected: int) -> DataFrame:
    """Events whose number of sensors is not ``expected``."""
    return (
        samples.groupBy("event_id")
        .agg(F.count_distinct("sensor_name").alias("sensor_count"))
        .filter(F.col("sensor_count") != expected)
    )
