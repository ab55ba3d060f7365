"""Model inputs from preprocessed events, and their split and scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwave.operators import tensors
from spanwave.operators.sizing import small
from spanwave.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    decks: tuple[str, ...] = ()
    strain_locations: tuple[str, ...] = ("INF", "SUP")
    acc_axis: str = "Z"
    half_window: int = 100
    min_aligned_samples: int = 500
    sampling_rate_hz: float = 100.0
    low_hz: float = 0.5
    high_hz: float = 20.0


def package(
    events: DataFrame,
    event_sensors: DataFrame,
    aligned_samples: DataFrame,
    sensors: DataFrame,
    settings: Settings = Settings(),
) -> dict[str, DataFrame]:
    """Channel map, manifest and the three modalities as rows of bounded arrays.

    ``sensors`` holds ``sensor_name, deck, sensor_order``. The transform length, the one global
    number, is read back once.
    """
    retained = events.filter(~F.col("discarded"))
    if settings.decks:
        retained = retained.filter(F.col("deck").isin(list(settings.decks)))
    channel_map = tensors.channel_map(
        sensors,
        decks=settings.decks,
        strain_locations=settings.strain_locations,
        acc_axis=settings.acc_axis,
    )
    channels = small(cut_lineage(tensors.selected_channels(channel_map)))
    samples = aligned_samples.join(retained.select("event_id"), "event_id", "left_semi")
    packaged = cut_lineage(
        tensors.package(
            retained.select("event_id", "set_name", "deck", "start_time_utc", "end_time_utc"),
            samples,
            channels,
            half_window=settings.half_window,
            min_aligned_samples=settings.min_aligned_samples,
        )
    )
    kept = packaged.filter("status = 'keep'").select("event_id")
    keys = ["event_id", "model_channel_index"]
    acc = samples.join(channels.filter("modality = 'acc'"), "sensor_name").join(kept, "event_id", "left_semi")
    band = {"sampling_rate_hz": settings.sampling_rate_hz, "low_hz": settings.low_hz, "high_hz": settings.high_hz}
    length = tensors.transform_length(packaged)
    return {
        "sensor_map": channel_map,
        "manifest": tensors.manifest(packaged),
        "valid_lengths": packaged.filter("status = 'keep'").select("event_id", F.col("row_count").alias("valid_length")),
        "strain_inputs": tensors.pack_arrays(
            tensors.strain_windows(samples, packaged, channels), keys, "position", "value", "values"
        ),
        "acc_inputs": tensors.pack_arrays(
            tensors.spectra(acc, keys, length, **band), keys, "bin", "magnitude", "values"
        ),
        "temperature_inputs": tensors.mean_temperature(event_sensors, channels).join(kept, "event_id", "left_semi"),
        "frequency_bins": tensors.frequency_bins(events.sparkSession, length, **band),
        "summary": tensors.coverage_tallies(tensors.coverage(samples, channels), packaged),
    }


def package_decks(
    events: DataFrame,
    event_sensors: DataFrame,
    aligned_samples: DataFrame,
    sensors: DataFrame,
    settings: Settings = Settings(),
) -> dict[str, DataFrame]:
    """``package`` of every deck in ``settings``, or else of the sensor table, as one run.

    Each deck has its own channel numbers, event axis and transform length; every table tells the deck
    its rows belong to. The decks are read from the sensor dimension, which has a few.
    """
    decks = settings.decks or [r.deck for r in sensors.select("deck").distinct().orderBy("deck").collect()]
    runs = [
        (deck, package(events, event_sensors, aligned_samples, sensors, replace(settings, decks=(deck,)))) for deck in decks
    ]
    return {
        name: reduce(DataFrame.unionByName, [run[name].withColumn("deck", F.lit(deck)) for deck, run in runs])
        for name in runs[0][1]
    }


def prepare(
    inputs: dict[str, DataFrame],
    *,
    seed: int = 2026,
    fractions: Sequence[float] = (0.7, 0.2, 0.1),
) -> dict[str, DataFrame]:
    """Split the packaged events and fit the scaling of every modality on the training part."""
    assigned = cut_lineage(tensors.split_events(inputs["manifest"].select("event_id"), seed=seed, fractions=fractions))
    train = assigned.filter("split = 'train'").select("event_id")

    def fitted(name: str) -> DataFrame:
        rows = inputs[name].join(train, "event_id", "left_semi")
        long = rows.select("model_channel_index", F.explode(F.col("values").cast("array<double>")).alias("value"))
        return tensors.scaling(long, ["model_channel_index"])

    temperature = inputs["temperature_inputs"].join(train, "event_id", "left_semi")
    return {
        "splits": assigned,
        "split_manifest": tensors.split_manifest(assigned),
        "strain_scaling": fitted("strain_inputs"),
        "acc_scaling": fitted("acc_inputs"),
        "temperature_scaling": tensors.scaling(temperature.withColumnRenamed("temperature_mean", "value"), []),
    }
