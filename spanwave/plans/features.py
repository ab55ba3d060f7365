"""The feature job: sensor-event features and modal tables from preprocessed events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwave.functions import naming, times
from spanwave.operators import conditioning, events, features, joins, modal, sequence
from spanwave.operators.sizing import small
from spanwave.session import cut_lineage, stage

#: Up to so many records are sent to the samples whole.
MAX_RECORDS = 10_000


@dataclass(frozen=True)
class Settings:
    sampling_rate_hz: float = 100.0
    modal_enabled: bool = True
    quantity: str = "ACC"
    axis: str = "Z"
    low_hz: float = 0.5
    high_hz: float = 20.0
    nperseg: int = 1024
    noverlap: int = 512
    n_peaks: int = 3
    min_common_events: int = 2
    max_events: int | None = None
    require_full_channel_set: bool = True
    tile_seconds: int = 60


def build(
    event_table: DataFrame, event_sensors: DataFrame, aligned_samples: DataFrame, settings: Settings = Settings()
) -> dict[str, DataFrame]:
    """The four feature tables of the retained events."""
    retained = event_table.filter(~F.col("discarded"))
    family = f"{settings.quantity.lower()}_{settings.axis.lower()}_fdd"
    samples = aligned_samples.join(retained.select("event_id"), "event_id", "left_semi").withColumn(
        "tile", times.time_tile(F.col("timestamp_utc"), settings.tile_seconds)
    )
    bridge = event_sensors.join(retained.select("event_id"), "event_id", "left_semi")
    table = features.sensor_event_features(bridge, samples, sampling_rate_hz=settings.sampling_rate_hz)
    targets = retained.select("set_name", "deck").distinct()
    if not settings.modal_enabled:
        status = targets.select(
            "set_name",
            "deck",
            F.lit(family).alias("feature_family"),
            F.lit("skipped").alias("status"),
            F.lit("disabled in config").alias("detail"),
            F.lit(0).cast("bigint").alias("event_count"),
            F.lit(0).cast("bigint").alias("channel_count"),
        )
        return {"sensor_event_features": table, "feature_family_status": status}

    starts = retained.select("event_id", "start_time_utc")
    channel_rows = modal.channels_of(
        bridge.drop("start_time_utc").join(starts, "event_id"), quantity=settings.quantity, axis=settings.axis
    )
    candidates = modal.candidate_events(
        channel_rows, require_full_channel_set=settings.require_full_channel_set
    )
    selected = cut_lineage(modal.first_events(candidates, settings.max_events))
    channels = cut_lineage(modal.common_channels(selected))
    matrices = cut_lineage(
        modal.event_matrices(samples, selected, channels, min_common_events=settings.min_common_events)
    )
    peaks, located = from_matrices(matrices, channels, settings)
    counts = matrices.groupBy("set_name", "deck").agg(
        F.max("channel_count").alias("channel_count"), F.max("event_count").alias("event_count")
    )
    labelled = peaks.withColumns(
        {
            "feature_family": F.lit(family),
            "quantity": F.lit(settings.quantity),
            "axis": F.lit(settings.axis),
        }
    ).join(counts, ["set_name", "deck"])
    return {
        "sensor_event_features": table,
        "deck_modal_peaks": labelled,
        "deck_mode_shape_components": located.drop("channel_index", "frequency_index"),
        "feature_family_status": modal.family_status(
            retained,
            channel_rows,
            candidates,
            selected,
            channels,
            matrices,
            quantity=settings.quantity,
            axis=settings.axis,
            min_common_events=settings.min_common_events,
            require_full_channel_set=settings.require_full_channel_set,
        ),
    }


def raw_record_matrices(
    records: DataFrame,
    samples: DataFrame,
    settings: Settings = Settings(),
    *,
    min_duration_seconds: float = 10.0,
    deck: str | None = None,
    min_rows: int = 2,
    order: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Band-passed channel matrices straight from raw records, and their channels.

    Events are the windows that every selected sensor of a set recorded long enough; channels are cut
    to the shortest and filtered as they are, without alignment. ``deck`` None takes all decks as
    one group, named ``ALL``. The samples are read once, those of other channels not at all.
    """
    common = events.common_sensor_events(
        records, min_duration_seconds, quantity=settings.quantity, axis=settings.axis, deck=deck
    ).withColumn("event_id", naming.event_id(F.col("set_name"), F.col("deck"), F.col("start_time_utc"), F.col("end_time_utc")))
    selected = cut_lineage(modal.first_events(common, settings.max_events))
    keys = ["set_name", "deck", "event_id", "sensor_name"]
    window = ["set_name", "sensor_name", "start_time_utc", "end_time_utc"]
    wanted = selected.select("set_name", "deck", "event_id", "start_time_utc", "end_time_utc", F.explode("sensor_names").alias("sensor_name"))
    own = joins.first_of(records.drop("deck"), window)
    recorded = events.select_channels(samples, quantity=settings.quantity, axis=settings.axis, deck=deck)
    # Few records against many samples: the samples stay where they were numbered.
    sliced = joins.slice_records(small(wanted.join(own, window), MAX_RECORDS), recorded).withColumn(
        "tile", F.floor(F.col("row_1based") / joins.ROWS_PER_BLOCK)
    )
    sliced = stage(sliced.select(*keys, "row_1based", "tile", "value"))  # counting and numbering read it
    shortest = cut_lineage(joins.shortest_sensors(sliced, keys[:3]))
    waves = sequence.ordinal(sliced, keys, ["row_1based"], "tile", "sample_index", in_place=True)
    even = joins.positional_rows(waves, keys[:3], shortest=small(shortest))
    filtered = conditioning.bandpass(
        even, keys, sampling_rate_hz=settings.sampling_rate_hz, low_hz=settings.low_hz, high_hz=settings.high_hz, order=order
    ).withColumn("tile", F.floor(F.col("sample_index") / joins.ROWS_PER_BLOCK))
    channels = wanted.select("set_name", "deck", "sensor_name").distinct()
    matrices = modal.event_matrices(
        filtered, selected, channels, min_common_events=settings.min_common_events, min_rows=min_rows
    )
    return matrices, channels


def from_raw_records(records: DataFrame, samples: DataFrame, settings: Settings = Settings(), **options) -> tuple[DataFrame, DataFrame]:
    """Peak table and located mode-shape components from raw records."""
    matrices, channels = raw_record_matrices(records, samples, settings, **options)
    return from_matrices(matrices, channels, settings)


def from_matrices(matrices: DataFrame, channels: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Peak table and located mode-shape components from given matrices (as ``modal.event_matrices``)."""
    return modal.run(
        matrices,
        channels,
        sampling_rate_hz=settings.sampling_rate_hz,
        nperseg=settings.nperseg,
        noverlap=settings.noverlap,
        low_hz=settings.low_hz,
        high_hz=settings.high_hz,
        n_peaks=settings.n_peaks,
    )
