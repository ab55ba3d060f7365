"""The overview bundle: layout, metrics, trends, correlations, event groups and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwave.functions import times
from spanwave.operators import joins, overview
from spanwave.session import cut_lineage


def build(records: DataFrame, samples: DataFrame | None = None, *, tile_seconds: int = 60) -> dict[str, DataFrame]:
    """Every table of the bundle; waveform previews only when ``samples`` are given."""
    layout = cut_lineage(overview.sensor_layout(records))
    metrics = cut_lineage(overview.metric_rows(overview.sensor_metrics(records)))
    groups = overview.event_groups(records)
    tables = {
        "sensor_layout": layout,
        "sensor_metrics": metrics,
        "sensor_trends": overview.trend_rows(metrics),
        "correlations": overview.correlations(metrics, layout),
        "event_groups": groups,
    }
    if samples is None:
        return tables
    chosen = overview.preview_events(groups).select("set_name", "deck", "start_time", "end_time")
    keyed = records.withColumns(
        {
            "start_time": times.iso_seconds(F.col("start_time_utc")),
            "end_time": times.iso_seconds(F.col("end_time_utc")),
        }
    )
    wanted = keyed.join(chosen, ["set_name", "deck", "start_time", "end_time"], "left_semi")
    keys = ["set_name", "deck", "start_time", "end_time", "sensor_name"]
    sliced = joins.slice_records(wanted, samples).withColumn(
        "tile", times.time_tile(F.col("timestamp_utc"), tile_seconds)
    )
    numbered = cut_lineage(overview.numbered_previews(sliced, keys).select(*keys, "sample_index", "timestamp_utc", "value"))
    value = F.round(F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.lit(0.0)), 6)
    tables["waveforms"] = overview.downsample(numbered, keys).withColumn("value", value)
    return tables
