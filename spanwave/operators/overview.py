"""Per-sensor metrics over sets and the tables built from them: bands, trends, correlations, groups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwave.functions import naming, numbers, times
from spanwave.operators import sequence

# The exported metrics, in catalogue order.
METRICS = ("event_count", "mean_range", "mean_abs_mean_value", "mean_duration", "mean_temperature")
PREVIEW_EVENTS = 2
PREVIEW_SAMPLES = 240


def with_layout(df: DataFrame) -> DataFrame:
    return df.withColumns(naming.layout_parts(F.col("sensor_name")))


def sensor_layout(records: DataFrame) -> DataFrame:
    """Placement of every allowed sensor; the partner on the other deck is NULL when it is absent."""
    names = records.select("sensor_name").distinct()
    placed = with_layout(names).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    partner = names.select(F.col("sensor_name").alias("homologous_sensor_id"), F.lit(True).alias("_known"))
    return (
        placed.join(partner, "homologous_sensor_id", "left")
        .withColumn("homologous_sensor_id", F.when(F.col("_known"), F.col("homologous_sensor_id")))
        .drop("_known")
    )


def layout_rejects(names: DataFrame) -> DataFrame:
    return with_layout(names.select("sensor_name").distinct()).filter(
        F.col("reject_reason").isNotNull()
    ).select("sensor_name", "reject_reason")


def sensor_metrics(records: DataFrame) -> DataFrame:
    """One row per set and sensor: record count and mean table values."""
    family = naming.layout_parts(F.col("sensor_name"))["measurement_family"]
    return records.groupBy("set_name", "sensor_name").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg("range_value").alias("mean_range"),
        F.avg(F.abs("mean_value")).alias("mean_abs_mean_value"),
        F.avg("duration").alias("mean_duration"),
        F.avg("temperature").alias("mean_temperature"),
    ).withColumns(
        {
            "set_label": naming.set_label(F.col("set_name")),
            "set_position": naming.set_position(F.col("set_name")),
            "measurement_family": family,
        }
    )


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Long metric table with units and a status band relative to (set, metric, family).

    The band compares a handful of sensors, so its quantiles are plain aggregates.
    """
    as_double = metrics.withColumn("event_count", F.col("event_count").cast("double"))
    long = as_double.unpivot(
        ["set_name", "set_label", "set_position", "sensor_name", "measurement_family"],
        list(METRICS),
        "metric_id",
        "value",
    ).filter(F.col("value").isNotNull())
    rounded = long.withColumns(
        {
            "value": numbers.round_half_even(F.col("value")),
            "unit": naming.metric_unit(F.col("metric_id"), F.col("measurement_family")),
        }
    )
    keys = ["set_name", "metric_id", "measurement_family"]
    limits = rounded.groupBy(*keys).agg(
        F.percentile("value", F.lit(0.2)).alias("_low"),
        F.percentile("value", F.lit(0.8)).alias("_high"),
        F.count(F.lit(1)).alias("_n"),
    )
    band = (
        F.when(F.col("_n") == 1, F.lit("mid"))
        .when(F.col("value") <= F.col("_low"), F.lit("low"))
        .when(F.col("value") >= F.col("_high"), F.lit("high"))
        .otherwise(F.lit("mid"))
    )
    return rounded.join(limits, keys).withColumn("status_band", band).drop("_low", "_high", "_n")


def trend_rows(metrics_long: DataFrame) -> DataFrame:
    """Points of each sensor and metric over sets, in set order."""
    point = F.struct("set_position", "set_name", "set_label", "value", "status_band")
    return metrics_long.groupBy("sensor_name", "metric_id", "measurement_family", "unit").agg(
        F.array_sort(F.collect_list(point)).alias("points")
    )


def correlations(
    metrics_long: DataFrame, layout: DataFrame, *, min_points: int = 3, partners: int = 3
) -> DataFrame:
    """Each sensor's most correlated partners per metric, over the sets both have.

    Pairs are formed per (metric, set) among the sensors of the layout, which are few; the rows are
    metric aggregates, never samples. Constant series have no correlation.
    """
    a = metrics_long.select("metric_id", "set_name", F.col("sensor_name").alias("a"), F.col("value").alias("x"))
    b = metrics_long.select("metric_id", "set_name", F.col("sensor_name").alias("b"), F.col("value").alias("y"))
    x, y, n = F.col("x"), F.col("y"), F.count(F.lit(1))
    shared = (
        a.join(b, ["metric_id", "set_name"])
        .filter(F.col("a") != F.col("b"))
        .groupBy("metric_id", "a", "b")
        .agg(
            n.alias("n"),
            F.covar_pop("x", "y").alias("cov"),
            F.var_pop(x).alias("vx"),
            F.var_pop(y).alias("vy"),
        )
        .filter((F.col("n") >= min_points) & (F.col("vx") > 1e-18) & (F.col("vy") > 1e-18))
        .withColumn("r", F.col("cov") / F.sqrt(F.col("vx") * F.col("vy")))
    )
    ranking = Window.partitionBy("metric_id", "a").orderBy(F.desc(F.round(F.abs("r"), 9)), "b")
    best = shared.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= partners)
    place = ["section_key", "deck", "measurement_family", "homologous_sensor_id"]
    left = layout.select(F.col("sensor_name").alias("a"), *[F.col(c).alias(f"_a_{c}") for c in place])
    right = layout.select(F.col("sensor_name").alias("b"), *[F.col(c).alias(f"_b_{c}") for c in place])
    same = lambda c: F.col(f"_a_{c}") == F.col(f"_b_{c}")
    return (
        best.join(left, "a")
        .join(right, "b")
        .select(
            F.col("a").alias("sensor_name"),
            F.col("b").alias("target_sensor"),
            "metric_id",
            numbers.round_half_even(F.col("r")).alias("correlation"),
            "rank",
            same("section_key").alias("same_section"),
            same("deck").alias("same_deck"),
            F.coalesce(F.col("_a_homologous_sensor_id") == F.col("b"), F.lit(False)).alias(
                "cross_deck_homologous"
            ),
            same("measurement_family").alias("same_measurement_family"),
        )
    )


def event_groups(records: DataFrame) -> DataFrame:
    """Records grouped by set, deck and window at second precision, with what each group covers."""
    parts = naming.layout_parts(F.col("sensor_name"))
    rows = records.select(
        "set_name",
        parts["deck"].alias("deck"),
        "sensor_name",
        parts["span"].alias("span"),
        parts["measurement_family"].alias("family"),
        times.iso_seconds(F.col("start_time_utc")).alias("start_time"),
        times.iso_seconds(F.col("end_time_utc")).alias("end_time"),
    ).filter(F.col("start_time").isNotNull() & F.col("end_time").isNotNull())
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return rows.groupBy("set_name", "deck", "start_time", "end_time").agg(
        distinct("sensor_name").alias("sensor_ids"),
        distinct("span").alias("spans"),
        distinct("family").alias("measurement_families"),
    ).withColumns(
        {
            "sensor_count": F.size("sensor_ids").cast("bigint"),
            "event_group_id": F.concat_ws(":", "set_name", "deck", "start_time", "end_time"),
        }
    )


def preview_events(groups: DataFrame, per_deck: int = PREVIEW_EVENTS) -> DataFrame:
    """The fullest event groups of each set and deck, the earliest on ties.

    Ranked first within a day so that no deck is sorted in one task.
    """
    order = [F.desc("sensor_count"), "start_time", "end_time"]
    day = Window.partitionBy("set_name", "deck", F.substring("start_time", 1, 10)).orderBy(*order)
    deck = Window.partitionBy("set_name", "deck").orderBy(*order)
    return (
        groups.withColumn("preview_rank", F.row_number().over(day))
        .filter(F.col("preview_rank") <= per_deck)
        .withColumn("preview_rank", F.row_number().over(deck))
        .filter(F.col("preview_rank") <= per_deck)
    )


def downsample(samples: DataFrame, keys: Sequence[str], max_samples: int = PREVIEW_SAMPLES) -> DataFrame:
    """Every k-th sample so that about ``max_samples`` remain, and always the last one."""
    lengths = samples.groupBy(*keys).agg((F.max("sample_index") + 1).alias("_n"))
    step = F.greatest(F.ceil(F.col("_n") / F.lit(max_samples)), F.lit(1))
    keep = (F.pmod(F.col("sample_index"), step) == 0) | (F.col("sample_index") == F.col("_n") - 1)
    return samples.join(lengths, list(keys)).filter(keep).drop("_n")


def homologous_pairs(metrics_long: DataFrame) -> DataFrame:
    """Each sensor's metric beside that of its partner on the other deck, NULL without one."""
    layout = naming.layout_parts(F.col("sensor_name"))
    own = metrics_long.withColumn("homologous_sensor_id", layout["homologous_sensor_id"])
    partner = metrics_long.select(
        "set_name",
        "metric_id",
        F.col("sensor_name").alias("homologous_sensor_id"),
        F.col("value").alias("homologous_value"),
    )
    return own.join(partner, ["set_name", "metric_id", "homologous_sensor_id"], "left")


def related_sensors(layout: DataFrame, limit: int = 4) -> DataFrame:
    """Sensors near each sensor: same deck, span and family, and same section for accelerometers."""
    other = layout.select(
        F.col("sensor_name").alias("related_sensor"),
        "deck",
        "span",
        "measurement_family",
        F.col("section").alias("_section"),
    )
    near = (F.col("measurement_family") != "ACC") | (F.col("section") == F.col("_section"))
    ranked = Window.partitionBy("sensor_name").orderBy("related_sensor")
    return (
        layout.select("sensor_name", "deck", "span", "measurement_family", "section")
        .join(other, ["deck", "span", "measurement_family"])
        .filter((F.col("sensor_name") != F.col("related_sensor")) & near)
        .withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= limit)
        .select("sensor_name", "related_sensor", "position")
    )


def facet_filter(
    layout: DataFrame,
    *,
    family: str = "ALL",
    isolate: DataFrame | None = None,
    **facets: Iterable[str],
) -> DataFrame:
    """Sensors that pass every facet (deck, span, side, section, axis_or_fibre); an empty facet passes all.

    ``isolate`` (one layout row) narrows to that sensor, its partner and its neighbourhood.
    """
    condition: Column = F.lit(True)
    if family != "ALL":
        condition = condition & (F.col("measurement_family") == family)
    for column, wanted in facets.items():
        wanted = list(wanted)
        if wanted:
            condition = condition & F.col(column).isin(wanted)
    kept = layout.filter(condition)
    if isolate is None:
        return kept
    near = ["deck", "span", "section"]
    neighbours = kept.join(isolate.select(*near), near, "left_semi")
    pair = isolate.select("sensor_name").unionByName(
        isolate.select(F.col("homologous_sensor_id").alias("sensor_name"))
    )
    return neighbours.unionByName(kept.join(pair, "sensor_name", "left_semi")).dropDuplicates(["sensor_name"])


def numbered_previews(samples: DataFrame, keys: Sequence[str], tile: str = "tile") -> DataFrame:
    """Samples with a position in their waveform, ready for :func:`downsample`."""
    return sequence.ordinal(samples, keys, ["timestamp_utc", "row_1based"], tile, "sample_index")
