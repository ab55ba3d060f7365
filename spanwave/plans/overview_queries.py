"""Registered queries: sensor metrics, bands, trends, correlations and layout look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwave.operators import overview
from spanwave.plans import event_queries
from spanwave.plans.oracle_views import rnd, with_views
from spanwave.plans.registry import query, tidy
from spanwave.session import cut_lineage
from spanwave.sources import tables

_METRICS = {
    "m": "SELECT set_name, sensor_name, split_part(sensor_name, '_', 5) AS measurement_family, regexp_extract(set_name, '(SET[0-9]+)_', 1) AS set_label, "
    "CAST(regexp_extract(set_name, 'SET([0-9]+)_', 1) AS BIGINT) AS set_position, CAST(count(*) AS DOUBLE) AS event_count, avg(range_value) AS mean_range, "
    "avg(abs(mean_value)) AS mean_abs_mean_value, avg(duration) AS mean_duration, avg(temperature) AS mean_temperature FROM records GROUP BY ALL",
    "long": "SELECT set_name, set_label, set_position, sensor_name, measurement_family, metric_id, round_even(value, 6) AS value FROM "
    "(UNPIVOT m ON event_count, mean_range, mean_abs_mean_value, mean_duration, mean_temperature INTO NAME metric_id VALUE value) WHERE value IS NOT NULL",
    "banded": "SELECT *, CASE WHEN n = 1 THEN 'mid' WHEN value <= low THEN 'low' WHEN value >= high THEN 'high' ELSE 'mid' END AS status_band, "
    "CASE WHEN metric_id = 'event_count' THEN 'records' WHEN metric_id = 'mean_duration' THEN 's' WHEN metric_id = 'mean_temperature' THEN 'deg C' "
    "WHEN measurement_family = 'ACC' THEN 'g' ELSE 'mm/m' END AS unit FROM long JOIN (SELECT set_name, metric_id, measurement_family, "
    "quantile_cont(value, 0.2) AS low, quantile_cont(value, 0.8) AS high, count(*) AS n FROM long GROUP BY ALL) USING (set_name, metric_id, measurement_family)",
}


def _metrics_long(spark, folder):
    return overview.metric_rows(overview.sensor_metrics(tables.records(spark, folder)))


@query(
    "sensor_metrics",
    with_views(
        f"SELECT set_name, set_label, set_position, sensor_name, measurement_family, CAST(event_count AS BIGINT) AS event_count, {rnd('mean_range', 8)} AS mean_range, "
        f"{rnd('mean_abs_mean_value')} AS mean_abs_mean_value, {rnd('mean_duration', 8)} AS mean_duration, {rnd('mean_temperature')} AS mean_temperature FROM m",
        "records",
        extra=_METRICS,
    ),
)
def sensor_metrics(spark, folder):
    return tidy(overview.sensor_metrics(tables.records(spark, folder)), {"mean_range": 8, "mean_duration": 8})


@query(
    "status_bands",
    with_views(
        f"SELECT set_name, sensor_name, metric_id, unit, status_band, {rnd('value')} AS value FROM banded", "records", extra=_METRICS
    ),
)
def status_bands(spark, folder):
    """Long metrics with unit and band within set, metric and family."""
    rows = _metrics_long(spark, folder)
    return tidy(rows.select("set_name", "sensor_name", "metric_id", "unit", "status_band", "value"))


@query(
    "metric_trends",
    with_views(
        "SELECT sensor_name, metric_id, measurement_family, unit, count(*) AS points, string_agg(set_label || ':' || status_band, ',' ORDER BY set_position) AS series "
        "FROM banded GROUP BY ALL",
        "records",
        extra=_METRICS,
    ),
)
def metric_trends(spark, folder):
    """Points of each sensor and metric in set order."""
    trends = overview.trend_rows(_metrics_long(spark, folder))
    series = F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["set_label"], p["status_band"])), ",")
    return trends.select(
        "sensor_name",
        "metric_id",
        "measurement_family",
        "unit",
        F.size("points").cast("bigint").alias("points"),
        series.alias("series"),
    )


_CORR = {
    **_METRICS,
    "pairs": "SELECT a.metric_id, a.sensor_name AS a, b.sensor_name AS b, count(*) AS n, corr(a.value, b.value) AS r, var_pop(a.value) AS va, var_pop(b.value) AS vb "
    "FROM long a JOIN long b ON a.metric_id = b.metric_id AND a.set_name = b.set_name AND a.sensor_name <> b.sensor_name GROUP BY ALL",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric_id, a ORDER BY round(abs(r), 9) DESC, b) AS rank FROM pairs WHERE n >= 3 AND va > 1e-18 AND vb > 1e-18) WHERE rank <= 3",
}


@query(
    "metric_correlations",
    with_views(
        f"SELECT a AS sensor_name, b AS target_sensor, metric_id, {rnd('r')} AS correlation, rank, "
        "split_part(a, '_', 1) = split_part(b, '_', 1) AS same_deck, split_part(a, '_', 5) = split_part(b, '_', 5) AS same_measurement_family, "
        "substr(a, 4) = substr(b, 4) AS cross_deck_homologous, split_part(a, '_', 2) = split_part(b, '_', 2) AND "
        "(a LIKE '%SHE%') = (b LIKE '%SHE%') AS same_section FROM best",
        "records",
        extra=_CORR,
    ),
)
def metric_correlations(spark, folder):
    """Three most correlated partners of each sensor and metric."""
    rows = cut_lineage(tables.records(spark, folder))
    long = overview.metric_rows(overview.sensor_metrics(rows))
    return tidy(overview.correlations(long, overview.sensor_layout(rows)))


@query(
    "event_groups",
    with_views(
        "SELECT set_name || ':' || deck || ':' || s || ':' || e AS event_group_id, set_name, deck, s AS start_time, e AS end_time, count(DISTINCT sensor_name) AS sensor_count, "
        "string_agg(DISTINCT sensor_name, ',' ORDER BY sensor_name) AS sensor_ids, string_agg(DISTINCT split_part(sensor_name, '_', 2), ',' ORDER BY split_part(sensor_name, '_', 2)) AS spans, "
        "string_agg(DISTINCT split_part(sensor_name, '_', 5), ',' ORDER BY split_part(sensor_name, '_', 5)) AS measurement_families FROM "
        "(SELECT *, strftime(start_time_utc, '%Y-%m-%dT%H:%M:%SZ') AS s, strftime(event_end_time_utc, '%Y-%m-%dT%H:%M:%SZ') AS e FROM grouped) GROUP BY ALL",
        "grouped",
    ),
)
def event_groups(spark, folder):
    """Records grouped by set, deck and window to the second."""
    from spanwave.operators import events

    grouped = events.assign_event_groups(tables.records(spark, folder), "shared_start")
    shared = grouped.withColumn("end_time_utc", F.col("event_end_time_utc"))
    return tidy(overview.event_groups(shared))


@query(
    "preview_events",
    with_views(
        "SELECT set_name, deck, start_time, sensor_count, preview_rank FROM (SELECT *, row_number() OVER (PARTITION BY set_name, deck ORDER BY sensor_count DESC, start_time) AS preview_rank FROM "
        "(SELECT set_name, deck, strftime(start_time_utc, '%Y-%m-%dT%H:%M:%SZ') AS start_time, count(DISTINCT sensor_name) AS sensor_count FROM grouped GROUP BY ALL)) WHERE preview_rank <= 2",
        "grouped",
    ),
)
def preview_events(spark, folder):
    """Two fullest events of each set and deck."""
    from spanwave.operators import events

    grouped = events.assign_event_groups(tables.records(spark, folder), "shared_start")
    groups = overview.event_groups(grouped.withColumn("end_time_utc", F.col("event_end_time_utc")))
    chosen = overview.preview_events(groups)
    return tidy(chosen.select("set_name", "deck", "start_time", "sensor_count", "preview_rank"))


@query(
    "homologous_pairs",
    with_views(
        f"SELECT a.set_name, a.metric_id, a.sensor_name, {rnd('a.value')} AS value, {rnd('b.value')} AS homologous_value FROM long a LEFT JOIN long b "
        "ON b.set_name = a.set_name AND b.metric_id = a.metric_id AND b.sensor_name = (CASE WHEN a.sensor_name LIKE 'OLD%' THEN 'NEW' ELSE 'OLD' END) || substr(a.sensor_name, 4)",
        "records",
        extra=_METRICS,
    ),
)
def homologous_pairs(spark, folder):
    """Each metric beside that of the same sensor on the other deck."""
    pairs = overview.homologous_pairs(_metrics_long(spark, folder))
    return tidy(
        pairs.select("set_name", "metric_id", "sensor_name", "value", "homologous_value")
    )


_LAYOUT = {
    "l": "SELECT *, CASE WHEN family = 'ACC' OR loc IN ('INF', 'SUP') THEN 'MID' ELSE 'SHE' END AS section FROM (SELECT DISTINCT sensor_name, split_part(sensor_name, '_', 1) AS deck, "
    "split_part(sensor_name, '_', 2) AS span, split_part(sensor_name, '_', 4) AS loc, split_part(sensor_name, '_', 5) AS family, split_part(sensor_name, '_', 6) AS axis FROM readings)"
}


@query(
    "related_sensors",
    with_views(
        "SELECT sensor_name, related_sensor, position FROM (SELECT a.sensor_name, b.sensor_name AS related_sensor, row_number() OVER (PARTITION BY a.sensor_name ORDER BY b.sensor_name) AS position "
        "FROM l a JOIN l b ON a.deck = b.deck AND a.span = b.span AND a.family = b.family AND a.sensor_name <> b.sensor_name AND (a.family <> 'ACC' OR a.section = b.section)) WHERE position <= 4",
        "readings",
        extra=_LAYOUT,
    ),
)
def related_sensors(spark, folder):
    """Up to four sensors near each sensor."""
    return tidy(overview.related_sensors(overview.sensor_layout(tables.readings(spark, folder))))


@query(
    "facet_filter",
    with_views(
        "SELECT 'faceted' AS kind, sensor_name FROM l WHERE family = 'STR' AND deck = 'OLD' AND section = 'MID' UNION ALL "
        "SELECT 'isolated', sensor_name FROM l WHERE (deck = 'NEW' AND span = 'S2' AND section = 'MID') OR sensor_name = 'OLD_S2_DO_INF_STR'",
        "readings",
        extra=_LAYOUT,
    ),
)
def facet_filter(spark, folder):
    """Sensors by facets, and the neighbourhood and partner of one sensor."""
    layout = overview.sensor_layout(tables.readings(spark, folder))
    faceted = overview.facet_filter(layout, family="STR", deck=["OLD"], section=["MID"], span=[])
    isolated = overview.facet_filter(layout, isolate=layout.filter("sensor_name = 'NEW_S2_DO_INF_STR'"))
    return faceted.select(F.lit("faceted").alias("kind"), "sensor_name").unionByName(
        isolated.select(F.lit("isolated").alias("kind"), "sensor_name")
    )
