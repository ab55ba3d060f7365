"""Registered queries: errors, thresholds, exceedances, health scores and projections.

The reconstruction under test replaces each value by its channel's mean in the event, which SQL can
repeat; the fitted low-rank reconstruction has its own query.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanwave.operators import scoring, tensors
from spanwave.plans import event_queries, feature_queries
from spanwave.plans.oracle_views import iso, rnd, with_views
from spanwave.plans.registry import query, tidy
from spanwave.session import cut_lineage, stage
from spanwave.sources import tables

REFERENCE = "SPAN_SET1_2024_01"
MEASURES = ["strain", "acc", "temperature", "total"]

# Channels 0-3 stand for strain, 4-7 for acceleration; a sample pairs channel c with c + 4.
_ERRORS = {
    "guess": "SELECT *, avg(value) OVER (PARTITION BY event_id, channel) AS guess FROM tensor_values",
    "mse": "SELECT event_id, set_name, vec_id, channel, avg((value - guess) * (value - guess)) * 100 AS mse FROM guess GROUP BY ALL",
    "errors": "SELECT s.event_id, s.set_name, s.vec_id, s.channel, s.mse AS strain, a.mse AS acc, (s.vec_id % 30) / 100.0 AS temperature, "
    "s.mse + a.mse + 0.1 * ((s.vec_id % 30) / 100.0) AS total FROM mse s JOIN mse a ON a.event_id = s.event_id AND a.channel = s.channel + 4",
    "scores": "SELECT event_id, set_name, vec_id, avg(strain) AS strain, avg(acc) AS acc, avg(total) AS total, avg(temperature) * 100 AS temperature "
    "FROM errors GROUP BY ALL",
    "lim": f"SELECT quantile_cont(total, 0.99) AS threshold FROM scores WHERE set_name = '{REFERENCE}'",
    "flagged": "SELECT s.*, threshold, total > threshold AS above FROM scores s, lim",
}


def _array_errors(spark, folder):
    """One row per event with the error of each of its eight channels; nothing is exploded or shuffled."""
    rows = tables.tensors(spark, folder)
    errors = F.transform(scoring.channel_errors(F.col("values"), 8), lambda e: e * 100)
    return rows.select("event_id", "set_name", "vec_id", errors.alias("m"), ((F.col("vec_id") % 30) / 100).alias("temperature"))


def sample_errors(spark, folder):
    """Channel c and c + 4 of an event are the two halves of a sample."""
    rows = _array_errors(spark, folder).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("channel"))
    halves = rows.select(
        "event_id",
        "set_name",
        "vec_id",
        "channel",
        F.get("m", F.col("channel")).alias("strain"),
        F.get("m", F.col("channel") + 4).alias("acc"),
        "temperature",
    )
    return halves.withColumn("total", scoring.total_error(F.col("strain"), F.col("acc"), F.col("temperature")))


def event_scores(spark, folder):
    strain, acc = (scoring.mean_of(F.slice("m", first, 4)) for first in (1, 5))
    means = _array_errors(spark, folder).select(
        "event_id", "set_name", "vec_id", strain.alias("strain"), acc.alias("acc"), "temperature"
    )
    total = scoring.total_error(F.col("strain"), F.col("acc"), F.col("temperature"))
    return means.withColumn("total", total).withColumn("temperature", F.col("temperature") * 100)


def staged_scores(spark, folder):
    """Event scores written once: the arrays behind them are read by one scan, however often the scores are."""
    return stage(event_scores(spark, folder))


def reference():
    return F.col("set_name") == REFERENCE


def flagged(spark, folder):
    scores = staged_scores(spark, folder)
    return scoring.flag_exceedances(scores, scoring.threshold(scores, reference()))


@query(
    "sample_errors",
    with_views(
        f"SELECT event_id, channel, {rnd('strain')} AS strain, {rnd('acc')} AS acc, {rnd('temperature')} AS temperature, {rnd('total')} AS total FROM errors",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def sample_error_table(spark, folder):
    """Squared errors per sample and modality with the weighted total."""
    return tidy(sample_errors(spark, folder).drop("set_name", "vec_id"))


@query(
    "array_errors",
    with_views(
        f"SELECT event_id, {rnd('avg((value - 0.5 * value) * (value - 0.5 * value))', 8)} AS mse FROM tensor_values GROUP BY event_id",
        "tensor_values",
    ),
)
def array_errors(spark, folder):
    """Error between two array columns, row by row without exploding."""
    half = F.transform("values", lambda v: v * 0.5)
    rows = tables.tensors(spark, folder)
    return tidy(rows.select("event_id", scoring.squared_error(F.col("values"), half).alias("mse")), {"mse": 8})


@query(
    "event_scores",
    with_views(
        f"SELECT event_id, set_name, {rnd('strain')} AS strain, {rnd('acc')} AS acc, {rnd('total')} AS total FROM scores",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def event_score_table(spark, folder):
    return tidy(event_scores(spark, folder).select("event_id", "set_name", "strain", "acc", "total"))


@query(
    "reference_threshold",
    with_views(f"SELECT {rnd('threshold')} AS threshold FROM lim", "tensor_values", extra=_ERRORS),
)
def reference_threshold(spark, folder):
    """99th percentile of the reference set's scores."""
    return tidy(scoring.threshold(staged_scores(spark, folder), reference()))


@query(
    "exceedance_rates",
    with_views(
        f"SELECT set_name, count(*) AS event_count, count(*) FILTER (above) AS above_count, {rnd('count(*) FILTER (above) / count(*)', 8)} AS above_rate "
        "FROM flagged GROUP BY set_name",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def exceedance_rates(spark, folder):
    return tidy(scoring.exceedance_rates(flagged(spark, folder), ["set_name"]), {"above_rate": 8})


@query(
    "modality_rates",
    with_views(
        f"SELECT set_name, modality, count(*) AS event_count, count(*) FILTER (score > threshold) AS above_count, "
        f"{rnd('count(*) FILTER (score > threshold) / count(*)', 8)} AS above_rate FROM long JOIN "
        f"(SELECT modality, quantile_cont(score, 0.99) AS threshold FROM long WHERE set_name = '{REFERENCE}' GROUP BY modality) USING (modality) "
        "GROUP BY set_name, modality",
        "tensor_values",
        extra={
            **_ERRORS,
            "long": "SELECT set_name, 'STR' AS modality, strain AS score FROM scores UNION ALL SELECT set_name, 'ACC', acc FROM scores "
            "UNION ALL SELECT set_name, 'ALL', total FROM scores",
        },
    ),
)
def modality_rates(spark, folder):
    """Exceedance rate of each set by modality, each against its own reference threshold."""
    scores = staged_scores(spark, folder)
    rates = scoring.modality_rates(scores, reference(), {"strain": "STR", "acc": "ACC", "total": "ALL"})
    return tidy(rates, {"above_rate": 8})


_COMPARE = (
    f"SELECT set_name, count(*) AS n_events, avg(total) AS mean_error, stddev_pop(total) AS std_error, "
    "100.0 * count(*) FILTER (above) / count(*) AS pct_above, avg(temperature) AS mean_temperature, min(temperature) AS min_temperature, "
    "max(temperature) AS max_temperature, median(total) AS median_error FROM flagged GROUP BY set_name"
)


@query(
    "set_comparison",
    with_views(
        f"SELECT set_name, n_events, {rnd('mean_error')} AS mean_error, {rnd('std_error')} AS std_error, {rnd('pct_above')} AS pct_above, "
        f"{rnd('mean_temperature')} AS mean_temperature, {rnd('min_temperature')} AS min_temperature, "
        f"{rnd('max_temperature')} AS max_temperature, {rnd('median_error')} AS median_error FROM cmp",
        "tensor_values",
        extra={**_ERRORS, "cmp": _COMPARE},
    ),
)
def set_comparison(spark, folder):
    return tidy(scoring.compare_sets(flagged(spark, folder)))


@query(
    "median_change",
    with_views(
        f"SELECT set_name, {rnd('median_error')} AS median_error, {rnd('(median_error - base) * 100 / base')} AS relative_change_pct FROM cmp, "
        f"(SELECT median_error AS base FROM cmp WHERE set_name = '{REFERENCE}') WHERE set_name <> '{REFERENCE}'",
        "tensor_values",
        extra={**_ERRORS, "cmp": _COMPARE},
    ),
)
def median_change(spark, folder):
    """Median of each set against the reference set's, in percent."""
    summary = stage(scoring.compare_sets(flagged(spark, folder)))
    return tidy(scoring.relative_change(summary, REFERENCE))


_SPLITS = "CASE vec_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' WHEN 2 THEN 'val' ELSE 'train' END"


@query(
    "error_by_split",
    with_views(
        f"SELECT {_SPLITS} AS split, count(*) AS n, {rnd('avg(total)')} AS total_mean, {rnd('stddev_pop(total)')} AS total_std, "
        f"{rnd('avg(strain)')} AS strain_mean, {rnd('stddev_pop(strain)')} AS strain_std FROM errors GROUP BY split",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def error_by_split(spark, folder):
    part = F.col("vec_id") % 10
    split = F.when(part == 0, F.lit("test")).when(part.isin(1, 2), F.lit("val")).otherwise(F.lit("train"))
    errors = sample_errors(spark, folder).withColumn("split", split)
    return tidy(scoring.error_summary(errors, ["split"], ["total", "strain"]))


@query(
    "error_by_channel",
    with_views(
        f"SELECT channel, count(*) AS n, {rnd('avg(strain)')} AS strain_mean, {rnd('stddev_pop(strain)')} AS strain_std, "
        f"{rnd('avg(acc)')} AS acc_mean, {rnd('stddev_pop(acc)')} AS acc_std FROM errors GROUP BY channel",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def error_by_channel(spark, folder):
    return tidy(scoring.error_summary(sample_errors(spark, folder), ["channel"], ["strain", "acc"]))


@query(
    "channel_diagnostics",
    with_views(
        f"SELECT set_name, channel, {rnd('min(value)')} AS min_value, {rnd('max(value)')} AS max_value, {rnd('avg(value)')} AS mean_value, "
        f"{rnd('stddev_pop(value)')} AS std_value FROM tensor_values GROUP BY set_name, channel",
        "tensor_values",
    ),
)
def channel_diagnostics(spark, folder):
    return tidy(scoring.value_diagnostics(tables.tensor_values(spark, folder), ["set_name", "channel"]))


@query(
    "sanity_flags",
    with_views(
        "SELECT event_id, channel, bool_or(isnan(v)) AS has_nan, coalesce(max(abs(v)) FILTER (channel < 4 AND NOT isnan(v)) > 0.3, false) AS strain_too_large, "
        "coalesce(max(v) FILTER (channel >= 4 AND NOT isnan(v)) > 0.25, false) AS acc_too_large FROM "
        "(SELECT *, CASE WHEN (vec_id + position) % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v FROM tensor_values) GROUP BY event_id, channel",
        "tensor_values",
    ),
)
def sanity_flags(spark, folder):
    """Channels with missing or outsized values."""
    holes = F.when((F.col("vec_id") + F.col("position")) % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    modality = F.when(F.col("channel") < 4, F.lit("strain")).otherwise(F.lit("acc"))
    values = tables.tensor_values(spark, folder).withColumns({"value": holes, "modality": modality})
    return tidy(scoring.sanity_flags(values, ["event_id", "channel"], max_abs_strain=0.3, max_acc=0.25))


@query(
    "score_histogram",
    with_views(
        "SELECT set_name, CAST(least(floor(coalesce((v - lo) / nullif(hi - lo, 0), 0) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM "
        "(SELECT *, min(v) OVER (PARTITION BY set_name) AS lo, max(v) OVER (PARTITION BY set_name) AS hi FROM "
        "(SELECT set_name, least(total, clip) AS v FROM scores, (SELECT quantile_cont(total, 0.995) AS clip FROM scores))) GROUP BY ALL",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def score_histogram(spark, folder):
    """Scores of each set in equal bins, clipped at the 99.5th percentile of all sets."""
    return scoring.histogram(staged_scores(spark, folder), ["set_name"], "total", bins=20)


@query(
    "score_quartiles",
    with_views(
        f"SELECT set_name, {rnd('quantile_cont(total, 0.25)')} AS q1, {rnd('median(total)')} AS median, {rnd('quantile_cont(total, 0.75)')} AS q3 "
        "FROM scores GROUP BY set_name",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def score_quartiles(spark, folder):
    return tidy(scoring.box_quantiles(staged_scores(spark, folder), ["set_name"], "total"))


@query(
    "extreme_events",
    with_views(
        f"SELECT event_id, set_name, {rnd('total')} AS total FROM scores ORDER BY scores.total DESC, event_id LIMIT 10",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def extreme_events(spark, folder):
    """The ten highest scores of all sets."""
    return tidy(scoring.most_extreme(event_scores(spark, folder)).select("event_id", "set_name", "total"))


@query(
    "worst_channels",
    with_views(
        f"SELECT event_id, CAST(first(channel ORDER BY total DESC, channel) AS BIGINT) AS worst_channel, {rnd('max(total)')} AS worst_error FROM errors GROUP BY event_id",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def worst_channels(spark, folder):
    return tidy(scoring.worst_channels(sample_errors(spark, folder), ["event_id"], "channel", "total"))


@query(
    "worst_sensor_counts",
    with_views(
        "SELECT CAST(worst AS BIGINT) AS worst_channel, count(*) AS event_count FROM (SELECT event_id, first(channel ORDER BY norm DESC, channel) AS worst FROM "
        "(SELECT event_id, channel, sqrt(sum(power(value - guess, 4))) AS norm FROM guess GROUP BY ALL) GROUP BY event_id) GROUP BY worst",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def worst_sensor_counts(spark, folder):
    """How often each channel has the largest error norm."""
    per_channel = Window.partitionBy("event_id", "channel")
    gap = F.col("value") - F.avg("value").over(per_channel)
    values = tables.tensor_values(spark, folder).withColumn("gap", gap)
    return tidy(scoring.worst_sensor_counts(values.withColumn("squared_error", F.col("gap") * F.col("gap"))))


@query(
    "best_and_worst_events",
    with_views(
        "SELECT set_name, first(event_id ORDER BY total, event_id) AS best_event, first(event_id ORDER BY total DESC, event_id DESC) AS worst_event "
        "FROM scores GROUP BY set_name",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def best_and_worst_events(spark, folder):
    return scoring.best_and_worst(event_scores(spark, folder), ["set_name"], "total")


@query(
    "chronological_scores",
    with_views(
        f"SELECT event_id, {iso('start_time_utc')} AS event_time, active_sensor_count AS score, active_sensor_count > 5 AS above FROM event_list",
        "event_list",
    ),
)
def chronological_scores(spark, folder):
    """Scores in time order, the time read from the event id."""
    found = event_queries.event_list(spark, folder).select("event_id", F.col("active_sensor_count").alias("score"))
    return tidy(scoring.chronological(found.withColumn("above", F.col("score") > 5)))


_FEATURES = ["waveform_mean", "waveform_rms", "waveform_peak_to_peak"]


@query(
    "baseline_scores",
    with_views(
        f"SELECT event_id, set_name, {rnd('median(z)')} AS score, count(*) AS feature_count FROM (SELECT l.event_id, l.set_name, "
        "abs((l.value - f.m) / f.s) AS z FROM long l JOIN fit f USING (sensor_name, feature) WHERE f.s > 0) GROUP BY ALL",
        "waveforms",
        extra={
            "long": "SELECT event_id, set_name, sensor_name, 'mean' AS feature, avg(value) AS value FROM waveforms GROUP BY ALL UNION ALL "
            "SELECT event_id, set_name, sensor_name, 'rms', sqrt(avg(value * value)) FROM waveforms GROUP BY ALL UNION ALL "
            "SELECT event_id, set_name, sensor_name, 'p2p', max(value) - min(value) FROM waveforms GROUP BY ALL",
            "fit": f"SELECT sensor_name, feature, avg(value) AS m, stddev_samp(value) AS s FROM long WHERE set_name = '{REFERENCE}' GROUP BY ALL",
        },
    ),
)
def baseline_scores(spark, folder):
    """Median absolute Z of an event's features against the reference set."""
    value = F.col("value")
    table = tables.waveforms(spark, folder).groupBy("event_id", "set_name", "sensor_name").agg(
        F.avg(value).alias(_FEATURES[0]),
        F.sqrt(F.avg(value * value)).alias(_FEATURES[1]),
        (F.max(value) - F.min(value)).alias(_FEATURES[2]),
    )
    return tidy(scoring.baseline_scores(table, reference(), _FEATURES))


_BAND = (
    "CASE WHEN pct_above <= 1.5 THEN 'near_reference' WHEN pct_above <= 3 THEN 'slight' WHEN pct_above <= 4.5 THEN 'moderate' "
    "WHEN pct_above <= 6 THEN 'marked' ELSE 'most_deviated' END"
)


@query(
    "health_bands",
    with_views(
        f"SELECT set_name, {rnd('pct_above')} AS pct_above, {_BAND} AS band, {rnd('greatest(0, (100 - (100 - pct_above)) / 12)')} AS anomaly FROM cmp",
        "tensor_values",
        extra={**_ERRORS, "cmp": _COMPARE},
    ),
)
def health_bands(spark, folder):
    """Band of each set's exceedance percentage, and the anomaly scale of a score."""
    summary = scoring.compare_sets(flagged(spark, folder))
    return tidy(
        summary.select(
            "set_name",
            "pct_above",
            scoring.health_band(F.col("pct_above")).alias("band"),
            scoring.score_to_anomaly(100 - F.col("pct_above")).alias("anomaly"),
        )
    )


@query(
    "set_health_scores",
    with_views(
        f"SELECT set_name, {rnd('frequency')} AS frequency, {rnd('severity')} AS severity, {rnd('least(100.0, coalesce(100 * base / nullif(burden, 0), 100.0))')} AS score FROM b, "
        f"(SELECT burden AS base FROM b WHERE set_name = '{REFERENCE}')",
        "tensor_values",
        extra={
            **_ERRORS,
            "b": "SELECT *, frequency * (1 + severity) AS burden FROM (SELECT set_name, count(*) FILTER (above) / count(*) AS frequency, "
            "avg(greatest(total / threshold - 1, 0)) AS severity FROM flagged GROUP BY set_name)",
        },
    ),
)
def set_health_scores(spark, folder):
    """Set score from how often and how far events pass the threshold (own definition)."""
    return tidy(scoring.set_scores(flagged(spark, folder), REFERENCE))


@query(
    "sensor_trends",
    with_views(
        f"SELECT sensor_name, count(*) AS sets, {rnd('regr_slope(y, x)')} AS slope, CASE WHEN regr_slope(y, x) > 0.5 THEN 'degrading' "
        "WHEN regr_slope(y, x) < -0.5 THEN 'improving' ELSE 'stable' END AS trend FROM (SELECT sensor_name, "
        "CAST(regexp_extract(set_name, 'SET([0-9]+)_', 1) AS DOUBLE) AS x, avg(abs(value)) AS y FROM readings GROUP BY ALL) GROUP BY sensor_name",
        "readings",
    ),
)
def sensor_trends(spark, folder):
    """Trend class of each sensor's level over the sets."""
    from spanwave.functions import naming

    history = tables.readings(spark, folder).groupBy(
        "sensor_name", naming.set_position(F.col("set_name")).alias("set_position")
    ).agg(F.avg(F.abs("value")).alias("level"))
    return tidy(scoring.sensor_trends(history, measure="level", tolerance=0.5))


@query(
    "rates_on_sensors",
    with_views(
        "SELECT s.sensor_name, s.set_name, s.set_token, s.family AS measurement_family, "
        "CASE WHEN s.family = 'ACC' THEN r.n * 0.5 ELSE r.n * 0.25 END AS rate_pct FROM "
        "(SELECT DISTINCT sensor_name, set_name, 'SET' || regexp_extract(set_name, 'SET([0-9]+)_', 1) AS set_token, "
        "split_part(sensor_name, '_', 5) AS family FROM readings) s JOIN (SELECT 'SET' || n AS set_token, n FROM range(1, 5) t(n)) r USING (set_token)",
        "readings",
    ),
)
def rates_on_sensors(spark, folder):
    """Set-level rates given to each sensor by family; a set without a rate gives none."""
    from spanwave.functions import naming

    sensors = tables.readings(spark, folder).select("sensor_name", "set_name").distinct().withColumn(
        "measurement_family", naming.layout_parts(F.col("sensor_name"))["measurement_family"]
    )
    rates = spark.createDataFrame(
        [(f"SET{n}", n * 0.5, n * 0.25) for n in range(1, 5)], "set_token string, acc_rate double, strain_rate double"
    )
    return scoring.attach_set_rates(sensors, rates)


@query(
    "metric_names_split",
    with_views(
        f"SELECT set_name, metric, {rnd('value')} AS value, split_part(metric, '_', 1) AS method, CASE split_part(metric, '_', 2) WHEN 'acc' THEN 'Accelerometers' "
        "WHEN 'sg' THEN 'Strain Gauges' WHEN 'comb' THEN 'All sensors' END AS type FROM (SELECT set_name, 'median_acc' AS metric, median(acc) AS value FROM scores GROUP BY ALL "
        "UNION ALL SELECT set_name, 'median_sg', median(strain) FROM scores GROUP BY ALL UNION ALL SELECT set_name, 'mean_comb', avg(total) FROM scores GROUP BY ALL)",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def metric_names_split(spark, folder):
    """Wide result columns melted, the metric name split and labelled."""
    scores = staged_scores(spark, folder)
    wide = scores.groupBy("set_name").agg(F.avg("total").alias("mean_comb"))
    for measure, name in (("acc", "median_acc"), ("strain", "median_sg")):
        box = scoring.box_quantiles(scores, ["set_name"], measure).select("set_name", F.col("median").alias(name))
        wide = wide.join(box, "set_name")
    return tidy(scoring.split_metric_names(wide, ["set_name"], ["median_acc", "median_sg", "mean_comb"]))


@query(
    "scores_with_events",
    with_views(
        f"SELECT s.event_id, s.set_name, {rnd('s.total')} AS total, t.vec_id FROM scores s JOIN tensors t ON s.event_id = t.event_id AND s.set_name = t.set_name",
        "tensor_values",
        extra=_ERRORS,
    ),
)
def scores_with_events(spark, folder):
    """Scores joined to the full table on every common column."""
    from spanwave.operators import joins

    scores = event_scores(spark, folder).select("event_id", "set_name", "total")
    return tidy(joins.natural_join(scores, tables.tensors(spark, folder).drop("values")))


def _axes_sql(count: int) -> dict[str, str]:
    """SQL of the leading ``count`` principal axes of the reference rows, as views ``v1``, ``v2``, ...

    The covariance is squared again and again until only its leading axis is left; then that axis is
    taken out and the next follows. An axis points to the side of its largest part.
    """
    views = {
        "means": f"SELECT position, avg(value) AS m FROM tensor_values WHERE set_name = '{REFERENCE}' GROUP BY position",
        "cen": "SELECT event_id, set_name, position, value - m AS z FROM tensor_values JOIN means USING (position)",
        "rows": "SELECT event_id, set_name, list(z ORDER BY position) AS x FROM cen GROUP BY ALL",
        "cov": "SELECT a.position AS i, b.position AS j, sum(a.z * b.z) AS c FROM cen a JOIN cen b USING (event_id) "
        f"WHERE a.set_name = '{REFERENCE}' GROUP BY ALL",
        "c0": "SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i)",
    }
    for k in range(1, count + 1):
        views[f"s{k}"] = (
            f"SELECT m FROM (WITH RECURSIVE s(n, m) AS (SELECT 0, c FROM c{k - 1} UNION ALL "
            "SELECT n + 1, list_transform(q, lambda a: list_transform(a, lambda z: z / t)) FROM "
            "(SELECT n, q, list_max(list_transform(q, lambda a: list_max(list_transform(a, lambda z: abs(z))))) AS t FROM "
            "(SELECT n, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS q FROM s WHERE n < 20))) "
            "SELECT m FROM s WHERE n = 20)"
        )
        views[f"u{k}"] = f"SELECT u FROM (SELECT unnest(m) AS u FROM s{k}) ORDER BY list_dot_product(u, u) DESC LIMIT 1"
        views[f"v{k}"] = (
            "SELECT list_transform(u, lambda z: z * CASE WHEN list_max(u) >= -list_min(u) THEN 1 ELSE -1 END "
            f"/ sqrt(list_dot_product(u, u))) AS v FROM u{k}"
        )
        views[f"c{k}"] = (
            "SELECT list_transform(c, lambda r, i: list_transform(r, lambda z, j: z - lam * v[i] * v[j])) AS c FROM "
            f"(SELECT c, v, list_dot_product(list_transform(c, lambda r: list_dot_product(r, v)), v) AS lam FROM c{k - 1}, v{k})"
        )
    return views


RANK = 8
_LOW_RANK = {
    **_axes_sql(RANK),
    "wrong": "SELECT event_id, set_name, (list_dot_product(x, x)"
    + "".join(f" - power(list_dot_product(x, (SELECT v FROM v{k})), 2)" for k in range(1, RANK + 1))
    + ") / 64 AS total FROM rows",
    "lim": f"SELECT quantile_cont(total, 0.99) AS threshold FROM wrong WHERE set_name = '{REFERENCE}'",
}


@query(
    "low_rank_errors",
    with_views(
        f"SELECT event_id, set_name, {rnd('total')} AS total, {rnd('threshold')} AS threshold, total > threshold AS above FROM wrong, lim",
        "tensor_values",
        extra=_LOW_RANK,
    ),
)
def low_rank_errors(spark, folder):
    """Errors of a low-rank reconstruction fitted on the reference set, applied to all sets."""
    centred = scoring.centre(tables.tensors(spark, folder), reference(), 64)
    model = scoring.fit_projection(centred.filter(reference()), RANK)
    rebuilt = scoring.reconstruct(model, scoring.project(model, centred))
    errors = cut_lineage(
        rebuilt.select(
            "event_id", "set_name", scoring.squared_error(F.col("values"), F.col("reconstruction")).alias("total")
        )
    )
    return tidy(scoring.flag_exceedances(errors, scoring.threshold(errors, reference())))


@query(
    "latent_coordinates",
    with_views(
        f"SELECT event_id, {rnd('list_dot_product(x, (SELECT v FROM v1))', 5)} AS x, {rnd('list_dot_product(x, (SELECT v FROM v2))', 5)} AS y FROM rows",
        "tensor_values",
        extra=_axes_sql(2),
    ),
)
def latent_coordinates(spark, folder):
    """Two-dimensional coordinates on axes fitted once on the reference set."""
    centred = scoring.centre(tables.tensors(spark, folder), reference(), 64)
    model = scoring.fit_projection(centred.filter(reference()), 2)
    latent = scoring.project(model, centred).withColumn("latent", scoring.turned(model, F.col("latent")))
    return tidy(latent.select("event_id", F.get("latent", F.lit(0)).alias("x"), F.get("latent", F.lit(1)).alias("y")), {"x": 5, "y": 5})
