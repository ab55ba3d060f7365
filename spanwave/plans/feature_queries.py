"""Registered queries: waveform features, baselines and modal analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwave.functions import times
from spanwave.operators import events, features, joins, modal, sequence
from spanwave.plans import event_queries, signal_queries
from spanwave.plans import features as feature_jobs
from spanwave.plans.oracle_views import iso, rnd, with_views
from spanwave.plans.registry import query, tidy
from spanwave.session import cut_lineage, stage
from spanwave.sources import tables

FEATURE_DIGITS = {"mean": 8, "energy": 4, "waveform_mean": 8, "waveform_energy": 4, "table_mean_value": 8,
                  "table_temperature": 8, "zero_crossing_rate": 8, "waveform_zero_crossing_rate": 8}
KEYS = ["event_id", "sensor_name"]

# Values are shifted so that waveforms change sign.
_CENTRED = "SELECT * REPLACE (value - 10 AS value) FROM waveforms"
_STATS = (
    "SELECT event_id, sensor_name, count(*) AS sample_count, "
    f"{rnd('(epoch_us(max(timestamp_utc)) - epoch_us(min(timestamp_utc))) / 1e6')} AS aligned_duration_s, "
    f"{rnd('avg(value)', 8)} AS mean, {rnd('stddev_samp(value)')} AS std, {rnd('sqrt(avg(value * value))')} AS rms, "
    f"{rnd('min(value)')} AS min, {rnd('max(value)')} AS max, {rnd('max(value) - min(value)')} AS peak_to_peak, "
    f"{rnd('sum(value * value)', 4)} AS energy, "
    f"{rnd('CASE WHEN sqrt(avg(value * value)) > 0 THEN max(abs(value)) / sqrt(avg(value * value)) END')} AS crest_factor, "
    f"{rnd('CASE WHEN count(*) > 1 THEN count(*) FILTER (sign(value) * sign(prev) < 0) / (count(*) - 1) ELSE 0.0 END', 8)} AS zero_crossing_rate, "
    f"{rnd('CASE WHEN count(*) > 2 THEN CASE WHEN var_pop(value) > 0 THEN skewness(value) ELSE 0.0 END END')} AS skewness, "
    f"{rnd('CASE WHEN count(*) > 3 THEN CASE WHEN var_pop(value) > 0 THEN kurtosis(value) ELSE 0.0 END END')} AS kurtosis "
    "FROM (SELECT *, lag(value) OVER (PARTITION BY event_id, sensor_name ORDER BY sample_index) AS prev FROM centred) GROUP BY ALL"
)


def centred(spark, folder):
    return tables.waveforms(spark, folder).withColumn("value", F.col("value") - 10)


@query("waveform_features", with_views(_STATS, "waveforms", extra={"centred": _CENTRED}))
def waveform_features(spark, folder):
    """Every waveform statistic per event and sensor."""
    return tidy(features.waveform_statistics(centred(spark, folder), KEYS), FEATURE_DIGITS)


@query(
    "sensor_event_features",
    with_views(
        "SELECT a.event_id, a.set_name, a.deck, a.sensor_name, a.sensor_order, split_part(a.sensor_name, '_', 5) AS quantity, "
        "nullif(split_part(a.sensor_name, '_', 6), '') AS axis, coalesce(s.sample_count, 0) AS sample_count, s.aligned_duration_s, "
        f"{rnd('a.duration')} AS table_duration, {rnd('a.start_value')} AS table_start_value, "
        f"{rnd('a.end_value')} AS table_end_value, {rnd('a.diff_value')} AS table_diff_value, "
        f"{rnd('a.min_value')} AS table_min_value, {rnd('a.max_value')} AS table_max_value, "
        f"{rnd('a.mean_value', 8)} AS table_mean_value, {rnd('a.range_value')} AS table_range_value, "
        f"{rnd('a.temperature', 8)} AS table_temperature, "
        + ", ".join(f"s.{name} AS waveform_{name}" for name in features.STATISTICS)
        + " FROM annotated a LEFT JOIN stats s ON s.event_id = a.set_name || '__' || a.deck || '__' || "
        "strftime(a.start_time_utc, '%Y-%m-%dT%H-%M-%SZ') AND s.sensor_name = a.sensor_name WHERE a.sensor_status = 'included'",
        "annotated",
        "waveforms",
        extra={"centred": _CENTRED, "stats": _STATS},
    ),
)
def sensor_event_features(spark, folder):
    """The feature table: table values of each included record beside its waveform statistics."""
    rows = event_queries.annotated(spark, folder)
    short = F.concat_ws("__", "set_name", "deck", F.date_format("start_time_utc", "yyyy-MM-dd'T'HH-mm-ss'Z'"))
    waves = centred(spark, folder)
    bridge = rows.withColumnRenamed("event_id", "full_id").withColumn("event_id", short)
    table = features.sensor_event_features(bridge, waves)
    full = bridge.select("event_id", "sensor_name", "full_id")
    named = table.join(full, KEYS).withColumn("event_id", F.col("full_id")).drop("full_id")
    return tidy(named, FEATURE_DIGITS)


_MEAN_ABS = "SELECT event_id, sensor_name, avg(abs(value)) AS mean_abs_value FROM waveforms GROUP BY ALL"


@query(
    "mean_abs_values",
    with_views(
        f"SELECT event_id, sensor_name, {rnd('mean_abs_value', 8)} AS mean_abs_value FROM m",
        "waveforms",
        extra={"m": _MEAN_ABS},
    ),
)
def mean_abs_values(spark, folder):
    return tidy(features.mean_abs(tables.waveforms(spark, folder)), {"mean_abs_value": 8})


@query(
    "span_activity_ratio",
    with_views(
        f"SELECT event_id, event_ordinal, {rnd('CASE WHEN s2 > 0 THEN s1 / s2 END')} AS ratio FROM ("
        "SELECT event_id, coalesce(sum(mean_abs_value) FILTER (sensor_name LIKE '%!_S1!_%' ESCAPE '!'), 0) AS s1, "
        "coalesce(sum(mean_abs_value) FILTER (sensor_name LIKE '%!_S2!_%' ESCAPE '!'), 0) AS s2 FROM m GROUP BY ALL) JOIN "
        "(SELECT event_id, row_number() OVER (ORDER BY window_start, event_id) AS event_ordinal FROM "
        "(SELECT DISTINCT event_id, window_start FROM waveforms)) USING (event_id)",
        "waveforms",
        extra={"m": _MEAN_ABS},
    ),
)
def span_activity_ratio(spark, folder):
    """Activity of span S1 over span S2 per event, with the event's chronological number."""
    waves = tables.waveforms(spark, folder)
    starts = waves.groupBy("event_id").agg(F.min("window_start").alias("start_time_utc"))
    ordinals = features.event_ordinals(starts).select("event_id", "event_ordinal")
    return tidy(features.span_ratio(features.mean_abs(waves)).join(ordinals, "event_id"))


WINDOW = 20
_BASELINE = {
    "means": "SELECT event_id, sensor_name, window_start, avg(value) AS event_mean FROM waveforms GROUP BY ALL",
    "base": "SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(event_mean) OVER w END AS baseline_mean, "
    "CASE WHEN count(*) OVER w = 20 THEN stddev_samp(event_mean) OVER w END AS baseline_std FROM means WINDOW w AS "
    "(PARTITION BY sensor_name ORDER BY window_start, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
}


@query(
    "trailing_baseline",
    with_views(
        f"SELECT event_id, sensor_name, {rnd('baseline_mean', 10)} AS baseline_mean, {rnd('baseline_std')} AS baseline_std FROM base",
        "waveforms",
        extra=_BASELINE,
    ),
)
def trailing_baseline(spark, folder):
    """Mean and deviation of each sensor's previous event means."""
    means = features.event_means(tables.waveforms(spark, folder))
    base = features.trailing_baseline(means, window=WINDOW)
    return tidy(base.select("event_id", "sensor_name", "baseline_mean", "baseline_std"), {"baseline_mean": 10})


@query(
    "point_anomalies",
    with_views(
        "SELECT event_id, sensor_name, count(*) FILTER (abs(value - baseline_mean) > 3 * baseline_std) AS anomaly_count, "
        f"{rnd('count(*) FILTER (abs(value - baseline_mean) > 3 * baseline_std) / count(*)', 8)} AS anomaly_rate "
        "FROM waveforms JOIN base USING (event_id, sensor_name) WHERE baseline_mean IS NOT NULL GROUP BY ALL",
        "waveforms",
        extra=_BASELINE,
    ),
)
def point_anomalies(spark, folder):
    """Samples far from the trailing baseline, count and rate per event and sensor."""
    waves = tables.waveforms(spark, folder)
    base = features.trailing_baseline(features.event_means(waves), window=WINDOW)
    return tidy(features.point_anomalies(waves, base), {"anomaly_rate": 8})


# Modal analysis over two-day events, vertical acceleration: two channels per deck.
SEGMENT, OVERLAP, RATE = 8, 4, 100.0
_MODAL = {
    "days": "SELECT set_name, deck, sensor_name, timestamp_utc, reading_id, value, "
    "set_name || '__' || deck || '__' || CAST(epoch_us(timestamp_utc) // 172800000000 AS VARCHAR) AS event_id, "
    "epoch_us(timestamp_utc) // 172800000000 AS block FROM readings",
    "waves": "SELECT *, row_number() OVER (PARTITION BY event_id, sensor_name ORDER BY timestamp_utc, reading_id) - 1 AS sample_index FROM days",
    "cand": "SELECT set_name, deck, event_id, block, list_sort(list(DISTINCT sensor_name)) AS channels FROM days "
    "WHERE sensor_name LIKE '%ACC!_Z' ESCAPE '!' GROUP BY ALL",
    "expect": "SELECT set_name, deck, list_sort(list(DISTINCT sensor_name)) AS expected_channels FROM days "
    "WHERE sensor_name LIKE '%ACC!_Z' ESCAPE '!' GROUP BY ALL",
    "chosen": "SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY set_name, deck ORDER BY block, event_id) AS r "
    "FROM cand c JOIN expect USING (set_name, deck) WHERE channels = expected_channels AND len(channels) >= 2)",
    "chan": "SELECT set_name, deck, sensor_name, row_number() OVER (PARTITION BY set_name, deck ORDER BY sensor_name) - 1 AS channel_index, "
    "count(*) OVER (PARTITION BY set_name, deck) AS channel_count FROM (SELECT set_name, deck, sensor_name FROM "
    "(SELECT set_name, deck, event_id, unnest(channels) AS sensor_name FROM chosen) JOIN "
    "(SELECT set_name, deck, count(*) AS n FROM chosen GROUP BY ALL) USING (set_name, deck) GROUP BY set_name, deck, sensor_name, n HAVING count(*) = n)",
    "full_rows": "SELECT event_id, sample_index FROM waves w JOIN chan USING (set_name, deck, sensor_name) "
    "WHERE event_id IN (SELECT event_id FROM chosen) GROUP BY event_id, sample_index HAVING count(*) = any_value(channel_count)",
    "mat": "SELECT w.set_name, w.deck, w.event_id, c.channel_index, w.sample_index AS row, w.value, n.row_count FROM waves w "
    "JOIN chan c USING (set_name, deck, sensor_name) JOIN full_rows f ON f.event_id = w.event_id AND f.sample_index = w.sample_index "
    "JOIN (SELECT event_id, count(*) AS row_count FROM full_rows GROUP BY ALL) n ON n.event_id = w.event_id WHERE n.row_count >= 2",
    "ev": "SELECT set_name, deck, count(DISTINCT event_id) AS event_count FROM mat GROUP BY ALL",
    "ev_long": f"SELECT set_name, deck, count(DISTINCT event_id) AS event_count FROM mat WHERE row_count >= {SEGMENT} "
    "GROUP BY ALL HAVING count(DISTINCT event_id) >= 2",
    "seg": f"SELECT m.*, s.segment, m.row - s.segment * {SEGMENT - OVERLAP} AS i, (row_count - {SEGMENT}) // {SEGMENT - OVERLAP} + 1 AS segment_count "
    f"FROM mat m, range((SELECT max(row_count) FROM mat)) AS s(segment) WHERE m.row_count >= {SEGMENT} AND s.segment <= (m.row_count - {SEGMENT}) // {SEGMENT - OVERLAP} "
    f"AND m.row BETWEEN s.segment * {SEGMENT - OVERLAP} AND s.segment * {SEGMENT - OVERLAP} + {SEGMENT - 1}",
    "hann": f"SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / {SEGMENT}) AS w FROM range({SEGMENT}) AS t(i)",
    "z": f"SELECT set_name, deck, event_id, segment, segment_count, channel_index, f.k, "
    f"sum(value * w * cos(2 * pi() * f.k * seg.i / {SEGMENT})) / (SELECT sum(w) FROM hann) AS re, "
    f"-sum(value * w * sin(2 * pi() * f.k * seg.i / {SEGMENT})) / (SELECT sum(w) FROM hann) AS im "
    f"FROM seg JOIN hann ON hann.i = seg.i, range({SEGMENT // 2 + 1}) AS f(k) GROUP BY ALL",
    "g": "SELECT a.set_name, a.deck, a.k AS frequency_index, a.channel_index AS channel_i, b.channel_index AS channel_j, "
    "sum((a.re * b.re + a.im * b.im) / a.segment_count) / any_value(event_count) AS re, "
    "sum((a.im * b.re - a.re * b.im) / a.segment_count) / any_value(event_count) AS im "
    "FROM z a JOIN z b ON a.event_id = b.event_id AND a.segment = b.segment AND a.k = b.k "
    "JOIN ev_long ev ON ev.set_name = a.set_name AND ev.deck = a.deck GROUP BY a.set_name, a.deck, a.k, a.channel_index, b.channel_index",
    "pair": "SELECT set_name, deck, frequency_index, max(re) FILTER (channel_i = 0 AND channel_j = 0) AS a, "
    "max(re) FILTER (channel_i = 1 AND channel_j = 1) AS d, max(re) FILTER (channel_i = 0 AND channel_j = 1) AS b, "
    "max(im) FILTER (channel_i = 0 AND channel_j = 1) AS c FROM g GROUP BY ALL",
    # Largest eigenvalue of [[a, b + ic], [b - ic, d]].
    "curve": f"SELECT *, frequency_index * {RATE} / {SEGMENT} AS frequency_hz, "
    "(a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b + c * c) AS singular_value FROM pair",
}
LOW_HZ, HIGH_HZ, N_PEAKS = 10.0, 50.0, 2
_PEAKS = {
    **_MODAL,
    "band": f"SELECT * FROM curve WHERE frequency_hz BETWEEN {LOW_HZ} AND {HIGH_HZ}",
    "shape": "SELECT *, lag(singular_value) OVER w AS before, lead(singular_value) OVER w AS after FROM band "
    "WINDOW w AS (PARTITION BY set_name, deck ORDER BY frequency_index)",
    "tops": "SELECT *, singular_value > before AND singular_value > after AS is_peak, "
    "row_number() OVER (PARTITION BY set_name, deck ORDER BY singular_value DESC, frequency_index) AS height FROM shape",
    "picked": "SELECT t.* FROM tops t JOIN (SELECT set_name, deck, bool_or(coalesce(is_peak, false)) AS any_peak FROM tops GROUP BY ALL) "
    "USING (set_name, deck) WHERE coalesce(is_peak, false) OR (NOT any_peak AND height = 1)",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY set_name, deck ORDER BY frequency_hz) AS peak_rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY set_name, deck ORDER BY singular_value DESC) AS r FROM picked) "
    f"WHERE r <= {N_PEAKS}",
}


def _modal(spark, folder, min_rows: int = 2, min_common_events: int = 2):
    block = times.time_tile(F.col("timestamp_utc"), 172800)
    rows = tables.readings(spark, folder).withColumn(
        "event_id", F.concat_ws("__", "set_name", "deck", block.cast("string"))
    )
    waves = sequence.ordinal(rows, ["event_id", "sensor_name"], ["timestamp_utc", "reading_id"], "tile", "sample_index")
    event_sensors = rows.groupBy("set_name", "deck", "event_id", "sensor_name").agg(
        F.min(block).alias("start_time_utc"), F.lit("included").alias("sensor_status")
    )
    selected = cut_lineage(modal.candidate_events(modal.channels_of(event_sensors)))
    channels = modal.common_channels(selected)
    return event_sensors, selected, channels, modal.event_matrices(
        waves, selected, channels, min_rows=min_rows, min_common_events=min_common_events
    )


@query(
    "modal_candidates",
    with_views(
        "SELECT c.set_name, c.deck, event_id, array_to_string(channels, ',') AS channels FROM cand c JOIN expect USING (set_name, deck) "
        "WHERE channels = expected_channels AND len(channels) >= 2",
        "readings",
        extra={k: _MODAL[k] for k in ("days", "cand", "expect")},
    ),
)
def modal_candidates(spark, folder):
    """Events showing exactly the channel set of their (set, deck)."""
    block = times.time_tile(F.col("timestamp_utc"), 172800)
    rows = tables.readings(spark, folder)
    event_sensors = rows.groupBy(
        "set_name", "deck", F.concat_ws("__", "set_name", "deck", block.cast("string")).alias("event_id"), "sensor_name"
    ).agg(F.min(block).alias("start_time_utc"), F.lit("included").alias("sensor_status"))
    found = modal.candidate_events(modal.channels_of(event_sensors))
    return tidy(found.select("set_name", "deck", "event_id", "channels"))


@query(
    "first_events_per_deck",
    with_views(
        "SELECT set_name, deck, event_id, active_sensor_count FROM (SELECT *, row_number() OVER (PARTITION BY set_name, deck "
        "ORDER BY start_time_utc, event_id) AS r FROM event_list) WHERE r <= 5",
        "event_list",
    ),
)
def first_events_per_deck(spark, folder):
    found = modal.first_events(event_queries.event_list(spark, folder), 5)
    return found.select("set_name", "deck", "event_id", "active_sensor_count")


@query(
    "common_channels",
    with_views(
        "SELECT set_name, deck, sensor_name FROM (SELECT *, unnest(string_split(active_sensors, ',')) AS sensor_name FROM event_list) "
        "JOIN (SELECT set_name, deck, count(*) AS n FROM event_list GROUP BY ALL) USING (set_name, deck) "
        "GROUP BY set_name, deck, sensor_name, n HAVING count(*) = n",
        "event_list",
    ),
)
def common_channels(spark, folder):
    """Sensors active in every event of a (set, deck)."""
    found = event_queries.event_list(spark, folder)
    return modal.common_channels(found.withColumnRenamed("active_sensors", "channels"))


@query(
    "event_matrices",
    with_views("SELECT set_name, deck, event_id, row, row_count, string_agg(CAST(value AS VARCHAR), ',' ORDER BY channel_index) AS \"values\" FROM mat JOIN ev USING (set_name, deck) WHERE event_count >= 2 GROUP BY ALL", "readings", extra={k: v for k, v in _MODAL.items() if k not in ("seg", "hann", "z", "g", "pair", "curve")}),
)
def event_matrices(spark, folder):
    """Channel matrices of the selected events without gappy rows."""
    _, _, _, matrices = _modal(spark, folder)
    return tidy(matrices.select("set_name", "deck", "event_id", "row", "row_count", "values"))


@query(
    "modal_event_report",
    with_views(
        "SELECT c.set_name, c.deck, c.event_id, coalesce(row_count, 0) AS row_count, CASE WHEN row_count IS NULL THEN 'no_full_rows' "
        f"WHEN row_count < {SEGMENT} THEN 'too_few_rows' WHEN count(*) FILTER (row_count >= {SEGMENT}) OVER (PARTITION BY c.set_name, c.deck) < 2 "
        "THEN 'too_few_events' END AS reason FROM chosen c LEFT JOIN (SELECT event_id, count(*) AS row_count FROM full_rows GROUP BY ALL) n USING (event_id)",
        "readings",
        extra={k: _MODAL[k] for k in ("days", "waves", "cand", "expect", "chosen", "chan", "full_rows")},
    ),
)
def modal_event_report(spark, folder):
    """Selected events with their full rows, and why the density below leaves some of them out."""
    _, selected, _, matrices = _modal(spark, folder, min_rows=1, min_common_events=1)
    return modal.matrix_report(selected, matrices, min_rows=SEGMENT)


def _density(spark, folder):
    _, _, channels, matrices = _modal(spark, folder, min_rows=SEGMENT)
    return channels, modal.spectral_density(
        modal.segments(matrices, nperseg=SEGMENT, noverlap=OVERLAP), sampling_rate_hz=RATE
    )


@query(
    "spectral_density",
    with_views(
        f"SELECT set_name, deck, frequency_index, {rnd('frequency_index * 100.0 / 8')} AS frequency_hz, channel_i, channel_j, "
        f"{rnd('re')} AS re, {rnd('im')} AS im FROM g",
        "readings",
        extra={k: v for k, v in _MODAL.items() if k not in ("pair", "curve")},
    ),
)
def spectral_density(spark, folder):
    """Cross-spectral density averaged over segments and events."""
    return tidy(_density(spark, folder)[1])


@query(
    "singular_values",
    with_views(
        f"SELECT set_name, deck, frequency_index, {rnd('frequency_hz')} AS frequency_hz, {rnd('singular_value')} AS singular_value FROM curve",
        "readings",
        extra=_MODAL,
    ),
)
def singular_values(spark, folder):
    """First singular value over frequency."""
    return tidy(modal.first_curve(modal.decompose(_density(spark, folder)[1])))


@query(
    "modal_peaks",
    with_views(
        f"SELECT set_name, deck, peak_rank, frequency_index, {rnd('frequency_hz')} AS frequency_hz, {rnd('singular_value')} AS singular_value FROM ranked",
        "readings",
        extra=_PEAKS,
    ),
)
def modal_peaks(spark, folder):
    """Dominant peaks per (set, deck), ranked by frequency."""
    modes = cut_lineage(modal.decompose(_density(spark, folder)[1]))
    table = modal.peaks(modal.first_curve(modes), low_hz=LOW_HZ, high_hz=HIGH_HZ, n_peaks=N_PEAKS)
    return tidy(table)


# First eigenvector of the 2 x 2 matrix is (b + ic, s - a), or (s - d, b - ic) scaled by its first part.
_SHAPES = {
    **_PEAKS,
    "vec": "SELECT r.*, sqrt(b * b + c * c) AS m0, abs(singular_value - a) AS m1 FROM ranked r",
    "comp": "SELECT set_name, deck, peak_rank, frequency_hz, channel_index, "
    "CASE channel_index WHEN 0 THEN m0 ELSE m1 END / greatest(m0, m1) AS amplitude, "
    # Turned by the leader's phase: component 0 has phase atan2(c, b), component 1 is real.
    "CASE WHEN m0 >= m1 THEN CASE channel_index WHEN 0 THEN 0.0 ELSE -atan2(c, b) END "
    "ELSE CASE channel_index WHEN 0 THEN atan2(c, b) ELSE 0.0 END END AS phase FROM vec, range(2) AS t(channel_index)",
}


@query(
    "mode_shapes",
    with_views(
        "SELECT q.set_name, q.deck, peak_rank, sensor_name, split_part(sensor_name, '_', 2) || '_' || split_part(sensor_name, '_', 3) || '_' "
        f"|| split_part(sensor_name, '_', 4) AS position_label, {rnd('amplitude')} AS mode_shape_amplitude, "
        f"{rnd('amplitude * cos(phase)')} AS mode_shape_signed_component, {rnd('cos(radians(degrees(phase)))')} AS phase_cosine "
        "FROM comp q JOIN chan c ON q.set_name = c.set_name AND q.deck = c.deck AND q.channel_index = c.channel_index",
        "readings",
        extra=_SHAPES,
    ),
)
def mode_shapes(spark, folder):
    """Normalised mode-shape components with sensor positions."""
    channels, density = _density(spark, folder)
    modes = cut_lineage(modal.decompose(density))
    table = modal.peaks(modal.first_curve(modes), low_hz=LOW_HZ, high_hz=HIGH_HZ, n_peaks=N_PEAKS)
    located = modal.annotate_locations(modal.mode_shapes(table, modes), channels)
    return tidy(
        located.select(
            "set_name",
            "deck",
            "peak_rank",
            "sensor_name",
            "position_label",
            "mode_shape_amplitude",
            "mode_shape_signed_component",
            F.cos(F.radians("mode_shape_phase_deg")).alias("phase_cosine"),
        )
    )


@query(
    "mode_shape_table",
    with_views(
        "SELECT q.set_name, q.deck, split_part(sensor_name, '_', 2) || '_' || split_part(sensor_name, '_', 3) || '_' "
        f"|| split_part(sensor_name, '_', 4) AS position_label, {rnd('max(amplitude) FILTER (peak_rank = 1)')} AS peak_1, "
        f"{rnd('max(amplitude) FILTER (peak_rank = 2)')} AS peak_2 "
        "FROM comp q JOIN chan c ON q.set_name = c.set_name AND q.deck = c.deck AND q.channel_index = c.channel_index GROUP BY ALL",
        "readings",
        extra=_SHAPES,
    ),
)
def mode_shape_table(spark, folder):
    """Amplitudes by location and peak."""
    channels, density = _density(spark, folder)
    modes = cut_lineage(modal.decompose(density))
    table = modal.peaks(modal.first_curve(modes), low_hz=LOW_HZ, high_hz=HIGH_HZ, n_peaks=N_PEAKS)
    located = modal.annotate_locations(modal.mode_shapes(table, modes), channels)
    return tidy(modal.pivot_shapes(located, "mode_shape_amplitude", N_PEAKS))


@query(
    "feature_family_status",
    with_views(
        "SELECT e.set_name, e.deck, 'acc_z_fdd' AS feature_family, CASE WHEN v.n >= 2 THEN 'completed' ELSE 'skipped' END AS status, "
        "CASE WHEN v.n >= 2 THEN 'computed from ' || v.n || ' retained events' "
        "WHEN coalesce(len(expected_channels), 0) < 2 THEN 'insufficient configured ACC_Z channels' "
        "WHEN k.n IS NULL THEN 'no events with all ' || len(expected_channels) || ' ACC_Z channels' "
        "WHEN k.n < 2 THEN 'insufficient events with all ' || len(expected_channels) || ' ACC_Z channels' "
        "ELSE 'insufficient full-set ACC_Z events after dropping missing rows' END AS detail, "
        "CASE WHEN v.n >= 2 THEN v.n ELSE e.n END AS event_count, "
        "CASE WHEN k.n >= 2 THEN len(expected_channels) ELSE 0 END::BIGINT AS channel_count "
        "FROM (SELECT set_name, deck, count(DISTINCT event_id) AS n FROM days GROUP BY ALL) e "
        "LEFT JOIN (SELECT set_name, deck, count(*) AS n FROM chosen GROUP BY ALL) k USING (set_name, deck) "
        "LEFT JOIN (SELECT set_name, deck, event_count AS n FROM ev) v USING (set_name, deck) LEFT JOIN expect USING (set_name, deck)",
        "readings",
        extra={k: v for k, v in _MODAL.items() if k not in ("seg", "hann", "z", "g", "pair", "curve")},
    ),
)
def feature_family_status(spark, folder):
    event_sensors, selected, channels, matrices = _modal(spark, folder)
    found = event_sensors.select("set_name", "deck", "event_id").distinct()
    return modal.family_status(found, modal.channels_of(event_sensors), selected, selected, channels, matrices)


RAW_ORDER = 1  # one section, so that days of ten samples are filtered
_RAW = {
    "daily": "SELECT set_name, deck, sensor_name, value, set_name || '__' || deck || '__' || strftime(timestamp_utc, '%Y%m%d') AS event_id, "
    "row_number() OVER (PARTITION BY set_name, sensor_name, raw_file ORDER BY timestamp_utc, reading_id) - 1 AS idx "
    "FROM readings WHERE sensor_name LIKE '%ACC!_Z' ESCAPE '!'",
    "chan": "SELECT *, row_number() OVER (PARTITION BY set_name, deck ORDER BY sensor_name) - 1 AS channel_index, "
    "count(*) OVER (PARTITION BY set_name, deck) AS channel_count FROM (SELECT DISTINCT set_name, deck, sensor_name FROM daily)",
    "cut": "SELECT event_id, min(n) AS row_count FROM (SELECT event_id, sensor_name, any_value(channel_count) AS c, count(*) AS n "
    "FROM daily JOIN chan USING (set_name, deck, sensor_name) GROUP BY event_id, sensor_name) GROUP BY event_id HAVING count(*) = any_value(c)",
    "even": "SELECT d.*, row_count FROM daily d JOIN cut USING (event_id) WHERE idx < row_count",
    **signal_queries.bandpass_views("even", ("event_id", "sensor_name"), order=RAW_ORDER, low_hz=LOW_HZ, high_hz=45.0),
    "mat": f"SELECT set_name, deck, event_id, channel_index, idx AS row, bp.value, row_count FROM bp JOIN even e USING (event_id, sensor_name, idx) "
    f"JOIN chan USING (set_name, deck, sensor_name) WHERE row_count >= {SEGMENT}",
    **{k: v for k, v in _SHAPES.items() if k not in ("days", "waves", "cand", "expect", "chosen", "chan", "full_rows", "mat", "band")},
}
_RAW = {k: v for k, v in _RAW.items() if k not in ("shape", "tops", "picked", "ranked", "vec", "comp")} | {
    "band": f"SELECT * FROM curve WHERE frequency_hz BETWEEN {LOW_HZ} AND 45",
    **{k: _SHAPES[k] for k in ("shape", "tops", "picked", "ranked", "vec", "comp")},
}


@query(
    "raw_record_decomposition",
    with_views(
        f"SELECT q.set_name, q.deck, peak_rank, sensor_name, {rnd('frequency_hz')} AS frequency_hz, {rnd('amplitude')} AS mode_shape_amplitude "
        "FROM comp q JOIN chan c ON q.set_name = c.set_name AND q.deck = c.deck AND q.channel_index = c.channel_index",
        "readings",
        extra=_RAW,
    ),
)
def raw_record_decomposition(spark, folder):
    """Decomposition straight from raw records, deck by deck: every day is a record of each sensor."""
    # The channels of the decomposition, read once for the index and the samples of both decks.
    rows = stage(
        events.select_channels(tables.readings(spark, folder), quantity="ACC", axis="Z").drop("window_start", "temperature")
    )
    samples = tables.number_rows(rows, in_place=True)
    day = F.date_trunc("day", F.min("timestamp_utc"))
    daily = cut_lineage(
        rows.groupBy("set_name", "deck", "sensor_name", "raw_file")
        .agg(day.alias("start_time_utc"), F.count(F.lit(1)).alias("end_row_1based"))
        .withColumns(
            {
                "end_time_utc": F.col("start_time_utc") + F.expr("INTERVAL 1 DAY"),
                "start_row_1based": F.lit(1).cast("bigint"),
                "duration": F.lit(86400.0),
            }
        )
    )
    settings = feature_jobs.Settings(
        low_hz=LOW_HZ, high_hz=45.0, nperseg=SEGMENT, noverlap=OVERLAP, n_peaks=N_PEAKS, sampling_rate_hz=RATE
    )
    found = [
        feature_jobs.from_raw_records(daily, samples, settings, deck=deck, min_rows=SEGMENT, order=RAW_ORDER)[1]
        for deck in ("NEW", "OLD")
    ]
    located = found[0].unionByName(found[1])
    return tidy(located.select("set_name", "deck", "peak_rank", "sensor_name", "frequency_hz", "mode_shape_amplitude"))
