"""Registered queries: model channels, packaging, windows, spectra, splits and scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwave.operators import events, joins, tensors
from spanwave.operators.sizing import small
from spanwave.plans import event_queries
from spanwave.plans.oracle_views import rnd, with_views
from spanwave.plans.registry import query, tidy
from spanwave.session import cut_lineage
from spanwave.sources import tables

HALF, MIN_ROWS = 1, 2
RATE, LOW, HIGH = 100.0, 0.5, 45.0

_CHANNELS = {
    "sensors": "SELECT sensor_name, split_part(sensor_name, '_', 1) AS deck, min(sensor_order) AS source_sensor_order, split_part(sensor_name, '_', 5) AS quantity, "
    "split_part(sensor_name, '_', 4) AS location, nullif(split_part(sensor_name, '_', 6), '') AS axis "
    "FROM records GROUP BY ALL",
    "kinds": "SELECT *, CASE WHEN quantity = 'STR' AND location IN ('INF', 'SUP') THEN 'strain' "
    "WHEN quantity = 'ACC' AND axis = 'Z' THEN 'acc' END AS modality FROM sensors",
    "channels": "SELECT *, CASE WHEN modality IS NOT NULL THEN row_number() OVER (PARTITION BY deck, modality ORDER BY source_sensor_order, "
    "sensor_name) - 1 END AS idx FROM kinds",
    "chosen": "SELECT deck, sensor_name, modality, idx FROM channels WHERE modality IS NOT NULL",
    "needs": "SELECT deck, count(*) AS need FROM chosen GROUP BY deck",
}
# Event windows of each deck, sensors side by side by sample index; one sensor in some events
# carries a broken value so that every gate is met.
_EVENTS = {
    **_CHANNELS,
    "aligned": "SELECT event_id, set_name, deck, window_start, sensor_name, sample_index, row_count, temperature, "
    "CASE WHEN reading_id % 401 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value - 20 END AS value FROM pos_rows",
    "ev": "SELECT DISTINCT event_id, set_name, deck, window_start FROM waveforms",
    "joined": "SELECT a.*, c.modality, c.idx FROM aligned a JOIN chosen c USING (sensor_name)",
    "stats": "SELECT event_id, count(DISTINCT sensor_name) AS have, bool_or(isnan(value) OR isinf(value)) AS broken, "
    "first(sample_index ORDER BY abs(value) DESC, sample_index, idx) FILTER (modality = 'strain') AS peak_row "
    "FROM joined GROUP BY ALL",
    "rows": "SELECT event_id, max(sample_index) + 1 AS row_count FROM aligned GROUP BY ALL",
    "judged": "SELECT ev.*, coalesce(r.row_count, 0) AS row_count, s.peak_row, CASE "
    "WHEN coalesce(r.row_count, 0) = 0 THEN 'empty_aligned_event' "
    "WHEN coalesce(s.have, 0) < n.need THEN 'missing_aligned_columns' WHEN s.broken THEN 'nonfinite_values' "
    f"WHEN r.row_count < {MIN_ROWS} THEN 'acc_too_short' WHEN r.row_count < {2 * HALF} THEN 'strain_window_out_of_bounds' END AS discard_reason, "
    f"greatest(least(s.peak_row - {HALF}, r.row_count - {2 * HALF}), 0) AS w0 "
    "FROM ev LEFT JOIN rows r USING (event_id) LEFT JOIN stats s USING (event_id) JOIN needs n ON n.deck = ev.deck",
    "kept": "SELECT * FROM judged WHERE discard_reason IS NULL",
}


def _by_deck(spark, folder, build):
    """One packaging run per deck, its rows under ``deck``; the layout has a few decks."""
    decks = event_queries.records(spark, folder).select("deck").distinct().collect()
    return reduce(DataFrame.unionByName, [build(r.deck).withColumn("deck", F.lit(r.deck)) for r in sorted(decks)])


def _channels(spark, folder, deck):
    records = event_queries.records(spark, folder)
    return tensors.channel_map(records.select("sensor_name", "deck", "sensor_order"), decks=[deck])


def _packaged(spark, folder, deck):
    waves = tables.waveforms(spark, folder).filter(F.col("deck") == deck)
    broken = F.when(F.col("reading_id") % 401 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 20)
    aligned = joins.positional_rows(waves, ["event_id"]).withColumn("value", broken)
    found = waves.groupBy("event_id", "set_name", "deck").agg(
        F.min("window_start").alias("start_time_utc"), F.max("timestamp_utc").alias("end_time_utc")
    )
    channels = small(cut_lineage(tensors.selected_channels(_channels(spark, folder, deck))))
    packaged = tensors.package(found, aligned, channels, half_window=HALF, min_aligned_samples=MIN_ROWS)
    return aligned, channels, packaged


@query(
    "model_channels",
    with_views(
        "SELECT deck, sensor_name, quantity AS sensor_type, location, coalesce(axis, location) AS axis_or_type, source_sensor_order, "
        "coalesce(idx, -1) AS model_channel_index, coalesce(CASE modality WHEN 'strain' THEN idx WHEN 'acc' THEN "
        "idx + (SELECT count(*) FROM kinds k WHERE k.modality = 'strain' AND k.deck = channels.deck) END, -1) AS global_model_channel_index, "
        "CASE modality WHEN 'strain' THEN printf('STR%02d', idx) WHEN 'acc' THEN printf('ACCZ%02d', idx) ELSE '' END AS model_channel_id, "
        "modality IS NOT NULL AS include_flag FROM channels",
        "records",
        extra=_CHANNELS,
    ),
)
def model_channels(spark, folder):
    """Stable channel numbering of each deck over all sets."""
    return tidy(
        _by_deck(spark, folder, lambda deck: _channels(spark, folder, deck)).select(
            "deck",
            "sensor_name",
            "sensor_type",
            "location",
            "axis_or_type",
            "source_sensor_order",
            F.coalesce("model_channel_index", F.lit(-1)).alias("model_channel_index"),
            F.coalesce("global_model_channel_index", F.lit(-1)).alias("global_model_channel_index"),
            "model_channel_id",
            "include_flag",
        )
    )


@query(
    "channel_coverage",
    with_views(
        "SELECT e.event_id, coalesce(string_agg(c.sensor_name, ',' ORDER BY c.sensor_name) FILTER (p.event_id IS NULL), '') AS missing_sensors, "
        "count(*) FILTER (p.event_id IS NULL) = 0 AS complete FROM ev e JOIN chosen c ON c.deck = e.deck "
        "LEFT JOIN (SELECT DISTINCT event_id, sensor_name FROM waveforms) p ON p.event_id = e.event_id AND p.sensor_name = c.sensor_name "
        "GROUP BY e.event_id",
        "pos_rows",
        "records",
        extra=_EVENTS,
    ),
)
def channel_coverage(spark, folder):
    """Which selected channels each event lacks."""
    waves = tables.waveforms(spark, folder)

    def build(deck):
        return tensors.coverage(waves.filter(F.col("deck") == deck), tensors.selected_channels(_channels(spark, folder, deck)))

    return tidy(_by_deck(spark, folder, build).drop("deck"))


@query(
    "packaging_gate",
    with_views(
        "SELECT event_id, row_count, CASE WHEN discard_reason IS NULL THEN 'keep' ELSE 'discard' END AS status, "
        f"discard_reason, coalesce(CASE WHEN discard_reason IS NULL THEN w0 END, -1) AS window_start_row, "
        f"coalesce(CASE WHEN discard_reason IS NULL THEN w0 + {2 * HALF} END, -1) AS window_stop_row FROM judged",
        "pos_rows",
        "records",
        extra=_EVENTS,
    ),
)
def packaging_gate(spark, folder):
    """First failing packaging reason and the strain window of kept events."""
    packaged = _by_deck(spark, folder, lambda deck: _packaged(spark, folder, deck)[2])
    return packaged.select(
        "event_id",
        "row_count",
        "status",
        "discard_reason",
        F.coalesce("window_start_row", F.lit(-1)).cast("bigint").alias("window_start_row"),
        F.coalesce("window_stop_row", F.lit(-1)).cast("bigint").alias("window_stop_row"),
    )


@query(
    "coverage_tallies",
    with_views(
        "SELECT deck, count(*) AS retained_events, count(*) FILTER (complete) AS complete_events, "
        "count(*) FILTER (NOT complete) AS incomplete_events, count(*) FILTER (complete AND discard_reason IS NOT NULL) AS packaging_rejected_events, "
        "count(*) FILTER (complete AND discard_reason IS NULL) AS packaged_events FROM (SELECT j.*, coalesce(s.have, 0) = n.need AS complete "
        "FROM judged j LEFT JOIN stats s USING (event_id) JOIN needs n ON n.deck = j.deck) GROUP BY deck",
        "pos_rows",
        "records",
        extra=_EVENTS,
    ),
)
def coverage_tallies(spark, folder):
    def build(deck):
        aligned, channels, packaged = _packaged(spark, folder, deck)
        return tensors.coverage_tallies(tensors.coverage(aligned, channels), packaged)

    return _by_deck(spark, folder, build)


@query(
    "strain_windows",
    with_views(
        "SELECT j.event_id, idx AS model_channel_index, sample_index - w0 AS position, "
        f"{rnd('value')} AS value FROM joined j JOIN kept k USING (event_id) WHERE modality = 'strain' "
        f"AND sample_index >= w0 AND sample_index < w0 + {2 * HALF}",
        "pos_rows",
        "records",
        extra=_EVENTS,
    ),
)
def strain_windows(spark, folder):
    """Strain samples around each kept event's peak."""

    def build(deck):
        aligned, channels, packaged = _packaged(spark, folder, deck)
        return tensors.strain_windows(aligned, packaged, channels)

    return tidy(_by_deck(spark, folder, build).drop("deck"))


_SPECTRA = {
    **_EVENTS,
    "n_fft": "SELECT deck, max(row_count) AS n FROM kept GROUP BY deck",
    "bins": f"SELECT deck, k AS bin, k * {RATE} / n AS hz FROM n_fft, range((SELECT max(row_count) FROM kept)) AS t(k) WHERE k <= n // 2 AND k * {RATE} / n BETWEEN {LOW} AND {HIGH}",
}


@query(
    "frequency_bins",
    with_views(
        f"SELECT deck, bin, {rnd('hz')} AS frequency_hz FROM bins", "pos_rows", "records", extra=_SPECTRA
    ),
)
def frequency_bins(spark, folder):
    """Kept bins of the transform as long as the longest kept record."""

    def build(deck):
        length = tensors.transform_length(_packaged(spark, folder, deck)[2])
        return tensors.frequency_bins(spark, length, sampling_rate_hz=RATE, low_hz=LOW, high_hz=HIGH)

    return tidy(_by_deck(spark, folder, build))


@query(
    "acceleration_spectra",
    with_views(
        "SELECT j.event_id, idx AS model_channel_index, bin, "
        "round(sqrt(power(sum(CAST(CAST(value AS FLOAT) AS DOUBLE) * cos(2 * pi() * bin * sample_index / n)), 2) + "
        "power(sum(CAST(CAST(value AS FLOAT) AS DOUBLE) * sin(2 * pi() * bin * sample_index / n)), 2)), 6) + 0.0 AS magnitude "
        "FROM joined j JOIN kept USING (event_id) JOIN bins ON bins.deck = j.deck JOIN n_fft ON n_fft.deck = j.deck WHERE modality = 'acc' GROUP BY ALL",
        "pos_rows",
        "records",
        extra=_SPECTRA,
    ),
)
def acceleration_spectra(spark, folder):
    """Zero-padded magnitude spectrum of every kept acceleration channel."""

    def build(deck):
        aligned, channels, packaged = _packaged(spark, folder, deck)
        return _spectra(aligned, channels, cut_lineage(packaged))

    return tidy(_by_deck(spark, folder, build).drop("deck"))


def _spectra(aligned, channels, packaged):
    kept = packaged.filter("status = 'keep'").select("event_id")
    acc = aligned.join(channels.filter("modality = 'acc'"), "sensor_name").join(kept, "event_id", "left_semi")
    length = tensors.transform_length(packaged)
    return tensors.spectra(acc, ["event_id", "model_channel_index"], length, sampling_rate_hz=RATE, low_hz=LOW, high_hz=HIGH)


_MODALITIES = {
    **_SPECTRA,
    "manifest": "SELECT deck, row_number() OVER (PARTITION BY deck ORDER BY set_name, deck, window_start, event_id) - 1 AS row_index, event_id, "
    "row_count AS valid_length, w0 FROM kept",
    "strain": "SELECT event_id, 'strain' AS modality, idx, sample_index - w0 AS position, value "
    f"FROM joined JOIN manifest USING (event_id) WHERE modality = 'strain' AND sample_index >= w0 AND sample_index < w0 + {2 * HALF}",
    "acc": "SELECT event_id, 'acc' AS modality, idx, bin - (SELECT min(bin) FROM bins b WHERE b.deck = j.deck) AS position, "
    "sqrt(power(sum(CAST(CAST(value AS FLOAT) AS DOUBLE) * cos(2 * pi() * bin * sample_index / n)), 2) + "
    "power(sum(CAST(CAST(value AS FLOAT) AS DOUBLE) * sin(2 * pi() * bin * sample_index / n)), 2)) AS value "
    "FROM joined j JOIN manifest USING (event_id) JOIN bins ON bins.deck = j.deck JOIN n_fft ON n_fft.deck = j.deck WHERE modality = 'acc' GROUP BY event_id, j.deck, idx, bin",
    "temps": "SELECT event_id, avg(t) AS temperature_mean, count(t) AS temperature_sensor_count FROM "
    "(SELECT event_id, sensor_name, avg(temperature) AS t FROM joined GROUP BY ALL) GROUP BY event_id",
}


@query(
    "packaged_tensors",
    with_views(
        "SELECT deck, row_index, event_id, valid_length, modality, idx AS model_channel_index, position, "
        "round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) + 0.0 AS value, "
        f"{rnd('temperature_mean', 8)} AS temperature_mean, temperature_sensor_count "
        "FROM (SELECT * FROM strain UNION ALL SELECT * FROM acc) JOIN manifest USING (event_id) LEFT JOIN temps USING (event_id)",
        "pos_rows",
        "records",
        extra=_MODALITIES,
    ),
)
def packaged_tensors(spark, folder):
    """The packed arrays of each modality on the event axis of their deck, one row per value: strain
    windows and spectra by their own channels, valid length and temperature of the event."""
    long = _by_deck(spark, folder, lambda deck: _tensors_of_deck(*_packaged(spark, folder, deck)))
    return tidy(long.withColumns({"value": F.col("value").cast("double"), "position": F.col("position").cast("bigint")}), {"value": 3, "temperature_mean": 8})


def _tensors_of_deck(aligned, channels, packaged):
    packaged = cut_lineage(packaged)
    keys = ["event_id", "model_channel_index"]
    strain = tensors.pack_arrays(tensors.strain_windows(aligned, packaged, channels), keys, "position", "value", "values")
    spectra = tensors.pack_arrays(_spectra(aligned, channels, packaged), keys, "bin", "magnitude", "values")
    packed = strain.withColumn("modality", F.lit("strain")).unionByName(spectra.withColumn("modality", F.lit("acc")))
    sensors = aligned.groupBy("event_id", "sensor_name").agg(F.avg("temperature").alias("temperature"))
    rows = (
        tensors.manifest(packaged)
        .select("row_index", "event_id")
        .join(packaged.select("event_id", F.col("row_count").alias("valid_length")), "event_id")
        .join(packed, "event_id")
        .join(tensors.mean_temperature(sensors, channels), "event_id", "left")
    )
    values = F.posexplode("values").alias("position", "value")
    return rows.select(
        "row_index", "event_id", "valid_length", "modality", "model_channel_index", values, "temperature_mean", "temperature_sensor_count"
    )


@query(
    "model_manifest",
    with_views(
        "SELECT row_number() OVER (PARTITION BY deck ORDER BY set_name, deck, window_start, event_id) - 1 AS row_index, event_id, set_name, deck FROM kept",
        "pos_rows",
        "records",
        extra=_EVENTS,
    ),
)
def model_manifest(spark, folder):
    rows = _by_deck(spark, folder, lambda deck: tensors.manifest(_packaged(spark, folder, deck)[2]))
    return rows.select("row_index", "event_id", "set_name", "deck")


@query(
    "event_temperatures",
    with_views(
        f"SELECT event_id, {rnd('avg(temperature)', 8)} AS temperature_mean, count(temperature) AS temperature_sensor_count "
        "FROM annotated WHERE sensor_name IN (SELECT sensor_name FROM chosen) GROUP BY event_id",
        "annotated",
        extra=_CHANNELS,
    ),
)
def event_temperatures(spark, folder):
    """Mean record temperature over an event's model channels."""
    rows = event_queries.annotated(spark, folder)

    def build(deck):
        chosen = tensors.selected_channels(_channels(spark, folder, deck))
        return tensors.mean_temperature(rows.filter(F.col("deck") == deck), chosen)

    return tidy(_by_deck(spark, folder, build).drop("deck"), {"temperature_mean": 8})


@query(
    "peak_windows",
    with_views(
        "SELECT event_id, sensor_name, peak, n, CASE WHEN n >= 4 THEN greatest(least(peak - 2, n - 4), 0) ELSE -1 END AS start_row, "
        "CASE WHEN n >= 4 THEN greatest(least(peak - 2, n - 4), 0) + 4 ELSE -1 END AS stop_row FROM ("
        "SELECT event_id, sensor_name, count(*) AS n, first(sample_index ORDER BY abs(value) DESC, sample_index) AS peak FROM waveforms GROUP BY ALL)",
        "waveforms",
    ),
)
def peak_windows(spark, folder):
    """Fixed-length window around each waveform's peak, shifted inside the record."""
    peak = F.max_by("sample_index", F.struct(F.abs("value"), -F.col("sample_index")))
    per = tables.waveforms(spark, folder).groupBy("event_id", "sensor_name").agg(
        peak.alias("peak"), F.count(F.lit(1)).alias("n")
    )
    start, stop = tensors.peak_window(F.col("peak"), F.col("n"), 2)
    return per.select(
        "event_id",
        "sensor_name",
        "peak",
        "n",
        F.coalesce(start, F.lit(-1)).cast("bigint").alias("start_row"),
        F.coalesce(stop, F.lit(-1)).cast("bigint").alias("stop_row"),
    )


@query(
    "unshared_events",
    with_views(
        "SELECT event_id, count(*) AS modalities FROM (SELECT DISTINCT event_id, split_part(sensor_name, '_', 5) AS q FROM waveforms) "
        "GROUP BY event_id HAVING count(*) < 2",
        "waveforms",
    ),
)
def unshared_events(spark, folder):
    """Events that one of the modalities lacks."""
    waves = tables.waveforms(spark, folder)
    acc, strain = (waves.filter(F.col("sensor_name").contains(q)) for q in ("_ACC_", "_STR"))
    return tensors.check_event_axis(acc, strain)


_VALUES = "SELECT *, CASE WHEN (vec_id + position) % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS v FROM tensor_values"


@query(
    "finite_counts",
    with_views(
        "SELECT channel, count(*) FILTER (NOT isnan(v)) AS finite_count, count(*) FILTER (isnan(v)) AS nan_count FROM x GROUP BY channel",
        "tensor_values",
        extra={"x": _VALUES},
    ),
)
def finite_counts(spark, folder):
    holes = F.when((F.col("vec_id") + F.col("position")) % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return tidy(tensors.finite_counts(tables.tensor_values(spark, folder).withColumn("value", holes), ["channel"]))


def _split_sql(train: str, validation: str) -> str:
    return (
        f"SELECT event_id, draw, CASE WHEN draw < {train} THEN 'train' WHEN draw < {train} + {validation} THEN 'validation' "
        "ELSE 'test' END AS split FROM drawn, (SELECT count(*) AS n FROM tensors)"
    )


_DRAWN = "SELECT event_id, row_number() OVER (ORDER BY md5(event_id || '2026'), event_id) - 1 AS draw FROM tensors"
# 70/20/10 of a multiple of ten leaves no remainder.
_SPLIT = _split_sql("CAST(n * 7 // 10 AS BIGINT)", "CAST(n * 2 // 10 AS BIGINT)")


# Largest remainders at any number of events, with the shares as doubles like ``tensors.split_counts``; of equal
# remainders the later part comes first. With 0.7 the first part is never empty.
_PARTS = {
    "shares": "SELECT part, n, fraction * n AS share, floor(fraction * n) AS whole FROM (VALUES (0, CAST('0.7' AS DOUBLE)), "
    "(1, CAST('0.2' AS DOUBLE)), (2, CAST('0.1' AS DOUBLE))) AS t(part, fraction), (SELECT count(*) AS n FROM tensors)",
    "sizes": "SELECT part, whole + CASE WHEN row_number() OVER (ORDER BY share - whole DESC, part DESC) <= n - sum(whole) OVER () "
    "THEN 1 ELSE 0 END AS size FROM shares",
    "edges": "SELECT sum(size) FILTER (part = 0) AS train, sum(size) FILTER (part <= 1) AS validation FROM sizes",
    "drawn": _DRAWN,
}
_EVENT_SPLIT = (
    "SELECT event_id, draw, CASE WHEN draw < train THEN 'train' WHEN draw < validation THEN 'validation' "
    "ELSE 'test' END AS split FROM drawn, edges"
)


@query("event_split", with_views(_EVENT_SPLIT, "tensors", extra=_PARTS))
def event_split(spark, folder):
    """Seeded train/validation/test split with largest-remainder counts."""
    assigned = tensors.split_events(tables.tensors(spark, folder).select("event_id"))
    return assigned.select("event_id", "draw", "split")


@query(
    "split_manifest",
    with_views(
        "SELECT split, count(*) AS event_count FROM s GROUP BY split",
        "tensors",
        extra={**_PARTS, "s": _EVENT_SPLIT},
    ),
)
def split_manifest(spark, folder):
    return tensors.split_manifest(tensors.split_events(tables.tensors(spark, folder).select("event_id")))


@query(
    "remainder_split",
    with_views(
        "SELECT split, count(*) AS event_count FROM (SELECT CASE WHEN draw < floor(0.7 * n) THEN 'train' WHEN draw < floor(0.7 * n) + floor(0.2 * n) "
        "THEN 'test' ELSE 'validation' END AS split FROM (SELECT row_number() OVER (ORDER BY md5(event_id || '42'), event_id) - 1 AS draw FROM event_list), "
        "(SELECT count(*) AS n FROM event_list)) GROUP BY split",
        "event_list",
    ),
)
def remainder_split(spark, folder):
    """Split whose validation part takes what is left."""
    found = event_queries.event_list(spark, folder).select("event_id")
    assigned = tensors.split_events(
        found, seed=42, fractions=(0.7, 0.2, 0.1), names=("train", "test", "validation"), remainder_to="validation"
    )
    return tensors.split_manifest(assigned)


@query(
    "sampled_events",
    with_views("SELECT event_id FROM drawn WHERE draw < 12", "tensors", extra={"drawn": _DRAWN}),
)
def sampled_events(spark, folder):
    """A repeatable sample of events."""
    return tensors.sample_events(tables.tensors(spark, folder).select("event_id"), 12)


@query(
    "training_scaling",
    with_views(
        f"SELECT channel, {rnd('avg(value)')} AS mean, {rnd('CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END')} AS std "
        "FROM tensor_values JOIN s USING (event_id) WHERE split = 'train' GROUP BY channel",
        "tensor_values",
        extra={"drawn": _DRAWN, "s": _SPLIT},
    ),
)
def training_scaling(spark, folder):
    """Means and deviations of the training events, per channel."""
    assigned = tensors.split_events(tables.tensors(spark, folder).select("event_id"))
    train = assigned.filter("split = 'train'").select("event_id")
    values = tables.tensor_values(spark, folder).join(train, "event_id", "left_semi")
    return tidy(tensors.scaling(values, ["channel"]))


_FIT = (
    "SELECT position, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS std "
    "FROM tensor_values WHERE event_id LIKE 'SPAN_SET1!_%' ESCAPE '!' GROUP BY position"
)


@query(
    "reference_scaling",
    with_views(
        f"SELECT position, {rnd('mean')} AS mean, {rnd('std')} AS std FROM fit", "tensor_values", extra={"fit": _FIT}
    ),
)
def reference_scaling(spark, folder):
    """Scaling of each array position, fitted on the reference set picked by id prefix."""
    values = tables.tensor_values(spark, folder).filter(F.col("event_id").startswith("SPAN_SET1_"))
    return tidy(tensors.scaling(values, ["position"]))


@query(
    "scaled_values",
    with_views(
        f"SELECT event_id, position, {rnd('(value - mean) / std')} AS value FROM tensor_values JOIN fit USING (position)",
        "tensor_values",
        extra={"fit": _FIT},
    ),
)
def scaled_values(spark, folder):
    """Reference scaling applied unchanged to every set."""
    rows = tables.tensors(spark, folder)
    scaled = tensors.scale_arrays(rows, F.col("event_id").startswith("SPAN_SET1_"), 64)
    return tidy(scaled.select("event_id", F.posexplode("values").alias("position", "value")))


@query(
    "channel_samples",
    with_views(
        f"SELECT event_id, channel, count(*) AS width, {rnd('sum(value)')} AS total, {rnd('first(value ORDER BY place)')} AS first_value, "
        "any_value(vec_id % 30) AS temperature FROM tensor_values GROUP BY event_id, channel",
        "tensor_values",
    ),
)
def channel_samples(spark, folder):
    """Event tensors as one row per channel, with the event's temperature on each."""
    rows = tables.tensors(spark, folder).withColumn("temperature", F.col("vec_id") % 30)
    per_channel = tensors.channel_samples(rows, 8)
    total = F.aggregate("values", F.lit(0.0), lambda t, v: t + v)
    return tidy(
        per_channel.select(
            "event_id",
            "channel",
            F.size("values").alias("width"),
            total.alias("total"),
            F.get("values", F.lit(0)).alias("first_value"),
            "temperature",
        )
    )


@query(
    "duplicate_channels",
    with_views(
        f"SELECT a.channel, b.channel AS other_channel, {rnd('max(abs(a.v - b.v))')} AS max_abs_diff, max(abs(a.v - b.v)) < 1e-6 AS duplicate "
        "FROM x a JOIN x b ON a.event_id = b.event_id AND a.place = b.place AND a.channel < b.channel GROUP BY ALL",
        "tensor_values",
        extra={
            "x": "SELECT event_id, place, channel, max(value) FILTER (true) OVER (PARTITION BY event_id, place, CASE WHEN channel IN (2, 5) "
            "THEN 2 ELSE channel END) AS v FROM tensor_values"
        },
    ),
)
def duplicate_channels(spark, folder):
    """Channel pairs that carry the same values; two channels are made equal first."""
    rows = tables.tensors(spark, folder)
    place = lambda c: F.slice("values", 8 * c + 1, 8)
    twin = F.zip_with(place(2), place(5), lambda x, y: F.greatest(x, y))
    values = F.concat(*[twin if c in (2, 5) else place(c) for c in range(8)])
    return tidy(tensors.duplicate_channels(rows.select(values.alias("values")), 8))
