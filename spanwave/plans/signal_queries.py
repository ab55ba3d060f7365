"""Registered queries: as-of joins, alignment, conditioning, wide and long layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwave.functions import times
from spanwave.operators import align, conditioning, events, features, joins, overview, sequence
from spanwave.plans import event_queries, preprocess
from spanwave.plans.oracle_views import iso, rnd, with_views
from spanwave.plans.registry import query, tidy
from spanwave.sources import tables

# Included sensors per deck: two spans of vertical acceleration, lower and upper strain.
SLOTS = 6
SENSORS = [f"{deck}_{span}_DO_{s}" for deck in ("NEW", "OLD") for span in ("S1", "S2") for s in tables.SENSOR_SUFFIX.values()]
TILE = 1800


def _with_tile(df):
    return df.withColumn("tile", times.time_tile(F.col("timestamp_utc"), TILE))


@query(
    "asof_reference_index",
    with_views(
        "SELECT t.event_id, t.sensor_name, t.sample_index, coalesce(r.sample_index + 1, 0) AS reference_index "
        "FROM (SELECT * FROM waveforms WHERE sensor_name NOT LIKE '%S1_DO_INF_STR') t ASOF LEFT JOIN "
        "(SELECT * FROM waveforms WHERE sensor_name LIKE '%S1_DO_INF_STR') r "
        "ON t.event_id = r.event_id AND t.timestamp_utc >= r.timestamp_utc",
        "waveforms",
    ),
)
def asof_reference_index(spark, folder):
    """Latest sample of the event's S1 lower strain gauge at or before each sample of the others."""
    waves = tables.waveforms(spark, folder)
    is_reference = F.col("sensor_name").endswith("S1_DO_INF_STR")
    matched = joins.asof_backward(waves.filter(is_reference), waves.filter(~is_reference), ["event_id"])
    return matched.select("event_id", "sensor_name", "sample_index", "reference_index")


def bandpass_views(source: str, keys: tuple[str, ...], *, order: int = 4, low_hz: float = 0.5, high_hz: float = 20.0) -> dict[str, str]:
    """SQL of the zero-phase band-pass over ``source`` (``keys, idx, value``) as view ``bp``.

    The impulse response of the cascade comes from its difference equations, one recursion step a
    sample; both passes are plain sums over it. Starting from the steady state of the first sample
    is the same as subtracting that sample, since the cascade lets no constant through.
    """
    sections = conditioning.butterworth_sections(order, low_hz, high_hz, 100.0)
    pad = 3 * (2 * len(sections) + 1)
    k = ", ".join(keys)
    ka = ", ".join(f"a.{c}" for c in keys)
    number = lambda x: f"CAST('{float(x)!r}' AS DOUBLE)"
    step = "SELECT *, CASE WHEN i = -1 THEN 1e0 ELSE 0e0 END AS y0 FROM h WHERE i < (SELECT max(n) FROM bp_src) + " + str(2 * pad)
    states = ["i + 1 AS i", f"y{len(sections)} AS y"]
    for j, (b0, b1, b2, _, a1, a2) in enumerate(sections, start=1):
        step = f"SELECT *, {number(b0)} * y{j - 1} + p{j} AS y{j} FROM ({step})"
        states.append(f"{number(b1)} * y{j - 1} - {number(a1)} * y{j} + q{j} AS p{j}")
        states.append(f"{number(b2)} * y{j - 1} - {number(a2)} * y{j} AS q{j}")
    names = "".join(f", p{j}, q{j}" for j in range(1, len(sections) + 1))
    zeros = ", 0e0" * (1 + 2 * len(sections))
    convolved = (
        f"SELECT {ka}, a.n, a.e, sum(h.y * (b.x - c.x)) AS y FROM {{0}} a JOIN {{0}} b USING ({k}) JOIN {{0}} c USING ({k}) "
        "JOIN bp_h h ON h.i = a.e - b.e WHERE c.e = 0 AND b.e <= a.e GROUP BY ALL"
    )
    return {
        "bp_src": f"SELECT {k}, idx, CASE WHEN value IS NULL OR isnan(value) THEN 0e0 ELSE value END AS value, count(*) OVER (PARTITION BY {k}) AS n FROM {source}",
        "bp_h": f"SELECT i, y FROM (WITH RECURSIVE h(i, y{names}) AS (SELECT -1::BIGINT{zeros} UNION ALL SELECT {', '.join(states)} FROM ({step})) SELECT i, y FROM h WHERE i >= 0)",
        "bp_ends": f"SELECT {k}, n, max(value) FILTER (idx = 0) AS x0, max(value) FILTER (idx = n - 1) AS x1 FROM bp_src WHERE n > {pad} GROUP BY ALL",
        "bp_ext": f"SELECT {k}, n, idx + {pad} AS e, value AS x FROM bp_src WHERE n > {pad} "
        f"UNION ALL SELECT {k}, n, {pad} - idx, 2 * x0 - value FROM bp_src JOIN bp_ends USING ({k}, n) WHERE idx BETWEEN 1 AND {pad} "
        f"UNION ALL SELECT {k}, n, {pad} + n + (n - 2 - idx), 2 * x1 - value FROM bp_src JOIN bp_ends USING ({k}, n) WHERE idx BETWEEN n - 1 - {pad} AND n - 2",
        "bp_forward": convolved.format("bp_ext"),
        "bp_turned": f"SELECT {k}, n, n + {2 * pad} - 1 - e AS e, y AS x FROM bp_forward",
        "bp_back": convolved.format("bp_turned"),
        "bp": f"SELECT {k}, n + {pad} - 1 - e AS idx, y AS value FROM bp_back WHERE n + {pad} - 1 - e BETWEEN 0 AND n - 1 "
        f"UNION ALL SELECT {k}, idx, value FROM bp_src WHERE n <= {pad}",
    }


#: Order of the band-pass in the job under test: one section, so that events of ten samples are filtered.
JOB_ORDER = 1


def _aligned_sql(select: str, *, filtered: bool = False) -> str:
    extra = {
        "inc": "SELECT a.* FROM annotated a JOIN event_list e USING (event_id) WHERE a.sensor_status = 'included' "
        f"AND e.active_sensor_count >= {event_queries.MIN_ACTIVE_SENSORS}",
        "slotted": "SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY sensor_order, sensor_name) - 1 AS slot FROM inc",
        "raw": "SELECT r.event_id, r.sensor_name, r.slot, s.timestamp_utc, s.value, s.row_1based - r.start_row_1based AS idx, "
        "r.end_row_1based - r.start_row_1based AS steps, r.start_value, r.end_value "
        "FROM slotted r JOIN samples s ON r.set_name = s.set_name AND r.sensor_name = s.sensor_name "
        "AND r.raw_file = s.raw_file AND s.row_1based BETWEEN r.start_row_1based AND r.end_row_1based",
        "sig": "SELECT event_id, sensor_name, slot, timestamp_utc, idx, CASE WHEN steps = 0 THEN 0.0 "
        "ELSE value - (start_value + (end_value - start_value) * idx / steps) END AS value FROM raw",
        "r0": "SELECT event_id, timestamp_utc AS ts, idx FROM sig WHERE slot = 0",
    }
    if filtered:
        passed = {
            "acc": "SELECT event_id, sensor_name, idx, value FROM raw WHERE sensor_name LIKE '%ACC!_Z' ESCAPE '!'",
            **bandpass_views("acc", ("event_id", "sensor_name"), order=JOB_ORDER),
            "clean": "SELECT r.* REPLACE (coalesce(bp.value, r.value) AS value) FROM raw r LEFT JOIN bp USING (event_id, sensor_name, idx)",
            "sig": "SELECT event_id, sensor_name, slot, timestamp_utc, idx, CASE WHEN steps = 0 THEN 0.0 "
            "ELSE value - (first_value(value) OVER w + (last_value(value) OVER w - first_value(value) OVER w) * idx / steps) END AS value "
            "FROM clean WINDOW w AS (PARTITION BY event_id, sensor_name ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        }
        head = {n: extra[n] for n in ("inc", "slotted", "raw")}
        extra = head | passed | {"r0": extra["r0"]}
    for k in range(1, SLOTS):
        extra[f"r{k}"] = (
            f"SELECT event_id, ts, idx FROM (SELECT *, lead(ts) OVER (PARTITION BY event_id ORDER BY ts, idx) AS nx FROM r{k - 1}) r "
            f"WHERE NOT EXISTS (SELECT 1 FROM slotted p WHERE p.event_id = r.event_id AND p.slot = {k}) "
            f"OR EXISTS (SELECT 1 FROM sig s WHERE s.event_id = r.event_id AND s.slot = {k} AND s.timestamp_utc >= r.ts "
            "AND (r.nx IS NULL OR s.timestamp_utc < r.nx))"
        )
    extra["clock"] = (
        f"SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts, idx) - 1 AS sample_index FROM r{SLOTS - 1}"
    )
    extra["aligned"] = (
        "SELECT c.event_id, s.sensor_name, c.sample_index, any_value(c.ts) AS ts, "
        "arg_min(s.value, s.timestamp_utc) AS value FROM clock c JOIN sig s ON s.event_id = c.event_id "
        "AND s.timestamp_utc >= c.ts GROUP BY ALL"
    )
    return with_views(select, "event_list", extra=extra)


def _unfiltered(spark, folder) -> preprocess.Run:
    """The preprocessing job with filtering off, which SQL can follow step by step."""
    settings = preprocess.Settings(
        min_active_sensors=event_queries.MIN_ACTIVE_SENSORS, acc_filter="none", tile_seconds=TILE
    )
    return preprocess.Run(
        tables.records(spark, folder),
        tables.raw_samples(spark, folder),
        settings,
        exclusions=event_queries.exclusions(spark),
        slots=SLOTS,
    )


@query(
    "aligned_samples",
    _aligned_sql(
        f"SELECT event_id, sensor_name, sample_index, {iso('ts')} AS timestamp_utc, {rnd('value', 9)} AS value FROM aligned"
    ),
)
def aligned_samples(spark, folder):
    """Group, select, slice, zero and align every event."""
    long = _unfiltered(spark, folder).aligned_samples
    return tidy(long.select("event_id", "sensor_name", "sample_index", "timestamp_utc", "value"), {"value": 9})


@query(
    "alignment_diagnostics",
    _aligned_sql(
        "SELECT p.event_id, p.sensor_name, f.sensor_name AS reference_sensor, f.n AS rows_reference, "
        "coalesce(c.n, 0) AS rows_after_alignment, coalesce(c.n, 0) AS matched_rows, "
        "greatest(p.n - coalesce(c.n, 0), 0) AS unmatched_rows "
        "FROM (SELECT event_id, sensor_name, slot, count(*) AS n FROM sig GROUP BY ALL) p "
        "JOIN (SELECT event_id, sensor_name, count(*) AS n FROM sig WHERE slot = 0 GROUP BY ALL) f USING (event_id) "
        "LEFT JOIN (SELECT event_id, count(*) AS n FROM clock GROUP BY ALL) c USING (event_id)"
    ),
)
def alignment_diagnostics(spark, folder):
    return _unfiltered(spark, folder).diagnostics


@query(
    "preprocessed_events",
    _aligned_sql(
        "SELECT e.event_id, e.active_sensor_count, coalesce(f.sensor_name, '') AS reference_sensor, "
        "coalesce(f.n, 0) AS rows_before_alignment, coalesce(c.n, 0) AS rows_after_alignment, "
        f"CASE WHEN e.active_sensor_count < {event_queries.MIN_ACTIVE_SENSORS} THEN 'insufficient_active_sensors' "
        "WHEN coalesce(c.n, 0) = 0 THEN 'no_common_aligned_rows' ELSE '' END AS discard_reason "
        "FROM event_list e LEFT JOIN (SELECT event_id, sensor_name, count(*) AS n FROM sig WHERE slot = 0 GROUP BY ALL) f USING (event_id) "
        "LEFT JOIN (SELECT event_id, count(*) AS n FROM clock GROUP BY ALL) c USING (event_id)"
    ),
)
def preprocessed_events(spark, folder):
    """Event manifest after alignment with both discard rules."""
    found = _unfiltered(spark, folder).events
    return found.select(
        "event_id",
        "active_sensor_count",
        "reference_sensor",
        "rows_before_alignment",
        "rows_after_alignment",
        "discard_reason",
    )


@query(
    "filtered_aligned_samples",
    _aligned_sql(
        f"SELECT event_id, sensor_name, sample_index, {iso('ts')} AS timestamp_utc, {rnd('value', 6)} AS value FROM aligned",
        filtered=True,
    ),
)
def filtered_aligned_samples(spark, folder):
    """The full chain with the band-pass on vertical acceleration."""
    settings = preprocess.Settings(
        min_active_sensors=event_queries.MIN_ACTIVE_SENSORS, tile_seconds=TILE, band={"order": JOB_ORDER}
    )
    result = preprocess.Run(
        tables.records(spark, folder),
        tables.raw_samples(spark, folder),
        settings,
        exclusions=event_queries.exclusions(spark),
        slots=SLOTS,
    )
    return tidy(result.aligned_samples.select("event_id", "sensor_name", "sample_index", "timestamp_utc", "value"))


@query(
    "bandpassed_waveforms",
    with_views(
        f"SELECT set_name, sensor_name, idx AS sample_index, {rnd('value')} AS value FROM bp",
        "readings",
        extra={
            "long": "SELECT set_name, sensor_name, value, row_number() OVER (PARTITION BY set_name, sensor_name "
            "ORDER BY timestamp_utc, reading_id) - 1 AS idx FROM readings",
            **bandpass_views("long", ("set_name", "sensor_name")),
        },
    ),
)
def bandpassed_waveforms(spark, folder):
    """Zero-phase band-pass of each sensor's whole set as one waveform."""
    rows = sequence.ordinal(
        tables.readings(spark, folder), ["set_name", "sensor_name"], ["timestamp_utc", "reading_id"], "tile", "sample_index"
    )
    return tidy(conditioning.bandpass(rows, ["set_name", "sensor_name"]))


@query(
    "zeroed_waveforms",
    with_views(
        "SELECT event_id, sensor_name, sample_index, "
        f"{rnd('CASE WHEN steps = 0 THEN 0.0 ELSE value - (v0 + (v1 - v0) * sample_index / steps) END', 9)} AS value "
        "FROM (SELECT *, first_value(value) OVER w AS v0, last_value(value) OVER w AS v1, "
        "count(*) OVER w - 1 AS steps FROM waveforms WINDOW w AS (PARTITION BY event_id, sensor_name ORDER BY sample_index "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
        "waveforms",
    ),
)
def zeroed_waveforms(spark, folder):
    """Endpoint baseline removed from every waveform."""
    zeroed = conditioning.zero_waveforms(tables.waveforms(spark, folder), ["event_id", "sensor_name"])
    return tidy(zeroed.select("event_id", "sensor_name", "sample_index", "value"), {"value": 9})


@query(
    "waveform_endpoints",
    with_views(
        "SELECT event_id, sensor_name, arg_min(value, sample_index) AS first_value, arg_max(value, sample_index) AS last_value, "
        "count(*) AS sample_count FROM waveforms GROUP BY ALL",
        "waveforms",
    ),
)
def waveform_endpoints(spark, folder):
    waves = tables.waveforms(spark, folder)
    return waves.groupBy("event_id", "sensor_name").agg(
        F.min_by("value", "sample_index").alias("first_value"),
        F.max_by("value", "sample_index").alias("last_value"),
        F.count(F.lit(1)).alias("sample_count"),
    )


@query(
    "sample_numbers",
    with_views("SELECT event_id, sensor_name, reading_id, sample_index FROM waveforms", "waveforms"),
)
def sample_numbers(spark, folder):
    """0-based position of each sample in its waveform."""
    return tables.waveforms(spark, folder).select("event_id", "sensor_name", "reading_id", "sample_index")


@query(
    "records_around_timestamp",
    with_views(
        "SELECT s.set_name, s.deck, s.sensor_name, r.raw_file, coalesce(r.start_row_1based, 0) AS start_row, "
        "coalesce(r.end_row_1based, 0) AS end_row "
        "FROM (SELECT DISTINCT set_name, deck, sensor_name FROM records WHERE sensor_name LIKE '%STR') s "
        "LEFT JOIN (SELECT * FROM records WHERE "
        f"start_time_utc < TIMESTAMP '{event_queries.PROBE}' AND end_time_utc > TIMESTAMP '{event_queries.PROBE}') r "
        "USING (set_name, sensor_name)",
        "records",
    ),
)
def records_around_timestamp(spark, folder):
    """Every selected sensor with its record around a moment, if any."""
    around = joins.records_around(event_queries.records(spark, folder), event_queries.PROBE, sensor_pattern="str")
    return around.select(
        "set_name",
        "deck",
        "sensor_name",
        "raw_file",
        F.coalesce("start_row_1based", F.lit(0)).alias("start_row"),
        F.coalesce("end_row_1based", F.lit(0)).alias("end_row"),
    )


QUERY_SLOTS = 6
_TIMESTAMP_EXTRA = {
    "chosen": "SELECT DISTINCT set_name, sensor_name FROM records WHERE deck = 'NEW' AND sensor_name LIKE '%STR'",
    "slotted": "SELECT set_name, sensor_name, row_number() OVER (PARTITION BY set_name ORDER BY sensor_name) - 1 AS slot FROM chosen",
    "sig": "SELECT set_name, w.sensor_name, slot, w.timestamp_utc, sample_index AS idx, "
    "CASE WHEN steps = 0 THEN 0.0 ELSE value - (v0 + (v1 - v0) * sample_index / steps) END AS value "
    "FROM (SELECT *, first_value(value) OVER k AS v0, last_value(value) OVER k AS v1, count(*) OVER k - 1 AS steps, "
    "max(timestamp_utc) OVER k AS ends FROM waveforms WINDOW k AS (PARTITION BY event_id, sensor_name ORDER BY sample_index "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) w JOIN slotted USING (set_name, sensor_name) "
    f"WHERE window_start < TIMESTAMP '{event_queries.PROBE}' AND ends > TIMESTAMP '{event_queries.PROBE}'",
    "r0": "SELECT set_name, timestamp_utc AS ts, idx FROM sig WHERE slot = 0",
}
for _k in range(1, QUERY_SLOTS):
    _TIMESTAMP_EXTRA[f"r{_k}"] = (
        f"SELECT set_name, ts, idx FROM (SELECT *, lead(ts) OVER (PARTITION BY set_name ORDER BY ts, idx) AS nx FROM r{_k - 1}) r "
        f"WHERE NOT EXISTS (SELECT 1 FROM sig s WHERE s.set_name = r.set_name AND s.slot = {_k}) OR EXISTS (SELECT 1 FROM sig s WHERE s.slot = {_k} "
        "AND s.set_name = r.set_name AND s.timestamp_utc >= r.ts AND (r.nx IS NULL OR s.timestamp_utc < r.nx))"
    )


@query(
    "timestamp_query",
    with_views(
        f"SELECT t.set_name, t.sensor_name, c.sample_index, {iso('c.ts')} AS timestamp_utc, "
        f"{rnd('(SELECT arg_min(s.value, s.timestamp_utc) FROM sig s WHERE s.set_name = t.set_name AND s.slot = t.slot AND s.timestamp_utc >= c.ts)', 9)} AS value "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY ts, idx) - 1 AS sample_index FROM r{QUERY_SLOTS - 1}) c JOIN slotted t ON t.set_name = c.set_name",
        "waveforms",
        "records",
        extra=_TIMESTAMP_EXTRA,
    ),
)
def timestamp_query(spark, folder):
    """Select, slice, zero and align the sensors of one deck around one moment, in every set that covers it."""
    found = align.timestamp_query(
        event_queries.records(spark, folder),
        tables.raw_samples(spark, folder),
        event_queries.PROBE,
        deck="NEW",
        sensor_pattern="*STR",
        slots=QUERY_SLOTS,
        tile_seconds=TILE,
    )
    return tidy(found.select("set_name", "sensor_name", "sample_index", "timestamp_utc", "value"), {"value": 9})


@query(
    "positional_matrix",
    with_views(
        "SELECT event_id, sample_index, "
        + ", ".join(f"max(value) FILTER (sensor_name = '{s}') AS {s}" for s in SENSORS)
        + " FROM pos_rows GROUP BY event_id, sample_index",
        "pos_rows",
    ),
)
def positional_matrix(spark, folder):
    """Sensors of an event side by side, cut to the shortest; absent sensors are NULL columns."""
    rows = joins.positional_rows(tables.waveforms(spark, folder), ["event_id"])
    return joins.to_wide(rows, ["event_id", "sample_index"], SENSORS)


@query(
    "long_samples",
    with_views(
        "SELECT event_id, sample_index, sensor_name, value FROM pos_rows WHERE deck = 'OLD' AND sensor_name LIKE '%ACC%'",
        "pos_rows",
    ),
)
def long_samples(spark, folder):
    """Wide rows back to long form for one deck and some sensors."""
    acc = [s for s in SENSORS if s.startswith("OLD") and "ACC" in s]
    waves = tables.waveforms(spark, folder).filter(F.col("deck") == "OLD")
    rows = joins.positional_rows(waves, ["event_id"])
    wide = joins.to_wide(rows, ["event_id", "sample_index"], SENSORS)
    return joins.to_long(wide, ["event_id", "sample_index"], acc)


@query(
    "irregular_events",
    with_views(
        "SELECT event_id, count(DISTINCT sensor_name) AS sensor_count FROM waveforms GROUP BY event_id "
        "HAVING count(DISTINCT sensor_name) <> 10",
        "waveforms",
    ),
)
def irregular_events(spark, folder):
    return features.irregular_events(tables.waveforms(spark, folder), 10)


@query(
    "waveform_previews",
    with_views(
        "SELECT w.event_id, w.sensor_name, sample_index, value FROM waveforms w JOIN (SELECT event_id, sensor_name, "
        "count(*) AS n FROM waveforms GROUP BY ALL) USING (event_id, sensor_name) "
        "WHERE sample_index % CAST(greatest(ceil(n / 3.0), 1) AS BIGINT) = 0 OR sample_index = n - 1",
        "waveforms",
    ),
)
def waveform_previews(spark, folder):
    """Waveforms thinned to a few samples, the last one kept."""
    thin = overview.downsample(tables.waveforms(spark, folder), ["event_id", "sensor_name"], 3)
    return thin.select("event_id", "sensor_name", "sample_index", "value")
