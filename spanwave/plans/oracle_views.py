"""SQL views shared by the oracle queries; each mirrors one adapter of ``sources.tables``."""

from __future__ import annotations


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def token(expr: str) -> str:
    return (
        f"CASE WHEN epoch_us({expr}) % 1000000 <> 0 THEN strftime({expr}, '%Y-%m-%dT%H-%M-%S.%g') || 'Z' "
        f"ELSE strftime({expr}, '%Y-%m-%dT%H-%M-%SZ') END"
    )


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def part(name: str, i: int) -> str:
    return f"nullif(split_part({name}, '_', {i}), '')"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

VIEWS["readings"] = (
    (),
    """
    SELECT reading_id, set_name, deck, sensor_name, timestamp_utc, value, temperature, window_start,
           sensor_name || '_' || strftime(timestamp_utc, '%Y%m%d') AS raw_file
    FROM (
        SELECT event_id AS reading_id,
               'SPAN_SET' || CAST(1 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 6 AS VARCHAR)
                   || '_2024_01' AS set_name,
               CASE WHEN user_id % 2 = 0 THEN 'OLD' ELSE 'NEW' END AS deck,
               (CASE WHEN user_id % 2 = 0 THEN 'OLD' ELSE 'NEW' END)
                   || (CASE WHEN (user_id // 2) % 2 = 0 THEN '_S1' ELSE '_S2' END) || '_DO_'
                   || (CASE event_type WHEN 'click' THEN 'MID_ACC_Z' WHEN 'view' THEN 'MID_ACC_Y'
                       WHEN 'purchase' THEN 'INF_STR' WHEN 'signup' THEN 'SUP_STR'
                       WHEN 'error' THEN 'SHE_STR' END) AS sensor_name,
               ts AS timestamp_utc, value,
               TRY_CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS temperature,
               make_timestamp((epoch_us(ts) // 21600000000) * 21600000000) AS window_start
        FROM events)
    """,
)
VIEWS["samples"] = (
    ("readings",),
    """
    SELECT *, row_number() OVER (PARTITION BY set_name, sensor_name, raw_file
                                 ORDER BY timestamp_utc, reading_id) AS row_1based
    FROM readings
    """,
)
VIEWS["records"] = (
    ("samples",),
    """
    SELECT set_name, deck, sensor_name, raw_file,
           1000 + 10 * row_number() OVER (PARTITION BY set_name, sensor_name ORDER BY window_start) AS record_uid,
           start_row_1based, end_row_1based, window_start AS start_time_utc, end_time_utc,
           ((epoch_us(end_time_utc) - epoch_us(window_start)) // 1000) / 1e3 AS duration,
           start_value, end_value, end_value - start_value AS diff_value, min_value, max_value, mean_value,
           max_value - min_value AS range_value, temperature,
           dense_rank() OVER (PARTITION BY set_name ORDER BY sensor_name) AS sensor_order
    FROM (SELECT set_name, deck, sensor_name, raw_file, window_start,
                 min(row_1based) AS start_row_1based, max(row_1based) AS end_row_1based,
                 max(timestamp_utc) AS end_time_utc,
                 arg_min(value, row_1based) AS start_value, arg_max(value, row_1based) AS end_value,
                 min(value) AS min_value, max(value) AS max_value, avg(value) AS mean_value,
                 avg(temperature) AS temperature
          FROM samples GROUP BY ALL)
    """,
)
VIEWS["grouped"] = (
    ("records",),
    f"""
    SELECT *, set_name || '__' || deck || '__' || ({token('start_time_utc')}) || '__'
              || ({token('event_end_time_utc')}) AS event_id
    FROM (SELECT *, start_time_utc AS event_start_time_utc,
                 max(end_time_utc) OVER (PARTITION BY set_name, deck, start_time_utc) AS event_end_time_utc
          FROM records)
    """,
)
VIEWS["exclusions"] = (
    (),
    """
    SELECT * FROM (VALUES
        ('SPAN_SET3_2024_01', 'OLD_S2_DO_INF_STR', 'damaged sensor', 'inspection'),
        ('SPAN_SET4_2024_01', 'NEW_S1_DO_SHE_STR', 'drifting sensor', 'inspection'),
        ('SPAN_SET5_2024_01', 'NEW_S1_DO_SUP_STR', 'damaged sensor', 'inspection'))
        AS t(set_name, sensor_name, reason, source)
    """,
)
VIEWS["annotated"] = (
    ("grouped", "exclusions"),
    """
    SELECT g.*,
           CASE WHEN x.reason IS NOT NULL OR NOT selected THEN 'excluded' ELSE 'included' END AS sensor_status,
           CASE WHEN x.reason IS NOT NULL THEN x.reason WHEN NOT selected THEN 'channel not selected for neural preprocessing'
                ELSE '' END AS exclusion_reason,
           CASE WHEN x.reason IS NOT NULL THEN x.source WHEN NOT selected THEN 'preprocessing sensor selection'
                ELSE '' END AS exclusion_source
    FROM (SELECT *, regexp_matches(sensor_name, '_(INF|SUP)_STR$|_ACC_Z$') AS selected FROM grouped) g
    LEFT JOIN exclusions x USING (set_name, sensor_name)
    """,
)
VIEWS["event_list"] = (
    ("annotated",),
    """
    SELECT event_id, set_name, deck, event_start_time_utc AS start_time_utc,
           event_end_time_utc AS end_time_utc, count(DISTINCT sensor_name) AS active_sensor_count,
           string_agg(sensor_name, ',' ORDER BY sensor_order) AS active_sensors
    FROM annotated WHERE sensor_status = 'included' GROUP BY ALL
    """,
)
VIEWS["waveforms"] = (
    ("readings",),
    f"""
    SELECT *, set_name || '__' || deck || '__' || ({token('window_start')}) AS event_id,
           row_number() OVER (PARTITION BY set_name, deck, window_start, sensor_name
                              ORDER BY timestamp_utc, reading_id) - 1 AS sample_index
    FROM readings
    """,
)
VIEWS["pos_rows"] = (
    ("waveforms",),
    """
    SELECT w.*, n.n AS row_count FROM waveforms w JOIN (
        SELECT event_id, min(n) AS n FROM (
            SELECT event_id, sensor_name, count(*) AS n FROM waveforms GROUP BY ALL) GROUP BY ALL) n
        ON w.event_id = n.event_id AND w.sample_index < n.n
    """,
)
VIEWS["tensors"] = (
    (),
    """
    SELECT printf('SPAN_SET%d_2024_01__OLD__%08d', label + 1, vec_id) AS event_id,
           'SPAN_SET' || CAST(label + 1 AS VARCHAR) || '_2024_01' AS set_name, vec_id, embedding
    FROM embeddings
    """,
)
VIEWS["tensor_values"] = (
    ("tensors",),
    """
    SELECT event_id, set_name, vec_id, position, position // 8 AS channel, position % 8 AS place,
           CAST(embedding[position + 1] AS DOUBLE) AS value
    FROM tensors, range(64) AS r(position)
    """,
)


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` behind the named views and those they need, then ``extra`` views in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for needed in VIEWS[name][0]:
                add(needed)
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    parts += [f"{name} AS ({body})" for name, body in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {sql}"
