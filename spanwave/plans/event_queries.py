"""Registered queries: index records, events, selection, exclusion and their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwave.functions import naming, numbers, times
from spanwave.operators import events, joins, overview
from spanwave.plans.oracle_views import iso, part, rnd, token, with_views
from spanwave.plans.registry import query, tidy
from spanwave.session import cut_lineage
from spanwave.sources import tables

EXCLUSIONS = [
    ("SPAN_SET3_2024_01", "OLD_S2_DO_INF_STR", "damaged sensor", "inspection"),
    ("SPAN_SET4_2024_01", "NEW_S1_DO_SHE_STR", "drifting sensor", "inspection"),
    ("SPAN_SET5_2024_01", "NEW_S1_DO_SUP_STR", "damaged sensor", "inspection"),
]
MIN_ACTIVE_SENSORS = 6
PROBE = "2024-01-08 20:30:00"


def exclusions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXCLUSIONS, "set_name string, sensor_name string, reason string, source string")


def records(spark: SparkSession, folder: str) -> DataFrame:
    return events.add_sensor_order(tables.records(spark, folder))


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    grouped = events.assign_event_groups(records(spark, folder), "shared_start")
    return events.annotate_records(grouped, exclusions=exclusions(spark))


def event_list(spark: SparkSession, folder: str) -> DataFrame:
    return events.group_events(events.included_records(annotated(spark, folder)))


RECORD_DIGITS = {"mean_value": 8, "temperature": 8}
RECORD_SQL = (
    f"set_name, sensor_name, deck, raw_file, record_uid, start_row_1based, end_row_1based, "
    f"{iso('start_time_utc')} AS start_time_utc, {iso('end_time_utc')} AS end_time_utc, "
    f"{rnd('duration')} AS duration, {rnd('start_value')} AS start_value, {rnd('end_value')} AS end_value, "
    f"{rnd('diff_value')} AS diff_value, {rnd('min_value')} AS min_value, {rnd('max_value')} AS max_value, "
    f"{rnd('mean_value', 8)} AS mean_value, {rnd('range_value')} AS range_value, "
    f"{rnd('temperature', 8)} AS temperature"
)


@query("index_records", with_views(f"SELECT {RECORD_SQL}, sensor_order, set_name AS dataset FROM records", "records"))
def index_records(spark, folder):
    """All sensors' index tables in one, with provenance."""
    return tidy(records(spark, folder).withColumn("dataset", F.col("set_name")), RECORD_DIGITS)


@query(
    "sensor_metadata_over_sets",
    with_views(
        f"SELECT set_name AS dataset, {iso('start_time_utc')} AS start_time_utc, "
        f"{iso('end_time_utc')} AS end_time_utc, {rnd('duration')} AS duration "
        "FROM records WHERE sensor_name = 'OLD_S1_DO_MID_ACC_Z'",
        "records",
    ),
)
def sensor_metadata(spark, folder):
    """One sensor's index rows from every set, chosen columns only."""
    rows = tables.records(spark, folder).filter(F.col("sensor_name") == "OLD_S1_DO_MID_ACC_Z")
    picked = rows.select(F.col("set_name").alias("dataset"), "start_time_utc", "end_time_utc", "duration")
    return tidy(picked.orderBy("start_time_utc"))


@query(
    "sensor_catalogue",
    with_views(
        "SELECT set_name AS dataset, sensor_name, 'TABLE_' || sensor_name || '_' || "
        "regexp_extract(set_name, '(SET[0-9]+)_', 1) || '.json' AS table_file, "
        "NOT (set_name LIKE 'SPAN!_SET3!_%' ESCAPE '!' AND sensor_name LIKE 'NEW!_%' ESCAPE '!') AS sensor_dir_exists FROM records GROUP BY ALL",
        "records",
    ),
)
def sensor_catalogue(spark, folder):
    """Sensors named by their table files; flags those whose raw files are missing."""
    from spanwave.sources import index_files

    rows = tables.records(spark, folder)
    files = rows.select(
        F.col("set_name").alias("dataset"),
        F.concat_ws("_", F.lit("TABLE"), "sensor_name", naming.set_label(F.col("set_name"))).alias("stem"),
    ).distinct()
    # The raw files of one deck of a set stand for files that were lost.
    lost = F.startswith("set_name", F.lit("SPAN_SET3_")) & F.startswith("sensor_name", F.lit("NEW_"))
    observed = rows.filter(~lost).select(F.col("set_name").alias("dataset"), "sensor_name").distinct()
    return index_files.catalogue(files.select("dataset", F.concat("stem", F.lit(".json")).alias("table_file")), observed)


@query(
    "kth_record_samples",
    with_views(
        "SELECT r.set_name, r.sensor_name, r.record_uid, s.row_1based, s.value "
        "FROM records r JOIN samples s ON r.set_name = s.set_name AND r.sensor_name = s.sensor_name "
        "AND r.raw_file = s.raw_file AND s.row_1based BETWEEN r.start_row_1based AND r.end_row_1based "
        "WHERE (SELECT count(*) FROM records e WHERE e.set_name = r.set_name AND e.sensor_name = r.sensor_name "
        "AND e.start_time_utc < r.start_time_utc) = 2",
        "records",
    ),
)
def kth_record_samples(spark, folder):
    """The third record of every sensor with its samples."""
    chosen = joins.kth_records(tables.records(spark, folder), 2)
    sliced = joins.slice_records(chosen, tables.raw_samples(spark, folder))
    return sliced.select("set_name", "sensor_name", "record_uid", "row_1based", "value")


@query(
    "record_samples",
    with_views(
        "SELECT r.set_name, r.sensor_name, r.record_uid, count(*) AS sample_count, "
        f"{rnd('avg(s.value)', 8)} AS mean_value, min(s.row_1based) AS first_row, max(s.row_1based) AS last_row "
        "FROM records r JOIN samples s ON r.set_name = s.set_name AND r.sensor_name = s.sensor_name "
        "AND r.raw_file = s.raw_file AND s.row_1based BETWEEN r.start_row_1based AND r.end_row_1based "
        "GROUP BY ALL",
        "records",
    ),
)
def record_samples(spark, folder):
    """Every record joined to its row range of the raw file."""
    sliced = joins.slice_records(
        tables.records(spark, folder), tables.raw_samples(spark, folder), rows_per_block=64
    )
    per_record = sliced.groupBy("set_name", "sensor_name", "record_uid").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg("value").alias("mean_value"),
        F.min("row_1based").alias("first_row"),
        F.max("row_1based").alias("last_row"),
    )
    return tidy(per_record, {"mean_value": 8})


@query(
    "sensor_name_parts",
    with_views(
        "SELECT DISTINCT sensor_name, "
        + ", ".join(f"{part('sensor_name', i)} AS {name}" for i, name in enumerate(naming.PARTS, start=1))
        + ", split_part(sensor_name, '_', 1) AS deck_token, nullif(split_part(short, '_', 4), '') AS short_location "
        "FROM (SELECT sensor_name, split_part(sensor_name, '_', 1) || '_' || split_part(sensor_name, '_', 2) AS short "
        "FROM readings)",
        "readings",
    ),
)
def sensor_name_parts(spark, folder):
    """Strict parse of full names, lenient parse of shortened ones."""
    names = tables.readings(spark, folder).select("sensor_name").distinct()
    short = F.substring_index("sensor_name", "_", 2)
    return names.select(
        "sensor_name",
        *naming.sensor_parts(F.col("sensor_name"), strict=True).values(),
        naming.sensor_deck(F.col("sensor_name")).alias("deck_token"),
        naming.sensor_parts(short)["location"].alias("short_location"),
    )


SIDE_NAMES_SQL = (
    "SELECT DISTINCT replace(sensor_name, '_DO_', CASE WHEN (reading_id % 2) = 0 THEN '_DO_' ELSE '_UP_' END) "
    "|| CASE WHEN reading_id % 5 = 0 THEN '_EXTRA' ELSE '' END AS sensor_name FROM readings"
)


def _side_names(spark: SparkSession, folder: str) -> DataFrame:
    side = F.when(F.col("reading_id") % 2 == 0, F.lit("_DO_")).otherwise(F.lit("_UP_"))
    extra = F.when(F.col("reading_id") % 5 == 0, F.lit("_EXTRA")).otherwise(F.lit(""))
    name = F.concat(F.replace(F.col("sensor_name"), F.lit("_DO_"), side), extra)
    return tables.readings(spark, folder).select(name.alias("sensor_name")).distinct()


LAYOUT_EXTRA = {
    "names": SIDE_NAMES_SQL,
    "tokens": "SELECT sensor_name, split_part(sensor_name, '_', 1) AS deck, split_part(sensor_name, '_', 2) AS span, "
    "split_part(sensor_name, '_', 3) AS side, split_part(sensor_name, '_', 4) AS loc, "
    "split_part(sensor_name, '_', 5) AS quantity, split_part(sensor_name, '_', 6) AS axis, "
    "len(string_split(sensor_name, '_')) AS n FROM names",
    "kinds": "SELECT *, n = 6 AND quantity = 'ACC' AS is_acc, n = 5 AND quantity = 'STR' AS is_str FROM tokens",
}


@query(
    "sensor_layout",
    with_views(
        "SELECT k.sensor_name, k.deck, span, side, "
        "CASE WHEN is_acc THEN loc WHEN loc IN ('INF', 'SUP') THEN 'MID' ELSE 'SHE' END AS section, "
        "quantity AS measurement_family, "
        "CASE WHEN is_acc THEN loc || '_ACC_' || axis ELSE loc || '_STR' END AS measurement_code, "
        "span || '_' || side || '_' || CASE WHEN is_acc THEN loc || '_ACC_' || axis ELSE loc || '_STR' END "
        "AS comparison_group_id, p.sensor_name AS homologous_sensor_id "
        "FROM kinds k LEFT JOIN names p ON p.sensor_name = (CASE WHEN k.deck = 'OLD' THEN 'NEW' ELSE 'OLD' END) || "
        "substr(k.sensor_name, 4) "
        "WHERE is_str OR (is_acc AND NOT (axis = 'Y' AND side <> 'DO'))",
        "readings",
        extra=LAYOUT_EXTRA,
    ),
)
def sensor_layout(spark, folder):
    return overview.sensor_layout(_side_names(spark, folder)).select(
        "sensor_name",
        "deck",
        "span",
        "side",
        "section",
        "measurement_family",
        "measurement_code",
        "comparison_group_id",
        "homologous_sensor_id",
    )


@query(
    "layout_rejects",
    with_views(
        "SELECT sensor_name, CASE WHEN NOT (is_acc OR is_str) THEN 'unsupported sensor name' "
        "ELSE 'transversal axis outside downstream side' END AS reject_reason FROM kinds "
        "WHERE NOT (is_acc OR is_str) OR (is_acc AND axis = 'Y' AND side <> 'DO')",
        "readings",
        extra=LAYOUT_EXTRA,
    ),
)
def layout_rejects(spark, folder):
    return overview.layout_rejects(_side_names(spark, folder))


def _grouped_sql(end: str, source: str) -> str:
    return (
        f"SELECT set_name || '__' || deck || '__' || ({token('start_time_utc')}) || '__' || ({token(end)}) AS event_id, "
        f"set_name, deck, {iso('start_time_utc')} AS start_time_utc, {iso(end)} AS end_time_utc, "
        "count(DISTINCT sensor_name) AS active_sensor_count, "
        f"string_agg(sensor_name, ',' ORDER BY sensor_order) AS active_sensors FROM {source} GROUP BY ALL"
    )


@query("events_exact_window", with_views(_grouped_sql("end_time_utc", "records"), "records"))
def events_exact_window(spark, folder):
    return tidy(events.find_events(records(spark, folder)))


@query("events_shared_start", with_views(_grouped_sql("event_end_time_utc", "grouped"), "grouped"))
def events_shared_start(spark, folder):
    return tidy(events.find_events(records(spark, folder), grouping_method="shared_start"))


@query(
    "events_around_timestamp",
    with_views(
        "SELECT * FROM ("
        + _grouped_sql("event_end_time_utc", "grouped WHERE sensor_name LIKE '%STR%'")
        .replace("FROM grouped WHERE sensor_name LIKE '%STR%' GROUP BY ALL", "FROM strain GROUP BY ALL")
        + f") WHERE start_time_utc < '{PROBE.replace(' ', 'T')}.000Z' AND end_time_utc > '{PROBE.replace(' ', 'T')}.000Z'",
        "records",
        extra={
            "strain": "SELECT *, max(end_time_utc) OVER (PARTITION BY set_name, deck, start_time_utc) AS "
            "event_end_time_utc FROM records WHERE upper(sensor_name) LIKE '%!_STR' ESCAPE '!'"
        },
    ),
)
def events_around_timestamp(spark, folder):
    """Strict containment of a moment, on a sensor selection by glob."""
    found = events.find_events(
        records(spark, folder), timestamp=PROBE, sensor_pattern="*_str", grouping_method="shared_start"
    )
    return tidy(found)


@query(
    "records_by_pattern",
    with_views(
        "SELECT 'glob' AS kind, set_name, sensor_name, count(*) AS n FROM records "
        "WHERE deck = 'OLD' AND regexp_matches(sensor_name, '^OLD_S[12]_.*_(INF|SUP)_STR$') GROUP BY ALL UNION ALL "
        "SELECT 'substring', set_name, sensor_name, count(*) FROM records WHERE sensor_name LIKE '%ACC!_Y%' ESCAPE '!' "
        "GROUP BY ALL",
        "records",
    ),
)
def records_by_pattern(spark, folder):
    """Deck filter with a glob, and a plain substring in another letter case."""
    rows = tables.records(spark, folder)

    def counted(kind: str, selected: DataFrame) -> DataFrame:
        return selected.groupBy(F.lit(kind).alias("kind"), "set_name", "sensor_name").agg(
            F.count(F.lit(1)).alias("n")
        )

    glob = events.filter_records(rows, deck="OLD", sensor_pattern="old_s[12]_*_[is][nu][fp]_STR")
    return counted("glob", glob).unionByName(
        counted("substring", events.filter_records(rows, sensor_pattern="acc_y"))
    )


DAILY = "set_name || '__' || deck || '__' || strftime(start_time_utc, '%Y-%m-%d')"


@query(
    "collapsed_records",
    with_views(
        f"SELECT {DAILY} AS event_id, sensor_name, count(DISTINCT raw_file) AS raw_file_count, "
        "min(start_row_1based) AS start_row_1based, max(end_row_1based) AS end_row_1based, "
        f"{iso('min(start_time_utc)')} AS start_time_utc, {iso('max(end_time_utc)')} AS end_time_utc, "
        f"arg_min(record_uid, start_time_utc) AS record_uid, {rnd('arg_min(mean_value, start_time_utc)', 8)} AS mean_value "
        "FROM records GROUP BY ALL",
        "records",
    ),
)
def collapsed_records(spark, folder):
    """Widen the records of a sensor within a day into one."""
    day = F.concat_ws("__", "set_name", "deck", F.date_format("start_time_utc", "yyyy-MM-dd"))
    collapsed = events.collapse_records(records(spark, folder).withColumn("event_id", day))
    return tidy(
        collapsed.select(
            "event_id",
            "sensor_name",
            "raw_file_count",
            "start_row_1based",
            "end_row_1based",
            "start_time_utc",
            "end_time_utc",
            "record_uid",
            "mean_value",
        ),
        {"mean_value": 8},
    )


@query(
    "cross_file_rejects",
    with_views(
        "SELECT set_name || '__' || deck AS event_id, sensor_name, count(DISTINCT raw_file) AS raw_file_count "
        "FROM records GROUP BY ALL HAVING count(DISTINCT raw_file) > 1",
        "records",
    ),
)
def cross_file_rejects(spark, folder):
    """Sensors whose matched records lie in more than one raw file."""
    whole = records(spark, folder).withColumn("event_id", F.concat_ws("__", "set_name", "deck"))
    return events.collapse_single_file(whole)[1]


@query(
    "inclusion_status",
    with_views(
        "SELECT set_name, sensor_name, "
        "CASE WHEN reason IS NOT NULL OR deck <> 'OLD' OR NOT selected THEN 'excluded' ELSE 'included' END AS sensor_status, "
        "CASE WHEN reason IS NOT NULL THEN reason WHEN deck <> 'OLD' THEN 'deck not selected for preprocessing' "
        "WHEN NOT selected THEN 'channel not selected for neural preprocessing' ELSE '' END AS exclusion_reason, "
        "CASE WHEN reason IS NOT NULL THEN source WHEN deck <> 'OLD' THEN 'preprocessing.sensor_selection.decks' "
        "WHEN NOT selected THEN 'preprocessing sensor selection' ELSE '' END AS exclusion_source, count(*) AS record_count "
        "FROM (SELECT r.*, x.reason, x.source, regexp_matches(sensor_name, '_(INF|SUP)_STR$|_ACC_Z$') AS selected "
        "FROM records r LEFT JOIN exclusions x USING (set_name, sensor_name)) GROUP BY ALL",
        "records",
        "exclusions",
    ),
)
def inclusion_status(spark, folder):
    """Deck selection, then channel selection, then configured exclusions."""
    marked = events.annotate_records(records(spark, folder), decks=["old"], exclusions=exclusions(spark))
    keys = ["set_name", "sensor_name", "sensor_status", "exclusion_reason", "exclusion_source"]
    return marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("record_count"))


@query(
    "exclusion_log",
    with_views(
        "SELECT set_name, sensor_name, exclusion_reason, exclusion_source, count(*) AS record_count "
        "FROM annotated WHERE sensor_status = 'excluded' GROUP BY ALL",
        "annotated",
    ),
)
def exclusion_log(spark, folder):
    return events.exclusion_log(annotated(spark, folder))


@query(
    "excluded_sensors_per_event",
    with_views(
        "SELECT event_id, count(DISTINCT sensor_name) AS excluded_sensor_count, "
        "string_agg(sensor_name, ',' ORDER BY sensor_order) AS excluded_sensors, "
        "list_aggregate(list_sort(list_distinct(list(exclusion_reason))), 'string_agg', ',') AS excluded_sensor_reasons "
        "FROM annotated WHERE sensor_status = 'excluded' GROUP BY event_id",
        "annotated",
    ),
)
def excluded_sensors_per_event(spark, folder):
    return tidy(events.excluded_per_event(annotated(spark, folder)))


EVENT_SQL = f"event_id, set_name, deck, {iso('start_time_utc')} AS start_time_utc, {iso('end_time_utc')} AS end_time_utc"


@query(
    "event_catalogue",
    with_views(
        f"SELECT {EVENT_SQL}, active_sensor_count, active_sensors, "
        f"CASE WHEN active_sensor_count < {MIN_ACTIVE_SENSORS} THEN 'insufficient_active_sensors' ELSE '' END "
        f"AS discard_reason, active_sensor_count < {MIN_ACTIVE_SENSORS} AS discarded FROM event_list",
        "event_list",
    ),
)
def event_catalogue(spark, folder):
    """Events with the minimum-sensor rule applied, in catalogue order."""
    marked = events.mark_discards(event_list(spark, folder), min_active_sensors=MIN_ACTIVE_SENSORS)
    return tidy(events.list_events(marked).drop("rows_after_alignment"))


@query(
    "retained_events_of_deck",
    with_views(
        f"SELECT {EVENT_SQL}, active_sensor_count FROM event_list WHERE active_sensor_count >= {MIN_ACTIVE_SENSORS} "
        "AND deck = 'OLD' AND set_name = 'SPAN_SET2_2024_01'",
        "event_list",
    ),
)
def retained_events_of_deck(spark, folder):
    """Catalogue read under set, deck and discard predicates."""
    marked = events.mark_discards(event_list(spark, folder), min_active_sensors=MIN_ACTIVE_SENSORS)
    kept = events.list_events(marked, set_name="SPAN_SET2_2024_01", deck="OLD", discarded=False)
    return tidy(kept.select("event_id", "set_name", "deck", "start_time_utc", "end_time_utc", "active_sensor_count"))


@query(
    "sensor_listing",
    with_views(
        "SELECT set_name, deck, sensor_name, split_part(sensor_name, '_', 2) AS span, "
        "split_part(sensor_name, '_', 3) AS side, split_part(sensor_name, '_', 4) AS location, "
        "split_part(sensor_name, '_', 5) AS quantity, nullif(split_part(sensor_name, '_', 6), '') AS axis, "
        "min(sensor_order) AS sensor_order FROM annotated "
        "WHERE sensor_status = 'included' AND split_part(sensor_name, '_', 5) = 'STR' GROUP BY ALL",
        "annotated",
    ),
)
def sensor_listing(spark, folder):
    """Sensors of each set with their lowest order, by quantity and status."""
    rows = cut_lineage(annotated(spark, folder))
    listed = events.list_sensors(
        rows, events.sensor_dimension(rows), quantity="STR", sensor_status="included"
    )
    return tidy(listed)


@query(
    "event_sensor_rows",
    with_views(
        "SELECT a.event_id, a.set_name, a.deck, a.sensor_name, a.sensor_order, a.sensor_status, a.exclusion_reason, "
        "a.raw_file, a.start_row_1based, a.end_row_1based, a.record_uid, "
        f"{rnd('a.duration')} AS duration, {rnd('a.temperature', 8)} AS temperature, "
        "CAST(coalesce(a.sensor_name = f.reference_sensor, false) AS BIGINT) AS is_reference "
        "FROM annotated a LEFT JOIN (SELECT event_id, arg_min(sensor_name, sensor_order) AS reference_sensor "
        "FROM annotated WHERE sensor_status = 'included' GROUP BY event_id) f USING (event_id)",
        "annotated",
    ),
)
def event_sensor_rows(spark, folder):
    """The event-sensor bridge with the reference sensor flagged."""
    rows = cut_lineage(annotated(spark, folder))
    reference = events.reference_sensors(events.included_records(rows))
    bridge = events.event_sensor_rows(rows, reference)
    return tidy(
        bridge.select(
            "event_id",
            "set_name",
            "deck",
            "sensor_name",
            "sensor_order",
            "sensor_status",
            "exclusion_reason",
            "raw_file",
            "start_row_1based",
            "end_row_1based",
            "record_uid",
            "duration",
            "temperature",
            "is_reference",
        ).repartition("event_id").sortWithinPartitions("event_id", "sensor_order", "sensor_name"),
        {"temperature": 8},
    )


@query(
    "preprocess_summary",
    with_views(
        "SELECT 'total' AS section, 'events' AS name, count(*) AS \"count\" FROM marked UNION ALL "
        "SELECT 'outcome', CASE WHEN bad THEN 'discarded' ELSE 'retained' END, count(*) FROM marked GROUP BY ALL UNION ALL "
        "SELECT 'deck_total', deck, count(*) FROM marked GROUP BY ALL UNION ALL "
        "SELECT 'deck_retained', deck, count(*) FROM marked WHERE NOT bad GROUP BY ALL UNION ALL "
        "SELECT 'discard_reason', 'insufficient_active_sensors', count(*) FROM marked WHERE bad GROUP BY ALL UNION ALL "
        "SELECT 'excluded_by_set', set_name, count(*) FROM annotated WHERE sensor_status = 'excluded' GROUP BY ALL UNION ALL "
        "SELECT 'excluded_by_reason', exclusion_reason, count(*) FROM annotated WHERE sensor_status = 'excluded' GROUP BY ALL",
        "event_list",
        extra={"marked": f"SELECT *, active_sensor_count < {MIN_ACTIVE_SENSORS} AS bad FROM event_list"},
    ),
)
def preprocess_summary(spark, folder):
    rows = cut_lineage(annotated(spark, folder))
    found = events.group_events(events.included_records(rows))
    marked = events.mark_discards(found, min_active_sensors=MIN_ACTIVE_SENSORS)
    return events.run_summary(marked, events.exclusion_log(rows))


@query(
    "discarded_event_sensors",
    with_views(
        "SELECT event_id, sensor_name, sensor_status FROM annotated WHERE event_id IN "
        f"(SELECT event_id FROM event_list WHERE active_sensor_count < {MIN_ACTIVE_SENSORS})",
        "event_list",
    ),
)
def discarded_event_sensors(spark, folder):
    """Event-sensor rows of discarded events only."""
    rows = cut_lineage(annotated(spark, folder))
    found = events.group_events(events.included_records(rows))
    marked = events.mark_discards(found, min_active_sensors=MIN_ACTIVE_SENSORS)
    return rows.join(marked.filter("discarded"), "event_id", "left_semi").select(
        "event_id", "sensor_name", "sensor_status"
    )


# Requests by id, by window or by neither, and what each step of the search finds.
_RESOLVE = {
    "requests": "SELECT event_id AS request_id, CASE (day(start_time_utc) % 3) WHEN 0 THEN event_id "
    "WHEN 1 THEN NULL ELSE 'unknown' END AS event_id, deck, start_time_utc, "
    "CASE WHEN day(start_time_utc) % 2 = 0 THEN end_time_utc ELSE end_time_utc + INTERVAL 1 SECOND END "
    "AS end_time_utc, active_sensor_count AS n FROM event_list",
    "inc": "SELECT * FROM annotated WHERE sensor_status = 'included'",
    "hits": "SELECT q.request_id, 1 AS kind, r.sensor_name, r.record_uid, r.set_name FROM requests q JOIN inc r USING (event_id) "
    "UNION ALL SELECT q.request_id, 2, r.sensor_name, r.record_uid, r.set_name FROM requests q JOIN inc r ON q.deck = r.deck "
    "AND q.start_time_utc = r.event_start_time_utc AND q.end_time_utc = r.event_end_time_utc "
    "UNION ALL SELECT q.request_id, 3, r.sensor_name, r.record_uid, r.set_name FROM requests q JOIN inc r ON q.deck = r.deck "
    "AND q.start_time_utc = r.start_time_utc AND r.end_time_utc <= q.end_time_utc",
    "chosen": "SELECT q.request_id, CASE "
    "WHEN q.event_id IS NOT NULL AND (SELECT count(DISTINCT sensor_name) FROM hits h WHERE h.request_id = q.request_id AND kind = 1) >= q.n THEN 1 "
    "WHEN (SELECT count(DISTINCT sensor_name) FROM hits h WHERE h.request_id = q.request_id AND kind = 2) >= greatest(q.n, 1) THEN 2 "
    "ELSE 3 END AS kind FROM requests q",
}


@query(
    "resolved_event_records",
    with_views(
        "SELECT request_id, step, sensor_name, record_uid FROM ("
        "SELECT c.request_id, q.kind AS step, sensor_name, record_uid FROM hits c JOIN chosen q "
        "ON c.request_id = q.request_id AND c.kind = q.kind)",
        "event_list",
        extra=_RESOLVE,
    ),
)
def resolved_event_records(spark, folder):
    """Records found again by id, by exact window, or by start, whichever step first suffices."""
    rows = cut_lineage(events.included_records(annotated(spark, folder)))
    resolved = events.resolve_event_records(rows, _requests(rows).drop("active_sensors"))
    return tidy(resolved.select("request_id", "step", "sensor_name", "record_uid"))


def _requests(rows):
    day = F.dayofmonth("start_time_utc")
    return events.group_events(rows).select(
        F.col("event_id").alias("request_id"),
        F.when(day % 3 == 0, F.col("event_id")).when(day % 3 == 2, F.lit("unknown")).alias("event_id"),
        "deck",
        "start_time_utc",
        F.when(day % 2 == 0, F.col("end_time_utc"))
        .otherwise(F.col("end_time_utc") + F.expr("INTERVAL 1 SECOND"))
        .alias("end_time_utc"),
        "active_sensor_count",
        "active_sensors",
    )


@query(
    "loaded_events",
    with_views(
        "SELECT r.request_id, r.sensor_name, r.files AS raw_file_count, count(s.row_1based) FILTER (s.row_1based % 7 <> 0) AS row_count, "
        f"count(s.row_1based) FILTER (s.row_1based % 7 = 0) AS dropped_rows, {rnd('coalesce(sum(s.value) FILTER (s.row_1based % 7 <> 0), 0)')} AS value_sum "
        "FROM one r LEFT JOIN samples s ON r.files = 1 AND r.set_name = s.set_name AND r.sensor_name = s.sensor_name AND r.raw_file = s.raw_file "
        "AND s.row_1based BETWEEN r.a AND r.b GROUP BY ALL",
        "event_list",
        "samples",
        extra={
            **_RESOLVE,
            "one": "SELECT c.request_id, c.sensor_name, count(DISTINCT a.raw_file) AS files, any_value(a.raw_file) AS raw_file, "
            "any_value(a.set_name) AS set_name, min(a.start_row_1based) AS a, max(a.end_row_1based) AS b FROM hits c "
            "JOIN chosen q ON c.request_id = q.request_id AND c.kind = q.kind JOIN requests w ON w.request_id = c.request_id "
            "JOIN inc a ON a.set_name = c.set_name AND a.sensor_name = c.sensor_name AND a.record_uid = c.record_uid "
            "WHERE day(w.start_time_utc) % 2 = 0 OR c.sensor_name LIKE '%STR' GROUP BY c.request_id, c.sensor_name",
        },
    ),
)
def loaded_events(spark, folder):
    """Waveforms of requested events: records resolved, sensors chosen, ranges widened, rows cut out and counted."""
    rows = cut_lineage(events.included_records(annotated(spark, folder)))
    strain = F.filter("active_sensors", lambda s: F.endswith(s, F.lit("STR")))
    sensors = F.when(F.dayofmonth("start_time_utc") % 2 != 0, strain).alias("sensors")
    requests = _requests(rows).select("*", sensors).drop("active_sensors")
    clock = F.when(F.col("row_1based") % 7 != 0, F.col("timestamp_utc"))
    samples = tables.raw_samples(spark, folder).withColumn("timestamp_utc", clock)
    loaded, waves = joins.load_events(rows, requests, samples)
    keys = ["request_id", "sensor_name"]
    sums = waves.groupBy(*keys).agg(F.sum("value").alias("value_sum"))
    done = loaded.select(*keys, "raw_file_count", "row_count", "dropped_rows").join(sums, keys, "left")
    return tidy(done.fillna(0.0, ["value_sum"]))


@query(
    "sensor_record_counts",
    with_views(
        "SELECT set_name, sensor_name, split_part(sensor_name, '_', 1) AS deck, split_part(sensor_name, '_', 2) AS span, "
        "split_part(sensor_name, '_', 3) AS side, split_part(sensor_name, '_', 4) AS location, "
        "split_part(sensor_name, '_', 5) AS quantity, nullif(split_part(sensor_name, '_', 6), '') AS axis, "
        "count(*) AS record_count FROM records WHERE sensor_name LIKE '%ACC!_Z' ESCAPE '!' GROUP BY ALL",
        "records",
    ),
)
def sensor_record_counts(spark, folder):
    return events.sensor_record_counts(tables.records(spark, folder), quantity="acc", axis="z")


@query(
    "long_enough_records",
    with_views(
        f"SELECT set_name, sensor_name, record_uid, {rnd('duration')} AS duration FROM records "
        "WHERE duration >= 18000 AND sensor_name LIKE 'OLD%ACC!_Z' ESCAPE '!'",
        "records",
    ),
)
def long_enough_records(spark, folder):
    kept = events.filter_min_duration(tables.records(spark, folder), 18000, deck="OLD")
    return tidy(kept.select("set_name", "sensor_name", "record_uid", "duration"))


DURATION_SQL = (
    "SELECT set_name, sensor_name, count(*) AS record_count, count(*) FILTER (duration >= 18000) AS kept_count, "
    "count(*) FILTER (duration < 18000) AS removed_count, "
    f"{rnd('count(*) FILTER (duration >= 18000) / count(*)', 8)} AS kept_fraction, "
    "18000.0::DOUBLE AS min_duration_seconds FROM records WHERE sensor_name LIKE '%STR' GROUP BY ALL"
)


@query("min_duration_summary", with_views(DURATION_SQL, "records"))
def min_duration_summary(spark, folder):
    summary = events.summarize_min_duration(tables.records(spark, folder), 18000, quantity="STR")
    return tidy(summary, {"kept_fraction": 8})


@query(
    "min_duration_roll_up",
    with_views(
        "SELECT set_name, count(*) AS sensor_count, CAST(sum(record_count) AS BIGINT) AS record_count, "
        "CAST(sum(kept_count) AS BIGINT) AS kept_count, CAST(sum(removed_count) AS BIGINT) AS removed_count, "
        f"{rnd('sum(kept_count) / sum(record_count)', 8)} AS kept_fraction FROM per_sensor GROUP BY ALL",
        "records",
        extra={"per_sensor": DURATION_SQL},
    ),
)
def min_duration_roll_up(spark, folder):
    summary = events.summarize_min_duration(tables.records(spark, folder), 18000, quantity="STR")
    return tidy(events.roll_up_duration(summary), {"kept_fraction": 8})


@query(
    "set_summary",
    with_views(
        "SELECT set_name, count(*) AS sensor_count, count(*) FILTER (sensor_name LIKE '%ACC%') AS acc_count, "
        "count(*) FILTER (sensor_name LIKE '%STR%') AS str_count, arg_min(n, sensor_name) AS records_per_sensor, "
        f"{iso('arg_min(lo, sensor_name)')} AS period_start, {iso('arg_min(hi, sensor_name)')} AS period_end "
        "FROM (SELECT set_name, sensor_name, count(*) AS n, min(start_time_utc) AS lo, max(start_time_utc) AS hi "
        "FROM records GROUP BY ALL) GROUP BY set_name",
        "records",
    ),
)
def set_summary(spark, folder):
    return tidy(events.summarize_sets(tables.records(spark, folder)))


@query(
    "common_sensor_events",
    with_views(
        f"SELECT set_name, {iso('start_time_utc')} AS start_time_utc, {iso('end_time_utc')} AS end_time_utc, "
        "string_agg(DISTINCT sensor_name, ',' ORDER BY sensor_name) AS sensor_names, count(DISTINCT sensor_name) AS sensor_count, "
        "any_value(expected) AS channel_count, 'ALL' AS deck "
        "FROM kept JOIN (SELECT set_name, count(DISTINCT sensor_name) AS expected FROM kept GROUP BY ALL) USING (set_name) "
        "GROUP BY set_name, start_time_utc, end_time_utc HAVING count(DISTINCT sensor_name) = any_value(expected)",
        "grouped",
        extra={
            "kept": "SELECT set_name, sensor_name, start_time_utc, max(end_time_utc) OVER (PARTITION BY set_name, "
            "start_time_utc) AS end_time_utc FROM grouped WHERE sensor_name LIKE '%ACC!_Z' ESCAPE '!' AND duration >= 9000"
        },
    ),
)
def common_sensor_events(spark, folder):
    """Windows that every vertical accelerometer of the set recorded long enough."""
    rows = events.filter_min_duration(tables.records(spark, folder), 9000)
    # Triggers share a start; let them share the latest end as well.
    ends = rows.groupBy("set_name", "start_time_utc").agg(F.max("end_time_utc").alias("end_time_utc"))
    shared = rows.drop("end_time_utc").join(ends, ["set_name", "start_time_utc"])
    return tidy(events.common_sensor_events(shared, 9000))


@query(
    "missing_sets",
    with_views(
        "SELECT set_name FROM (VALUES ('SPAN_SET1_2024_01'), ('SPAN_SET5_2024_01'), ('SPAN_SET6_2024_01'), "
        "('SPAN_SET9_2024_01')) t(set_name) WHERE set_name NOT IN (SELECT set_name FROM readings)",
        "readings",
    ),
)
def missing_sets(spark, folder):
    expected = spark.createDataFrame([(f"SPAN_SET{i}_2024_01",) for i in (1, 5, 6, 9)], "set_name string")
    return events.missing_sets(expected, tables.readings(spark, folder))


@query(
    "sensor_dimension_upsert",
    with_views(
        "SELECT sensor_name, min(set_name) AS first_set FROM records WHERE sensor_name NOT IN "
        "(SELECT sensor_name FROM records WHERE deck = 'OLD' AND set_name = 'SPAN_SET1_2024_01') GROUP BY sensor_name",
        "records",
    ),
)
def sensor_dimension_upsert(spark, folder):
    """Sensors of later sets that the stored dimension lacks."""
    rows = tables.records(spark, folder)
    stored = rows.filter("deck = 'OLD' AND set_name = 'SPAN_SET1_2024_01'").select("sensor_name").distinct()
    first = rows.groupBy("sensor_name").agg(F.min("set_name").alias("first_set"))
    return events.new_sensors(first, stored)


@query(
    "unprocessed_events",
    with_views(
        "SELECT event_id, set_name, active_sensor_count FROM event_list WHERE active_sensor_count = 6 "
        "AND event_id NOT IN (SELECT event_id FROM event_list WHERE hour(start_time_utc) < 12)",
        "event_list",
    ),
)
def unprocessed_events(spark, folder):
    """Exactly-N-sensor events that a previous run has not handled."""
    found = event_list(spark, folder)
    done = found.filter(F.hour("start_time_utc") < 12)
    wanted = found.filter(F.col("active_sensor_count") == 6)
    return events.unprocessed(wanted, done).select("event_id", "set_name", "active_sensor_count")


@query(
    "modal_targets",
    with_views("SELECT DISTINCT set_name, deck FROM event_list", "event_list"),
)
def modal_targets(spark, folder):
    return event_list(spark, folder).select("set_name", "deck").distinct().orderBy("set_name", "deck")


@query(
    "sensors_over_sets",
    with_views("SELECT DISTINCT sensor_name FROM (SELECT * FROM readings)", "readings"),
)
def sensors_over_sets(spark, folder):
    """Union of every set's sensors, by name."""
    rows = tables.readings(spark, folder).select("set_name", "sensor_name", "temperature")
    acc = rows.filter(F.col("sensor_name").contains("ACC")).drop("temperature")
    strain = rows.filter(~F.col("sensor_name").contains("ACC"))
    return acc.unionByName(strain, allowMissingColumns=True).select("sensor_name").distinct().orderBy("sensor_name")


@query(
    "timestamp_forms",
    "SELECT CAST(event_id AS BIGINT) AS event_id, "
    + iso("CASE event_id % 4 WHEN 1 THEN date_trunc('second', ts) ELSE ts END")
    + " AS parsed_ms, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seconds, event_id % 4 <> 3 AS parsed "
    "FROM events",
)
def timestamp_forms(spark, folder):
    """Text in mixed layouts, with and without fraction or offset, parsed to one UTC instant."""
    ts = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 4
    shifted = F.concat(
        F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")
    )
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 2, shifted)
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )
    parsed = times.parse_utc(text)
    broken = times.parse_utc(F.when(kind == 3, F.lit("not a time")).otherwise(text))
    return tables.read_table(spark, folder, "events").select(
        "event_id",
        times.iso_millis(parsed).alias("parsed_ms"),
        times.iso_seconds(parsed).alias("seconds"),
        broken.isNotNull().alias("parsed"),
    )


@query(
    "unparsed_timestamp_counts",
    with_views(
        "SELECT set_name, sensor_name, count(*) FILTER (reading_id % 7 = 0) AS dropped_rows, count(*) AS row_count "
        "FROM readings GROUP BY ALL",
        "readings",
    ),
)
def unparsed_timestamp_counts(spark, folder):
    """Rows lost to unusable timestamps, per sensor."""
    text = F.when(F.col("reading_id") % 7 == 0, F.lit("bad clock")).otherwise(times.iso_millis(F.col("timestamp_utc")))
    rows = tables.readings(spark, folder).withColumn("timestamp_utc", times.parse_utc(text))
    return joins.unparsed_counts(rows, ["set_name", "sensor_name"])


@query(
    "numeric_coercion",
    "SELECT event_type, count(*) FILTER (event_id % 3 <> 0) AS numbers, count(*) FILTER (event_id % 3 = 0) AS not_numbers, "
    "CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS whole_sum FROM events GROUP BY event_type",
)
def numeric_coercion(spark, folder):
    """Text to number or NULL, and one-element lists to whole numbers."""
    text = F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    number = numbers.to_number(text)
    whole = numbers.to_int(F.element_at(F.array("value"), 1), "value")
    return (
        tables.read_table(spark, folder, "events")
        .groupBy("event_type")
        .agg(
            F.count(number).alias("numbers"),
            F.count_if(number.isNull()).alias("not_numbers"),
            F.sum(whole).alias("whole_sum"),
        )
    )


@query(
    "sets_from_event_ids",
    with_views(
        "SELECT regexp_extract(event_id, '^(SPAN_SET[0-9]+_[0-9]{4}_[0-9]{2})', 1) AS set_prefix, "
        "any_value(regexp_extract(set_name, '(SET[0-9]+)_', 1)) AS set_label, "
        "any_value(CAST(regexp_extract(set_name, 'SET([0-9]+)_', 1) AS BIGINT)) AS set_position, count(*) AS event_count, "
        f"{iso('min(start_time_utc)')} AS first_start FROM event_list GROUP BY ALL",
        "event_list",
    ),
)
def sets_from_event_ids(spark, folder):
    """Sets discovered from event-id prefixes, with label, position and first start read from ids."""
    prefix = F.regexp_extract("event_id", r"^(SPAN_SET\d+_\d{4}_\d{2})", 1)
    found = event_list(spark, folder).select(
        prefix.alias("set_prefix"), "set_name", naming.event_start(F.col("event_id")).alias("start")
    )
    per_set = found.groupBy("set_prefix").agg(
        F.first(naming.set_label(F.col("set_name"))).alias("set_label"),
        F.first(naming.set_position(F.col("set_name"))).alias("set_position"),
        F.count(F.lit(1)).alias("event_count"),
        F.min("start").alias("first_start"),
    )
    return tidy(per_set)


@query(
    "settings_json",
    with_views(
        "SELECT event_id, '[' || list_aggregate(list_transform(string_split(active_sensors, ','), lambda x: '\"' || x || '\"'), "
        "'string_agg', ',') || ']' AS active_sensors_json, active_sensor_count AS decoded_count FROM event_list",
        "event_list",
    ),
)
def settings_json(spark, folder):
    """Sensor lists to JSON text and back."""
    encoded = event_list(spark, folder).select("event_id", F.to_json("active_sensors").alias("active_sensors_json"))
    decoded = F.from_json("active_sensors_json", "array<string>")
    return encoded.withColumn("decoded_count", F.size(decoded).cast("bigint"))
