"""Event model: grouping index records into events, selection, exclusion and discard rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwave.functions import naming, times

GROUPING_METHODS = ("exact_window", "shared_start")
# Texts of the exclusion log.
DECK_REASON, DECK_SOURCE = "deck not selected for preprocessing", "preprocessing.sensor_selection.decks"
CHANNEL_REASON, CHANNEL_SOURCE = "channel not selected for neural preprocessing", "preprocessing sensor selection"
# Why an event is discarded.
TOO_FEW_SENSORS, NO_COMMON_ROWS = "insufficient_active_sensors", "no_common_aligned_rows"
EVENT_KEYS = ["event_id", "set_name", "deck", "event_start_time_utc", "event_end_time_utc"]


def sensor_dimension(records: DataFrame) -> DataFrame:
    """Distinct sensors with their parsed name parts."""
    names = records.select("sensor_name").distinct()
    return names.select("sensor_name", *naming.sensor_parts(F.col("sensor_name")).values())


def add_sensor_order(records: DataFrame) -> DataFrame:
    """Add the 1-based rank of each sensor's name within its set."""
    sensors = records.select("set_name", "sensor_name").distinct()
    by_name = Window.partitionBy("set_name").orderBy("sensor_name")
    return records.join(
        sensors.withColumn("sensor_order", F.row_number().over(by_name)), ["set_name", "sensor_name"]
    )


def assign_event_groups(records: DataFrame, method: str = "exact_window") -> DataFrame:
    """Add event start, end and id to each record.

    ``exact_window`` takes the record's own end; ``shared_start`` the latest end of the records
    with the same set, deck and start.
    """
    if method not in GROUPING_METHODS:
        raise ValueError(f"unsupported event grouping method {method!r}; use one of {GROUPING_METHODS}")
    if method == "exact_window":
        grouped = records.withColumn("event_end_time_utc", F.col("end_time_utc"))
    else:
        # One trigger gives each sensor of a deck one record, so these groups are short.
        trigger = Window.partitionBy("set_name", "deck", "start_time_utc")
        grouped = records.withColumn("event_end_time_utc", F.max("end_time_utc").over(trigger))
    return grouped.withColumn("event_start_time_utc", F.col("start_time_utc")).withColumn(
        "event_id",
        naming.event_id(
            F.col("set_name"), F.col("deck"), F.col("event_start_time_utc"), F.col("event_end_time_utc")
        ),
    )


def filter_records(
    records: DataFrame, *, deck: str | None = None, sensor_pattern: str | None = None
) -> DataFrame:
    if deck is not None:
        records = records.filter(F.col("deck") == deck)
    if sensor_pattern is not None:
        records = records.filter(naming.matches_pattern(F.col("sensor_name"), sensor_pattern))
    return records


def group_events(records: DataFrame) -> DataFrame:
    """One row per event with its sensors in sensor order."""
    sensors = F.array_sort(F.collect_set(F.struct("sensor_order", "sensor_name")))
    return (
        records.groupBy(*EVENT_KEYS)
        .agg(sensors.alias("_sensors"))
        .select(
            "event_id",
            "set_name",
            "deck",
            F.col("event_start_time_utc").alias("start_time_utc"),
            F.col("event_end_time_utc").alias("end_time_utc"),
            F.size("_sensors").cast("bigint").alias("active_sensor_count"),
            F.transform("_sensors", lambda s: s["sensor_name"]).alias("active_sensors"),
        )
    )


def find_events(
    records: DataFrame,
    *,
    timestamp: str | None = None,
    deck: str | None = None,
    sensor_pattern: str | None = None,
    grouping_method: str = "exact_window",
) -> DataFrame:
    """Events of the selected records; with ``timestamp`` only those strictly around it."""
    selected = filter_records(records, deck=deck, sensor_pattern=sensor_pattern)
    found = group_events(assign_event_groups(selected, grouping_method))
    if timestamp is None:
        return found
    at = times.parse_utc(F.lit(timestamp))
    return found.filter((F.col("start_time_utc") < at) & (F.col("end_time_utc") > at))


def collapse_records(records: DataFrame, keys: Iterable[str] = ("event_id", "sensor_name")) -> DataFrame:
    """Widen several records of one sensor in one event into one row.

    Row and time ranges become the outer ones, all other columns come from the first record.
    ``raw_file_count`` above 1 marks a sensor spread over files, which cannot be sliced.
    """
    keys = list(keys)
    widened = ("start_row_1based", "end_row_1based", "start_time_utc", "end_time_utc")
    kept = [c for c in records.columns if c not in (*keys, *widened)]
    place = F.struct("sensor_order", "start_time_utc", "start_row_1based")
    grouped = records.groupBy(*keys).agg(
        F.min("start_row_1based").alias("start_row_1based"),
        F.max("end_row_1based").alias("end_row_1based"),
        F.min("start_time_utc").alias("start_time_utc"),
        F.max("end_time_utc").alias("end_time_utc"),
        F.min_by(F.struct(*kept), place).alias("_first"),
        F.size(F.collect_set("raw_file")).cast("bigint").alias("raw_file_count"),
    )
    return grouped.select(*keys, *widened, "raw_file_count", "_first.*")


def collapse_single_file(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collapsed records that can be sliced, and the rejects whose sensor spans several files."""
    collapsed = collapse_records(records)
    spread = F.col("raw_file_count") > 1
    rejects = collapsed.filter(spread).select("event_id", "sensor_name", "raw_file_count")
    return collapsed.filter(~spread).drop("raw_file_count"), rejects


def annotate_records(
    records: DataFrame,
    *,
    decks: Iterable[str] = (),
    strain_locations: Iterable[str] = ("INF", "SUP"),
    acc_axis: str = "Z",
    exclusions: DataFrame | None = None,
) -> DataFrame:
    """Add inclusion status, reason and source to each record.

    Deck selection is tested before channel selection; a configured exclusion (``set_name,
    sensor_name, reason, source``) comes last and replaces both.
    """
    parts = naming.sensor_parts(F.col("sensor_name"))
    decks = [d.upper() for d in decks]
    wrong_deck = ~F.upper("deck").isin(decks) if decks else F.lit(False)
    is_strain = (parts["quantity"] == "STR") & F.upper(parts["location"]).isin(list(strain_locations))
    is_acc = (parts["quantity"] == "ACC") & F.coalesce(parts["axis"] == acc_axis, F.lit(False))
    wrong_channel = ~(is_strain | is_acc)
    reason = (
        F.when(wrong_deck, F.lit(DECK_REASON))
        .when(wrong_channel, F.lit(CHANNEL_REASON))
        .otherwise(F.lit(""))
    )
    source = (
        F.when(wrong_deck, F.lit(DECK_SOURCE))
        .when(wrong_channel, F.lit(CHANNEL_SOURCE))
        .otherwise(F.lit(""))
    )
    status = F.when(wrong_deck | wrong_channel, F.lit("excluded")).otherwise(F.lit("included"))
    base = records.withColumns(
        {"sensor_status": status, "exclusion_reason": reason, "exclusion_source": source}
    )
    if exclusions is None:
        return base
    listed = exclusions.select(
        "set_name", "sensor_name", F.col("reason").alias("_reason"), F.col("source").alias("_source")
    )
    hit = F.col("_reason").isNotNull()
    return (
        base.join(listed, ["set_name", "sensor_name"], "left")
        .withColumns(
            {
                "sensor_status": F.when(hit, F.lit("excluded")).otherwise(F.col("sensor_status")),
                "exclusion_reason": F.coalesce("_reason", "exclusion_reason"),
                "exclusion_source": F.coalesce("_source", "exclusion_source"),
            }
        )
        .drop("_reason", "_source")
    )


def included_records(annotated: DataFrame) -> DataFrame:
    return annotated.filter(F.col("sensor_status") == "included")


def exclusion_log(annotated: DataFrame) -> DataFrame:
    return (
        annotated.filter(F.col("sensor_status") == "excluded")
        .groupBy("set_name", "sensor_name", "exclusion_reason", "exclusion_source")
        .agg(F.count(F.lit(1)).alias("record_count"))
    )


def excluded_per_event(annotated: DataFrame) -> DataFrame:
    """Excluded sensors and the distinct reasons of each event."""
    sensors = F.array_sort(F.collect_set(F.struct("sensor_order", "sensor_name")))
    reasons = F.array_sort(F.collect_set(F.when(F.trim("exclusion_reason") != "", F.col("exclusion_reason"))))
    return (
        annotated.filter(F.col("sensor_status") == "excluded")
        .groupBy("event_id")
        .agg(sensors.alias("_s"), reasons.alias("excluded_sensor_reasons"))
        .select(
            "event_id",
            F.size("_s").cast("bigint").alias("excluded_sensor_count"),
            F.transform("_s", lambda s: s["sensor_name"]).alias("excluded_sensors"),
            "excluded_sensor_reasons",
        )
    )


def mark_discards(
    events: DataFrame, *, min_active_sensors: int, aligned_counts: DataFrame | None = None
) -> DataFrame:
    """Add ``discarded`` and ``discard_reason``: too few sensors first, then no aligned rows."""
    too_few = F.col("active_sensor_count") < min_active_sensors
    if aligned_counts is None:
        reason = F.when(too_few, F.lit(TOO_FEW_SENSORS)).otherwise(F.lit(""))
        marked = events.withColumn("rows_after_alignment", F.lit(None).cast("bigint"))
    else:
        marked = events.join(
            aligned_counts.select("event_id", F.col("aligned_rows").alias("rows_after_alignment")),
            "event_id",
            "left",
        ).withColumn(
            "rows_after_alignment",
            F.when(too_few, F.lit(0)).otherwise(F.coalesce("rows_after_alignment", F.lit(0))).cast("bigint"),
        )
        reason = (
            F.when(too_few, F.lit(TOO_FEW_SENSORS))
            .when(F.col("rows_after_alignment") == 0, F.lit(NO_COMMON_ROWS))
            .otherwise(F.lit(""))
        )
    return marked.withColumn("discard_reason", reason).withColumn("discarded", F.col("discard_reason") != "")


def reference_sensors(records: DataFrame) -> DataFrame:
    """The first sensor of each event in sensor order."""
    return records.groupBy("event_id").agg(
        F.min_by("sensor_name", F.struct("sensor_order", "sensor_name")).alias("reference_sensor")
    )


def event_sensor_rows(annotated: DataFrame, reference: DataFrame) -> DataFrame:
    """The event-sensor bridge: collapsed records flagged with the event's reference sensor."""
    collapsed, _ = collapse_single_file(annotated)
    joined = collapsed.join(reference.select("event_id", "reference_sensor"), "event_id", "left")
    return joined.withColumn(
        "is_reference",
        F.coalesce(F.col("sensor_name") == F.col("reference_sensor"), F.lit(False)).cast("int"),
    ).drop("reference_sensor")


def run_summary(marked: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Counts of a preprocessing run as (section, name, count) rows."""
    by_event = marked.select(
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("section"), F.lit("events").alias("name")),
                F.struct(
                    F.lit("outcome").alias("section"),
                    F.when(F.col("discarded"), F.lit("discarded")).otherwise(F.lit("retained")).alias("name"),
                ),
                F.struct(F.lit("deck_total").alias("section"), F.col("deck").alias("name")),
                F.struct(
                    F.when(F.col("discarded"), F.lit("discard_reason")).otherwise(F.lit("deck_retained"))
                    .alias("section"),
                    F.when(F.col("discarded"), F.col("discard_reason")).otherwise(F.col("deck")).alias("name"),
                ),
            )
        ).alias("entry"),
        F.lit(1).cast("bigint").alias("n"),
    )
    by_record = exclusions.select(
        F.explode(
            F.array(
                F.struct(F.lit("excluded_by_set").alias("section"), F.col("set_name").alias("name")),
                F.struct(
                    F.lit("excluded_by_reason").alias("section"), F.col("exclusion_reason").alias("name")
                ),
            )
        ).alias("entry"),
        F.col("record_count").alias("n"),
    )
    return (
        by_event.unionByName(by_record)
        .groupBy("entry.section", "entry.name")
        .agg(F.sum("n").alias("count"))
    )


def resolve_event_records(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records of each requested event (``request_id, event_id, deck, start_time_utc, end_time_utc,
    active_sensor_count``, and ``set_name`` where the events of several sets are told apart).

    Tried in turn: the event id; the same deck and event window; the same start with an end not
    after the request's. A step is passed over when it finds fewer sensors than the request names.
    """
    r = records.alias("r")
    q = requests.alias("q")
    asked = [F.col(f"q.{c}").alias(f"_q_{c}") for c in requests.columns]
    own = [F.col(f"r.{c}") for c in records.columns]

    def step(level: int, condition) -> DataFrame:
        return r.join(q, condition).select(*asked, *own, F.lit(level).alias("_level"))

    same_deck = F.col("r.deck") == F.col("q.deck")
    if "set_name" in requests.columns:
        same_deck = same_deck & (F.col("r.set_name") == F.col("q.set_name"))
    found = (
        step(1, F.col("r.event_id") == F.col("q.event_id"))
        .unionByName(
            step(
                2,
                same_deck
                & (F.col("r.event_start_time_utc") == F.col("q.start_time_utc"))
                & (F.col("r.event_end_time_utc") == F.col("q.end_time_utc")),
            )
        )
        .unionByName(
            step(
                3,
                same_deck
                & (F.col("r.start_time_utc") == F.col("q.start_time_utc"))
                & (F.col("r.end_time_utc") <= F.col("q.end_time_utc")),
            )
        )
    )
    per_step = found.groupBy("_q_request_id").agg(
        *[
            F.count_distinct(F.when(F.col("_level") == level, F.col("sensor_name"))).alias(f"_n{level}")
            for level in (1, 2)
        ],
        F.first("_q_event_id").alias("_has_id"),
        F.coalesce(F.first("_q_active_sensor_count"), F.lit(0)).alias("_expected"),
    )
    chosen = per_step.select(
        "_q_request_id",
        F.when(F.col("_has_id").isNotNull() & (F.col("_n1") >= F.col("_expected")), F.lit(1))
        .when((F.col("_n2") > 0) & (F.col("_n2") >= F.col("_expected")), F.lit(2))
        .otherwise(F.lit(3))
        .alias("_level"),
    )
    widened = F.col("_level") == 3
    start = F.when(widened, F.col("_q_start_time_utc")).otherwise(F.col("event_start_time_utc"))
    end = F.when(widened, F.col("_q_end_time_utc")).otherwise(F.col("event_end_time_utc"))
    rebuilt = naming.event_id(F.col("set_name"), F.col("deck"), start, end)
    return (
        found.join(chosen, ["_q_request_id", "_level"])
        .withColumns(
            {
                "event_id": F.when(widened, F.coalesce("_q_event_id", rebuilt)).otherwise(F.col("event_id")),
                "event_start_time_utc": start,
                "event_end_time_utc": end,
            }
        )
        .select(F.col("_q_request_id").alias("request_id"), F.col("_level").alias("step"), *records.columns)
    )


def filter_min_duration(
    records: DataFrame,
    min_seconds: float = 10.0,
    *,
    quantity: str | None = "ACC",
    axis: str | None = "Z",
    deck: str | None = None,
) -> DataFrame:
    return select_channels(records, quantity=quantity, axis=axis, deck=deck).filter(
        F.col("duration") >= min_seconds
    )


def select_channels(
    records: DataFrame, *, quantity: str | None = None, axis: str | None = None, deck: str | None = None
) -> DataFrame:
    parts = naming.sensor_parts(F.col("sensor_name"))
    for part, wanted in (("quantity", quantity), ("axis", axis), ("deck", deck)):
        if wanted is not None:
            records = records.filter(parts[part] == wanted.upper())
    return records


def sensor_record_counts(
    records: DataFrame, *, quantity: str | None = None, axis: str | None = None
) -> DataFrame:
    """Record count per set and sensor beside the parsed name."""
    counted = (
        select_channels(records, quantity=quantity, axis=axis)
        .groupBy("set_name", "sensor_name")
        .agg(F.count(F.lit(1)).alias("record_count"))
    )
    return counted.select(
        "set_name",
        "sensor_name",
        *naming.sensor_parts(F.col("sensor_name"), strict=True).values(),
        "record_count",
    )


def summarize_min_duration(records: DataFrame, min_seconds: float = 10.0, **selection) -> DataFrame:
    kept = F.count_if(F.col("duration") >= min_seconds)
    total = F.count(F.lit(1))
    return (
        select_channels(records, **selection)
        .groupBy("set_name", "sensor_name")
        .agg(
            total.alias("record_count"),
            kept.alias("kept_count"),
            (total - kept).alias("removed_count"),
            F.coalesce(F.try_divide(kept, total), F.lit(0.0)).alias("kept_fraction"),
        )
        .withColumn("min_duration_seconds", F.lit(float(min_seconds)))
    )


def roll_up_duration(summary: DataFrame) -> DataFrame:
    kept, total = F.sum("kept_count"), F.sum("record_count")
    return summary.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("sensor_count"),
        total.alias("record_count"),
        kept.alias("kept_count"),
        F.sum("removed_count").alias("removed_count"),
        F.coalesce(F.try_divide(kept, total), F.lit(0.0)).alias("kept_fraction"),
    )


def summarize_sets(records: DataFrame) -> DataFrame:
    """Per set: sensors by quantity, records of its first sensor, and period of that sensor."""
    per_sensor = records.groupBy("set_name", "sensor_name").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("start_time_utc").alias("first_start"),
        F.max("start_time_utc").alias("last_start"),
    )
    return per_sensor.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("sensor_count"),
        F.count_if(F.contains(F.col("sensor_name"), F.lit("ACC"))).alias("acc_count"),
        F.count_if(F.contains(F.col("sensor_name"), F.lit("STR"))).alias("str_count"),
        F.min_by("records", "sensor_name").alias("records_per_sensor"),
        F.min_by("first_start", "sensor_name").alias("period_start"),
        F.min_by("last_start", "sensor_name").alias("period_end"),
    )


def common_sensor_events(
    records: DataFrame,
    min_seconds: float = 10.0,
    *,
    quantity: str | None = "ACC",
    axis: str | None = "Z",
    deck: str | None = None,
) -> DataFrame:
    """Windows recorded by every selected sensor of the set after the duration filter."""
    kept = filter_min_duration(records, min_seconds, quantity=quantity, axis=axis, deck=deck)
    expected = kept.groupBy("set_name").agg(F.count_distinct("sensor_name").alias("channel_count"))
    windows = kept.groupBy("set_name", "start_time_utc", "end_time_utc").agg(
        F.array_sort(F.collect_set("sensor_name")).alias("sensor_names")
    )
    return (
        windows.withColumn("sensor_count", F.size("sensor_names").cast("bigint"))
        .join(expected, "set_name")
        .filter(F.col("sensor_count") == F.col("channel_count"))
        .withColumn("deck", F.lit(deck.upper() if deck else "ALL"))
    )


def missing_sets(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected set names that ``observed`` does not hold."""
    return expected.select("set_name").join(observed.select("set_name").distinct(), "set_name", "left_anti")


def new_sensors(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Sensors to append to the dimension: first seen once, and not stored yet."""
    return incoming.dropDuplicates(["sensor_name"]).join(existing, "sensor_name", "left_anti")


def unprocessed(events: DataFrame, processed: DataFrame) -> DataFrame:
    """Events whose id is not among the processed ones."""
    return events.join(processed.select("event_id").distinct(), "event_id", "left_anti")


def list_sensors(annotated: DataFrame, dimension: DataFrame, **predicates: str | None) -> DataFrame:
    """Distinct sensors of the record table with the smallest order each holds."""
    joined = annotated.join(dimension.drop("deck"), "sensor_name")
    for column, wanted in predicates.items():
        if wanted is not None:
            joined = joined.filter(F.col(column) == wanted)
    return joined.groupBy(
        "set_name", "deck", "sensor_name", "span", "side", "location", "quantity", "axis"
    ).agg(F.min("sensor_order").alias("sensor_order"))


def list_events(
    events: DataFrame,
    *,
    set_name: str | None = None,
    deck: str | None = None,
    discarded: bool | None = None,
) -> DataFrame:
    """Event catalogue under optional predicates, in catalogue order."""
    for column, wanted in (("set_name", set_name), ("deck", deck), ("discarded", discarded)):
        if wanted is not None:
            events = events.filter(F.col(column) == F.lit(wanted))
    return events.orderBy("set_name", "deck", "start_time_utc", "event_id")
