from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spanwave.functions import naming, times
from spanwave.operators import events, joins

A, B, C = "NEW_S1_DO_INF_STR", "NEW_S1_DO_MID_ACC_Z", "NEW_S1_DO_SUP_STR"
T0 = datetime(2022, 7, 1)


def at(s):
    return T0.replace(second=int(s), microsecond=int(round((s % 1) * 1e6)))


def records(spark, rows):
    df = spark.createDataFrame(
        [("SET1", n.split("_")[0], n, f, a, b, at(s), at(e)) for n, f, a, b, s, e in rows],
        "set_name string, deck string, sensor_name string, raw_file string, start_row_1based bigint, "
        "end_row_1based bigint, start_time_utc timestamp, end_time_utc timestamp",
    )
    return events.add_sensor_order(df)


def test_event_ids(spark):
    df = spark.createDataFrame([(at(1), at(2.25))], "s timestamp, e timestamp")
    row = df.select(
        naming.event_id(F.lit("SET1"), F.lit("OLD"), F.col("s"), F.col("e")).alias("id")
    ).withColumn("start", naming.event_start(F.col("id"))).first()
    assert row.id == "SET1__OLD__2022-07-01T00-00-01Z__2022-07-01T00-00-02.250Z"
    assert row.start == at(1)


def test_shared_start_and_exact_window(spark):
    rows = records(spark, [(A, "f", 1, 2, 0, 2), (B, "f", 1, 3, 0, 3)])
    assert events.find_events(rows, grouping_method="exact_window").count() == 2
    shared = events.find_events(rows, grouping_method="shared_start").collect()
    assert len(shared) == 1 and shared[0].end_time_utc == at(3) and shared[0].active_sensors == [A, B]
    with pytest.raises(ValueError):
        events.assign_event_groups(rows, "other")


def test_containment_leaves_out_boundaries(spark):
    rows = records(spark, [(A, "f", 1, 2, 1, 3)])
    found = {s: events.find_events(rows, timestamp=f"2022-07-01 00:00:0{s}").count() for s in (1, 2, 3)}
    assert found == {1: 0, 2: 1, 3: 0}


def test_records_of_one_sensor_are_widened(spark):
    rows = events.assign_event_groups(records(spark, [(A, "f", 2, 4, 0, 3), (A, "f", 1, 2, 0, 3), (B, "f", 1, 1, 0, 3)]))
    samples = spark.createDataFrame(
        [("SET1", A, "f", i, at(i), 10.0 * i) for i in range(1, 6)],
        "set_name string, sensor_name string, raw_file string, row_1based bigint, timestamp_utc timestamp, value double",
    )
    collapsed, rejects = events.collapse_single_file(rows)
    for rows_per_block in (1, 2, 4096):
        sliced = joins.slice_records(collapsed, samples, rows_per_block=rows_per_block)
        assert [r.value for r in sliced.orderBy("row_1based").collect()] == [10.0, 20.0, 30.0, 40.0]
    assert rejects.count() == 0


def test_sensor_over_two_files_is_rejected(spark):
    rows = events.assign_event_groups(records(spark, [(A, "f", 1, 2, 0, 3), (A, "g", 1, 2, 0, 3), (B, "f", 1, 2, 0, 3)]))
    collapsed, rejects = events.collapse_single_file(rows)
    assert [r.sensor_name for r in collapsed.collect()] == [B]
    assert [(r.sensor_name, r.raw_file_count) for r in rejects.collect()] == [(A, 2)]


def test_exclusion_comes_last(spark):
    rows = records(spark, [(A, "f", 1, 2, 0, 3), (B, "f", 1, 2, 0, 3), (C, "f", 1, 2, 0, 3)])
    listed = spark.createDataFrame([("SET1", C, "damaged", "visit")], "set_name string, sensor_name string, reason string, source string")
    marked = events.annotate_records(rows, decks=["OLD"], exclusions=listed).orderBy("sensor_name").collect()
    assert [r.exclusion_reason for r in marked] == ["deck not selected for preprocessing", "deck not selected for preprocessing", "damaged"]
    marked = events.annotate_records(rows, acc_axis="Y", exclusions=listed).orderBy("sensor_name").collect()
    assert [r.sensor_status for r in marked] == ["included", "excluded", "excluded"]


def test_discard_reasons(spark):
    found = spark.createDataFrame([("a", 1), ("b", 3), ("c", 3)], "event_id string, active_sensor_count bigint")
    counts = spark.createDataFrame([("b", 5)], "event_id string, aligned_rows bigint")
    out = events.mark_discards(found, min_active_sensors=2, aligned_counts=counts).orderBy("event_id").collect()
    assert [r.discard_reason for r in out] == ["insufficient_active_sensors", "", "no_common_aligned_rows"]


def test_empty_set_gives_empty_tables(spark):
    rows = records(spark, [])
    grouped = events.assign_event_groups(rows, "shared_start")
    marked = events.annotate_records(grouped)
    assert events.group_events(marked).count() == 0
    assert events.exclusion_log(marked).count() == 0
    assert events.collapse_single_file(marked)[0].count() == 0


def test_names_and_patterns(spark):
    df = spark.createDataFrame([(A,), (B,), ("OLD_S1",)], "sensor_name string")
    def hits(p):
        return {r[0] for r in df.filter(naming.matches_pattern(F.col("sensor_name"), p)).collect()}

    assert hits("*inf*") == {A} and hits("acc_z") == {B} and hits("old_s?") == {"OLD_S1"} and hits("*[!x]r") == {A}
    parts = naming.sensor_parts(F.col("sensor_name"))
    assert df.select(parts["axis"]).collect()[1][0] == "Z"
    assert df.filter("sensor_name = 'OLD_S1'").select(parts["side"]).first()[0] is None
    with pytest.raises(Exception, match="unrecognised sensor name"):
        df.select(*naming.sensor_parts(F.col("sensor_name"), strict=True).values()).collect()


def test_mixed_timestamps_lose_nothing(spark):
    texts = ["2022-07-01 00:00:01.500000", "2022-07-01 00:00:02", "2022-07-01T02:00:03+02:00", "2022-07-01T00:00:04.25Z", "junk"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(times.parse_utc(F.col("t"))).collect()] == [at(1.5), at(2), at(3), at(4.25), None]
